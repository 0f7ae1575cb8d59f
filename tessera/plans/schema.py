"""Schemas: flattened type trees, names, equality, declarations."""

from __future__ import annotations

from pyspark.sql import types as T

KINDS = {
    T.BooleanType: "BOOLEAN", T.ByteType: "BYTE", T.ShortType: "SHORT", T.IntegerType: "INT", T.LongType: "LONG", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE",
    T.StringType: "STRING", T.BinaryType: "BINARY", T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP", T.ArrayType: "LIST", T.MapType: "MAP", T.StructType: "STRUCT",
}


def is_union(t: T.DataType) -> bool:
    """Whether a struct stands for a tagged union."""
    return isinstance(t, T.StructType) and [f.name for f in t] == ["tag", *[f"f{i}" for i in range(len(t) - 1)]] and len(t) > 1


def kind(t: T.DataType) -> str:
    """The format's kind of a type; types it lacks are an error, not coerced."""
    if is_union(t):
        return "UNION"
    if type(t) not in KINDS:
        raise TypeError(f"the format has no {t.simpleString()}")
    return KINDS[type(t)]


def children(t: T.DataType) -> list[tuple[str, T.DataType]]:
    """Named child types."""
    if is_union(t):
        return [(f.name, f.dataType) for f in t.fields[1:]]
    if isinstance(t, T.StructType):
        return [(f.name, f.dataType) for f in t]
    if isinstance(t, T.ArrayType):
        return [("_elem", t.elementType)]
    return [("_key", t.keyType), ("_value", t.valueType)] if isinstance(t, T.MapType) else []


def type_tree(t: T.DataType) -> list[tuple[int, int, str, str]]:
    """(id, parent, path, kind) in pre-order; the root is 0 with parent -1."""
    out: list[tuple[int, int, str, str]] = []

    def walk(t: T.DataType, parent: int, path: str) -> None:
        me = len(out)
        out.append((me, parent, path, kind(t)))
        for name, c in children(t):
            walk(c, me, f"{path}.{name}" if path else name)

    walk(t, -1, "")
    return out


def type_name(t: T.DataType) -> str:
    """The type's name with unions as uniontype<...>."""
    if is_union(t):
        return f"uniontype<{','.join(type_name(c) for _, c in children(t))}>"
    if isinstance(t, T.StructType):
        return f"struct<{','.join(f'{f.name}:{type_name(f.dataType)}' for f in t)}>"
    if isinstance(t, T.ArrayType):
        return f"array<{type_name(t.elementType)}>"
    if isinstance(t, T.MapType):
        return f"map<{type_name(t.keyType)},{type_name(t.valueType)}>"
    return "timestamp" if isinstance(t, T.TimestampNTZType) else t.simpleString()


def equal(a: T.DataType, b: T.DataType) -> bool:
    """Same names and types in the same order; nullability does not matter."""
    return type_name(a) == type_name(b)


def declared(columns: str, types: str = "") -> T.StructType:
    """A schema from comma-separated column names and colon-separated types; without types all are strings."""
    names = [c for c in columns.split(",") if c]
    kinds, depth, word = [], 0, ""
    for ch in types:
        depth += (ch in "<(") - (ch in ">)")
        if ch == ":" and not depth:
            kinds.append(word)
            word = ""
        else:
            word += ch
    kinds += [word] if word else []
    kinds = kinds or ["string"] * len(names)
    if len(kinds) != len(names):
        raise ValueError(f"{len(names)} columns but {len(kinds)} types")
    return T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(names, kinds, strict=True)])


#: Streams of each kind in a stripe: (area, stream).  Dictionaries come from the encoding in force.
_STREAMS = {
    "BOOLEAN": ["DATA"], "BYTE": ["DATA"], "SHORT": ["DATA"], "INT": ["DATA"], "LONG": ["DATA"], "FLOAT": ["DATA"], "DOUBLE": ["DATA"], "STRING": ["LENGTH", "DATA"],
    "BINARY": ["LENGTH", "DATA"], "TIMESTAMP": ["DATA", "NANO_DATA"], "LIST": ["LENGTH"], "MAP": ["LENGTH"], "STRUCT": [], "UNION": ["DATA"],
}
_AREAS = {"ROW_INDEX": 0, "LENGTH_OF_DICTIONARY": 1, "DICTIONARY_DATA": 1}


def streams(t: T.DataType, dictionary: frozenset[str] = frozenset(), nulls: frozenset[str] = frozenset()) -> list[tuple[int, str, str, str]]:
    """(column id, path, stream, area) in the order in which a stripe holds them: index, dictionary, data; by column."""
    out = []
    for i, _, path, k in type_tree(t):
        names = ["ROW_INDEX"] + (["PRESENT"] if path in nulls else [])
        if path in dictionary and k in ("SHORT", "INT", "LONG"):
            names += ["DICTIONARY_DATA", "DATA"]
        elif path in dictionary and k == "STRING":
            names += ["LENGTH_OF_DICTIONARY", "DICTIONARY_DATA", "DATA"]
        else:
            names += _STREAMS[k]
        out += [(_AREAS.get(n, 2), i, r, path, n) for r, n in enumerate(names)]
    label = ("INDEX", "DICTIONARY", "DATA")
    return [(i, path, n.replace("LENGTH_OF_DICTIONARY", "LENGTH"), label[a]) for a, i, _, path, n in sorted(out)]
