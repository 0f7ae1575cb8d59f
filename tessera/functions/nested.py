"""Access to and updates of nested values; tagged unions; value texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def list_size(c: Column) -> Column:
    """Length; -1 for NULL."""
    return F.coalesce(F.size(c), F.lit(-1)).cast("int")


def list_get(c: Column, i: int) -> Column:
    """Element, NULL outside of the list or of NULL."""
    return F.get(c, F.lit(i))


def list_set(c: Column, i: int, value: Column, element: T.DataType) -> Column:
    """The list with an element replaced, padded with NULL up to it."""
    return F.transform(list_resize(c, F.greatest(F.size(c), F.lit(i + 1)), element), lambda x, k: F.when(k == i, value).otherwise(x))


def list_resize(c: Column, n: Column, element: T.DataType) -> Column:
    """The list cut or padded with NULL to n elements."""
    return F.slice(F.concat(c, F.array_repeat(F.lit(None).cast(element), F.greatest(n - F.size(c), F.lit(0)))), F.lit(1), n)


def map_size(c: Column) -> Column:
    """Entries; -1 for NULL."""
    return F.coalesce(F.size(c), F.lit(-1)).cast("int")


def map_get(c: Column, key: Column) -> Column:
    """Value, NULL for a missing key."""
    return F.try_element_at(c, key)


def map_put(c: Column, key: Column, value: Column) -> Column:
    """The map with an entry set; independent of the session's policy on repeated keys."""
    return F.map_concat(F.map_filter(c, lambda k, _: k != key), F.create_map(key, value))


def map_remove(c: Column, key: Column) -> Column:
    """The map without a key."""
    return F.map_filter(c, lambda k, _: k != key)


def entries_get(c: Column, key: Column) -> Column:
    """Value of a key in array<struct<key, value>>, which stands for a map that may have a NULL key; the last entry wins."""
    found = F.filter(c, lambda e: e["key"].eqNullSafe(key))
    return F.get(found, F.size(found) - 1)["value"]


def union_value(tag: Column, *children: Column) -> Column:
    """A tagged union as struct<tag, f0, f1, ...>; only the chosen child is set."""
    return F.struct(tag.cast("tinyint").alias("tag"), *[F.when(tag == i, c).alias(f"f{i}") for i, c in enumerate(children)])


def union_tag(u: Column) -> Column:
    """The tag; -1 for NULL."""
    return F.coalesce(u["tag"].cast("int"), F.lit(-1))


def union_text(u: Column, n: int) -> Column:
    """``union(tag, value)``."""
    value = F.coalesce(*[F.when(u["tag"] == i, u[f"f{i}"].cast("string")) for i in range(n)], F.lit("null"))
    return F.when(u.isNotNull(), F.concat(F.lit("union("), u["tag"].cast("string"), F.lit(", "), value, F.lit(")")))


def struct_text(*fields: Column) -> Column:
    """``{a, b}``; NULL fields read ``null``."""
    return F.concat(F.lit("{"), F.concat_ws(", ", *[F.coalesce(f.cast("string"), F.lit("null")) for f in fields]), F.lit("}"))


def same_value(a: Column, b: Column) -> Column:
    """Equality of values of one type, structs, lists and unions included; NULL equals NULL."""
    return a.eqNullSafe(b)


def value_hash(c: Column) -> Column:
    """A hash that equal values share; 0 for NULL."""
    return F.when(c.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(c))
