"""Registry of the library's queries and of the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import bits, memory, nested, rawsize
from tessera.operators import encoding as E
from tessera.operators import scan as S
from tessera.operators import stats as A
from tessera.plans import schema as N
from tessera.plans.layout import lay_out, with_position
from tessera.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Positions of tables with a dense key.
DENSE = {"orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "pages": "page_id", "embeddings": "vec_id", "part": "p_partkey", "customer": "c_custkey"}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")
#: Stripes of the queries that look at many stripes.
SMALL = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def laid(spark: SparkSession, sf_dir: str, name: str, stripe_rows: int = 4096, stride_rows: int = 1000) -> DataFrame:
    """A table with a dense key, with position, stripe and stride."""
    return lay_out(table(spark, sf_dir, name), DENSE[name], stripe_rows, stride_rows)


def query(oracle: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return put


# --- scans ----------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def scan_full(spark, d):
    """Every row and column."""
    return table(spark, d, "orders")


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def project_columns(spark, d):
    """Columns by ordinal; only those are read."""
    return S.project_ids(table(spark, d, "orders"), [0, 5])


@query("SELECT conv_id, CAST(NULL AS BIGINT) AS turn, role, CAST(NULL AS VARCHAR) AS text FROM conversations")
def project_null_pad(spark, d):
    """Columns not chosen keep their place as NULL."""
    return S.null_padded(table(spark, d, "conversations"), [0, 2])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def project_nested(spark, d):
    """One field of a nested value."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT event_id, event_type FROM events WHERE event_id // 4096 * 4096 >= 4000 AND event_id // 4096 * 4096 < 8200")
def split_scan(spark, d):
    """Rows of the stripes that begin in a byte-range-like split."""
    return S.split(laid(spark, d, "events"), 4000, 4200, 4096).select("event_id", "event_type")


@query("SELECT event_id // 4096 AS stripe, event_id, user_id, event_type FROM events WHERE event_id // 4096 = 1")
def stripe_copy(spark, d):
    """One stripe, whole."""
    return S.split(laid(spark, d, "events"), 4096, 1, 4096).select("stripe", "event_id", "user_id", "event_type")


@query("SELECT event_id, user_id FROM events WHERE event_id >= 777")
def seek_row(spark, d):
    """Rows from a position on."""
    return S.seek(laid(spark, d, "events"), 777).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events WHERE event_id % 100 = 0")
def every_nth(spark, d):
    """Every hundredth row."""
    return laid(spark, d, "events").where("pos % 100 = 0").select("event_id", "user_id")


@query("SELECT event_id, event_id AS row_number, event_id // 4096 AS stripe, event_id % 4096 AS row_in_stripe FROM events")
def row_number(spark, d):
    """File-wide and stripe-wide row numbers."""
    return laid(spark, d, "events").select("event_id", F.col("pos").alias("row_number"), "stripe", (F.col("pos") % 4096).alias("row_in_stripe"))


@query("SELECT event_id, CAST((event_id + 1) * 1000 // (SELECT count(*) FROM events) AS BIGINT) AS per_mille FROM events")
def progress(spark, d):
    """Share of the rows read, after each row."""
    e = laid(spark, d, "events")
    n = table(spark, d, "events").agg(F.count("*").alias("n")).scalar()
    return e.select("event_id", F.floor((F.col("pos") + 1) * 1000 / n).alias("per_mille"))


@query("SELECT CAST(100 * quality AS BIGINT) AS cents, doc_id FROM labels WHERE quality IS NOT NULL")
def typed_access(spark, d):
    """Typed reads: an INT read as int, a BIGINT as bigint; anything else raises."""
    t = table(spark, d, "labels")
    return t.select((100 * S.strict(t, "quality", "int")).cast("long").alias("cents"), S.strict(t, "doc_id", "bigint").alias("doc_id"))


@query("SELECT r_regionkey AS k, r_name AS name, CAST(NULL AS BIGINT) AS added FROM region")
def schema_evolution(spark, d):
    """A table with more columns than the file: matched by position, the rest NULL."""
    return S.conform(table(spark, d, "region"), T.StructType.fromDDL("k int, name string, added bigint"))


# --- file and stripe summaries --------------------------------------------------------------------------------

_ORDER_SIZE = "8 + 8 + strlen(o_orderstatus) + 8 + 12 + strlen(o_orderpriority)"


@query(f"SELECT count(*) AS rows, CAST(sum({_ORDER_SIZE}) AS BIGINT) AS raw_size, CAST(max(o_orderkey) // 4096 + 1 AS BIGINT) AS stripes, CAST(1000 AS BIGINT) AS stride FROM orders")
def file_summary(spark, d):
    """Rows, raw size, stripes and stride of a table."""
    o = table(spark, d, "orders")
    t = lay_out(o, "o_orderkey").withColumn("_size", rawsize.row_size(o))
    return t.agg(F.count("*").alias("rows"), F.sum("_size").alias("raw_size"), (F.max("stripe") + 1).alias("stripes"), F.lit(1000).cast("long").alias("stride"))


@query(f"SELECT o_orderkey // 4096 AS stripe, min(o_orderkey) AS first_row, count(*) AS rows, CAST(sum({_ORDER_SIZE}) AS BIGINT) AS raw_size FROM orders GROUP BY 1")
def stripe_summary(spark, d):
    """Rows and raw size of each stripe."""
    o = table(spark, d, "orders")
    t = lay_out(o, "o_orderkey").withColumn("_size", rawsize.row_size(o))
    return t.groupBy("stripe").agg(F.min("pos").alias("first_row"), F.count("*").alias("rows"), F.sum("_size").alias("raw_size"))


_TREE = """VALUES (0, -1, '', 'STRUCT'), (1, 0, 'vec_id', 'LONG'), (2, 0, 'embedding', 'LIST'), (3, 2, 'embedding._elem', 'FLOAT'), (4, 0, 'label', 'INT')"""


@query(f"SELECT id, parent, path, kind FROM ({_TREE}) AS t(id, parent, path, kind)")
def type_tree(spark, d):
    """The flattened type tree of a nested table."""
    return files.literal(spark, N.type_tree(table(spark, d, "embeddings").schema), "id int, parent int, path string, kind string")


@query("""SELECT seq, column_id, path, stream, area FROM (VALUES
 (0, 0, '', 'ROW_INDEX', 'INDEX'), (1, 1, 'c_custkey', 'ROW_INDEX', 'INDEX'), (2, 2, 'c_name', 'ROW_INDEX', 'INDEX'), (3, 3, 'c_nationkey', 'ROW_INDEX', 'INDEX'), (4, 4, 'c_acctbal', 'ROW_INDEX', 'INDEX'), (5, 5, 'c_mktsegment', 'ROW_INDEX', 'INDEX'),
 (6, 3, 'c_nationkey', 'DICTIONARY_DATA', 'DICTIONARY'), (7, 5, 'c_mktsegment', 'LENGTH', 'DICTIONARY'), (8, 5, 'c_mktsegment', 'DICTIONARY_DATA', 'DICTIONARY'),
 (9, 1, 'c_custkey', 'DATA', 'DATA'), (10, 2, 'c_name', 'LENGTH', 'DATA'), (11, 2, 'c_name', 'DATA', 'DATA'), (12, 3, 'c_nationkey', 'DATA', 'DATA'), (13, 4, 'c_acctbal', 'DATA', 'DATA'), (14, 5, 'c_mktsegment', 'DATA', 'DATA')
) AS t(seq, column_id, path, stream, area)""")
def stream_layout(spark, d):
    """Order of a stripe's streams: index, dictionary, data; columns have dictionaries where the values call for them."""
    c = laid(spark, d, "customer")
    choices = [f(c, n).where("encoding = 'DICTIONARY'").select(F.lit(n).alias("n")) for f, names in ((E.numeric_choice, ("c_custkey", "c_nationkey")), (E.string_choice, ("c_name", "c_mktsegment"))) for n in names]
    chosen = {r["n"] for some in choices for r in some.limit(1).collect()}  # a name a column at most
    s = N.streams(table(spark, d, "customer").schema, dictionary=frozenset(chosen))
    return files.literal(spark, [(i, *x) for i, x in enumerate(s)], "seq int, column_id int, path string, stream string, area string")


@query("SELECT column_name, type FROM (VALUES ('str', 'string'), ('n', 'int'), ('m', 'map<string,array<int>>'), ('a', 'string'), ('b', 'string')) AS t(column_name, type)")
def schema_infer(spark, d):
    """Schemas from declarations; without types all columns are strings."""
    fields = [*N.declared("str,n,m", "string:int:map<string,array<int>>"), *N.declared("a,b")]
    return files.literal(spark, [(f.name, f.dataType.simpleString()) for f in fields], "column_name string, type string")


@query("SELECT a, b, equal FROM (VALUES ('orders', 'orders', true), ('orders', 'customer', false), ('region', 'nation', false)) AS t(a, b, equal)")
def schema_equal(spark, d):
    """Equality of schemas by names and types in order."""
    pairs = [("orders", "orders"), ("orders", "customer"), ("region", "nation")]
    return files.literal(spark, [(a, b, N.equal(table(spark, d, a).schema, table(spark, d, b).schema)) for a, b in pairs], "a string, b string, equal boolean")


@query("""SELECT name, value FROM (VALUES ('stripe_size', '1048576'), ('compress', 'SNAPPY'), ('buffer_size', '262144'), ('row_index_stride', '0'), ('create_index', 'false')) AS t(name, value)""")
def resolve_options(spark, d):
    """Layout options: table properties over configuration over defaults."""
    got = files.resolve_options({"compress": "SNAPPY", "create_index": "false"}, {"compress": "ZLIB", "stripe_size": "1048576", "row_index_stride": "5000"})
    return files.literal(spark, list(got.items()), "name string, value string")


@query("SELECT input, valid FROM (VALUES ('none', false), ('tables', true), ('missing', false)) AS t(input, valid)")
def validate_input(spark, d):
    """Readability of inputs."""
    tries = {"none": [], "tables": [f"{d}/orders.parquet", f"{d}/region.parquet"], "missing": [f"{d}/orders.parquet", f"{d}/no_such_table.parquet"]}
    return files.literal(spark, [(k, files.validate(spark, v)) for k, v in tries.items()], "input string, valid boolean")


@query("SELECT name, value FROM (VALUES ('my.meta', '0102030405'), ('clobber', '0506'), ('big', repeat('ab', 40000))) AS t(name, value)")
def user_metadata(spark, d):
    """User metadata, the last value of a name winning."""
    rows = [(0, "my.meta", bytes([1, 2, 3, 4, 5])), (1, "clobber", b"\x01"), (2, "clobber", b"\x03"), (3, "clobber", b"\x05\x06"), (4, "big", b"\xab" * 40000)]
    return files.with_metadata(files.literal(spark, rows, "seq int, name string, value binary")).select("name", F.lower(F.hex("value")).alias("value"))


# --- statistics -----------------------------------------------------------------------------------------------

_COUNTS = " UNION ALL ".join(f"SELECT '{c}' AS column, count({c}) AS value_count, count(*) - count({c}) AS null_count FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))


@query(_COUNTS)
def column_stats(spark, d):
    """Value and null counts of every column, in one pass."""
    return A.counts(table(spark, d, "orders"))


def _int_sql(c: str, t: str) -> str:
    s = f"sum(CAST({c} AS HUGEINT))"
    return f"SELECT '{c}' AS column, count({c}) AS value_count, CAST(min({c}) AS BIGINT) AS minimum, CAST(max({c}) AS BIGINT) AS maximum, CASE WHEN {s} BETWEEN -9223372036854775808 AND 9223372036854775807 THEN CAST({s} AS BIGINT) END AS total FROM {t}"


@query(" UNION ALL ".join(_int_sql(c, "lineitem") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")))
def int_stats(spark, d):
    """Integer statistics; an overflowing sum is undefined."""
    return A.integers(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column, count({c}) AS value_count, min({c}) AS minimum, max({c}) AS maximum, round(sum({c}), 2) AS total FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def double_stats(spark, d):
    """Floating-point statistics; sums to the hundredth, since their last digits depend on the order of rows."""
    return A.doubles(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_discount", "l_tax").withColumn("total", F.round("total", 2))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column, count({c}) AS value_count, min({c}) AS minimum, max({c}) AS maximum FROM documents" for c in ("text", "lang", "source")))
def string_stats(spark, d):
    """String statistics in byte order."""
    return A.strings(table(spark, d, "documents"), "text", "lang", "source")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column, count({c}) AS value_count, CAST(count(*) FILTER ({c} = 1) AS BIGINT) AS true_count, CAST(count({c}) - count(*) FILTER ({c} = 1) AS BIGINT) AS false_count FROM labels" for c in ("quality", "toxic")))
def bool_stats(spark, d):
    """Boolean statistics."""
    return A.booleans(table(spark, d, "labels"), quality=F.col("quality") == 1, toxic=F.col("toxic") == 1)


@query("SELECT event_id // 4096 AS stripe, event_id % 4096 // 1000 AS stride, count(user_id) AS n, min(user_id) AS lo, max(user_id) AS hi, CAST(sum(user_id) AS BIGINT) AS total FROM events GROUP BY 1, 2")
def stride_stats(spark, d):
    """Statistics of every stride."""
    return A.by_stride(laid(spark, d, "events"), "user_id")


@query("SELECT count(user_id) AS n, min(user_id) AS lo, max(user_id) AS hi, CAST(sum(user_id) AS BIGINT) AS total FROM events")
def stats_merge(spark, d):
    """Stride statistics merged to stripes and then to the file."""
    return A.merge(A.merge(A.by_stride(laid(spark, d, "events"), "user_id"), "stripe"))


def _text_sql(t: str, ints: tuple[str, ...], reals: tuple[str, ...], strings: tuple[str, ...], others: tuple[str, ...]) -> str:
    out = [f"SELECT '{c}' AS column, 'count: ' || count({c}) || ' min: ' || min({c}) || ' max: ' || max({c}) || ' sum: ' || sum({c}) AS stats FROM {t}" for c in ints]
    out += [f"SELECT '{c}', 'count: ' || count({c}) || ' min: ' || CAST(CAST(min({c}) AS DECIMAL(22,2)) AS VARCHAR) || ' max: ' || CAST(CAST(max({c}) AS DECIMAL(22,2)) AS VARCHAR) || ' sum: ' || CAST(CAST(round(sum({c}), 2) AS DECIMAL(22,2)) AS VARCHAR) FROM {t}" for c in reals]
    out += [f"SELECT '{c}', 'count: ' || count({c}) || ' min: ' || min({c}) || ' max: ' || max({c}) FROM {t}" for c in strings]
    return " UNION ALL ".join(out + [f"SELECT '{c}', 'count: ' || count({c}) FROM {t}" for c in others])


_TEXTS = _text_sql("orders", ("o_orderkey", "o_custkey"), ("o_totalprice",), ("o_orderstatus", "o_orderpriority"), ("o_orderdate",))


@query(_TEXTS)
def stats_text(spark, d):
    """The printed form of every column's statistics."""
    return A.texts(table(spark, d, "orders"))


@query("SELECT event_id, user_id FROM events WHERE user_id BETWEEN 10 AND 12")
def stride_prune(spark, d):
    """A range filter that skips strides by their statistics."""
    e = laid(spark, d, "events")
    return S.prune_strides(e, A.by_stride(e, "user_id"), "user_id", 10, 12).select("event_id", "user_id")


_WIDTH = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "bigint": 8, "double": 8, "timestamp_ntz": 12}
_SHAPES = {
    "region": "r_regionkey int, r_name string", "nation": "n_nationkey int, n_name string, n_regionkey int", "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double", "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string", "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint", "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string", "labels": "doc_id bigint, quality int, toxic int", "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def _raw_sql(t: str, shape: str) -> str:
    parts = [(c, _WIDTH.get(k)) for c, k in (x.split() for x in shape.split(", "))]
    size = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE {w or f'strlen({c})'} END" for c, w in parts)
    return f"SELECT '{t}' AS name, count(*) AS rows, CAST(coalesce(sum({size}), 0) AS BIGINT) AS raw_size FROM {t}"


@query(" UNION ALL ".join(_raw_sql(t, s) for t, s in _SHAPES.items()) + " UNION ALL SELECT 'embeddings', count(*), CAST(sum(8 + 4 * len(embedding) + 4) AS BIGINT) FROM embeddings")
def raw_size(spark, d):
    """Raw data size of all tables."""
    return files.merge(*[rawsize.total(table(spark, d, t)).select(F.lit(t).alias("name"), "rows", "raw_size") for t in (*TABLES, "embeddings")])


# --- encodings ------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey // 4096 AS stripe, count(*) AS rows, count(nullif(o_orderstatus, 'F')) AS present, count(*) = count(nullif(o_orderstatus, 'F')) AS suppressed FROM orders GROUP BY 1")
def null_mask(spark, d):
    """Presence masks per stripe."""
    return E.null_mask(laid(spark, d, "orders"), F.nullif(F.col("o_orderstatus"), F.lit("F")))


@query("SELECT o_custkey AS value, count(*) AS n, min(o_orderkey) AS first_pos, min(o_orderkey) % 4096 // 1000 AS first_stride FROM orders GROUP BY 1")
def int_dictionary(spark, d):
    """A file-wide integer dictionary."""
    return E.dictionary(laid(spark, d, "orders"), "o_custkey")


@query("SELECT c_mktsegment AS value, count(*) AS n, min(c_custkey) AS first_pos, min(c_custkey) % 4096 // 1000 AS first_stride FROM customer GROUP BY 1")
def string_dictionary(spark, d):
    """A file-wide string dictionary."""
    return E.dictionary(laid(spark, d, "customer"), "c_mktsegment")


_DICT = "SELECT o_orderkey // 4096 AS stripe, o_custkey AS value, count(*) AS n, min(o_orderkey) AS first_pos, min(o_orderkey) % 4096 // 1000 AS first_stride FROM orders GROUP BY 1, 2"


@query(f"""SELECT stripe, value, row_number() OVER (PARTITION BY stripe ORDER BY value) - 1 AS sorted_id, row_number() OVER (PARTITION BY stripe ORDER BY first_pos) - 1 AS inserted_id,
  row_number() OVER (PARTITION BY stripe ORDER BY CASE WHEN n > 1 THEN 1 ELSE 0 END, CASE WHEN n = 1 THEN first_stride ELSE 0 END, value) - 1 AS stride_id FROM ({_DICT})""")
def dict_order(spark, d):
    """Ids of stripe dictionaries in the three orders."""
    out = E.dictionary(laid(spark, d, "orders"), "o_custkey", "stripe")
    for mode in ("sorted", "inserted", "stride"):
        out = E.ordered(out, ["stripe"], mode).withColumnRenamed("id", f"{mode}_id")
    return out.select("stripe", "value", "sorted_id", "inserted_id", "stride_id")


@query("SELECT o_orderkey // 4096 AS stripe, o_orderkey AS pos, o_orderpriority AS value FROM orders")
def dict_roundtrip(spark, d):
    """Values to ids and back."""
    o = laid(spark, d, "orders")
    dic = E.ordered(E.dictionary(o, "o_orderpriority", "stripe"), ["stripe"])
    return E.decoded(E.encoded(o, "o_orderpriority", dic), dic)


_NUM = [("orders", "o_custkey", "o_orderkey"), ("orders", "o_orderkey", "o_orderkey"), ("events", "user_id", "event_id")]


def _num_sql(t: str, c: str, k: str, rows: int) -> str:
    return f"SELECT '{c}' AS column, {k} // {rows} AS stripe, count({c}) AS rows, count(DISTINCT {c}) AS distinct_values, CASE WHEN count({c}) > 0 AND 10 * count(DISTINCT {c}) <= 7 * count({c}) THEN 'DICTIONARY' ELSE 'DIRECT' END AS encoding FROM {t} GROUP BY 2"


@query(" UNION ALL ".join(_num_sql(t, c, k, 4096) for t, c, k in _NUM))
def encoding_choice_num(spark, d):
    """Dictionary or direct for integer columns, by stripe."""
    return files.merge(*[E.numeric_choice(laid(spark, d, t), c).select(F.lit(c).alias("column"), "stripe", "rows", "distinct_values", "encoding") for t, c, _ in _NUM])


_STR = [("customer", "c_name", "c_custkey"), ("customer", "c_mktsegment", "c_custkey"), ("orders", "o_orderpriority", "o_orderkey"), ("events", "props", "event_id"), ("part", "p_type", "p_partkey")]


def _str_sql(t: str, c: str, k: str) -> str:
    return f"""SELECT '{c}' AS column, stripe, rows, distinct_values, chars, CASE WHEN (10 * (rows - distinct_values) > 9 * rows OR chars > 20) AND 10 * (rows - distinct_values) > 2 * rows THEN 'DICTIONARY' ELSE 'DIRECT' END AS encoding
      FROM (SELECT {k} // 4096 AS stripe, count({c}) AS rows, count(DISTINCT {c}) AS distinct_values FROM {t} GROUP BY 1) JOIN
           (SELECT stripe, count(DISTINCT ch) AS chars FROM (SELECT {k} // 4096 AS stripe, unnest(string_split({c}, '')) AS ch FROM {t}) WHERE ch <> '' GROUP BY 1) USING (stripe)"""


@query(" UNION ALL ".join(_str_sql(*x) for x in _STR))
def encoding_choice_str(spark, d):
    """Dictionary or direct for string columns, by stripe, with the test of how varied the characters are."""
    return files.merge(*[E.string_choice(laid(spark, d, t), c).select(F.lit(c).alias("column"), "stripe", "rows", "distinct_values", "chars", "encoding") for t, c, _ in _STR])


@query("SELECT c_custkey // 4096 AS stripe, count(DISTINCT ch) AS chars FROM (SELECT c_custkey, unnest(string_split(c_name, '')) AS ch FROM customer) WHERE ch <> '' GROUP BY 1")
def char_entropy(spark, d):
    """Distinct characters of each stripe's dictionary."""
    return E.characters(E.dictionary(laid(spark, d, "customer"), "c_name", "stripe"), "stripe")


@query(f"""WITH c AS ({_num_sql("orders", "o_custkey", "o_orderkey", SMALL)}) SELECT a.stripe, a.stripe // 30 * 30 AS decided_at, a.encoding, b.encoding AS effective FROM c a JOIN c b ON b.stripe = a.stripe // 30 * 30""")
def encoding_carryover(spark, d):
    """The encoding in force: decided every 30 stripes."""
    return E.carried(E.numeric_choice(laid(spark, d, "orders", SMALL), "o_custkey"))


@query("SELECT o_orderkey // 4096 AS stripe, count(o_custkey) AS rows, count(DISTINCT o_custkey) AS distinct_values, 'DIRECT' AS encoding FROM orders GROUP BY 1")
def encoding_lowmem(spark, d):
    """Low memory: always direct."""
    return E.numeric_choice(laid(spark, d, "orders"), "o_custkey", E.EncodingConfig(low_memory=True))


@query("""SELECT stripe, stride, count(*) AS n_values, count(*) FILTER (c = 1) AS n_once, count(*) FILTER (c > 1) AS n_in_dictionary FROM
  (SELECT o_orderkey // 4096 AS stripe, o_orderkey % 4096 // 1000 AS stride, count(*) OVER (PARTITION BY o_orderkey // 4096, o_custkey) AS c FROM orders) GROUP BY 1, 2""")
def stride_dictionary(spark, d):
    """Values that leave a stripe's dictionary because they occur once."""
    return E.stride_dictionary(laid(spark, d, "orders"), "o_custkey")


@query("""WITH s AS (SELECT event_id // 4096 AS stripe, event_id AS pos, event_type AS value, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY event_id // 4096 ORDER BY event_id) THEN 1 ELSE 0 END AS new FROM events),
 r AS (SELECT *, sum(new) OVER (PARTITION BY stripe ORDER BY pos) AS run FROM s),
 g AS (SELECT stripe, run, min(pos) AS p, count(*) AS n, min(value) AS value FROM r GROUP BY 1, 2),
 x AS (SELECT *, unnest(range((n - 1) // 130 + 1)) AS part FROM g)
 SELECT stripe, p + part * 130 AS start_pos, value, least(130, n - part * 130) AS length, CASE WHEN least(130, n - part * 130) >= 3 THEN 'run' ELSE 'literal' END AS kind FROM x""")
def rle_runs(spark, d):
    """Runs of equal values."""
    return E.equal_runs(laid(spark, d, "events"), "event_type")


@query("""WITH p AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, toxic FROM labels)
 SELECT pos // 8 AS byte_index, CAST(sum(CASE WHEN toxic = 1 THEN CAST(pow(2, 7 - pos % 8) AS BIGINT) ELSE 0 END) AS BIGINT) AS value FROM p GROUP BY 1""")
def bit_pack(spark, d):
    """Eight flags per byte, on a table without a dense key."""
    return bits.pack_bits(with_position(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id"), F.col("toxic") == 1)


_CENTS = "CAST(round(c_acctbal * 100) AS BIGINT)"


@query(f"SELECT c_custkey, {_CENTS} AS value, xor({_CENTS} * 2, {_CENTS} >> 63) AS encoded, {_CENTS} AS decoded FROM customer")
def zigzag(spark, d):
    """Signed values as unsigned ones and back."""
    c = table(spark, d, "customer").select("c_custkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("value"))
    return c.withColumn("encoded", bits.zigzag(F.col("value"))).withColumn("decoded", bits.unzigzag(F.col("encoded")))


@query(f"SELECT bytes, count(*) AS n FROM (SELECT CASE WHEN u < 128 THEN 1 WHEN u < 16384 THEN 2 WHEN u < 2097152 THEN 3 WHEN u < 268435456 THEN 4 ELSE 5 END AS bytes FROM (SELECT xor({_CENTS} * 2, {_CENTS} >> 63) AS u FROM customer)) GROUP BY 1")
def varint_len(spark, d):
    """Sizes of variable-length integers."""
    u = bits.zigzag(F.round(F.col("c_acctbal") * 100).cast("long"))
    return table(spark, d, "customer").select(bits.varint_bytes(u).alias("bytes")).groupBy("bytes").agg(F.count("*").alias("n"))


_BASE_US = 1420070400000000  # 2015-01-01


@query(f"""WITH t AS (SELECT event_id, epoch_us(ts) AS us FROM events), n AS (SELECT event_id, us, (us % 1000000 + 1000000) % 1000000 * 1000 AS ns FROM t)
 SELECT event_id, CAST(floor((us - {_BASE_US}) / 1000000.0) AS BIGINT) AS seconds, CAST(CASE WHEN ns = 0 THEN 0 {" ".join(f"WHEN ns % {10**z} = 0 THEN ns // {10**z} * 8 + {z - 1}" for z in range(8, 1, -1))} ELSE ns * 8 END AS BIGINT) AS nanos FROM n""")
def timestamp_split(spark, d):
    """Timestamps as seconds from 2015 and scaled nanoseconds."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    seconds, nanos = bits.split_timestamp(us, _BASE_US)
    return table(spark, d, "events").select("event_id", seconds.alias("seconds"), nanos.alias("nanos"))


# --- nested values --------------------------------------------------------------------------------------------


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS size, CAST(-1 AS INTEGER) AS null_size, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[100001] AS DOUBLE) AS outside FROM embeddings")
def list_access(spark, d):
    """Sizes and elements of lists."""
    e = F.col("embedding")
    null = F.lit(None).cast("array<float>")
    return table(spark, d, "embeddings").select("vec_id", nested.list_size(e).alias("size"), nested.list_size(null).alias("null_size"), nested.list_get(e, 0).cast("double").alias("first"), nested.list_get(e, 100000).cast("double").alias("outside"))


@query("SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS idx, CAST(unnest(embedding) AS DOUBLE) AS element FROM embeddings")
def list_flatten(spark, d):
    """Elements of all lists with their place."""
    return table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("idx", "e")).select("vec_id", "idx", F.col("e").cast("double").alias("element"))


@query("SELECT vec_id, CAST(6 AS INTEGER) AS size, CAST(embedding[1] AS DOUBLE) AS e0, CAST(embedding[2] AS DOUBLE) AS e1, CAST(NULL AS DOUBLE) AS e4, CAST(7 AS DOUBLE) AS e5 FROM embeddings")
def list_update(spark, d):
    """A list cut to two elements, then set beyond its end."""
    short = nested.list_resize(F.col("embedding"), F.lit(2), T.FloatType())
    e = F.col("e")
    t = table(spark, d, "embeddings").select("vec_id", nested.list_set(short, 5, F.lit(7.0).cast("float"), T.FloatType()).alias("e"))
    return t.select("vec_id", F.size(e).alias("size"), *[F.get(e, F.lit(i)).cast("double").alias(f"e{i}") for i in (0, 1, 4, 5)])


def _props(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "map<string,int>").alias("m"))


@query("SELECT event_id, CAST(len(json_keys(props)) AS INTEGER) AS size, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(NULL AS INTEGER) AS missing FROM events")
def map_access(spark, d):
    """Sizes and values of maps."""
    m = F.col("m")
    return _props(spark, d).select("event_id", nested.map_size(m).alias("size"), nested.map_get(m, F.lit("k")).alias("k"), nested.map_get(m, F.lit("no such key")).alias("missing"))


@query("SELECT event_id, key, CAST(json_extract(props, '$.' || key) AS INTEGER) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def map_flatten(spark, d):
    """Entries of all maps."""
    return _props(spark, d).select("event_id", F.explode("m").alias("key", "value"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) + 1 AS k, CAST(5 AS INTEGER) AS added, CAST(len(json_keys(props)) AS INTEGER) AS left_after_remove FROM events")
def map_update(spark, d):
    """Entries put and removed."""
    m = F.col("m")
    put = nested.map_put(nested.map_put(m, F.lit("k"), m["k"] + 1), F.lit("new"), F.lit(5))
    return _props(spark, d).select("event_id", nested.map_get(put, F.lit("k")).alias("k"), nested.map_get(put, F.lit("new")).alias("added"), F.size(nested.map_remove(put, F.lit("new"))).alias("left_after_remove"))


def _message(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.struct(F.col("role").alias("role"), F.struct(F.col("text").alias("body"), F.length("text").alias("n")).alias("content")).alias("m"))


@query("SELECT conv_id, turn, role, CAST(length(text) AS INTEGER) AS n FROM conversations")
def nested_field(spark, d):
    """Fields of nested structs."""
    return _message(spark, d).select("conv_id", "turn", F.col("m.role").alias("role"), F.col("m.content.n").alias("n"))


@query("SELECT conv_id, turn, '{' || role || ', ' || length(text) || ', null}' AS shown FROM conversations")
def struct_text(spark, d):
    """Printed structs."""
    return _message(spark, d).select("conv_id", "turn", nested.struct_text(F.col("m.role"), F.col("m.content.n"), F.lit(None)).alias("shown"))


@query("SELECT conv_id, turn, upper(role) AS role, CAST(-1 AS INTEGER) AS n, 'x' AS added FROM conversations")
def struct_update(spark, d):
    """Fields of structs replaced and added."""
    m = F.col("m").withField("role", F.upper("m.role")).withField("content.n", F.lit(-1)).withField("extra", F.lit("x"))
    return _message(spark, d).select("conv_id", "turn", m.alias("m")).select("conv_id", "turn", F.col("m.role").alias("role"), F.col("m.content.n").alias("n"), F.col("m.extra").alias("added"))


@query("""SELECT tag, count(*) AS n, min(shown) AS least FROM (SELECT CASE WHEN user_id % 7 = 0 THEN -1 WHEN user_id % 2 = 0 THEN 0 ELSE 1 END AS tag,
  CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 2 = 0 THEN 'union(0, ' || user_id || ')' ELSE 'union(1, ' || event_type || ')' END AS shown FROM events) GROUP BY 1""")
def union_tags(spark, d):
    """Tagged unions: tags, values and printed form; a NULL union has tag -1."""
    u = nested.union_value((F.col("user_id") % 2).cast("int"), F.col("user_id"), F.col("event_type"))
    t = table(spark, d, "events").select(F.when(F.col("user_id") % 7 != 0, u).alias("u"))
    return t.select(nested.union_tag(F.col("u")).alias("tag"), nested.union_text(F.col("u"), 2).alias("shown")).groupBy("tag").agg(F.count("*").alias("n"), F.min("shown").alias("least"))


# --- files ----------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def roundtrip(spark, d):
    """Written to a columnar file with layout options and read back."""
    return files.round_trip(table(spark, d, "orders"), "orc", {"compress": "SNAPPY", "stripe_size": "1048576"})


@query("SELECT o_orderkey // 4096 AS stripe, count(*) AS rows, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders GROUP BY 1")
def merge_files(spark, d):
    """Two tables' rows in one, statistics by stripe merged from the partials of each."""
    o = laid(spark, d, "orders")
    parts = [files.round_trip(o.where(F.col("stride") % 2 == k), "parquet") for k in (0, 1)]
    partials = [A.by_stride(p, "o_custkey") for p in parts]
    return A.merge(partials[0].unionByName(partials[1]), "stripe").select("stripe", F.col("n").alias("rows"), "total")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE false")
def empty_file(spark, d):
    """A file without rows keeps its schema."""
    return files.round_trip(table(spark, d, "orders").where("false").select("o_orderkey", "o_custkey", "o_orderstatus"), "orc")


_DUMP_TYPE = "struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double,o_orderdate:timestamp,o_orderpriority:string>"


@query(f"""SELECT 'rows: ' || count(*) AS line FROM orders UNION ALL SELECT 'compression: ZLIB' UNION ALL SELECT 'type: {_DUMP_TYPE}'
 UNION ALL SELECT 'raw data size: ' || sum({_ORDER_SIZE}) FROM orders UNION ALL SELECT 'column ' || "column" || ': ' || stats FROM ({_TEXTS})
 UNION ALL SELECT 'stripe ' || stripe || ': first row ' || f || ' rows ' || n || ' raw data size ' || s FROM (SELECT o_orderkey // 4096 AS stripe, min(o_orderkey) AS f, count(*) AS n, sum({_ORDER_SIZE}) AS s FROM orders GROUP BY 1)""")
def file_dump(spark, d):
    """A readable description of a table: rows, codec, type, sizes, statistics, stripes."""
    o = table(spark, d, "orders")
    fixed = files.literal(spark, [(f"compression: {files.DEFAULTS['compress']}",), (f"type: {N.type_name(o.schema)}",)], "line string")
    size = rawsize.total(o).select(F.explode(F.array(F.concat(F.lit("rows: "), "rows"), F.concat(F.lit("raw data size: "), "raw_size"))).alias("line"))
    stats = A.texts(o).select(F.concat(F.lit("column "), "column", F.lit(": "), "stats").alias("line"))
    stripes = stripe_summary(spark, d).select(F.concat(F.lit("stripe "), "stripe", F.lit(": first row "), "first_row", F.lit(" rows "), "rows", F.lit(" raw data size "), "raw_size").alias("line"))
    return files.merge(fixed, size, stats, stripes)


@query("SELECT writers, scale FROM (VALUES (1, 1.0::DOUBLE), (2, 1.0::DOUBLE), (3, 2 / 3::DOUBLE), (4, 0.5::DOUBLE), (6, 1 / 3::DOUBLE)) AS t(writers, scale)")
def memory_scale(spark, d):
    """How requests are scaled to the pool."""
    return files.literal(spark, [(n, memory.scale(2000, [1000] * n)) for n in (1, 2, 3, 4, 6)], "writers int, scale double")


@query("SELECT round, writer, multiplier FROM (VALUES (1, 0, 1.5::DOUBLE), (1, 1, 0.5::DOUBLE), (2, 0, 1.75::DOUBLE), (2, 1, 0.25::DOUBLE), (3, 0, 0.875::DOUBLE), (3, 1, 1.125::DOUBLE)) AS t(round, writer, multiplier)")
def memory_rebalance(spark, d):
    """Memory moved from idle to needy writers, and back."""
    writers, out = [memory.Writer(100 << 20, 2), memory.Writer(100 << 20, 0)], []
    for n, flushes in ((1, (2, 0)), (2, (2, 0)), (3, (0, 2))):
        writers = memory.rebalance(1 << 30, [memory.Writer(w.requested, f, w.multiplier) for w, f in zip(writers, flushes, strict=True)])
        out += [(n, i, w.multiplier) for i, w in enumerate(writers)]
    return files.literal(spark, out, "round int, writer int, multiplier double")


from tessera.plans import stripe_queries  # noqa: E402, F401  registers its queries
