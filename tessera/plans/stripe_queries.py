"""Queries over stripe files: tables are written by tasks, byte by byte, and read back in different ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import memory, nested
from tessera.operators import encoding as E
from tessera.operators import scan
from tessera.plans.catalogue import laid, query, table
from tessera.plans.session import fresh_path
from tessera.sources import striped as D
from tessera.sources.stripes import Options

#: Small enough for several stripes in the test tables; files of real size take the defaults.
LAYOUT = Options(stripe_rows=4096, stride=1000)


def written(spark: SparkSession, d: str, name: str, options: Options = LAYOUT, metadata: dict[str, bytes] | None = None) -> DataFrame:
    """The manifest of a test table with a dense key, written so that a stripe is 4096 keys: whole stripes go to one file."""
    rows = laid(spark, d, name, options.stripe_rows, options.stride)
    key = [c for c in rows.columns if c not in ("pos", "stripe", "stride")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "stripe").sortWithinPartitions("pos").select(*key)
    return D.write(rows, fresh_path(spark, name), options, metadata)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def stripe_round_trip(spark, d):
    """Every row and column through our own writer and reader."""
    return D.scan(written(spark, d, "orders"))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def stripe_projection(spark, d):
    """Two columns by their numbers in the type tree; only their streams are read."""
    return D.scan(written(spark, d, "orders"), ids=[1, 4])


_NESTED = """SELECT o_orderkey, struct(o_custkey AS c, struct(o_orderstatus AS s, o_totalprice AS p) AS i) AS st,
 CASE WHEN o_orderkey % 5 != 0 THEN array(o_custkey, CASE WHEN o_orderkey % 3 != 0 THEN o_orderkey END) END AS li, map(o_orderstatus, o_custkey, o_orderpriority, o_orderkey) AS m,
 CASE WHEN o_orderkey % 7 != 0 THEN struct(CAST(o_orderkey % 2 AS TINYINT) AS tag, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS f0, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS f1) END AS u FROM {o}"""


def _nested(spark: SparkSession, d: str) -> DataFrame:
    return D.write(spark.sql(_NESTED, o=table(spark, d, "orders")), fresh_path(spark, "nested"), LAYOUT)


@query("SELECT o_orderkey, o_orderstatus AS s FROM orders")
def stripe_nested_projection(spark, d):
    """One field two levels down, by its number; its neighbours' streams stay unread and its structs hold it alone."""
    out = D.scan(_nested(spark, d), ids=[1, 5])
    assert out.schema["st"].dataType.simpleString() == "struct<i:struct<s:string>>"
    return out.select("o_orderkey", F.col("st.i.s").alias("s"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 != 0 THEN o_custkey END AS first, CASE WHEN o_orderkey % 5 != 0 AND o_orderkey % 3 != 0 THEN o_orderkey END AS second,
 o_custkey AS by_status, CASE WHEN o_orderkey % 7 != 0 THEN CAST(o_orderkey % 2 AS TINYINT) END AS tag, CASE WHEN o_orderkey % 7 != 0 AND o_orderkey % 2 = 0 THEN o_custkey END AS f0,
 CASE WHEN o_orderkey % 7 != 0 AND o_orderkey % 2 = 1 THEN o_orderpriority END AS f1 FROM orders""")
def stripe_nested_values(spark, d):
    """Lists, maps and unions with nulls through the writer and reader; a map's key is the status that was read with it."""
    t = D.scan(_nested(spark, d))
    return t.select("o_orderkey", F.get("li", F.lit(0)).alias("first"), F.get("li", F.lit(1)).alias("second"), F.try_element_at("m", F.col("st.i.s")).alias("by_status"), F.col("u.tag").alias("tag"), F.col("u.f0").alias("f0"), F.col("u.f1").alias("f1"))


@query("""SELECT o_orderkey, o_orderkey % 3 = 0 AS b, CAST(o_orderkey % 100 AS TINYINT) AS y, CAST(o_orderkey % 30000 AS SMALLINT) AS s, CAST(o_custkey AS INTEGER) AS i, o_custkey * 1000003 AS l,
 CAST(o_orderkey AS FLOAT) / 4 AS f, o_totalprice AS x, o_orderpriority AS t, hex(encode(o_orderstatus)) AS n, o_orderdate AS ts, CAST(o_orderdate AS DATE) AS dt FROM orders WHERE o_orderkey % 4 <> 1
 UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 4 = 1""")
def stripe_all_types(spark, d):
    """A column of each primitive type with nulls; ids as dictionaries of integers, values that occur once in line."""
    rows = _typed(spark, d)
    got = D.scan(D.write(rows, fresh_path(spark, "types"), Options(stripe_rows=4096, stride=1000, codec="ZSTD", int_dictionary=0.7, once_in_line=True)))
    return got.withColumn("n", F.hex("n"))


def _typed(spark: SparkSession, d: str) -> DataFrame:
    """A column of each primitive type; every fourth row is NULL but for its key."""
    rows = spark.sql(
        """SELECT o_orderkey, o_orderkey % 3 = 0 AS b, CAST(o_orderkey % 100 AS TINYINT) AS y, CAST(o_orderkey % 30000 AS SMALLINT) AS s, CAST(o_custkey AS INT) AS i, o_custkey * 1000003 AS l,
        CAST(o_orderkey / 4 AS FLOAT) AS f, o_totalprice AS x, o_orderpriority AS t, CAST(o_orderstatus AS BINARY) AS n, o_orderdate AS ts, CAST(o_orderdate AS DATE) AS dt FROM {o}""",
        o=table(spark, d, "orders"),
    )
    return rows.select("o_orderkey", *[F.when(F.col("o_orderkey") % 4 != 1, F.col(c)).alias(c) for c in rows.columns[1:]])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def stripe_splits(spark, d):
    """The rows of all byte ranges of the files: each stripe belongs to the range in which it begins, so to one only."""
    files = written(spark, d, "orders")
    step = (files.agg(F.max("bytes").alias("n")).first()["n"] or 1) // 3 + 1
    parts = [D.scan(files, ids=[1, 2, 4], split=(k * step, step)) for k in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT o_orderkey AS pos, o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 1200")
def stripe_seek(spark, d):
    """Rows from a position of the table on; stripes before it aren't read."""
    return D.scan(written(spark, d, "orders"), ids=[1, 2], seek=1200, positions=True)


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey BETWEEN 700 AND 5500")
def stripe_prune(spark, d):
    """A range of values: the index of each stripe says which strides can hold it, the others aren't decoded."""
    return D.scan(written(spark, d, "orders"), ids=[1, 6], where=("o_orderkey", 700, 5500))


@query("SELECT name, kind, n, low_integer, high_integer, sum_integer, low_double, high_double, round(sum_double, 2) AS sum_double, low_string, high_string FROM (" + " UNION ALL ".join([
    "SELECT '' AS name, 'STRUCT' AS kind, count(*) AS n, NULL::BIGINT AS low_integer, NULL::BIGINT AS high_integer, NULL::BIGINT AS sum_integer, NULL::DOUBLE AS low_double, NULL::DOUBLE AS high_double, NULL::DOUBLE AS sum_double, NULL::VARCHAR AS low_string, NULL::VARCHAR AS high_string FROM orders",
    *[f"SELECT '{c}', 'LONG', count({c}), min({c}), max({c}), CAST(sum({c}) AS BIGINT), NULL, NULL, NULL, NULL, NULL FROM orders" for c in ("o_orderkey", "o_custkey")],
    *[f"SELECT '{c}', 'STRING', count({c}), NULL, NULL, NULL, NULL, NULL, NULL, min({c}), max({c}) FROM orders" for c in ("o_orderstatus", "o_orderpriority")],
    "SELECT 'o_totalprice', 'DOUBLE', count(o_totalprice), NULL, NULL, NULL, min(o_totalprice), max(o_totalprice), sum(o_totalprice), NULL, NULL FROM orders",
    "SELECT 'o_orderdate', 'TIMESTAMP', count(o_orderdate), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM orders",
]) + ")")
def footer_stats(spark, d):
    """Statistics of all columns, from the files' footers only, merged over files."""
    s = D.merge_stats(D.file_stats(written(spark, d, "orders")))
    return s.select("name", "kind", "n", "low_integer", "high_integer", "sum_integer", "low_double", "high_double", F.round("sum_double", 2).alias("sum_double"), "low_string", "high_string")


@query("SELECT o_orderkey // 4096 AS stripe, o_orderkey % 4096 // 1000 AS stride, count(*) AS n, min(o_custkey) AS lo, max(o_custkey) AS hi, CAST(sum(o_custkey) AS BIGINT) AS total, min(o_orderpriority) AS first, max(o_orderpriority) AS last FROM orders GROUP BY 1, 2")
def index_stats(spark, d):
    """Statistics by stripe and stride, of integers and strings, from the files' indexes only."""
    s = D.stride_stats(written(spark, d, "orders"), "o_orderkey", "o_custkey", "o_orderpriority")
    pick = lambda name, c: F.max(F.when(F.col("name") == name, F.col(c)))
    s = s.groupBy("path", "stripe", "stride").agg(pick("o_orderkey", "low_integer").alias("key"), F.max("n").alias("n"), pick("o_custkey", "low_integer").alias("lo"), pick("o_custkey", "high_integer").alias("hi"), pick("o_custkey", "sum_integer").alias("total"), pick("o_orderpriority", "low_string").alias("first"), pick("o_orderpriority", "high_string").alias("last"))
    return s.select(F.expr("key div 4096").alias("stripe"), "stride", "n", "lo", "hi", "total", "first", "last")


@query("SELECT o_orderkey // 4096 AS stripe, count(*) AS rows, CAST(sum(8 + 8 + strlen(o_orderstatus) + 8 + 12 + strlen(o_orderpriority)) AS BIGINT) AS raw_size FROM orders GROUP BY 1")
def footer_stripes(spark, d):
    """Rows and raw size of each stripe, from the footers."""
    files = written(spark, d, "orders")
    keys = D.stride_stats(files, "o_orderkey").groupBy("path", "stripe").agg(F.min("low_integer").alias("key"))
    return D.stripe_list(files).join(keys, ["path", "stripe"]).select(F.expr("key div 4096").alias("stripe"), "rows", "raw_size")


_STREAMS_SQL = """WITH s AS (SELECT o_orderkey // 4096 AS k, count(*) AS n, count(DISTINCT o_orderstatus) AS a, count(DISTINCT o_orderpriority) AS b, count(DISTINCT o_orderdate) AS t FROM orders GROUP BY 1),
 c AS (SELECT * FROM (VALUES (0, '', 'STRUCT'), (1, 'o_orderkey', 'LONG'), (2, 'o_custkey', 'LONG'), (3, 'o_orderstatus', 'STRING'), (4, 'o_totalprice', 'DOUBLE'), (5, 'o_orderdate', 'TIMESTAMP'), (6, 'o_orderpriority', 'STRING')) AS v(id, name, kind)),
 e AS (SELECT k, id, name, kind, kind = 'STRING' AND 10 * (CASE WHEN id = 3 THEN a ELSE b END) <= 8 * n AS dict, CASE WHEN id = 3 THEN a ELSE b END AS size FROM s, c),
 x AS (SELECT *, unnest(['ROW_INDEX'] || CASE WHEN kind = 'STRUCT' THEN [] WHEN dict THEN ['DICTIONARY_DATA', 'LENGTH', 'DATA'] WHEN kind = 'STRING' THEN ['DATA', 'LENGTH'] WHEN kind = 'TIMESTAMP' THEN ['DATA', 'SECONDARY'] ELSE ['DATA'] END) AS stream FROM e)
SELECT name, stream, CASE WHEN dict THEN 'DICTIONARY' ELSE 'DIRECT' END AS encoding, count(*) AS stripes, CAST(sum(CASE WHEN dict THEN size ELSE 0 END) AS BIGINT) AS entries FROM x GROUP BY 1, 2, 3"""


@query(_STREAMS_SQL)
def footer_streams(spark, d):
    """Which streams and encodings the stripes have, from the stripes' footers; the writer chose them by the values."""
    s = D.stream_list(written(spark, d, "orders"))
    return s.groupBy("name", "stream", "encoding").agg(F.count("*").alias("stripes"), F.sum("dictionary_size").alias("entries"))


@query("SELECT name, value FROM (VALUES ('empty', ''), ('made by', 'a later value'), ('key', 'o_orderkey')) AS t(name, value)")
def footer_metadata(spark, d):
    """User metadata stored in the files' footers; every file has it all."""
    files = written(spark, d, "orders", metadata={"made by": b"a value"} | {"made by": b"a later value", "key": b"o_orderkey", "empty": b""})
    return D.file_list(files).select(F.explode("metadata").alias("name", "value")).select("name", F.col("value").cast("string").alias("value")).distinct()


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def stripe_concatenate(spark, d):
    """Files joined to fewer: stripes are copied as bytes."""
    return D.scan(D.concatenate(written(spark, d, "orders"), fresh_path(spark, "joined"), per_file=3))


@query("SELECT count(*) AS n, min(o_custkey) AS lo, max(o_custkey) AS hi, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders")
def concatenated_stats(spark, d):
    """Statistics of joined files: merged from those of their parts, without reading a row."""
    files = D.concatenate(written(spark, d, "orders"), fresh_path(spark, "joined"), per_file=3)
    return D.merge_stats(D.file_stats(files)).where("name = 'o_custkey'").select("n", F.col("low_integer").alias("lo"), F.col("high_integer").alias("hi"), F.col("sum_integer").alias("total"))


@query("SELECT o_orderkey // 4096 AS stripe, count(*) AS rows FROM orders GROUP BY 1")
def stripe_bytes(spark, d):
    """Stripes as bytes, a row each; the rows are counted by decoding the bytes' own footer length against the list."""
    files = written(spark, d, "orders")
    keys = D.stride_stats(files, "o_orderkey").groupBy("path", "stripe").agg(F.min("low_integer").alias("key"))
    sizes = D.stripe_list(files).select("path", "stripe", (F.col("index_bytes") + F.col("data_bytes") + F.col("footer_bytes")).alias("size"))
    raw = D.raw_stripes(files).join(sizes, ["path", "stripe"]).where(F.octet_length("content") == F.col("size"))
    return raw.join(keys, ["path", "stripe"]).select(F.expr("key div 4096").alias("stripe"), "rows")


@query("SELECT what, good FROM (VALUES ('none', false), ('all', true), ('one damaged', false)) AS t(what, good)")
def stripe_validate(spark, d):
    """No files, good files, and good files with one that is cut off: each file's own tail is read."""
    files = [r["path"] for r in written(spark, d, "customer").select("path").collect()]  # a row a file
    bad = fresh_path(spark, "damaged")
    spark.range(1, numPartitions=1).selectExpr("'ORC and no more' AS value").write.text(bad)
    damaged = [r["p"] for r in spark.read.text(bad).select(F.input_file_name().alias("p")).distinct().collect()]
    rows = [("none", D.validate(spark, [])), ("all", D.validate(spark, files)), ("one damaged", D.validate(spark, [*files, *damaged]))]
    return spark.createDataFrame(rows, "what string, good boolean")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE false")
def stripe_empty(spark, d):
    """A table without rows: one valid file with its schema."""
    return D.scan(D.write(table(spark, d, "orders").where("false"), fresh_path(spark, "empty"), LAYOUT))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def stripe_read_by_others(spark, d):
    """Our files read by Spark's own reader of the public format."""
    files = written(spark, d, "orders", Options(stripe_rows=4096, stride=1000, codec="SNAPPY"))
    return spark.read.schema("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double").orc(files.select("path").first()["path"].rsplit("/", 1)[0] + "/*.orc")


_RUNS_SQL = """WITH RECURSIVE v AS (SELECT o_orderkey // 4096 AS stripe, o_orderkey AS pos, o_custkey AS x, lead(o_custkey) OVER w - o_custkey AS d FROM orders WINDOW w AS (PARTITION BY o_orderkey // 4096 ORDER BY o_orderkey)),
 a AS (SELECT *, coalesce(d BETWEEN -128 AND 127 AND lead(d) OVER w = d, false) AS run, CASE WHEN d IS DISTINCT FROM lag(d) OVER w OR NOT coalesce(d BETWEEN -128 AND 127, false) THEN 1 ELSE 0 END AS new FROM v WINDOW w AS (PARTITION BY stripe ORDER BY pos)),
 b AS (SELECT *, sum(new) OVER (PARTITION BY stripe ORDER BY pos) AS g, max(pos) OVER (PARTITION BY stripe) + 1 AS stop, min(CASE WHEN run THEN pos END) OVER (PARTITION BY stripe ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next FROM a),
 c AS (SELECT stripe, pos, x, d, run, max(pos) OVER (PARTITION BY stripe, g) + 2 AS last, CASE WHEN run THEN NULL ELSE least(128, coalesce(next, stop) - pos) END AS literal FROM b),
 e AS (SELECT stripe, pos, x, CASE WHEN run THEN d END AS delta, run, CASE WHEN run THEN least(130, last - pos) ELSE literal END AS length FROM c),
 r AS (SELECT stripe, pos, x, delta, run, length FROM e WHERE pos % 4096 = 0 UNION ALL SELECT e.stripe, e.pos, e.x, e.delta, e.run, e.length FROM r JOIN e ON e.stripe = r.stripe AND e.pos = r.pos + r.length)
SELECT stripe, pos AS start_pos, x AS value, delta, length, CASE WHEN run THEN 'run' ELSE 'literal' END AS kind FROM r"""


@query(_RUNS_SQL)
def rle_delta_runs(spark, d):
    """The runs and literals that the integer code of each stripe consists of."""
    return E.coded_runs(laid(spark, d, "orders"), "o_custkey")


@query("""SELECT o_orderkey % 3 = 0 AS b, CAST(o_orderkey % 100 AS TINYINT) AS y, CAST(o_orderkey % 30000 AS SMALLINT) AS s, CAST(o_custkey AS INTEGER) AS i, o_custkey * 1000003 AS l,
 CAST(o_orderkey AS FLOAT) / 4 AS f, o_totalprice AS x, o_orderpriority AS t, hex(encode(o_orderstatus)) AS n, o_orderdate AS ts FROM orders WHERE o_orderkey % 4 <> 1""")
def typed_access_all(spark, d):
    """Values of the ten primitive types, each read as its own type only, where there is a value."""
    t = _typed(spark, d).where("b IS NOT NULL")
    kinds = {"b": "boolean", "y": "tinyint", "s": "smallint", "i": "int", "l": "bigint", "f": "float", "x": "double", "t": "string", "n": "binary", "ts": "timestamp_ntz"}
    return t.select(*[scan.strict(t, c, k).alias(c) for c, k in kinds.items()]).withColumn("n", F.hex("n"))


@query("SELECT 'ZLIB' AS codec, 262144::BIGINT AS block, 10000::BIGINT AS stride, CAST(count(*) AS BIGINT) AS rows, CAST(sum(8 + strlen(c_name) + 4 + 8 + strlen(c_mktsegment)) AS BIGINT) AS raw_size, 'struct<c_custkey:bigint,c_name:string,c_nationkey:int,c_acctbal:double,c_mktsegment:string>' AS type, true AS has_content FROM customer")
def footer_summary(spark, d):
    """What footers say of a table that a sink wrote with its own defaults, whatever the session's settings are."""
    f = D.file_list(D.write(table(spark, d, "customer"), fresh_path(spark, "customer")))
    return f.groupBy("codec", "block", "stride", "type").agg(F.sum("rows").alias("rows"), F.sum("raw_size").alias("raw_size"), F.bool_and(F.col("content") > 0).alias("has_content"))


@query("""SELECT unnest(['Compression: SNAPPY', 'Compression size: 65536', 'Stride: 1000', 'Rows: ' || count(*), 'Raw data size: ' || CAST(sum(8 + strlen(c_name) + 4 + 8 + strlen(c_mktsegment)) AS BIGINT), 'Metadata made by: 2 bytes',
 'Type: struct<c_custkey:bigint,c_name:string,c_nationkey:int,c_acctbal:double,c_mktsegment:string>', 'Column 0 count: ' || count(*), 'Column 1 c_custkey count: ' || count(*) || ' min: ' || min(c_custkey) || ' max: ' || max(c_custkey) || ' sum: ' || CAST(sum(c_custkey) AS BIGINT),
 'Column 2 c_name count: ' || count(*) || ' min: ' || min(c_name) || ' max: ' || max(c_name), 'Column 3 c_nationkey count: ' || count(*) || ' min: ' || min(c_nationkey) || ' max: ' || max(c_nationkey) || ' sum: ' || CAST(sum(c_nationkey) AS BIGINT),
 'Column 5 c_mktsegment count: ' || count(*) || ' min: ' || min(c_mktsegment) || ' max: ' || max(c_mktsegment)]) AS text FROM customer""")
def footer_dump(spark, d):
    """The dump of one file, but for the lines that hold places in it and a sum of doubles."""
    files = D.write(table(spark, d, "customer").coalesce(1), fresh_path(spark, "customer"), Options(codec="SNAPPY", block=65536, stride=1000), {"made by": b"us"})
    return D.dump(files).where("NOT text RLIKE '^(Stripe|Stream|Encoding|Column 4)'").select("text")


@query("""SELECT a.o_orderkey, a.o_orderstatus = b.o_orderstatus AND a.o_custkey % 3 = b.o_custkey % 3 AS same, a.o_orderstatus = b.o_orderstatus AND a.o_custkey % 3 = b.o_custkey % 3 AS same_hash, CAST(0 AS BIGINT) AS null_hash
 FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1""")
def struct_equal(spark, d):
    """Structs of neighbouring rows: equal in value, and then in hash; the hash of NULL is 0."""
    o = table(spark, d, "orders").select("o_orderkey", F.struct("o_orderstatus", F.struct(F.col("o_custkey") % 3, F.lit(None).cast("string")).alias("inner")).alias("v"))
    b = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("v").alias("w"))
    return o.join(b, "o_orderkey").select("o_orderkey", nested.same_value(F.col("v"), F.col("w")).alias("same"), (nested.value_hash(F.col("v")) == nested.value_hash(F.col("w"))).alias("same_hash"), nested.value_hash(F.lit(None).cast("string")).alias("null_hash"))


@query("SELECT doc_id, n_chars > 600 OR length(lang) > 2 AS flush FROM documents WHERE n_chars IS NOT NULL AND lang IS NOT NULL")
def memory_flush(spark, d):
    """The writer's rule to flush: more in memory than its share of a stripe, or a dictionary over its cap."""
    t = table(spark, d, "documents").where("n_chars IS NOT NULL AND lang IS NOT NULL")
    return t.select("doc_id", memory.flush_rule(F.col("n_chars"), 2000, 0.6, 0.5, F.length("lang"), 2).alias("flush"))


@query("""WITH c AS (SELECT o_orderkey // 256 AS stripe, CASE WHEN (o_orderkey // 256) % 4 <> 1 AND o_orderkey >= 1024 THEN o_custkey END AS v FROM orders),
 s AS (SELECT stripe, count(v) AS n, count(DISTINCT v) AS k FROM c GROUP BY 1), e AS (SELECT stripe, CASE WHEN n = 0 THEN NULL WHEN 10 * k <= 7 * n THEN 'DICTIONARY' ELSE 'DIRECT' END AS encoding FROM s),
 d AS (SELECT stripe, coalesce(last_value(encoding IGNORE NULLS) OVER (ORDER BY stripe), 'DIRECT') AS effective FROM e WHERE stripe % 3 = 0)
 SELECT e.stripe, e.stripe // 3 * 3 AS decided_at, encoding, effective FROM e JOIN d ON d.stripe = e.stripe // 3 * 3""")
def encoding_carryover_nulls(spark, d):
    """Decisions every three stripes, where some have no values: the one before stays in force."""
    o = laid(spark, d, "orders", 256).withColumn("v", F.when((F.col("stripe") % 4 != 1) & (F.col("pos") >= 1024), F.col("o_custkey")))
    c = E.numeric_choice(o, "v").withColumn("encoding", F.when(F.col("rows") > 0, F.col("encoding")))
    return E.carried(c, E.EncodingConfig(interval=3))
