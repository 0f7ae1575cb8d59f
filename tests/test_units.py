"""Units: dictionaries, statistics, memory, codes, schemas, nested values, files."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import bits, memory, nested, rawsize
from tessera.operators import encoding as E
from tessera.operators import scan as S
from tessera.operators import stats as A
from tessera.plans import schema as N
from tessera.plans.layout import lay_out, with_position
from tessera.sources import files

WORDS = ["owen", "ashutosh", "owen", "alan", "alan", "ashutosh", "greg", "eric", "arun", "eric14", "o", "ziggy", "z"]


def words(spark, stride):
    rows = [(i, stride(i), 0, w) for i, w in enumerate(WORDS)]
    return spark.createDataFrame(rows, "pos long, stride long, stripe long, w string")


def order(spark, stride, mode):
    d = E.ordered(E.dictionary(words(spark, stride), "w", "stripe"), ["stripe"], mode)
    return [r["value"] for r in d.orderBy("id").collect()]


def test_dictionary_orders(spark):
    assert order(spark, lambda i: 0, "sorted") == ["alan", "arun", "ashutosh", "eric", "eric14", "greg", "o", "owen", "z", "ziggy"]
    assert order(spark, lambda i: 0, "stride") == ["arun", "eric", "eric14", "greg", "o", "z", "ziggy", "alan", "ashutosh", "owen"]
    assert order(spark, lambda i: i % 3, "stride") == ["eric14", "greg", "z", "eric", "o", "arun", "ziggy", "alan", "ashutosh", "owen"]
    assert order(spark, lambda i: 0, "inserted")[:3] == ["owen", "ashutosh", "alan"]


def test_statistics_text_and_overflow(spark):
    big = 2**63 - 1
    df = spark.createDataFrame([(False, 1024, big, -15.0, "hi", None), (True, 2048, big, -5.0, "bye", b"x")], "b boolean, s smallint, l bigint, d double, t string, bin binary")
    got = {r["column"]: r["stats"] for r in A.texts(df).collect()}
    assert got == {
        "b": "count: 2 true: 1", "s": "count: 2 min: 1024 max: 2048 sum: 3072", "l": f"count: 2 min: {big} max: {big}",
        "d": "count: 2 min: -15.00 max: -5.00 sum: -20.00", "t": "count: 2 min: bye max: hi", "bin": "count: 1",
    }


def test_merge_keeps_undefined_totals(spark):
    p = spark.createDataFrame([(2, 1, 5, 6), (1, 9, 9, None), (0, None, None, None)], "n long, lo long, hi long, total long")
    assert A.merge(p).first().asDict() == {"n": 3, "lo": 1, "hi": 9, "total": None}
    assert A.merge(p.where("lo <=> 1 OR n = 0")).first()["total"] == 6


def test_memory():
    assert memory.scale(1000, [500, 500]) == 1 and memory.scale(1000, [1000, 1000]) == 0.5
    w = [memory.Writer(100 << 20, f) for f in (2, 0)]
    w = memory.rebalance(1 << 30, w)
    assert [x.multiplier for x in w] == [1.5, 0.5]
    tiny = memory.rebalance(1 << 30, [memory.Writer(100, 2), memory.Writer(100, 0)])
    assert [x.multiplier for x in tiny] == [1.0, 1.0]
    assert memory.must_flush(101, 100, 1.0, 1.0) and not memory.must_flush(100, 100, 1.0, 1.0) and memory.must_flush(0, 100, 1, 1, 5, 4)
    assert memory.starts_low(100, [100], 100, 50) and not memory.starts_low(1000, [], 100, 50)


@pytest.mark.parametrize("seed", range(6))
def test_byte_runs_round_trip(seed):
    r = random.Random(seed)
    values = [r.choice([0, 7, 255]) for _ in range(r.randint(0, 900)) for _ in range(r.choice([1, 1, 4, 200]))]
    assert E.byte_values(E.byte_runs(values)) == values
    assert E.byte_runs([5] * 130) == bytes([127, 5]) and E.byte_runs([1, 2]) == bytes([254, 1, 2]) and E.byte_runs([]) == b""


@pytest.mark.parametrize("seed", range(4))
def test_integer_runs_round_trip(seed):
    r = random.Random(seed)
    values, at = [], 0
    for _ in range(200):
        step = r.choice([0, 1, -128, 127, 128, r.randrange(-(2**62), 2**62)])
        for _ in range(r.choice([1, 2, 5, 140])):
            at = max(-(2**63), min(2**63 - 1, at + step))
            values.append(at)
    assert E.integer_values(E.integer_runs(values)) == values
    assert E.integer_runs([7] * 100, signed=False) == bytes([97, 0, 7]) and E.integer_runs([1, 2, 3], signed=False) == bytes([0, 1, 1])
    assert E.integer_values(E.integer_runs([2, 3, 6, 7, 11], signed=False), signed=False) == [2, 3, 6, 7, 11]


def test_entries_with_a_null_key(spark):
    df = spark.sql("SELECT array(struct(CAST(NULL AS STRING) AS key, 1 AS value), struct('a' AS key, 2 AS value), struct('a' AS key, 3 AS value)) AS m")
    assert tuple(df.select(nested.entries_get(F.col("m"), F.lit(None).cast("string")), nested.entries_get(F.col("m"), F.lit("a")), nested.entries_get(F.col("m"), F.lit("z"))).first()) == (1, 3, None)


def test_zigzag_edges(spark):
    v = [0, -1, 1, -2, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(x,) for x in v], "v long").withColumn("z", bits.zigzag(F.col("v")))
    got = df.select("v", "z", bits.unzigzag(F.col("z")).alias("u"), bits.varint_bytes(F.col("z")).alias("n")).collect()
    assert [r["u"] for r in got] == v and [r["z"] for r in got][:4] == [0, 1, 2, 3]
    assert [r["n"] for r in got] == [1, 1, 1, 1, 10, 10]


def test_runs_are_cut_and_cover_all_rows(spark):
    df = lay_out(spark.range(1000).withColumn("v", F.when(F.col("id") < 500, 1).otherwise(F.col("id") % 2)), "id", 4096, 1000)
    runs = E.equal_runs(df, "v").collect()
    assert sum(r["length"] for r in runs) == 1000 and max(r["length"] for r in runs) == 130
    d = E.coded_runs(spark.range(300).withColumn("pos", F.col("id")).withColumn("stripe", F.col("id") * 0).withColumn("v", F.when(F.col("id") < 200, F.col("id")).otherwise(F.col("id") * F.col("id"))), "v").orderBy("start_pos").collect()
    assert [(r["start_pos"], r["value"], r["delta"], r["length"], r["kind"]) for r in d] == [(0, 0, 1, 130, "run"), (130, 130, 1, 70, "run"), (200, 40000, None, 100, "literal")]


def test_positions_without_a_key(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(3).sample(range(10**6), 500)], "k long")
    got = with_position(df, "k").orderBy("k").collect()
    assert [r["pos"] for r in got] == list(range(500))


def test_strides_below_the_minimum(spark):
    with pytest.raises(ValueError):
        lay_out(spark.range(1), "id", 4096, 10)
    assert lay_out(spark.range(5000), "id", 4096, 0).select("stride").distinct().count() == 1


def test_schema_tree_names_and_declarations():
    u = T.StructType.fromDDL("time timestamp_ntz, u struct<tag:tinyint,f0:int,f1:string>, m map<string,array<int>>")
    assert N.type_name(u) == "struct<time:timestamp,u:uniontype<int,string>,m:map<string,array<int>>>"
    assert [x[3] for x in N.type_tree(u)] == ["STRUCT", "TIMESTAMP", "UNION", "INT", "STRING", "MAP", "STRING", "LIST", "INT"]
    assert N.declared("a,b", "int:map<string,int>").simpleString() == "struct<a:int,b:map<string,int>>"
    with pytest.raises(ValueError):
        N.declared("a,b", "int")
    with pytest.raises(TypeError):
        N.kind(T.DateType())


def test_nested_access_of_null_and_missing(spark):
    df = spark.createDataFrame([([1, 2], {"a": 1}), (None, None)], "l array<int>, m map<string,int>")
    got = df.select(nested.list_size(F.col("l")), nested.list_get(F.col("l"), 9), nested.map_size(F.col("m")), nested.map_get(F.col("m"), F.lit("z")), nested.list_set(F.col("l"), 3, F.lit(9), T.IntegerType())).collect()
    assert tuple(got[0]) == (2, None, 1, None, [1, 2, None, 9]) and tuple(got[1])[:4] == (-1, None, -1, None)


def test_raw_size_of_nested_rows(spark):
    df = spark.createDataFrame([(1, "é", [1.0, None], {"ab": 5}, (1, None, "xyz")), (None, None, None, None, None)], "a int, s string, l array<double>, m map<string,int>, u struct<tag:tinyint,f0:int,f1:string>")
    sizes = [r[0] for r in df.select(rawsize.row_size(df)).collect()]
    assert sizes == [4 + 2 + (8 + 1) + (2 + 4) + (1 + 3), 5]


def test_strict_access(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    with pytest.raises(TypeError):
        S.strict(df, "x", "bigint")
    with pytest.raises(Exception, match="no value"):
        df.select(S.strict(df, "x", "int")).collect()


def test_files(spark, tmp_path):
    df = spark.range(10).withColumn("s", F.lit("x"))
    assert files.round_trip(df.where("false")).schema.names == ["id", "s"]
    files.write(df, str(tmp_path / "t"), "orc")
    assert files.open_table(spark, str(tmp_path / "t")).count() == 10
    assert files.validate(spark, [str(tmp_path / "t")], "orc") and not files.validate(spark, []) and not files.validate(spark, [str(tmp_path / "none")], "orc")
    (tmp_path / "bad.orc").write_text("hello world, no table here")
    with pytest.raises(files.NotReadableError):
        files.open_table(spark, str(tmp_path / "bad.orc"))
    with pytest.raises(KeyError):
        files.metadata_value(files.literal(spark, [("a", b"1")], "name string, value binary"), "unknown")
    with pytest.raises(ValueError):
        files.resolve_options({"compress": "BROTLI9"}, {})


def test_null_padding_and_evolution(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    assert tuple(S.null_padded(df, [1]).first()) == (None, "a")
    assert tuple(S.conform(df, T.StructType.fromDDL("p bigint, q string, r double")).first()) == (1, "a", None)
    with pytest.raises(ValueError):
        S.seek(df.withColumn("pos", F.lit(0)), -1)


def test_string_choice_edges(spark):
    rows = [(i, i // 1000, 0, None if i < 1000 else ("a" if i % 2 else "b")) for i in range(2000)]
    df = spark.createDataFrame(rows, "pos long, stripe long, stride long, s string")
    got = {r["stripe"]: r["encoding"] for r in E.string_choice(df, "s").collect()}
    assert got == {0: None, 1: "DICTIONARY"}


def test_sums_of_doubles_keep_small_and_large_values(spark):
    df = spark.createDataFrame([(0.004, 1e300), (0.004, 1.0), (0.004, None)], "a double, b double")
    got = {r["column"]: r for r in A.doubles(df, "a", "b").collect()}
    assert abs(got["a"]["total"] - 0.012) < 1e-12 and got["b"]["total"] == 1e300 and got["b"]["value_count"] == 2
    text = {r["column"]: r["stats"] for r in A.texts(df).collect()}
    assert text["a"] == "count: 3 min: 0.004 max: 0.004 sum: 0.01" and text["b"] == "count: 2 min: 1.00 max: 1.0E300 sum: 1.0E300"
