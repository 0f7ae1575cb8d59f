"""The pipeline against plain Python, stage by stage."""

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import check_packing

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "123 456", None, "s", 7), (10**6 + 3, "of the and to in that is for with on mail jane@x.org", None, "s", 40)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name == "packing":
            check_packing(rows, [(i, r["text"]) for i, r in before.items()])
            break
        assert out.columns == columns
        got = {r["doc_id"]: r for r in rows}
        assert len(got) == len(rows)
        if name == "language_id":
            assert set(before) - set(got) == {10**6, 10**6 + 1, 10**6 + 2} and got[10**6 + 3]["lang"] == "en"
        elif name == "near_dedup":
            comps = brute.components([(i, r["text"]) for i, r in before.items()], 5)
            assert set(got) == {c for _, _, c in comps}
        elif name == "decontamination":
            full = [x for x in items if len((x[1] or "").split()) >= 8]
            assert set(got) == {i for i, r in before.items() if not brute.hits(r["text"], full)[2]}
        else:
            assert set(got) == set(before)
            for i, r in got.items():
                assert not brute.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
                if not brute.base_spans(before[i]["text"]) and "token" not in before[i]["text"] and "password" not in before[i]["text"] and "AKIA" not in before[i]["text"]:
                    assert r["text"] == before[i]["text"]
        docs, before = spark.createDataFrame(rows, docs.schema), got


def test_stages_with_odd_columns_and_no_rows(spark):
    extra = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, node long, rid long, t string, c0 string"
    rows = [(1, "the and of to in that " * 20, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, 1.0, "x", 1, 1, "t", "c"), (2, "of the and is for " * 30, "en", "s", 1, 1.0, "x", 1, 1, "t", "c")]
    for some in (rows, []):
        docs = spark.createDataFrame(some, extra)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            n = out.count()
            assert (name == "packing" or out.columns == docs.columns) and (n > 0) == bool(some)


def test_run_gives_the_last_stage(spark):
    assert "sequence_id" in corpus_pipeline.run(spark, SF).columns
