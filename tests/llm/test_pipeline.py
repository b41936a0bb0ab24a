import brute

import corpus_pipeline as P
from tidemark.llm.resample import resample
from tidemark.llm.scratch import settle


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kinds = docs.dtypes
    chosen = {r.doc_id for r in resample(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("selected").collect()}
    one = settle(P.quality(spark, docs, sf))
    assert {r.doc_id for r in one.collect()} == chosen and one.dtypes == kinds
    rows = [(r.doc_id, r.text) for r in one.collect()]
    want = {i for i, (_, c) in brute.near_duplicates(rows, size=5).items() if i == c}
    two = settle(P.near_dedup(spark, one, sf))
    assert {r.doc_id for r in two.collect()} == want and two.dtypes == kinds
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = brute.contamination([(r.doc_id, r.text) for r in two.collect()], items)
    three = settle(P.decontaminated(spark, two, sf))
    assert {r.doc_id for r in three.collect()} == {i for i, v in dirty.items() if not v[1]} and three.dtypes == kinds
    four = settle(P.mixed(spark, three, sf))
    assert four.dtypes == kinds and {r.doc_id for r in four.collect()} <= {r.doc_id for r in three.collect()}
    five = P.sharded(spark, four, sf)
    assert five.count() == four.count() and set(docs.columns) | {"shard", "slot"} <= set(five.columns)


def test_defined_cases_of_every_stage(spark, sf):
    """Nulls in any column, blank and long texts, repeated rows, columns with clashing names."""
    long = "one two three four five " * 3000 + "end"
    rows = [(1, None, None, None), (2, "", "a", "en"), (None, "alpha beta gamma delta epsilon zeta", "a", None), (4, long, None, "en"), (4, long, None, "en"), (5, long + " more", "b", "en"), (6, "alpha beta gamma delta epsilon zeta eta", "a", "en")]
    docs = spark.createDataFrame([(*r, 7, "x", 0.5, "keep") for r in rows], "doc_id long, text string, source string, lang string, size int, slot string, rate double, item string")
    count = {"quality classifier": 5, "MinHash near-dedup": 6, "benchmark decontamination": 7}
    for name, stage in P.STAGES:
        got = settle(stage(spark, docs, sf)).collect()
        assert settle(stage(spark, docs.where("doc_id = -1"), sf)).count() == 0
        if name in count:
            assert len(got) == count[name], name
        if name != P.STAGES[-1][0]:
            assert all(r.asDict().keys() == set(docs.columns) and (r["size"], r.slot, r.rate, r["item"]) == (7, "x", 0.5, "keep") for r in got), name
        else:
            assert len(got) == len(rows) and all(r["item"] == "keep" and r.rate == 0.5 for r in got)


def test_run(spark, sf):
    rows = P.run(spark, sf).collect()
    assert rows and {r.shard for r in rows} == set(range(24))
