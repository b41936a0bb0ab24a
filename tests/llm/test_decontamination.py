import brute
from pyspark.sql import functions as F

from tidemark.llm.phrase_index import build_index, decontaminate, search


def found(df):
    return {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in df.collect()}


def test_matches_brute_force(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute.contamination([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sum(v[1] > 0 for v in want.values()) > 0
    assert found(decontaminate(docs, items)) == want


def test_defined_cases_blocks_and_chunks(spark):
    docs = [(1, None), (2, ""), (3, "a b c d"), (4, "x A-B c! y a b c a b c"), (5, "a b " * 30), (None, "a b c"), (7, "é ü " * 2000 + "q r")]
    items = [(10, "a b c"), (11, None), (12, "..."), (10, "A b c"), (None, "q r"), (13, "a b a b a b a b a b a b")]
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, n_hit int")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(docs, [("null" if a is None else a, b) for a, b in items])
    assert found(decontaminate(d, i)) == want
    small = search(build_index(d, block_bytes=16), i, chunk_bytes=100)
    assert {r.id: (r.n_words, r.n_hit, r["items"]) for r in small.collect()} == want
    assert decontaminate(d.where(F.lit(False)), i).count() == 0
    assert all(r.n_hit == 0 for r in decontaminate(d, i.where(F.lit(False))).collect())


def test_an_item_that_is_most_of_the_benchmark(spark):
    """Its copies are one item, so no chunk holds more than its share; spans of several
    chunks that meet become one."""
    docs = [(k, f"a{k} b c d e f g h " * 40) for k in range(4)]
    items = [(1, "b c d e f")] * 400 + [(k, f"e f g h a{k % 4} b") for k in range(2, 30)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = search(build_index(d), i, size=4, chunk_bytes=300).collect()
    assert {r.id: (r.n_words, r.n_hit, r["items"]) for r in got} == brute.contamination(docs, items, size=4)
    assert all(a.end < b.start for r in got for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_proximity_and_spans(spark):
    docs = spark.createDataFrame([(1, "gamma alpha noise beta"), (2, "alpha " + "noise " * 30 + "beta gamma"), (3, "z alpha beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate(docs, items, slop=5).collect()}
    assert got[1].near_items == ["1"] and got[1].n_hit == 0 and got[2].near_items == []
    assert [tuple(s) for s in got[3].spans] == [(1, 4)]
