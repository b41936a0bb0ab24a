import brute
from pyspark.sql import functions as F

from tidemark.llm.minmax import near_duplicates

LONG = " ".join(f"w{i}" for i in range(120))


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(near_duplicates(docs)) == brute.near_duplicates(rows)


def test_chains_and_edited_copies(spark):
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):
        own = list(words)
        for e in range(i % 9):
            own[(37 * i + 23 * e) % 200] = f"edit{i}.{e}"
        rows.append((i * 3 + 1, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(near_duplicates(docs)) == brute.near_duplicates(rows)


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t "), (4, "one two"), (5, "One  TWO"), (None, LONG), (7, LONG), (8, LONG + " x"), (8, LONG + " x"), (9, "é" * 50000)]
    docs = spark.createDataFrame([(a, b, 5, "c") for a, b in rows], "doc_id long, text string, n_shingles int, id string")
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and all(by[i].component_id == i and by[i].kept for i in (1, 2, 3))
    assert (by[4].component_id, by[5].component_id, by[5].kept) == (4, 4, False)
    assert by[None].component_id is None and by[None].kept and by[8].component_id == 7
    assert sum(r.doc_id == 8 for r in got) == 2
    assert near_duplicates(docs.where(F.lit(False))).count() == 0
