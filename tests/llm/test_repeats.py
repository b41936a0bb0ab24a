import brute
import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.fm_index import FmIndex, WaveletMatrix, remove_repeats


def found(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_wavelet_rank_and_intervals():
    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 23, 500)
    tree = WaveletMatrix(symbols, 23)
    for c in range(23):
        at = np.arange(501)
        want = np.r_[0, np.cumsum(symbols == c)]
        assert np.array_equal(tree.rank(np.full(501, c), at), want)
    symbol, before = tree.access(np.arange(500))
    assert np.array_equal(symbol, symbols)
    assert all(before[i] == (symbols[:i] == symbols[i]).sum() for i in range(500))


def test_matching_statistics_match_brute_force():
    rng = np.random.default_rng(4)
    for most, alphabet in ((5, 2), (8, 3), (20, 2)):
        parts = [rng.integers(0, alphabet, n).astype(np.uint64) for n in (30, 12, 50, 5, 1, 40)]
        index = FmIndex(parts)
        places = {}
        for i, p in enumerate(parts):
            for s in range(len(p)):
                for n in range(1, min(most, len(p) - s) + 1):
                    places.setdefault(tuple(p[s : s + n]), []).append(int(index.first[i]) + s)
        ends = np.concatenate([index.first[i] + np.arange(len(p)) for i, p in enumerate(parts)])
        length, lo, hi = index.matching_statistics(ends, most)
        k = 0
        for p in parts:
            for e in range(len(p)):
                want = max([n for n in range(1, min(most, e + 1) + 1) if len(places[tuple(p[e + 1 - n : e + 1])]) > 1], default=0)
                assert length[k] == want
                if want:
                    assert sorted(index.locate(np.arange(lo[k], hi[k]))) == places[tuple(p[e + 1 - want : e + 1])]
                k += 1


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute.repeated_windows([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(v[1] > 0 for v in want.values()) > 5
    assert found(remove_repeats(docs)) == want


def test_shards_hot_minimizers_and_overlaps(spark):
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(60):
        own = [f"w{x}" for x in rng.integers(0, 10**6, 40)]
        a, b = sorted(rng.integers(0, 60, 2))
        rows.append((i, " ".join(own[:15] + passage[a:b] + own[15:] + (passage if i % 3 == 0 else []) + ["same"] * (i % 50))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.repeated_windows(rows)
    assert found(remove_repeats(docs)) == want
    assert found(remove_repeats(docs, shard_words=200, hot=4)) == want


def test_defined_cases(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, "short text"), (4, "short text"), (5, text), (5, text), (6, "a " + text), (None, text), (8, "é " * 30000), (9, text + " b")]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, n_words int")
    got = remove_repeats(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].n_removed for i in (1, 2, 3, 4, 5, 6, None, 8, 9)] == [0, 0, 0, 0, 0, 30, 30, 29999, 30]
    assert all(r.n_removed == 0 for r in got if r.doc_id == 5)
    assert remove_repeats(docs.where(F.lit(False))).count() == 0


def test_tasks_do_not_grow_with_the_shards(spark):
    """A thousand shards are groups of as few tasks as there are shuffle partitions."""
    import re

    from tidemark.llm.fm_index import search_shards

    parts = spark.createDataFrame([], "route long, p1 long, p2 long, id long, start long, payload string")
    plan = search_shards(parts, 1000, 20)._jdf.queryExecution().toString()
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(shard#\d+, (\d+)\)", plan)]
    assert dealt and max(dealt) <= most
