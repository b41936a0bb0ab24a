import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.hilbert import hilbert_index, shard, write_shards
from tidemark.llm.mixing import mix


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    fixed = {}
    while True:
        left = sum(sizes.values()) - sum(fixed.values())
        open_ = [s for s in order if s not in fixed]
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: float(cap * sizes[s]) for s in over}


def check_mix(rows, got):
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = plain_targets(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.source_size == sizes[s] for r in own)
        assert all(r.taken == r.copies * r.size <= 3 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r.size for r in own) + 1
    assert len(got) == len(rows)


def test_targets_and_taken(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mix(docs).collect()
    check_mix(docs.collect(), got)
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in mix(docs.repartition(3)).collect())


def test_rates_and_copies_match_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(n)), f"s{i % 5}") for i, n in enumerate(rng.integers(1, 60, 900))]
    rows += [(1000 + i, "hot " * 7, "s1") for i in range(600)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in {r.source for r in got}:
        own = sorted((r for r in got if r.source == s), key=lambda r: r.size)
        size = np.array([r.size for r in own], float)
        goal = own[0].target
        if goal >= 3 * size.sum() * (1 - 1e-9):
            assert all(r.rate == 3 and r.copies == 3 for r in own)
            continue
        lo, hi = -100.0, 100.0
        for _ in range(200):  # the dual by halving: rates rise with it
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (np.minimum(3, np.exp(mid * size / size.mean())) * size).sum() < goal else (lo, mid)
        assert np.allclose([r.rate for r in own], np.minimum(3, np.exp(lo * size / size.mean())), rtol=1e-5)
        assert all(np.floor(r.rate) <= r.copies <= np.ceil(r.rate) for r in own)
        # systematic rounding: the copies of every size class and all smaller ones are within one of the rates' sum
        for n in np.unique(size):
            assert abs(sum(r.copies - r.rate for r in own if r.size <= n)) <= 1


def test_mix_defined_cases(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "one", None), (4, "x " * 500, "b"), (4, "x " * 500, "b"), (None, "p q r", "c"), (6, "p q", "é"), (7, " ", "z")]
    docs = spark.createDataFrame([(*r, 9.0) for r in rows], "doc_id long, text string, source string, rate double")
    check_mix(rows, mix(docs).collect())
    assert mix(docs.where(F.lit(False))).count() == 0


def test_hilbert_curve_is_a_walk():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)
    order = np.argsort(hilbert_index(cells, 3))
    assert sorted(hilbert_index(cells, 3)) == list(range(512))
    assert np.all(np.abs(np.diff(cells[order], axis=0)).sum(1) == 1)


def test_shards(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = shard(docs).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r.shard, []).append(r.slot)
        assert r.size == len(r.text.encode()) + 8 and r.text_crc32 == zlib.crc32(r.text.encode()) and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in sizes.values()) and set(sizes) == set(range(24))
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    path = write_shards(shard(docs))
    assert spark.read.parquet(path).count() == len(got)
    # the assignment: rows in curve order, cut as evenly as whole rows go
    ranked = sorted(got, key=lambda r: (r.shard, r.slot))
    order = [(r.curve_index, r.text_crc32, r.doc_id) for r in ranked]
    assert order == sorted(order)
    assert [r.shard for r in ranked] == [i * 24 // len(got) for i in range(len(got))]


def test_files_can_be_skipped_by_every_dimension(spark):
    rng = np.random.default_rng(2)
    n = 4000
    rows = [(int(i), "x" * int(rng.integers(0, 3000)), f"https://crawl.example/cc-{rng.integers(2000, 2030)}") for i in rng.permutation(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    path = write_shards(shard(docs, shards=32), partitions=16)
    files = spark.read.parquet(path).withColumn("file", F.input_file_name()).groupBy("file").agg(*[f(c).alias(f"{c}_{k}") for c in ("size", "doc_id", "source") for k, f in (("lo", F.min), ("hi", F.max))]).collect()
    assert len(files) >= 32
    for column, low, high in (("size", 100, 200), ("doc_id", 500, 600), ("source", "https://crawl.example/cc-2003", "https://crawl.example/cc-2004")):
        read = [f for f in files if f[f"{column}_lo"] <= high and f[f"{column}_hi"] >= low]
        assert len(read) <= len(files) * 0.6, column


def test_a_shard_is_written_by_several_tasks(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    path = write_shards(shard(docs, shards=2), partitions=8)
    files = spark.read.parquet(path).select("shard", F.input_file_name().alias("file")).groupBy("shard").agg(F.countDistinct("file").alias("n")).collect()
    assert all(r.n > 1 for r in files)


def test_shard_defined_cases(spark):
    rows = [(None, None, None, "a"), (1, "", "en", None), (2, "é" * 70000, "de", "b"), (2, "same", "de", "b"), (2, "same", "de", "b")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, shard int")
    got = shard(docs).collect()
    assert len(got) == 5 and sorted(r.size for r in got) == [8, 8, 12, 12, 140008]
    assert shard(docs.where(F.lit(False))).count() == 0
