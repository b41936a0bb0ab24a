"""Resampling with replacement, exactly: the copies of n rows in a draw are multinomial and
add up to n.

Rows are dealt to buckets by a hash of their key. How many of a draw's n picks fall into each
bucket is multinomial in the buckets' sizes (a binomial for each bucket, given what the buckets
before it took), and the picks within a bucket are uniform. So a draw needs one number a bucket from the
driver, and buckets are worked on apart. All random numbers come from the seed, the number of
buckets and a bucket's sorted keys: a rerun on other partitions makes the same copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets at most; the table of picks by draw and bucket is that wide at any size.
BUCKETS, BUCKET_ROWS = 1024, 512


def _dealt(rows: DataFrame, key: list[str]) -> tuple[DataFrame, dict[int, int]]:
    """``rows`` with their bucket, and the buckets' sizes (BUCKETS rows at most)."""
    n = rows.count()
    buckets = max(1, min(BUCKETS, n // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in key]), F.lit(buckets)).cast("int")
    rows = rows.withColumn("__bucket", bucket)
    return rows, {r["__bucket"]: r["n"] for r in rows.groupBy("__bucket").agg(F.count("*").alias("n")).collect()}


def bucket_picks(sizes: dict[int, int], draws: int, seed: int) -> dict[int, np.ndarray]:
    """For each bucket, how many of each draw's picks it takes."""
    order = sorted(sizes)
    n = sum(sizes.values())
    share = np.array([sizes[b] / n for b in order])
    taken = np.random.default_rng(seed).multinomial(n, share / share.sum(), size=draws)
    return {b: taken[:, i].astype(np.int32) for i, b in enumerate(order)}


def _picks(rng: np.random.Generator, n: int, taken: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges of draws with their picks, not many more than ``most`` at once."""
    at, ends = 0, np.cumsum(taken)
    while at < len(taken):
        past = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, past + most, side="right")))
        yield at, to, rng.integers(0, n, int(taken[at:to].sum()))
        at = to


def _sorted(table: pa.Table, key: list[str]) -> pa.Table:
    return table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in key]))


def copies(df: DataFrame, key: list[str], draws: int, seed: int) -> DataFrame:
    """key and ``copies``, an array with the row's copies in each draw. Keys are unique and not
    null; of no rows there are no copies."""
    rows, sizes = _dealt(df.select(*key), key)
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in key) + ", copies array<int>"
    if not sizes:
        return df.select(*key, F.array().cast("array<int>").alias("copies"))
    taken = df.sparkSession.sparkContext.broadcast(bucket_picks(sizes, draws, seed))

    def run(table: pa.Table) -> pa.Table:
        table = _sorted(table, key)
        bucket, n = table["__bucket"][0].as_py(), table.num_rows
        own = taken.value[bucket]
        times = np.zeros((n, len(own)), np.int32)
        for a, b, picks in _picks(np.random.default_rng([seed, bucket]), n, own):
            np.add.at(times, (picks, np.repeat(np.arange(a, b), own[a:b])), 1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(own), pa.int32()), pa.array(times.ravel()))
        return table.select(key).append_column("copies", lists)

    return rows.groupBy("__bucket").applyInArrow(run, schema)


def resampled_sums(df: DataFrame, key: str, values: list[str], draws: int, seed: int) -> DataFrame:
    """(draw, values): the sums of ``values`` over each draw of the rows of ``df``, whose keys
    are unique. What leaves a bucket is one row a draw."""
    rows, sizes = _dealt(df.select(key, *[F.col(v).cast("double").alias(v) for v in values]), [key])
    schema = "draw int, " + ", ".join(f"`{v}` double" for v in values)
    if not sizes:
        return df.sparkSession.createDataFrame([], schema)
    taken = df.sparkSession.sparkContext.broadcast(bucket_picks(sizes, draws, seed))

    def run(table: pa.Table) -> pa.Table:
        table = _sorted(table, [key])
        bucket, n = table["__bucket"][0].as_py(), table.num_rows
        own, columns = taken.value[bucket], [table[v].to_numpy() for v in values]
        sums = np.zeros((len(columns), len(own)))
        for a, b, picks in _picks(np.random.default_rng([seed, bucket]), n, own):
            draw = np.repeat(np.arange(b - a), own[a:b])
            for i, column in enumerate(columns):
                sums[i, a:b] = np.bincount(draw, weights=column[picks], minlength=b - a)
        return pa.table([pa.array(np.arange(len(own), dtype=np.int32)), *[pa.array(s) for s in sums]], names=["draw", *values])

    return rows.groupBy("__bucket").applyInArrow(run, schema).groupBy("draw").agg(*[F.sum(v).alias(v) for v in values])


def interval(value: Column, level: float) -> list[Column]:
    """Aggregates low and high: the middle ``level`` of ``value``, over one row a draw."""
    half = (1 - level) / 2
    return [F.percentile(value, half).alias("low"), F.percentile(value, 1 - half).alias("high")]
