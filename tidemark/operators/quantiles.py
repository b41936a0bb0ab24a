"""Exact quantiles of all groups at once, by counting in ever finer bins.

A quantile of n values lies at place q (n - 1) of their order, between the values of two
ranks. A pass counts the values of every group in BINS bins between the group's least and
largest value, and the bin that holds a wanted rank, with the least and largest value found
in it, is what the next pass looks at. Counts are combined before the shuffle, so a group of
most rows sends BINS counts a task; no group is sorted or held anywhere. Bins that have
become one value, or hold few rows, are done: the last pass gathers at most FEW values a rank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.grouped import MAX_GROUPS
from tidemark.sources.shared import kept

BINS, FEW = 512, 2048


def _bin(x: Column, lo: Column, hi: Column, log: bool) -> Column:
    """0 for lo, BINS - 1 for hi, and never falling between; by difference, or by its
    logarithm so that values of many sizes fall apart."""
    share = (x / 2 - lo / 2) / (hi / 2 - lo / 2)  # halves: a difference may exceed the largest double
    if log:
        share = F.log1p(share * 1e15) / F.log1p(F.lit(1e15))
    return F.when(x == lo, 0).when(x == hi, BINS - 1).otherwise(F.least(F.greatest(F.floor(share * BINS), F.lit(0)), F.lit(BINS - 1))).cast("int")


def _meet(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beside the wanted ranks of their group: broadcast while these are few."""
    side = wanted.select(*[F.col(k).alias(f"__w{i}") for i, k in enumerate(keys)], *[c for c in wanted.columns if c not in keys])
    if side.count() <= MAX_GROUPS:
        side = F.broadcast(side)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__w{i}")) for i, k in enumerate(keys)], F.lit(True))
    return rows.join(side, same & F.col("__x").between(F.col("lo"), F.col("hi"))).drop(*[f"__w{i}" for i in range(len(keys))])


def grouped_quantiles(df: DataFrame, keys: list[str], value: str | Column, quantiles: dict[str, float]) -> DataFrame:
    """keys, and a column a quantile ({name: q}), interpolated between the two nearest ranks.

    Null keys are a group. Values that are null, NaN or infinite do not count; a group without
    any has null quantiles. Ties are values like others; an empty table gives an empty result
    (without keys: one row of nulls). Some passes over the rows run when this is called: two and the
    gathering one in most cases, more where a group has very many rows."""
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    x = F.when(F.abs(x) < float("inf"), x)
    rows = df.select(*keys, x.alias("__x"))
    groups = kept(rows.groupBy(*keys).agg(F.count("__x").alias("n"), F.min("__x").alias("lo"), F.max("__x").alias("hi")))
    places = [F.lit(float(q)) * (F.col("n") - 1) for q in quantiles.values()]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in places])))
    found = None
    wanted = groups.where("n > 0").select(*keys, F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), "n")
    step = 0
    while True:
        wanted = kept(wanted)
        done = wanted.where("lo = hi").select(*keys, "rank", F.col("lo").alias("v"))
        small = wanted.where((F.col("lo") < F.col("hi")) & (F.col("n") <= FEW))
        few = _meet(rows, small, keys).groupBy(*keys, "rank").agg(F.sort_array(F.collect_list("__x")).alias("__all"), F.first("below").alias("below"))
        few = few.select(*keys, "rank", F.get("__all", (F.col("rank") - F.col("below")).cast("int")).alias("v"))
        found = done.union(few) if found is None else found.union(done).union(few)
        wanted = wanted.where((F.col("lo") < F.col("hi")) & (F.col("n") > FEW))
        if wanted.isEmpty():
            break
        met = _meet(rows, wanted.drop("n"), keys).withColumn("bin", _bin(F.col("__x"), F.col("lo"), F.col("hi"), step % 2 == 1))
        bins = met.groupBy(*keys, "rank", "below", "bin").agg(F.count("*").alias("n"), F.min("__x").alias("lo"), F.max("__x").alias("hi"))
        every = bins.groupBy(*keys, "rank", "below").agg(F.array_sort(F.collect_list(F.struct("bin", "n", "lo", "hi"))).alias("bins"))  # BINS at most
        start = F.struct(F.col("below").alias("past"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"))
        held = F.aggregate("bins", start, lambda a, b: F.when((a["past"] <= F.col("rank")) & (F.col("rank") < a["past"] + b["n"]), F.struct((a["past"] + b["n"]).alias("past"), a["past"].alias("below"), b["n"].alias("n"), b["lo"].alias("lo"), b["hi"].alias("hi"))).otherwise(
            F.struct((a["past"] + b["n"]).alias("past"), a["below"].alias("below"), a["n"].alias("n"), a["lo"].alias("lo"), a["hi"].alias("hi"))))
        wanted = every.select(*keys, "rank", held.alias("h")).select(*keys, "rank", "h.lo", "h.hi", "h.below", "h.n")
        step += 1
    values = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("__v"))
    names = [f"__g{i}" for i in range(len(keys))]
    side = values.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], "__v")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)], F.lit(True))
    out = groups.join(side, same, "left")
    between = lambda p: F.col("__v")[F.floor(p)] + (F.col("__v")[F.ceil(p)] - F.col("__v")[F.floor(p)]) * (p - F.floor(p))
    return out.select(*keys, *[between(p).alias(name) for p, name in zip(places, quantiles, strict=True)])
