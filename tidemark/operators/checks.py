"""Data contracts and integrity checks. A check is a one-row DataFrame (name, violations)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_where(name: str, df: DataFrame, bad: Column) -> DataFrame:
    return df.agg(F.count_if(bad).alias("violations")).select(F.lit(name).alias("name"), "violations")


def total(name: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("name"), "violations")


def agreement(name: str, df: DataFrame, a: str, b: str, tolerance: float) -> DataFrame:
    """1 violation if the mean absolute difference exceeds the tolerance."""
    mad = F.avg(F.abs(F.col(a) - F.col(b)))
    return df.agg(F.when(mad > tolerance, 1).otherwise(0).cast("long").alias("violations")).select(F.lit(name).alias("name"), "violations")


def not_finite(name: str, df: DataFrame, columns: list[str]) -> DataFrame:
    """Infinity and NaN."""
    return count_where(name, df, reduce(lambda a, b: a | b, [F.isnan(c) | (F.abs(c) == float("inf")) for c in columns]))


def out_of_range(name: str, df: DataFrame, bounds: dict[str, tuple[float, float]], where: Column | None = None) -> DataFrame:
    rows = df if where is None else df.where(where)
    return count_where(name, rows, reduce(lambda a, b: a | b, [~F.col(c).between(lo, hi) for c, (lo, hi) in bounds.items()]))


def not_unique(name: str, df: DataFrame, keys: list[str]) -> DataFrame:
    return total(name, df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"))


def not_functional(name: str, df: DataFrame, a: list[str], b: str) -> DataFrame:
    """Values of ``a`` with more than one ``b``."""
    return total(name, df.groupBy(*a).agg(F.countDistinct(b).alias("n")).where("n > 1"))


def orphans(name: str, df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return total(name, df.join(other.select(*keys).distinct(), keys, "left_anti"))


def too_many(name: str, df: DataFrame, bad: Column, ceiling: int) -> DataFrame:
    n = F.count_if(bad)
    return df.agg(F.when(n > ceiling, n).otherwise(0).alias("violations")).select(F.lit(name).alias("name"), "violations")


def pair_checks(pairs: DataFrame, panel: DataFrame, max_gap: int = 2) -> DataFrame:
    """A pair changes group, keeps the gap, lands once, leaves once, and its periods exist."""
    places = lambda side: panel.select("entity", F.col("grp").alias(f"{side}_group"), F.col("period").alias(f"{side}_period"))
    parts = [
        count_where("pair_changes_group", pairs, F.col("source_group") == F.col("target_group")), count_where("pair_gap", pairs, ~F.col("gap").between(1, max_gap)),
        not_unique("pair_landing", pairs, ["entity", "source_group", "target_group", "target_period"]), not_unique("pair_departure", pairs, ["entity", "source_group", "target_group", "source_period"]),
        *[orphans(f"pair_{side}_exists", pairs, places(side), ["entity", f"{side}_group", f"{side}_period"]) for side in ("source", "target")],
    ]
    return reduce(DataFrame.union, parts)


def profile(df: DataFrame) -> DataFrame:
    """(column, dtype, null_rate, min, max, n_rows) of every column, in one pass."""
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(df.columns):
        aggs += [F.count(c).alias(f"c{i}"), F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}")]
    one = df.agg(*aggs)
    rate = lambda i: F.round(F.when(F.col("n") > 0, 1 - F.col(f"c{i}") / F.col("n")).otherwise(0.0), 6)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), rate(i).alias("null_rate"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"), F.col("n").alias("n_rows")) for i, (c, t) in enumerate(df.dtypes)]
    return one.select(F.inline(F.array(*rows)))


def content_hash(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(n_rows, content_hash), whatever the row order: row digests are added up. Each
    value has its length in front (null has none), so no two rows have one text."""
    columns = columns or sorted(df.columns)
    value = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("~"))
    text = F.concat_ws("|", *[value(c) for c in columns])
    part = lambda i: F.sum(F.conv(F.substring(F.md5(text), i, 8), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws("-", F.count("*"), part(1), part(9), part(17), part(25)), 256).substr(1, 32).alias("content_hash"))


def compare_contracts(expected: DataFrame, actual: DataFrame, tolerance: float = 1e-6, bounds: bool = False) -> DataFrame:
    """(column, problem) between two profiles."""
    e, a = expected.alias("e"), actual.alias("a")
    both = e.join(a, F.col("e.column") == F.col("a.column"), "full")
    problems = [
        F.when(F.col("a.column").isNull(), "removed"), F.when(F.col("e.column").isNull(), "added"), F.when(F.col("e.dtype") != F.col("a.dtype"), "dtype"),
        F.when(F.abs(F.col("e.null_rate") - F.col("a.null_rate")) > tolerance, "null_rate"), F.when(F.col("e.n_rows") != F.col("a.n_rows"), "n_rows"),
    ]
    if bounds:
        problems.append(F.when(~F.col("e.min").eqNullSafe(F.col("a.min")) | ~F.col("e.max").eqNullSafe(F.col("a.max")), "bounds"))
    return both.select(F.coalesce("e.column", "a.column").alias("column"), F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def snapshot_id(hashes: dict[str, str]) -> str:
    """One id for a set of tables."""
    import hashlib

    return hashlib.sha256("".join(f"{k}={hashes[k]};" for k in sorted(hashes)).encode()).hexdigest()[:12]


def not_reproduced(now: dict[str, float], committed: dict[str, float], tolerance: float = 1e-6) -> dict[str, tuple]:
    """Metrics that differ from the committed ones or are missing on a side."""
    return {k: (committed.get(k), now.get(k)) for k in {*now, *committed} if k not in now or k not in committed or abs(now[k] - committed[k]) > tolerance}
