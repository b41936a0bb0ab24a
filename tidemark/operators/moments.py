"""Weighted moments and standardising within a period.

The mean is weighted and null-aware, the standard deviation is the unweighted sample
one, both over qualified rows only; z-scores are then given to all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import z_score
from tidemark.operators.grouped import with_groups


def weighted_mean(x: str, w: str, where: Column | None = None) -> Column:
    """sum(x * w) / sum(w where x is not null)."""
    use = F.col(x).isNotNull() if where is None else F.col(x).isNotNull() & where
    return F.sum(F.when(use, F.col(x) * F.col(w))) / F.nullif(F.sum(F.when(use, F.col(w))), F.lit(0))


def moments(df: DataFrame, keys: list[str], metric: str, weight: str, qualified: str) -> DataFrame:
    """keys, mean, sd, n of a metric over qualified rows."""
    rows = df.where(F.col(qualified) & F.col(metric).isNotNull())
    return rows.groupBy(*keys).agg(weighted_mean(metric, weight).alias("mean"), F.stddev_samp(metric).alias("sd"), F.count("*").alias("n"))


def standardize(df: DataFrame, keys: list[str], metrics: list[str], weight: str, qualified: str) -> DataFrame:
    """Add z_<metric>: the moments of qualified rows of each group (one aggregation for
    all metrics) meet all rows of the group."""
    ok, aggregates = F.col(qualified), {}
    for m in metrics:
        aggregates |= {f"__mean_{m}": weighted_mean(m, weight, ok), f"__sd_{m}": F.stddev_samp(F.when(ok, F.col(m)))}
    out = with_groups(df, keys, **aggregates)
    return out.withColumns({f"z_{m}": z_score(m, f"__mean_{m}", f"__sd_{m}") for m in metrics}).drop(*aggregates)


def standardize_population(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Population z-scores (a constant is 0), columns replaced."""
    aggregates = {}
    for c in columns:
        aggregates |= {f"__mean_{c}": F.avg(c), f"__sd_{c}": F.stddev_pop(c)}
    out = with_groups(df, keys, **aggregates)
    z = {c: F.when(F.col(f"__sd_{c}") > 0, (F.col(c) - F.col(f"__mean_{c}")) / F.col(f"__sd_{c}")).otherwise(F.when(F.col(c).isNotNull(), 0.0)) for c in columns}
    return out.withColumns(z).drop(*aggregates)


def group_totals(df: DataFrame, keys: list[str], stats: list[str], prefix: str = "all_") -> DataFrame:
    """Add the group's totals of each stat to its rows."""
    return with_groups(df, keys, **{f"{prefix}{s}": F.coalesce(F.sum(s), F.lit(0)) for s in stats})
