"""Aggregates of a row's group beside the row, without a window over the group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups that are broadcast at most; more of them are joined by a shuffle on the keys.
MAX_GROUPS = 50_000


def with_groups(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Add aggregates over the rows of equal ``keys`` (null keys are a group).

    Groups are combined before the shuffle, so a group that holds most rows is a few
    partial sums. Their table is counted: up to MAX_GROUPS rows it is broadcast and the
    rows stay where they are; beyond that it is joined by its keys."""
    names = [f"__key{i}" for i in range(len(keys))]
    groups = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(*[c.alias(n) for n, c in aggregates.items()])
    few = groups.limit(MAX_GROUPS + 1).toArrow()
    if few.num_rows <= MAX_GROUPS:
        groups = F.broadcast(df.sparkSession.createDataFrame(few, groups.schema))
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(groups[n]) for k, n in zip(keys, names, strict=True)], F.lit(True))
    return df.join(groups, same, "left").drop(*names)
