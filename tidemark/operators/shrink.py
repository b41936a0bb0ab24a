"""Beta-binomial shrinkage of rates, per period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.grouped import with_groups

# Attempts and entities that a prior needs, attempts of a reportable rate.
MIN_ATTEMPTS, MIN_ENTITIES, REPORTABLE = 50, 20, 20


def beta_shrink(df: DataFrame, period: str, makes: str, attempts: str, min_attempts: int = MIN_ATTEMPTS, min_entities: int = MIN_ENTITIES, reportable: int = REPORTABLE) -> DataFrame:
    """Add alpha, beta (prior by moments over rates of at least ``min_attempts``;
    (1, 1) with too few of them or no spread), raw_rate, shrunk_rate, prior_weight of the data,
    volume_score and reportable. A period's prior is one aggregation, combined before
    the shuffle."""
    use = (F.col(attempts) >= min_attempts) & F.col(makes).isNotNull()
    rate = F.when(F.col(attempts) > 0, F.col(makes) / F.col(attempts))
    rows = df.withColumn("raw_rate", rate)
    rated = F.when(use, F.col("raw_rate"))
    rows = with_groups(rows, [period], __m=F.avg(rated), __v=F.var_pop(rated), __n=F.count(F.when(use, 1)))
    fitted = (F.col("__n") >= min_entities) & (F.col("__v") > 0) & (F.col("__m") > 0) & (F.col("__m") < 1)
    size = F.greatest(F.when(fitted, F.col("__m") * (1 - F.col("__m")) / F.col("__v") - 1), F.lit(1.0))
    rows = rows.withColumns({"alpha": F.when(fitted, F.col("__m") * size).otherwise(1.0), "beta": F.when(fitted, (1 - F.col("__m")) * size).otherwise(1.0)})
    total = F.col(attempts) + F.col("alpha") + F.col("beta")
    shrunk = (F.coalesce(F.col(makes), F.lit(0)) + F.col("alpha")) / total
    return rows.withColumns({"shrunk_rate": shrunk, "data_weight": F.col(attempts) / total, "volume_score": shrunk * F.col(attempts), "reportable": F.col(attempts) >= reportable}).drop("__m", "__v", "__n")
