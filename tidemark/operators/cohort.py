"""Cohorts of longitudinal entities: who moved between groups, who stayed, who might.

A panel has one row per (entity, grp, period) with a weight; column names are those
of the ``Panel``. Moves are found with equi-joins that carry the range part as a
residual, and a greedy one-to-one matching that is two window minima."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import z_score
from tidemark.functions.names import direction


@dataclass(frozen=True)
class Panel:
    entity: str = "entity"
    group: str = "grp"
    period: str = "period"
    weight: str = "weight"


# Least weight at source and target, largest gap in periods, least
# weight of a persistence row.
SOURCE_WEIGHT, TARGET_WEIGHT, MAX_GAP, PERSISTENCE_WEIGHT = 400, 300, 2, 500


def greedy_pairs(candidates: DataFrame, keys: list[str], source: str, target: str, gap: str, max_gap: int) -> DataFrame:
    """One-to-one matching that takes the smallest gaps first.

    With gaps 1 and 2 and unique places, a pair stays where its gap is the smallest
    at both its ends: two window minima. Larger gaps go level by level, each anti-joined
    with the ends already used."""
    if max_gap <= 2:
        at_source, at_target = Window.partitionBy(*keys, source), Window.partitionBy(*keys, target)
        best = candidates.withColumn("__s", F.min(gap).over(at_source)).withColumn("__t", F.min(gap).over(at_target))
        return best.where(f"{gap} = __s and {gap} = __t").drop("__s", "__t")
    taken = None
    for g in range(1, max_gap + 1):
        level = candidates.where(F.col(gap) == g)
        if taken is not None:
            level = level.join(taken.select(*keys, source), [*keys, source], "left_anti").join(taken.select(*keys, target), [*keys, target], "left_anti")
        taken = level.select(candidates.columns) if taken is None else taken.union(level.select(candidates.columns))
    return taken


def transition_pairs(panel: DataFrame, p: Panel = Panel(), source_weight: float = SOURCE_WEIGHT, target_weight: float = TARGET_WEIGHT, max_gap: int = MAX_GAP, carry: list[str] | None = None) -> DataFrame:
    """Moves from one group to another within ``max_gap`` periods: entity,
    source_group, target_group, source_period, target_period, weights, carried
    columns, direction, gap. Entities already in the target group in the source
    period (at any weight) did not move. (entity, group, period) must be unique."""
    carry = carry or []
    at = lambda side, least: panel.where(F.col(p.weight) >= least).select(
        F.col(p.entity).alias("entity"), F.col(p.group).alias(f"{side}_group"), F.col(p.period).alias(f"{side}_period"), F.col(p.weight).alias(f"{side}_weight"),
        *[F.col(c).alias(f"{side}_{c}") for c in carry])
    pairs = at("source", source_weight).join(at("target", target_weight), "entity")
    pairs = pairs.where("source_group <> target_group").withColumn("gap", F.col("target_period") - F.col("source_period")).where(F.col("gap").between(1, max_gap))
    there = panel.select(F.col(p.entity).alias("entity"), F.col(p.group).alias("target_group"), F.col(p.period).alias("source_period"))
    pairs = pairs.join(there, ["entity", "target_group", "source_period"], "left_anti")
    pairs = greedy_pairs(pairs, ["entity", "source_group", "target_group"], "source_period", "target_period", "gap", max_gap)
    return pairs.withColumn("direction", direction("source_group", "target_group"))


def cohort_summary(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("direction").agg(F.count("*").alias("n_pairs"), F.countDistinct("entity").alias("n_entities"), F.min("source_period").alias("first_period"), F.max("source_period").alias("last_period"))


def persistence_frame(panel: DataFrame, metric_z: str, p: Panel = Panel(), least: float = PERSISTENCE_WEIGHT, covariates: list[str] | None = None) -> DataFrame:
    """Consecutive periods in one group, both eligible: entity, grp, period, z_from,
    z_to, log_weight and covariates of the first."""
    covariates = covariates or []
    ok = panel.where((F.col(p.weight) >= least) & F.col(metric_z).isNotNull())
    for c in covariates:
        ok = ok.where(F.col(c).isNotNull())
    one = ok.select(F.col(p.entity).alias("entity"), F.col(p.group).alias("grp"), F.col(p.period).alias("period"), F.col(metric_z).alias("z_from"), F.log(p.weight).alias("log_weight"), *covariates)
    two = ok.select(F.col(p.entity).alias("entity"), F.col(p.group).alias("grp"), (F.col(p.period) - 1).alias("period"), F.col(metric_z).alias("z_to"))
    return one.join(two, ["entity", "grp", "period"])


def transition_frame(pairs: DataFrame, panel: DataFrame, target_moments: DataFrame, metric: str, p: Panel = Panel(), covariates: list[str] | None = None) -> DataFrame:
    """Pairs with the metric and its z at both ends and the target's moments;
    rows whose target spread is 0 or unknown go."""
    covariates = covariates or []
    at = lambda side, extra: panel.select(
        F.col(p.entity).alias("entity"), F.col(p.group).alias(f"{side}_group"), F.col(p.period).alias(f"{side}_period"), F.col(metric).alias(f"{side}_value"), F.col(f"z_{metric}").alias(f"z_{side}"), *extra)
    out = pairs.join(at("source", [F.col(c) for c in covariates]), ["entity", "source_group", "source_period"])
    out = out.join(at("target", []), ["entity", "target_group", "target_period"])
    m = target_moments.select(F.col(p.group).alias("target_group"), F.col(p.period).alias("target_period"), F.col("mean").alias("target_mean"), F.col("sd").alias("target_sd"))
    return out.join(m, ["target_group", "target_period"], "left").where("target_sd > 0").withColumn("log_source_weight", F.log("source_weight"))


def latest_period(panel: DataFrame, p: Panel = Panel()) -> DataFrame:
    return panel.groupBy(F.col(p.group).alias("grp")).agg(F.max(p.period).alias("period"))


def latest_rows(panel: DataFrame, p: Panel = Panel(), tie: str | None = None) -> DataFrame:
    """The latest row of each entity."""
    w = Window.partitionBy(p.entity).orderBy(F.col(p.period).desc(), *([F.col(tie)] if tie else []))
    return panel.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def counterfactuals(panel: DataFrame, pairs: DataFrame, target_moments: DataFrame, metric: str, source: str, target: str, p: Panel = Panel(), least: float = SOURCE_WEIGHT) -> DataFrame:
    """Entities of ``source`` that were never seen to move to ``target``, as if they
    moved next period: their latest row there, the moments of the target's latest
    period as constants, gap 1, whether z lies inside the movers' range, and whether
    they moved anywhere before."""
    rows = panel.where((F.col(p.group) == source) & (F.col(p.weight) >= least) & F.col(f"z_{metric}").isNotNull())
    rows = latest_rows(rows, p).select(F.col(p.entity).alias("entity"), F.col(p.period).alias("source_period"), F.col(f"z_{metric}").alias("z_source"), F.col(p.weight).alias("source_weight"))
    way = F.lit(f"{source}->{target}")
    moved = pairs.where(F.col("direction") == way)
    rows = rows.join(moved.select("entity").distinct(), "entity", "left_anti")
    m = target_moments.where(F.col(p.group) == target).groupBy().agg(F.max_by("mean", p.period).alias("target_mean"), F.max_by("sd", p.period).alias("target_sd"), F.max(p.period).alias("target_period"))
    # one row each, whatever the input: constants of the direction
    rows = rows.crossJoin(F.broadcast(m)).crossJoin(F.broadcast(support_range(moved.join(panel.select(F.col(p.entity).alias("entity"), F.col(p.group).alias("source_group"), F.col(p.period).alias("source_period"), F.col(f"z_{metric}").alias("z_source")), ["entity", "source_group", "source_period"]))))
    before = pairs.select("entity", F.lit(True).alias("moved_before")).distinct()
    return rows.join(before, "entity", "left").select(
        "entity", way.alias("direction"), "source_period", "z_source", "source_weight", "target_period", "target_mean", "target_sd", F.lit(1).alias("gap"),
        F.coalesce(F.col("z_source").between(F.col("z_min"), F.col("z_max")), F.lit(False)).alias("in_support"), F.coalesce("moved_before", F.lit(False)).alias("moved_before"))


def support_range(movers: DataFrame) -> DataFrame:
    return movers.agg(F.min("z_source").alias("z_min"), F.max("z_source").alias("z_max"), F.count("z_source").alias("n_movers"))


def support_ranges(transitions: DataFrame) -> DataFrame:
    return transitions.groupBy("direction").agg(F.min("z_source").alias("z_min"), F.max("z_source").alias("z_max"), F.count("z_source").alias("n_movers"))


def selection_summary(transitions: DataFrame, panel: DataFrame, metric: str, qualified: Column, p: Panel = Panel()) -> DataFrame:
    """Movers' mean z against qualified peers of the same group and periods."""
    movers = transitions.groupBy("direction").agg(F.count("*").alias("n_movers"), F.avg("z_source").alias("mover_mean"))
    cells = transitions.select("direction", F.col("source_group").alias(p.group), F.col("source_period").alias(p.period)).distinct()
    peers = panel.where(qualified & F.col(f"z_{metric}").isNotNull()).join(cells, [p.group, p.period])
    peers = peers.groupBy("direction").agg(F.count("*").alias("n_peers"), F.avg(f"z_{metric}").alias("peer_mean"))
    return movers.join(peers, "direction", "left").withColumn("selection", F.col("mover_mean") - F.col("peer_mean"))


def with_z(rows: DataFrame, value: str, mean: str, sd: str, name: str) -> DataFrame:
    return rows.withColumn(name, z_score(value, mean, sd))
