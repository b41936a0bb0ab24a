"""Fact tables: what may be said of one move, each statement with its value and source.

A fact is a role (what its number is) about a topic (a metric, the cohort or the move).
Statements come from one phrase a role, in which %s stands for the topic's label or for
columns of the row; callers pass their own labels, and their own phrases where these do not
suit. A table is one projection, so fact ids come from a fact's place in its row and need
no sort or window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KIND = "struct<statement:string,value:double,unit:string,source:string,metric:string,role:string>"

PHRASES = {
    "projected": "Forecast of %s after the move",
    "low80": "10th percentile of the forecast of %s",
    "high80": "90th percentile of the forecast of %s",
    "low95": "2.5th percentile of the forecast of %s",
    "high95": "97.5th percentile of the forecast of %s",
    "source": "Observed %s before the move",
    "z": "Observed %s less the mean of its cell, in standard deviations",
    "mean": "Mean %s where the move leads, by weight",
    "sd": "Spread of %s where the move leads",
    "same_z": "%s at an unchanged number of standard deviations",
    "folk": "%s by the fixed multiplier",
    "mae": "Mean miss of %s forecasts (%s moves)",
    "best_mae": "Mean miss of %s by rule %s, %s",
    "rule_loses": "more than the forecast's",
    "rule_wins": "no more than the forecast's, so the rule is preferred",
    "slope": "Gain of %s standing per unit of earlier standing, %s",
    "cohort": "Moves along %s",
    "selection": "Lead of movers along %s over those who stayed, before moving",
    "stat": "%s, last period before the move",
    "gap": "Periods from the last one before the move to the first one after it",
    "move": "%s left after %s for %s",
}


class Facts:
    """Builds the facts of a row. ``phrases`` replace those of PHRASES."""

    def __init__(self, phrases: dict[str, str] | None = None):
        self.phrases = PHRASES | (phrases or {})

    def one(self, role: str, about: list[str | Column], value: str | None, unit: str, source: str, metric: str | None = None, when: Column | None = None) -> Column:
        """One fact; null where ``when`` does not hold."""
        said = F.format_string(self.phrases[role], *[F.lit(a) if isinstance(a, str) else a.cast("string") for a in about])
        number = F.lit(None) if value is None else F.col(value)
        kept = F.lit(role if metric else None).cast("string")
        fact = F.struct(said.alias("statement"), number.cast("double").alias("value"), F.lit(unit).alias("unit"), F.lit(source).alias("source"), F.lit(metric).cast("string").alias("metric"), kept.alias("role")).cast(KIND)
        return fact if when is None else F.when(when, fact)

    def metric(self, m: str, label: str, unit: str, folk: bool = False) -> list[Column]:
        """Forecast with its bounds, where it starts from, what it leads to, and the simple
        predictions: columns <m>_projected, _low80, _high80, _low95, _high95, _source, _z, _mean,
        _sd, _same_z and, with ``folk``, _folk."""
        made = {"model": ["projected", "low80", "high80", "low95", "high95"], f"panel.{m}": ["source"], f"panel.z_{m}": ["z"], "moments": ["mean", "sd"], "baselines": ["same_z", *["folk"] * folk]}
        return [self.one(role, [label], f"{m}_{role}", "sd" if role == "z" else unit, source, m) for source, roles in made.items() for role in roles]

    def quality(self, m: str, label: str, unit: str) -> list[Column]:
        """How far forecasts and the best simple rule missed, and the direction's slope: columns
        <m>_mae, _n_evaluated, _best, _best_mae and _slope; what is null is left out."""
        there = lambda role: F.col(f"{m}_{role}").isNotNull()
        verdict = F.when(F.col(f"{m}_mae") < F.col(f"{m}_best_mae"), self.phrases["rule_loses"]).otherwise(self.phrases["rule_wins"])
        about = {"mae": [label, F.col(f"{m}_n_evaluated")], "best_mae": [label, F.col(f"{m}_best"), verdict], "slope": [label, F.col("direction")]}
        return [self.one(role, words, f"{m}_{role}", "none" if role == "slope" else unit, "run", m, there(role)) for role, words in about.items()]

    def cohort(self) -> list[Column]:
        """Columns n_direction and selection (left out where null)."""
        way = [F.col("direction")]
        return [self.one("cohort", way, "n_direction", "count", "pairs"), self.one("selection", way, "selection", "sd", "selection", when=F.col("selection").isNotNull())]

    def move(self, stats: dict[str, tuple[str, str]]) -> list[Column]:
        """The source period's stats ({column: (label, unit)}; unknown ones are left out), the gap
        where it is longer than one period, and the move itself."""
        own = [self.one("stat", [label], c, unit, f"panel.{c}", when=F.col(c).isNotNull()) for c, (label, unit) in stats.items()]
        gap = self.one("gap", [], "gap", "count", "pairs.gap", when=F.col("gap") > 1)
        return [*own, gap, self.one("move", [F.col("source_group"), F.col("source_period"), F.col("target_group")], None, "period", "pairs")]


def fact_table(frame: DataFrame, key: list[str], facts: list[Column]) -> DataFrame:
    """key, fact_id (f01 and so on, in the order of ``facts``), statement, value, unit, source,
    metric, role: one row for every fact that holds."""
    numbered = frame.select(*key, F.posexplode(F.array_compact(F.array(*facts))).alias("at", "f"))
    return numbered.select(*key, F.format_string("f%02d", F.col("at") + 1).alias("fact_id"), "f.*")
