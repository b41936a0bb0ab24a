"""Column expressions: guarded ratios, shared-denominator rates, z-scores.

An undefined value is NULL: never 0, NaN or infinity."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weight of a free throw in a possession, minutes of the per-minute
# scale, players on the floor, floor of a qualified weight, reference age,
# pseudo-count of a composition.
ATTEMPT_WEIGHT = 0.44
PER_MINUTES = 36.0
ON_FLOOR = 5
QUALIFIED_WEIGHT = 250
REFERENCE_AGE = 27.0
PSEUDO_COUNT = 0.005


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(n: str | Column, d: str | Column) -> Column:
    """n / d, NULL unless d > 0."""
    return F.when(col(d) > 0, col(n) / col(d))


def per_unit(stat: str | Column, weight: str | Column, scale: float = PER_MINUTES) -> Column:
    """Stat per ``scale`` units of weight."""
    return ratio(stat, weight) * scale


def efficiency(points: str, attempts: str, free: str) -> Column:
    """Points over twice the shooting possessions."""
    return ratio(points, 2 * (col(attempts) + ATTEMPT_WEIGHT * col(free)))


def usage(attempts: str, free: str, lost: str, weight: str, all_attempts: str, all_free: str, all_lost: str, all_weight: str) -> Column:
    """Share of the group's possessions that one entity used while it was active."""
    own = col(attempts) + ATTEMPT_WEIGHT * col(free) + col(lost)
    everyone = col(all_attempts) + ATTEMPT_WEIGHT * col(all_free) + col(all_lost)
    return F.when((col(weight) > 0) & (everyone > 0), own * (col(all_weight) / ON_FLOOR) / (col(weight) * everyone))


def share_while_active(stat: str, weight: str, all_weight: str, all_makes: str, makes: str) -> Column:
    """Stat over what the rest of the group made while the entity was active."""
    active = F.when(col(all_weight) > 0, col(weight) / (col(all_weight) / ON_FLOOR))
    return ratio(stat, active * col(all_makes) - col(makes))


def z_score(x: str | Column, mean: str | Column, sd: str | Column) -> Column:
    return F.when(col(sd) > 0, (col(x) - col(mean)) / col(sd))


def from_z(z: str | Column, mean: str | Column, sd: str | Column) -> Column:
    return col(z) * col(sd) + col(mean)


def log_weight(x: str | Column) -> Column:
    return F.when(col(x) > 0, F.log(col(x)))


def finite(x: str | Column) -> Column:
    """NaN and infinity become NULL."""
    v = col(x)
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def rounded(x: str | Column, places: int = 4) -> Column:
    """Half up, NULL for NaN and infinity."""
    return F.round(finite(x), places)


def birth_period(period: str, age: str) -> Column:
    return col(period) - col(age)


def qualified(weight: str, floor: float = QUALIFIED_WEIGHT) -> Column:
    return F.coalesce(col(weight) >= floor, F.lit(False))


def log_shares(parts: list[str], pseudo: float = PSEUDO_COUNT) -> list[Column]:
    """Centred log-ratios of a composition; the parts sum to 0."""
    raised = [col(p) + pseudo for p in parts]
    total = reduce(lambda a, b: a + b, raised)
    logs = [F.log(r / total) for r in raised]
    centre = reduce(lambda a, b: a + b, logs) / len(parts)
    return [x - centre for x in logs]


def normal_quantile(level: float) -> float:
    """Half width, in standard deviations, of a central interval."""
    return NormalDist().inv_cdf(0.5 + level / 2)
