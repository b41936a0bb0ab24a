"""Least squares from aggregated moments, walk-forward evaluation, intervals.

A model's rows never leave the executors: one aggregation returns the moments of its few
columns, and the small system is solved on the driver. Moments are sums, so folds and
levels of many groups come from adding and taking off moments, not from refitting."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import REFERENCE_AGE, from_z, normal_quantile
from tidemark.operators.resampling import interval, resampled_sums
from tidemark.sources.shared import kept

# Least rows of a first stage, of a slope of its own, of a test and a
# train fold, gap at which slopes disagree, multiplier of the folk rule, draws.
MIN_STAGE1, MIN_SLOPE, MIN_TEST, MIN_TRAIN, SLOPE_GAP, FOLK, DRAWS, SEED = 100, 30, 5, 40, 0.15, 0.75, 2000, 20260810


@dataclass
class Fit:
    """``absorbed``: levels of groups that were fitted beside the named columns."""

    names: list[str]
    coef: np.ndarray
    n: int
    rss: float
    tss: float
    absorbed: int = 0
    extra: dict = field(default_factory=dict)

    @property
    def r2(self) -> float:
        return 1 - self.rss / self.tss if self.tss > 0 else 0.0

    @property
    def residual_sd(self) -> float:
        return float(np.sqrt(self.rss / max(self.n - len(self.names) - self.absorbed, 1)))

    def __getitem__(self, name: str) -> float:
        return float(self.coef[self.names.index(name)]) if name in self.names else 0.0


# Moments of columns x0.. and, last, y: n, sums s<i> and products g<i>_<j>. They add up
# over groups, and what is taken out of a group is taken off its moments.


def fields(k: int) -> list[str]:
    """Names of the moments of k columns with y."""
    return ["n", *[f"s{i}" for i in range(k + 1)], *[f"g{i}_{j}" for i in range(k + 1) for j in range(i, k + 1)]]


def moment_sums(x: list[Column], y: Column) -> list[Column]:
    """Aggregates that make the moments; rows with an undefined value are left out."""
    cols = [*x, y]
    whole = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])
    held = lambda v: F.coalesce(F.sum(F.when(whole, v)), F.lit(0.0))
    sums = [F.count_if(whole), *[held(c) for c in cols], *[held(cols[i] * cols[j]) for i in range(len(cols)) for j in range(i, len(cols))]]
    return [c.alias(name) for c, name in zip(sums, fields(len(x)), strict=True)]


def added(k: int) -> list[Column]:
    return [F.sum(f).alias(f) for f in fields(k)]


def within_sums(groups: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Moments about the groups' own means, added up over the rows of ``groups`` (one a group):
    c<i>_<j>, n, n_groups, and sy and syy of the outcome as it is."""
    about = lambda i, j: F.col(f"g{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")
    rows = groups.where("n > 0").groupBy(*by)
    return rows.agg(
        F.sum("n").alias("n"), F.count("*").alias("n_groups"), F.sum(f"s{k}").alias("sy"), F.sum(f"g{k}_{k}").alias("syy"),
        *[F.sum(about(i, j)).alias(f"c{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)])


def solve_within(row, names: list[str]) -> Fit:
    """Fit of the named columns beside one level a group, from one row of ``within_sums``."""
    k, n = len(names), row["n"] or 0
    c = np.zeros((k + 1, k + 1))
    for i in range(k + 1):
        for j in range(i, k + 1):
            c[i, j] = c[j, i] = row[f"c{i}_{j}"] or 0.0
    coef = least_squares(c[:k, :k], c[:k, k])
    rss = max(0.0, float(c[k, k] - 2 * coef @ c[:k, k] + coef @ c[:k, :k] @ coef))
    return Fit(names, coef, n, rss, float(row["syy"] - row["sy"] ** 2 / n) if n else 0.0, row["n_groups"] or 0)


def least_squares(xx: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Coefficients from cross products, columns brought to one length first; the shortest
    solution where they are collinear."""
    size = np.sqrt(np.maximum(np.diag(xx), 0))
    unit = np.divide(1.0, size, out=np.zeros_like(size), where=size > 0)
    return np.linalg.pinv(xx * np.outer(unit, unit), rcond=1e-12, hermitian=True) @ (xy * unit) * unit


def level(coef: list[Column]) -> Column:
    """A group's level from its moments: its mean outcome less what its means explain."""
    k = len(coef)
    return (F.col(f"s{k}") - reduce(lambda a, b: a + b, [c * F.col(f"s{i}") for i, c in enumerate(coef)])) / F.col("n")


def ols(df: DataFrame, features: dict[str, Column], y: Column) -> Fit:
    """Fit of ``features`` without a constant of its own; see ``ols_with_constant``."""
    names, k = list(features), len(features)
    row = df.agg(*moment_sums(list(features.values()), y)).first()
    g = np.zeros((k + 1, k + 1))
    for i in range(k + 1):
        for j in range(i, k + 1):
            g[i, j] = g[j, i] = row[f"g{i}_{j}"]
    coef, n = least_squares(g[:k, :k], g[:k, k]), row["n"]
    rss = max(0.0, float(g[k, k] - 2 * coef @ g[:k, k] + coef @ g[:k, :k] @ coef))
    return Fit(names, coef, n, rss, float(g[k, k] - row[f"s{k}"] ** 2 / n) if n else 0.0)


def ols_with_constant(df: DataFrame, features: dict[str, Column], y: Column) -> Fit:
    """The same beside a constant (``one``), which is taken out before solving: columns that
    hardly vary, and their squares, are told apart."""
    k = len(features)
    sums = df.agg(*moment_sums(list(features.values()), y))
    one = sums.first()
    about = {f"c{i}_{j}": one[f"g{i}_{j}"] - one[f"s{i}"] * one[f"s{j}"] / one["n"] if one["n"] else 0.0 for i in range(k + 1) for j in range(i, k + 1)}
    fit = solve_within(about | {"n": one["n"], "n_groups": 1 if one["n"] else 0, "sy": one[f"s{k}"], "syy": one[f"g{k}_{k}"]}, list(features))
    constant = (one[f"s{k}"] - fit.coef @ [one[f"s{i}"] for i in range(k)]) / one["n"] if one["n"] else 0.0
    return Fit(["one", *fit.names], np.r_[constant, fit.coef], fit.n, fit.rss, fit.tss)


def fit_persistence(frame: DataFrame, age: str = "age") -> Fit:
    """z_to on z_from, centred age, its square and centred log weight."""
    mean = frame.agg(F.avg("log_weight")).first()[0] or 0.0
    features = persistence_features("z_from", age, "log_weight", mean)
    features.pop("one")
    fit = ols_with_constant(frame, features, F.col("z_to"))
    if fit.n < MIN_STAGE1:
        raise ValueError(f"{fit.n} rows; the first stage needs {MIN_STAGE1}")
    fit.extra["mean_log_weight"] = mean
    return fit


def persistence_features(z: str, age: str, log_weight: str, mean: float) -> dict[str, Column]:
    a = F.col(age) - REFERENCE_AGE
    return {"one": F.lit(1.0), "z": F.col(z), "age": a, "age2": a * a, "log_weight": F.col(log_weight) - mean}


def linear(fit: Fit, features: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(fit[n]) * c for n, c in features.items()])


def persisted(stage1: Fit, age: str = "source_age") -> Column:
    return linear(stage1, persistence_features("z_source", age, "log_source_weight", stage1.extra["mean_log_weight"]))


def transition_features(stage1: Fit, age: str = "source_age") -> dict[str, Column]:
    return {"persisted": persisted(stage1, age), "log_weight": F.col("log_source_weight"), "gap": F.col("gap").cast("double")}


def fit_translation(frame: DataFrame, stage1: Fit, age: str = "source_age") -> Fit:
    """z_target on one level a direction, the persisted z, log weight and gap.

    Levels are absorbed: moments are added up by direction, and the columns' coefficients come
    from those about the directions' means, so the driver holds three columns however many
    directions there are. extra["levels"] is the table of (direction, level, n)."""
    features = transition_features(stage1, age)
    k = len(features)
    cells = frame.groupBy("direction").agg(*moment_sums(list(features.values()), F.col("z_target")))
    fit = solve_within(within_sums(cells, k, []).first(), list(features))
    levels = cells.where("n > 0").select("direction", level([F.lit(float(c)) for c in fit.coef]).alias("level"), "n")
    fit.extra |= {"stage1": stage1, "levels": levels}
    return fit


def predict(frame: DataFrame, fit: Fit, level: float = 0.8, age: str = "source_age") -> DataFrame:
    """Add z_hat, value_hat and the interval [low, high] of the value. A direction that
    the fit has not seen has level 0."""
    levels = fit.extra["levels"].select("direction", F.col("level").alias("__level"))
    known = frame.join(levels, "direction", "left").select(*frame.columns, F.coalesce("__level", F.lit(0.0)).alias("__level"))
    out = known.withColumn("z_hat", F.col("__level") + linear(fit, transition_features(fit.extra["stage1"], age))).drop("__level")
    return with_interval(out, F.lit(fit.residual_sd), level)


def with_interval(out: DataFrame, sd: Column, level: float = 0.8) -> DataFrame:
    half = normal_quantile(level) * sd
    return out.withColumns({"value_hat": from_z("z_hat", "target_mean", "target_sd"), "low": from_z(F.col("z_hat") - half, "target_mean", "target_sd"), "high": from_z(F.col("z_hat") + half, "target_mean", "target_sd")})


def direction_slopes(frame: DataFrame, x: str, y: str, least: int = MIN_SLOPE) -> DataFrame:
    return frame.groupBy("direction").agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope")).where(F.col("n") >= least)


def baselines(frame: DataFrame, persisted_z: Column | None = None) -> DataFrame:
    """The simple predictions of the target's value."""
    out = frame.withColumns({"b_mean": F.col("target_mean"), "b_folk": F.col("source_value") * FOLK, "b_same_z": from_z("z_source", "target_mean", "target_sd")})
    return out if persisted_z is None else out.withColumn("b_persist", from_z(persisted_z, "target_mean", "target_sd"))


def best_baseline(errors: DataFrame) -> DataFrame:
    """(baseline, mae, n) of the smallest error; ties go to the first name."""
    return errors.orderBy("mae", "baseline").limit(1)


def baseline_errors(frame: DataFrame, names: list[str], actual: str = "target_value") -> DataFrame:
    """(baseline, mae, n), best first."""
    per = frame.agg(F.count("*").alias("n"), *[F.avg(F.abs(F.col(b) - F.col(actual))).alias(b) for b in names])
    return per.select("n", F.inline(F.array(*[F.struct(F.lit(b).alias("baseline"), F.col(b).alias("mae")) for b in names]))).orderBy("mae", "baseline")


def skill(mae: float, reference: float) -> float | None:
    return 1 - mae / reference if reference else None


def walk_forward(frame: DataFrame, stage1: Fit, first_period: int, age: str = "source_age", min_test: int = MIN_TEST, min_train: int = MIN_TRAIN) -> DataFrame:
    """Errors of every target period from ``first_period`` on, each predicted by a model
    of strictly earlier targets without the period's entities, beside the simple predictions
    b_mean, b_folk, b_same_z and b_persist; periods with too few rows either way are left out.

    No fold is fitted by itself. Moments are added up once by period, entity and direction;
    running sums over periods are the moments before each fold, and those that its own entities
    had before are taken off again. What is collected is one row a period (``fold_sums``), in
    two jobs however many folds there are; both guards are checked on it."""
    features = transition_features(stage1, age)
    names = list(features)
    frame = baselines(frame, persisted(stage1, age))
    n_test = F.count("*").alias("n_test")
    periods = sorted(r[0] for r in frame.where(F.col("target_period") >= first_period).groupBy("target_period").agg(n_test).where(F.col("n_test") >= min_test).collect())
    kinds = "fold long, sd double, " + ", ".join(f"b{i} double" for i in range(len(names)))
    solved, rest = [], None
    if periods:
        rest, sums = fold_sums(frame, list(features.values()), periods)
        for row in sums.collect():  # one a period
            guard_fold(row)
            if row["n"] >= min_train:
                fit = solve_within(row, names)
                solved.append((int(row["fold"]), fit.residual_sd, *map(float, fit.coef)))
    if not solved:
        none = frame.where(F.lit(False)).withColumns({c: F.lit(None).cast("double") for c in ("z_hat", "value_hat", "low", "high")})
        return none.withColumn("error", F.col("value_hat") - F.col("target_value"))
    fits = F.broadcast(frame.sparkSession.createDataFrame(solved, kinds))
    slopes = [F.col(f"b{i}") for i in range(len(names))]
    levels = rest.join(fits, "fold").select("fold", "direction", level(slopes).alias("__level"))
    tests = frame.withColumn("fold", F.col("target_period").cast("long")).join(fits, "fold").join(levels, ["fold", "direction"], "left")
    z = F.coalesce("__level", F.lit(0.0)) + reduce(lambda a, b: a + b, [b * x for b, x in zip(slopes, features.values(), strict=True)])
    out = with_interval(tests.withColumn("z_hat", z), F.col("sd"))
    return out.select(*frame.columns, "z_hat", "value_hat", "low", "high", (F.col("value_hat") - F.col("target_value")).alias("error"))


def fold_sums(frame: DataFrame, x: list[Column], periods: list[int]) -> tuple[DataFrame, DataFrame]:
    """Training moments of each fold by direction (fold, direction, moments), and one row a
    fold: ``within_sums``, the last training period, how many rows were taken off, and how
    many earlier rows the fold's entities have by a count of their own."""
    k, held = len(x), fields(len(x))
    rows = frame.select(F.col("target_period").cast("long").alias("t"), "entity", "direction", *[c.alias(f"x{i}") for i, c in enumerate(x)], F.col("z_target").alias("y"))
    cells = rows.groupBy("t", "entity", "direction").agg(*moment_sums([F.col(f"x{i}") for i in range(k)], F.col("y"))).where("n > 0")
    by_period = cells.groupBy("direction", "t").agg(*added(k))
    # a mark of no rows for each fold and direction, at which the running sums are read
    folds = F.explode(F.array(*[F.lit(int(p)).cast("long") for p in periods]))
    marks = by_period.select("direction").distinct().select("direction", folds.alias("t")).withColumns({f: F.lit(0).cast(dict(by_period.dtypes)[f]) for f in held})
    both = by_period.withColumn("last", F.col("t")).withColumn("mark", F.lit(False)).unionByName(marks.withColumn("last", F.lit(None).cast("long")).withColumn("mark", F.lit(True)))
    earlier = Window.partitionBy("direction").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    before = both.select("direction", "mark", F.col("t").alias("fold"), F.max("last").over(earlier).alias("last"), *[F.sum(f).over(earlier).alias(f) for f in held]).where("mark and n > 0")
    # what the fold's own entities had before it
    tests = rows.where(F.col("t").isin(periods)).select("entity", F.col("t").alias("fold")).distinct()
    own = cells.join(tests, "entity").where("t < fold").groupBy("fold", "direction").agg(*added(k))
    own = own.select("fold", "direction", *[F.col(f).alias(f"own_{f}") for f in held])
    rest = before.join(own, ["fold", "direction"], "left").select("fold", "direction", "last", F.coalesce("own_n", F.lit(0)).alias("n_off"), *[(F.col(f) - F.coalesce(f"own_{f}", F.lit(0))).alias(f) for f in held])
    seen = Window.partitionBy("entity").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    counted = cells.groupBy("entity", "t").agg(F.sum("n").alias("m")).withColumn("m", F.coalesce(F.sum("m").over(seen), F.lit(0)))
    counted = counted.join(tests.select("entity", F.col("fold").alias("t")), ["entity", "t"]).groupBy(F.col("t").alias("fold")).agg(F.sum("m").alias("n_seen"))
    off = rest.groupBy("fold").agg(F.max("last").alias("last"), F.sum("n_off").alias("n_off"))
    return rest.where("n > 0").drop("last", "n_off"), within_sums(rest, k, ["fold"]).join(off, "fold").join(counted, "fold", "left")


def guard_fold(row) -> None:
    """The two guards, from a row of ``fold_sums``."""
    if row["last"] is not None and row["last"] >= row["fold"]:
        raise ValueError(f"leakage: training reaches period {row['last']}, the test starts at {row['fold']}")
    if row["n_off"] != (row["n_seen"] or 0):
        raise ValueError(f"leakage: of {row['n_seen']} earlier rows of the entities of period {row['fold']}, {row['n_off']} were left out")


def assert_earlier(train: DataFrame, test: DataFrame, order: str) -> None:
    a, b = train.agg(F.max(order)).first()[0], test.agg(F.min(order)).first()[0]
    if a is not None and b is not None and a >= b:
        raise ValueError(f"leakage: training reaches {order} {a}, the test starts at {b}")


def assert_no_overlap(train: DataFrame, test: DataFrame, entity: str) -> None:
    both = train.select(entity).intersect(test.select(entity)).limit(5).collect()
    if both:
        raise ValueError(f"leakage: {entity} in both folds, for example {[r[0] for r in both]}")


def shuffled_targets(frame: DataFrame, key: list[str], seed: int = SEED) -> DataFrame:
    """The control: targets dealt to other rows by one permutation (z and value
    together). Ranks come from hashed order inside hash buckets joined bucket by bucket,
    so no task sees all rows."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *key))
    h2 = F.md5(F.concat_ws("|", F.lit(str(seed + 1)), *key))
    bucket = F.pmod(F.xxhash64(*key), F.lit(64))
    rows = frame.withColumn("__b", bucket)
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__b").orderBy(h))).withColumn("__m", F.row_number().over(Window.partitionBy("__b").orderBy(h2)))
    donors = rows.select("__b", F.col("__m").alias("__n"), F.col("z_target").alias("__z"), F.col("target_value").alias("__v"))
    return rows.join(donors, ["__b", "__n"]).withColumn("z_target", F.col("__z")).withColumn("target_value", F.col("__v")).select(frame.columns)


def shuffled_control(frame: DataFrame, stage1: Fit, first_period: int, key: list[str], age: str = "source_age", seed: int = SEED, **folds) -> DataFrame:
    """(n, baseline, mae) of the walk-forward refitted on shuffled targets: the model's
    error (``model``) and the baselines' on the same rows. A model that still beats
    them has seen what it should not."""
    # written once: the folds read it many times
    errors = walk_forward(kept(shuffled_targets(frame, key, seed)), stage1, first_period, age, **folds)
    return baseline_errors(errors.withColumnRenamed("value_hat", "model"), ["model", "b_mean", "b_folk", "b_same_z", "b_persist"])


def cluster_bootstrap(errors: DataFrame, entity: str, error: str, draws: int = DRAWS, level: float = 0.95, seed: int = SEED) -> DataFrame:
    """(mae, n, n_entities, low, high): the mean absolute error with its interval over draws of
    as many entities, with replacement. Entities are summed first; rows without an entity or
    an error are left out."""
    known = errors.where(F.col(entity).isNotNull() & F.col(error).isNotNull())
    per = known.groupBy(entity).agg(F.sum(F.abs(error)).alias("s"), F.count("*").alias("n"))
    drawn = resampled_sums(per, entity, ["s", "n"], draws, seed)
    ends = drawn.agg(*interval(F.col("s") / F.col("n"), level))
    return per.agg((F.sum("s") / F.sum("n")).alias("mae"), F.sum("n").alias("n"), F.count("*").alias("n_entities")).crossJoin(ends)  # one row each


def probit(df: DataFrame, features: dict[str, Column], moved: Column, steps: int = 12) -> Fit:
    """Probit by iterated weighted least squares; each step is one aggregation."""
    names = list(features)
    beta = np.zeros(len(names))
    fit = None
    # read once a step, computed once
    df = df.select(*[c.alias(f"x{i}") for i, c in enumerate(features.values())], moved.alias("moved")).persist()
    features, moved = {n: F.col(f"x{i}") for i, n in enumerate(names)}, F.col("moved")
    for _ in range(steps):
        eta = reduce(lambda a, b: a + b, [F.lit(float(b)) * c for b, c in zip(beta, features.values(), strict=True)])
        eta = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), eta))
        phi, cdf = density(eta), cumulative(eta)
        w = phi * phi / F.greatest(F.lit(1e-9), cdf * (1 - cdf))
        z = eta + (moved - cdf) / F.greatest(F.lit(1e-9), phi)
        root = F.sqrt(w)
        fit = ols(df, {n: root * c for n, c in features.items()}, root * z)
        done = np.max(np.abs(fit.coef - beta)) < 1e-8
        beta = fit.coef
        if done:
            break
    df.unpersist()
    return fit


def density(x: Column) -> Column:
    return F.exp(-x * x / 2) / float(np.sqrt(2 * np.pi))


def cumulative(x: Column) -> Column:
    """Normal distribution function by a rational series of erfc (error below 2e-7)."""
    a = F.abs(x) / float(np.sqrt(2))
    t = 1 / (1 + 0.5 * a)
    # fixed values: coefficients of the published erfc approximation
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    series = reduce(lambda acc, k: acc * t + k, c[::-1][1:], F.lit(c[-1]))
    tail = t * F.exp(-a * a + series) / 2
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def inverse_mills(fit: Fit, features: dict[str, Column]) -> Column:
    eta = linear(fit, features)
    return density(eta) / F.greatest(F.lit(1e-12), cumulative(eta))
