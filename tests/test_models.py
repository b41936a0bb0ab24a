import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import linmod, roles
from tidemark.operators.resampling import copies, resampled_sums

KIND = "entity string, direction string, z_source double, z_target double, source_age double, log_source_weight double, gap int, target_mean double, target_sd double, target_period int, source_value double, target_value double"


@pytest.fixture(scope="module")
def stage1(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=500)
    rows = [(float(a), float(0.8 * a + rng.normal() * 0.3), float(rng.uniform(22, 33)), float(rng.uniform(6.5, 7.8))) for a in z]
    return linmod.fit_persistence(spark.createDataFrame(rows, "z_from double, z_to double, age double, log_weight double"))


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(200):
        z = rng.normal()
        t = 0.7 * z + rng.normal() * 0.4
        rows.append((f"p{i % 150}", ["A->B", "B->A"][i % 2], float(z), float(t), float(rng.uniform(22, 32)), float(rng.uniform(6.2, 7.6)), int(rng.integers(1, 3)), 0.2, 0.05, int(rng.integers(2013, 2023)), 0.2 + 0.05 * float(z), 0.2 + 0.05 * float(t)))
    return spark.createDataFrame(rows, KIND)


def test_parameter_recovery(stage1, frame):
    assert stage1["z"] == pytest.approx(0.8, abs=0.05) and stage1.r2 > 0.8
    fit = linmod.fit_translation(frame, stage1)
    assert fit["persisted"] == pytest.approx(0.7 / 0.8, abs=0.12) and fit.residual_sd == pytest.approx(0.4, abs=0.08)
    rows = linmod.predict(frame, fit).collect()
    wide = linmod.predict(frame, fit, level=0.95).collect()
    assert all(w.high - w.low > r.high - r.low > 0 for r, w in zip(rows, wide))
    assert np.mean([r.low <= r.target_value <= r.high for r in rows]) == pytest.approx(0.8, abs=0.1)
    unseen = frame.limit(1).withColumn("direction", F.lit("C->D"))
    got = linmod.predict(unseen, fit).withColumn("by_hand", linmod.linear(fit, linmod.transition_features(stage1))).first()
    assert got.z_hat == pytest.approx(got.by_hand)


def dummies(rows, persisted, train, test):
    """z_hat of ``test`` by least squares with one column a direction, at once."""
    ways = sorted({r.direction for r in train})
    line = lambda r: [float(r.direction == d) for d in ways] + [persisted(r), r.log_source_weight, float(r.gap)]
    coef, *_ = np.linalg.lstsq(np.array([line(r) for r in train]), np.array([r.z_target for r in train]), rcond=None)
    return [float(np.dot(line(r), coef)) for r in test]


def by_hand(stage1):
    mean = stage1.extra["mean_log_weight"]
    return lambda r: stage1["one"] + stage1["z"] * r.z_source + stage1["age"] * (r.source_age - 27) + stage1["age2"] * (r.source_age - 27) ** 2 + stage1["log_weight"] * (r.log_source_weight - mean)


def test_a_thousand_directions(spark, stage1):
    """The absorbed levels and the coefficients are those of one column a direction."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(4000):
        d, z = int(rng.integers(0, 1000)), rng.normal()
        rows.append((f"p{i}", f"d{d:04d}", float(z), float(d / 500 + 0.6 * z + rng.normal() * 0.2), 25.0 + i % 9, float(rng.uniform(6, 8)), 1 + i % 2, 0.0, 1.0, 2010, 0.0, 0.0))
    many = spark.createDataFrame(rows, KIND)
    fit = linmod.fit_translation(many, stage1)
    assert len(fit.coef) == 3 and fit.absorbed == many.select("direction").distinct().count() == fit.extra["levels"].count() > 950
    got = linmod.predict(many, fit).select("entity", "z_hat").collect()
    plain = many.collect()
    want = dict(zip([r.entity for r in plain], dummies(plain, by_hand(stage1), plain, plain), strict=True))
    assert max(abs(r.z_hat - want[r.entity]) for r in got) < 1e-8
    rss = sum((r.z_target - want[r.entity]) ** 2 for r in plain)
    assert fit.rss == pytest.approx(rss) and fit.residual_sd == pytest.approx((rss / (4000 - 3 - fit.absorbed)) ** 0.5)


def test_few_rows_and_collinear_columns(spark):
    few = spark.createDataFrame([(0.0, 0.0, 25.0, 7.0)] * 5, "z_from double, z_to double, age double, log_weight double")
    with pytest.raises(ValueError):
        linmod.fit_persistence(few)
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(10)], "x double, y double")
    fit = linmod.ols(df, {"a": F.col("x"), "b": F.col("x")}, F.col("y"))
    assert fit["a"] == pytest.approx(1.0) and fit["b"] == pytest.approx(1.0)


def test_walk_forward_and_guards(stage1, frame):
    out = linmod.walk_forward(frame, stage1, 2018)
    assert out.count() > 50 and out.agg(F.min("target_period")).first()[0] >= 2018
    with pytest.raises(ValueError):
        linmod.assert_earlier(frame, frame, "target_period")
    with pytest.raises(ValueError):
        linmod.assert_no_overlap(frame, frame, "entity")
    with pytest.raises(ValueError, match="reaches period"):
        linmod.guard_fold({"fold": 2000, "last": 2000, "n_off": 0, "n_seen": 0})
    with pytest.raises(ValueError, match="earlier rows"):
        linmod.guard_fold({"fold": 2000, "last": 1999, "n_off": 3, "n_seen": 4})
    none = frame.where(F.lit(False))
    linmod.assert_earlier(none, frame, "target_period")
    linmod.assert_no_overlap(none, frame, "entity")
    assert linmod.walk_forward(frame, stage1, 3000).count() == 0


def test_walk_forward_equals_refitting(spark, stage1, frame):
    """Every fold against a fit of its own training rows; few directions, one of them new in
    a fold, and rows without an outcome."""
    late = frame.limit(6).withColumn("direction", F.lit("C->A")).withColumn("target_period", F.lit(2020))
    frame = frame.unionByName(late).unionByName(frame.limit(3).withColumn("z_target", F.lit(None).cast("double")))
    rows = [r for r in frame.collect()]
    got = {}
    for r in linmod.walk_forward(frame, stage1, 2017).collect():
        got.setdefault(r.target_period, []).append((r.entity, r.direction, r.z_source, r.z_hat))
    assert len(got) >= 4
    for t in range(2017, 2023):
        test = [r for r in rows if r.target_period == t]
        out = {r.entity for r in test}
        train = [r for r in rows if r.target_period < t and r.entity not in out and r.z_target is not None]
        ways = {r.direction for r in train}
        known = [r for r in test if r.direction in ways]
        want = sorted(zip([(r.entity, r.direction, r.z_source) for r in known], dummies(rows, by_hand(stage1), train, known), strict=True))
        own = sorted(((e, d, z), hat) for e, d, z, hat in got[t] if d in ways)
        assert [k for k, _ in own] == [k for k, _ in want] and np.allclose([v for _, v in own], [v for _, v in want], atol=1e-8)
        assert len(got[t]) == len(test)


def test_jobs_do_not_grow_with_the_folds(spark, stage1, frame):
    def jobs(first):
        spark.sparkContext.setJobGroup(f"folds{first}", "folds")
        linmod.walk_forward(frame, stage1, first, min_train=1)
        ids = spark.sparkContext.statusTracker().getJobIdsForGroup(f"folds{first}")
        spark.sparkContext._jsc.clearJobGroup()
        return len(ids)

    few, many = jobs(2022), jobs(2014)
    assert many <= few + 2


def test_copies_of_a_draw(spark):
    """They add up to n, are the same on other partitions, and spread as a multinomial's do."""
    rows = spark.range(1500).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).alias("v"))
    one, two = ({r.k: r.copies for r in copies(x, ["k"], 40, 9).collect()} for x in (rows.repartition(3), rows.repartition(11, "v")))
    assert one == two and len(one) == 1500
    times = np.array([one[k] for k in sorted(one)])
    assert (times.sum(axis=0) == 1500).all() and times.var() == pytest.approx(1 - 1 / 1500, abs=0.03)
    assert abs(np.corrcoef(times[:, 0], times[:, 1])[0, 1]) < 0.1
    sums = {r.draw: r.v for r in resampled_sums(rows, "k", ["v"], 40, 9).collect()}
    v = np.array([int(k) % 7 for k in sorted(one)])
    assert [sums[d] for d in range(40)] == [float(x) for x in v @ times]
    assert copies(rows.limit(0), ["k"], 3, 1).count() == 0 and resampled_sums(rows.limit(0), "k", ["v"], 3, 1).count() == 0


def test_interval_against_plain_resampling(spark):
    rng = np.random.default_rng(8)
    rows = [(f"e{i}", float(x)) for i in range(300) for x in rng.normal(size=int(rng.integers(1, 6))) * (1 + i % 3)]
    got = linmod.cluster_bootstrap(spark.createDataFrame(rows, "entity string, error double"), "entity", "error").first()
    names = sorted({e for e, _ in rows})
    s, n = (np.array([sum(f(x) for e, x in rows if e == name) for name in names]) for f in (abs, lambda x: 1))
    picks = rng.integers(0, len(names), (4000, len(names)))
    low, high = np.quantile(s[picks].sum(axis=1) / n[picks].sum(axis=1), [0.025, 0.975])
    assert got.mae == pytest.approx(s.sum() / n.sum()) and abs(got.low - low) < 0.02 * got.mae and abs(got.high - high) < 0.02 * got.mae


def test_control_and_bootstrap(spark, frame):
    mixed = linmod.shuffled_targets(frame, ["entity", "direction", "z_source"])
    a, b = ([sorted(round(r.z_target, 9) for r in x.collect())] for x in (frame, mixed))
    assert a == b and abs(mixed.stat.corr("z_source", "z_target")) < 0.3
    errors = frame.withColumn("error", F.col("z_target") - F.col("z_source"))
    row = linmod.cluster_bootstrap(errors, "entity", "error", draws=300).first()
    assert row.low < row.mae < row.high and row.n == 200 and row.n_entities == 150


def test_probit(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=3000)
    y = (0.5 + 1.2 * x + rng.normal(size=3000) > 0).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    features = {"one": F.lit(1.0), "x": F.col("x")}
    fit = linmod.probit(df, features, F.col("y"))
    assert fit["one"] == pytest.approx(0.5, abs=0.12) and fit["x"] == pytest.approx(1.2, abs=0.15)
    assert df.agg(F.min(linmod.inverse_mills(fit, features))).first()[0] > 0
    got = spark.range(1).select(linmod.cumulative(F.lit(0.0)), linmod.cumulative(F.lit(1.959963984540054)), linmod.cumulative(F.lit(-1.2815515655446004))).first()
    assert list(got) == pytest.approx([0.5, 0.975, 0.1], abs=1e-6)


def test_neighbours_blocks_and_clusters(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, [float(v) for v in rng.normal(size=4)]) for i in range(60)] + [(100, 7, [0.0] * 4), (101, 7, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id int, p int, v array<double>")
    got = {(r.id, r["rank"]): r.neighbour for r in roles.neighbours(df, "id", "v", "p", k=5, block=7).collect()}
    for i, p, v in rows[:60]:
        near = sorted((float(np.linalg.norm(np.array(v) - np.array(w))), j) for j, q, w in rows if q == p and j != i)[:5]
        assert [got[i, k + 1] for k in range(5)] == [j for _, j in near]
    assert not any(i >= 100 for i, _ in got)
    one = roles.neighbours(df, "id", "v", "p", k=5, block=7, of=F.col("id") == 13).collect()
    assert sorted((r["rank"], r.neighbour) for r in one) == [(n, got[13, n]) for n in range(1, 6)]
    centres = [(-4.0, 0.0), (4.0, 0.0), (0.0, 5.0)]
    pts = [(i, i % 10, float(centres[i % 3][0] + rng.normal() * 0.3), float(centres[i % 3][1] + rng.normal() * 0.3)) for i in range(300)]
    frame = spark.createDataFrame(pts, "id int, t int, x double, y double")
    reduced, k = roles.reduce_dimensions(frame, ["x", "y"], 0.99)
    assert k == 2
    labelled = roles.mixture(reduced, 3, starts=2).transform(reduced)
    assert labelled.select(F.col("id") % 3, "cluster").distinct().count() == 3
    steady = roles.stability(reduced, labelled, ["id"], 3, draws=1).collect()
    assert len(steady) == 3 and all(r.stability > 0.4 for r in steady)
    said = roles.describe_clusters(labelled, ["x", "y"], "id", "t", top=1, exemplars=2).collect()
    assert all(len(r.traits) == 1 and len(r.exemplars) == 2 for r in said)
    scores = roles.held_out_log_likelihood(reduced, "t", [2, 3])
    assert scores[1][1] > scores[0][1]


def test_neighbours_prune_blocks(spark):
    """Clustered rows, ties, equal rows and a period smaller than k: the result is that of
    all pairs, and few pairs are compared."""
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(30, 6)) * 8
    v = centres[rng.integers(0, 30, 1500)] + rng.normal(size=(1500, 6)) * 0.3
    v[10:25] = v[10]
    v[100:120] = np.round(v[100:120])
    rows = [(i, "a", [float(x) for x in y]) for i, y in enumerate(v)] + [(5000 + i, "b", [float(i), 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "id int, p string, v array<double>")
    got = {}
    for r in roles.neighbours(df, "id", "v", "p", k=6, block=50).collect():
        got.setdefault(r.id, {})[r["rank"]] = (r.neighbour, r.distance)
    for i in range(1500):
        gap = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        gap[i] = np.inf
        want = np.lexsort((np.arange(1500), gap))[:6]
        assert [got[i][n][0] for n in range(1, 7)] == want.tolist() and np.allclose([got[i][n][1] for n in range(1, 7)], gap[want])
    assert [[got[5000 + i][n][0] - 5000 for n in range(1, 4)] for i in range(4)] == [[1, 2, 3], [0, 2, 3], [1, 3, 0], [2, 1, 0]] and len(got[5000]) == 3
    sized = df.select(F.col("p").alias("__g"), F.col("id").alias("__id"), F.col("v").alias("__v"), F.lit(True).alias("__of"), F.lit(1500).alias("__size"))
    blocks = roles.Blocks.of(sized, 50)
    assert blocks.compared(6) < 0.15 and max(x[4] for g in blocks.rings.values() for x in g) <= 120


def test_neighbours_memory_of_many_that_ask():
    """Rows that ask one block stream past it: memory does not grow with their number."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 8))

    def batches(n):
        for asks, m in ((False, 600), *((True, 1000) for _ in range(n // 1000))):
            x = v[np.arange(m) % 600]
            yield pa.record_batch([pa.array(["a"] * m), pa.array([asks] * m), pa.array(np.arange(m) % 600), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 8).cast(pa.list_(pa.float64()))], ["__g", "__asks", "__id", "__v"])

    peaks = []
    for n in (2000, 20000):
        tracemalloc.start()
        rows = [(i, j) for b in roles._nearest(4)(batches(n)) for i, j in zip(b["__id"].to_pylist()[:8], b["neighbour"].to_pylist()[:8], strict=True)]
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    gap = ((v - v[0]) ** 2).sum(axis=1)
    assert [j for i, j in rows[:4]] == np.argsort(gap)[1:5].tolist() and peaks[1] < 1.3 * peaks[0]


def test_shuffled_control_writes_targets_once(spark, stage1, frame, monkeypatch):
    """The folds read the shuffled targets from files; they do not shuffle them for each reading."""
    seen, told = [], linmod.walk_forward
    monkeypatch.setattr(linmod, "walk_forward", lambda df, *args, **more: seen.append(df) or told(df, *args, **more))
    linmod.shuffled_control(frame, stage1, 2000, ["entity", "direction", "z_source"])
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
