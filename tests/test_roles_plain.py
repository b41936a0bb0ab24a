"""Mixtures, stability, descriptions and the selection model against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import linmod, roles


@pytest.fixture(scope="module")
def reduced(spark):
    rng = np.random.default_rng(14)
    centres = np.array([[-3.0, 0.0], [3.0, 0.5], [0.0, 4.0]])
    pts = [(i, i % 12, *(centres[i % 3] + rng.normal(size=2) * (0.4 + 0.3 * (i % 3))).tolist(), float(rng.uniform(1, 9))) for i in range(360)]
    frame = spark.createDataFrame(pts, "id int, t int, x double, y double, w double")
    return roles.reduce_dimensions(frame, ["x", "y"], 0.99)[0].cache()


def log_densities(model, v):
    """(rows, components): log of weight times normal density."""
    out = []
    for w, g in zip(model.weights, model.gaussians, strict=True):
        d, c = v - g.mean.toArray(), g.cov.toArray()
        out.append(math.log(w) - 0.5 * (v.shape[1] * math.log(2 * math.pi) + math.log(np.linalg.det(c)) + np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d)))
    return np.stack(out, axis=1)


def test_components_keep_the_variance(spark, reduced):
    rows = reduced.orderBy("id").collect()
    x = np.array([[r.x, r.y] for r in rows])
    values, axes = np.linalg.eigh(np.cov(x.T))
    want = x @ axes[:, ::-1]
    got = np.array([r.pcs.toArray() for r in rows])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8) and values[::-1][0] >= values[::-1][1]


def test_roles_are_the_likeliest_components(reduced):
    model = roles.mixture(reduced, 3, starts=2)
    rows = model.transform(reduced).orderBy("id").collect()
    logs = log_densities(model, np.array([r.pcs.toArray() for r in rows]))
    assert [r.cluster for r in rows] == logs.argmax(axis=1).tolist()
    total = np.logaddexp.reduce(logs, axis=1)
    assert model.summary.logLikelihood == pytest.approx(total.sum(), rel=1e-3)
    # of several starts the best is taken
    each = [roles.mixture(reduced, 3, starts=1, seed=s).summary.logLikelihood for s in (1, 2)]
    assert model.summary.logLikelihood == pytest.approx(max(each))


def test_weights_count_as_copies(reduced):
    """A row of weight two is two rows: the likelihood of the weighted fit counts it twice."""
    doubled = reduced.withColumn("k", F.when(F.col("id") % 2 == 0, 2.0).otherwise(1.0))
    model = roles.mixture(doubled, 3, starts=1, weight="k")
    rows = doubled.collect()
    total = np.logaddexp.reduce(log_densities(model, np.array([r.pcs.toArray() for r in rows])), axis=1)
    assert model.summary.logLikelihood == pytest.approx(float(total @ np.array([r.k for r in rows])), rel=1e-3)


def test_held_out_likelihood(reduced):
    got = dict(roles.held_out_log_likelihood(reduced, "t", [2, 3, 4]))
    rows = reduced.collect()
    cut = np.quantile([r.t for r in rows], 0.75)
    late = np.array([r.pcs.toArray() for r in rows if r.t > cut])
    for k, value in got.items():
        model = roles.mixture(reduced.where(F.col("t") <= float(cut)), k, starts=1)
        assert value == pytest.approx(np.logaddexp.reduce(log_densities(model, late), axis=1).mean(), abs=1e-6)
    assert got[3] > got[2]


def test_best_overlap(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in zip(rng.integers(0, 4, 200), rng.integers(0, 5, 200), strict=True)]
    got = {r.cluster: r.jaccard for r in roles.jaccard_best(spark.createDataFrame(pairs, "cluster int, other int")).collect()}
    for a in range(4):
        own = {i for i, p in enumerate(pairs) if p[0] == a}
        others = [{i for i, p in enumerate(pairs) if p[1] == b} for b in range(5)]
        assert got[a] == pytest.approx(max(len(own & o) / len(own | o) for o in others))


def test_descriptions(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 3)), *[float(x) for x in rng.normal(size=3)], float(i % 7)) for i in range(90)]
    got = {r.cluster: r for r in roles.describe_clusters(spark.createDataFrame(rows, "id int, cluster int, a double, b double, c double, w double"), ["a", "b", "c"], "id", "w", top=2, exemplars=4).collect()}
    for k in range(3):
        own = [r for r in rows if r[1] == k]
        means = {n: float(np.mean([r[i] for r in own])) for n, i in (("a", 2), ("b", 3), ("c", 4))}
        traits = sorted(means.items(), key=lambda x: -abs(x[1]))[:2]
        assert got[k].n == len(own) and [t.name for t in got[k].traits] == [n for n, _ in traits]
        assert [t.value for t in got[k].traits] == pytest.approx([v for _, v in traits])
        assert got[k].exemplars == [str(r[0]) for r in sorted(own, key=lambda r: (-r[5], r[0]))[:4]]


def test_probit_is_the_maximum(spark):
    """Coefficients and Mills ratios of a plain Newton search of the likelihood."""
    rng = np.random.default_rng(6)
    x = np.c_[np.ones(1500), rng.normal(size=(1500, 2))]
    moved = (x @ [0.3, 0.8, -0.5] + rng.normal(size=1500) > 0).astype(float)
    cdf, pdf = np.vectorize(lambda t: 0.5 * math.erfc(-t / math.sqrt(2))), lambda t: np.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    beta = np.zeros(3)
    for _ in range(30):
        eta = x @ beta
        q = 2 * moved - 1
        ratio = q * pdf(eta) / cdf(q * eta)
        beta = beta + np.linalg.solve((x * (ratio * (ratio + eta))[:, None]).T @ x, x.T @ ratio)
    df = spark.createDataFrame([(float(a), float(b), float(m)) for (_, a, b), m in zip(x, moved, strict=True)], "a double, b double, m double")
    features = {"one": F.lit(1.0), "a": F.col("a"), "b": F.col("b")}
    fit = linmod.probit(df, features, F.col("m"))
    assert fit.coef == pytest.approx(beta, abs=1e-5)
    rows = df.select("a", "b", linmod.inverse_mills(fit, features).alias("mills")).limit(50).collect()
    for r in rows:
        eta = beta @ [1.0, r.a, r.b]
        assert r.mills == pytest.approx(pdf(eta) / cdf(eta), abs=1e-4)


def test_draws_are_fitted_in_one_pass_a_round(spark, reduced):
    """Each mixture is the one that the library fits alone, and more of them take no more rounds."""
    from pyspark.ml.clustering import GaussianMixture

    for own, (k, seed) in zip(roles.mixtures(reduced, [(3, 4), (2, 5)]), [(3, 4), (2, 5)], strict=True):
        alone = GaussianMixture(k=k, featuresCol="pcs", seed=seed, maxIter=60).fit(reduced)
        assert np.allclose(own.weights, alone.weights, atol=1e-9)
        assert all(np.allclose(a.cov.toArray(), b.cov.toArray(), atol=1e-9) for a, b in zip(own.gaussians, alone.gaussians, strict=True))
    labelled = reduced.select("id", (F.col("id") % 3).alias("cluster"))
    spark.sparkContext.setJobGroup("draws", "draws")
    found = roles.stability(reduced, labelled, ["id"], 3, draws=12).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("draws"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(found) == 3 and jobs < 200
