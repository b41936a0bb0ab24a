import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import identity, quantiles
from tidemark.operators.quantiles import grouped_quantiles


def plain(values, q):
    v = sorted(x for x in values if x is not None and np.isfinite(x))
    return float(np.quantile(v, q)) if v else None


@pytest.mark.parametrize("few", [1, 2048])
def test_groups_of_every_kind(spark, monkeypatch, few):
    """One group of most rows, ties, values of many sizes, one value, none that count."""
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BINS", 16)
    rng = np.random.default_rng(5)
    rows = [("hot", float(x)) for x in rng.normal(size=3000)] + [("ties", float(x)) for x in rng.integers(0, 4, 200)] + [("sizes", float(x)) for x in np.exp(rng.uniform(-200, 200, 150))]
    rows += [("one", 3.5)] * 9 + [("single", -1.0), (None, 2.0), (None, 4.0), ("none", None), ("none", float("nan")), ("none", float("inf")), ("mixed", None), ("mixed", -7.0), ("mixed", float("-inf"))]
    rows += [("wide", 1.7e308), ("wide", -1.7e308), ("wide", 1.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(6)
    got = {r.k: (r.a, r.b, r.c) for r in grouped_quantiles(df, ["k"], "x", {"a": 0.1, "b": 0.5, "c": 1.0}).collect()}
    groups = {}
    for k, x in rows:
        groups.setdefault(k, []).append(x)
    assert set(got) == set(groups)
    for k, v in groups.items():
        want = tuple(plain(v, q) for q in (0.1, 0.5, 1.0))
        if k == "wide":  # numpy's own difference of the two ends is infinite
            assert got[k][1:] == (1.0, 1.7e308)
        else:
            assert got[k] == (want if None in want else pytest.approx(want, rel=1e-12)), k
    assert grouped_quantiles(df.limit(0), ["k"], "x", {"a": 0.5}).count() == 0
    whole = grouped_quantiles(df.where("k = 'hot'"), [], "x", {"a": 0.5}).collect()
    assert [r.a for r in whole] == [pytest.approx(plain(groups["hot"], 0.5), rel=1e-12)]


def test_plan_holds_no_group(spark):
    df = spark.range(10_000).select((F.col("id") % 3).alias("k"), F.hash("id").alias("x"))
    plan = grouped_quantiles(df, ["k"], "x", {"a": 0.5})._jdf.queryExecution().toString()
    assert not any(w in plan.lower() for w in ("median", "percentile", "window", "cartesian"))


def test_covariates(spark):
    rows = spark.createDataFrame([("a", 2000, 20.0), ("a", 2001, 22.0), ("a", 2003, None), ("b", 2000, None), (None, 2000, 30.0), (None, 2001, None)], "e string, t int, age double")
    got = sorted((r.e or "", r.t, r.age) for r in identity.fill_covariate(rows, "e", "t", "age").collect())
    assert got == [("", 2000, 30.0), ("", 2001, None), ("a", 2000, 20.0), ("a", 2001, 22.0), ("a", 2003, 23.5), ("b", 2000, None)]
