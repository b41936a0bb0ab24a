import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cohort, identity, moments, shrink


def greedy(cands):
    out, s_used, t_used = [], set(), set()
    for c in sorted(cands, key=lambda c: (c[0], c[1], c[2], c[4] - c[3], c[4])):
        s, t = (c[0], c[1], c[2], c[3]), (c[0], c[1], c[2], c[4])
        if s not in s_used and t not in t_used:
            s_used.add(s)
            t_used.add(t)
            out.append(c)
    return set(out)


@pytest.mark.parametrize("max_gap", [2, 4])
def test_greedy_matches_the_loop(spark, max_gap):
    rng = random.Random(max_gap)
    rows = []
    for e in range(150):
        src, tgt = rng.sample(range(12), rng.randint(1, 6)), rng.sample(range(12), rng.randint(1, 6))
        rows += [(e, "A", "B", s, t) for s in src for t in tgt if 1 <= t - s <= max_gap]
    df = spark.createDataFrame(rows, "entity int, source_group string, target_group string, s int, t int").withColumn("gap", F.col("t") - F.col("s"))
    got = cohort.greedy_pairs(df, ["entity", "source_group", "target_group"], "s", "t", "gap", max_gap).drop("gap")
    assert {tuple(r) for r in got.collect()} == greedy(rows)


def test_transition_rules(spark):
    rows = [("a", "X", 1, 500), ("a", "Y", 2, 500), ("b", "X", 1, 500), ("b", "Y", 1, 5), ("b", "Y", 2, 500), ("c", "X", 1, 399), ("c", "Y", 2, 500), ("d", "X", 1, 500), ("d", "Y", 4, 500), ("e", "X", 1, 500), ("e", "Y", 3, 300)]
    got = cohort.transition_pairs(spark.createDataFrame(rows, "entity string, grp string, period int, weight int"))
    assert sorted((r.entity, r.gap, r.direction) for r in got.collect()) == [("a", 1, "X->Y"), ("e", 2, "X->Y")]


def test_standardize_is_weighted_and_covers_all_rows(spark):
    rows = [(1, 1.0, 1.0, True), (1, 3.0, 3.0, True), (1, 9.0, 5.0, False), (1, None, 2.0, True), (2, 5.0, 1.0, True)]
    out = moments.standardize(spark.createDataFrame(rows, "p int, x double, w double, ok boolean"), ["p"], ["x"], "w", "ok").collect()
    mean, sd = (1 + 9) / 4, 2**0.5
    by = {(r.p, r.x): r.z_x for r in out}
    assert by[1, 1.0] == pytest.approx((1 - mean) / sd) and by[1, 9.0] == pytest.approx((9 - mean) / sd) and by[1, None] is None and by[2, 5.0] is None
    pop = moments.standardize_population(spark.createDataFrame([(1, 4.0), (1, 4.0)], "p int, x double"), ["p"], ["x"]).collect()
    assert [r.x for r in pop] == [0.0, 0.0]


def test_fill_covariate(spark):
    rows = [("p1", 2019, 25.0), ("p1", 2018, None), ("p2", 2020, None), (None, 2000, None), (None, 2000, 30.0)]
    out = identity.fill_covariate(spark.createDataFrame(rows, "p string, y int, age double"), "p", "y", "age")
    assert {(r.p, r.y, r.age) for r in out.collect()} == {("p1", 2019, 25.0), ("p1", 2018, 24.0), ("p2", 2020, None), (None, 2000, None), (None, 2000, 30.0)}


def test_crosswalk_rules(spark):
    s = "system string, id string, match_key string, birth double"
    anchor = spark.createDataFrame([("A", "1", "k1", 1990.0), ("A", "2", "k2", 1991.0), ("A", "3", "k2", 1970.0), ("A", "4", "k4", None), ("A", "5", "k5", 1980.0)], s)
    shared = spark.createDataFrame([("B", "1", "k1", 1990.0), ("B", "9", None, None)], s)
    other = spark.createDataFrame([("C", "a", "k1", 1991.0), ("C", "b", "k2", None), ("C", "c", "k4", None), ("C", "d", "zz", None), ("C", "e", "k5", 1999.0), ("C", "f", "k1", None), ("C", "g", None, None), ("C", "h", "k2", 1971.0)], s)
    over = spark.createDataFrame([("f", "5")], "other_id string, anchor_id string")
    ids = identity.crosswalk(anchor, shared, other, over)
    got = {(r.system, r.source_id): (r.person_id, r.method, r.confidence) for r in ids.collect()}
    assert got["C", "a"] == ("a_1", "name_and_age", 0.95) and got["C", "b"] == ("o_b", "name_ambiguous", 0.30)
    assert got["C", "c"] == ("a_4", "name_only_unique", 0.70) == got["C", "e"][:0] + ("a_4", "name_only_unique", 0.70) and got["C", "e"] == ("a_5", "name_only_unique", 0.70)
    assert got["C", "d"] == ("o_d", "unmatched", 1.0) and got["C", "f"] == ("a_5", "override", 1.0) and got["C", "g"][0] == "o_g"
    assert got["C", "h"] == ("a_3", "name_and_age", 0.95) and got["B", "1"] == ("a_1", "shared_id", 1.0) and got["B", "9"][0] == "a_9"
    people = spark.createDataFrame([("A", "1", None, None), ("B", "1", "Bee", 1990.5), ("C", "a", "Cee", 1991.0)], "system string, id string, name string, birth double")
    person = {r.person_id: r for r in identity.golden_persons(ids, people, ["A", "B", "C"]).collect()}
    assert (person["a_1"].display_name, person["a_1"].birth, person["a_1"].systems) == (None, 1990.5, "A+B+C")
    assert set(person) == {r.person_id for r in ids.collect()}


def test_beta_shrink(spark):
    rng = random.Random(7)
    rows = [(1, i, sum(rng.random() < rng.betavariate(36, 64) for _ in range(1)) + sum(rng.random() < 0.36 for _ in range(299)), 300) for i in range(200)]
    rows += [(1, 999, 3, 3), (2, 1, 5, 60), (2, 2, 0, 0)]
    out = {(r.p, r.i): r for r in shrink.beta_shrink(spark.createDataFrame(rows, "p int, i int, m int, a int"), "p", "m", "a").collect()}
    few = out[1, 999]
    assert few.raw_rate == 1.0 and few.shrunk_rate < 0.45 and few.data_weight < 0.05 and not few.reportable
    assert (out[2, 1].alpha, out[2, 1].beta) == (1.0, 1.0) and out[2, 2].raw_rate is None


def test_counterfactuals_and_support(spark):
    rows = [(f"m{i}", "X", 1, 500.0, 0.1 * i) for i in range(5)] + [(f"m{i}", "Y", 2, 500.0, 0.1 * i) for i in range(5)] + [("s1", "X", 1, 500.0, 0.2), ("s1", "X", 2, 500.0, 0.3), ("s2", "X", 2, 500.0, 5.0)]
    panel = spark.createDataFrame(rows, "entity string, grp string, period int, weight double, z_v double")
    m = spark.createDataFrame([("Y", 1, 1.0, 2.0), ("Y", 2, 3.0, 4.0)], "grp string, period int, mean double, sd double")
    pairs = cohort.transition_pairs(panel)
    got = {r.entity: r for r in cohort.counterfactuals(panel, pairs, m, "v", "X", "Y").collect()}
    assert set(got) == {"s1", "s2"} and got["s1"].source_period == 2 and got["s1"].target_mean == 3.0
    assert got["s1"].in_support and not got["s2"].in_support
