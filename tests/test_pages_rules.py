import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit as A
from tidemark.operators import serving as S


@pytest.mark.parametrize("offset", [0, 35, 400, 1170, 5000])
def test_deep_pages(spark, offset):
    """Ties, nulls and one value of most rows; every page is that of the whole sort."""
    rng = random.Random(offset)
    rows = [(i, None if i % 50 == 7 else 5.0 if i % 3 else float(rng.randrange(40))) for i in range(1200)]
    df = spark.createDataFrame(rows, "id int, x double").repartition(5)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))[offset : offset + 25]
    got = S.page(df, [*S.descending("x"), F.col("id")], 25, offset, top=60, ranges=16)
    assert [tuple(r) for r in got.collect()] == want
    assert S.page(df.limit(0), [F.col("id")], 5, offset, top=3).count() == 0


def test_a_deep_page_sorts_few_rows(spark):
    df = spark.range(50_000).select((F.hash("id")).alias("x"), "id")
    deep = S.page(df, [F.col("x"), F.col("id")], 10, 40_000, top=1000, ranges=64)
    plan = deep._jdf.queryExecution().toString()
    assert "offset=4" not in plan and "Offset 40000" not in plan and deep.count() == 10


def test_placed(spark):
    got = S.search(spark.createDataFrame([(1, "Ann", "ann", "A"), (2, "Anna", "anna", "A+B"), (3, "Bo", "bo", "A")], "person_id int, display_name string, normalized_name string, systems string"), "ANN", 5)
    assert [(r.person_id, r.place) for r in got.orderBy("place").collect()] == [(2, 1), (1, 2)]


def test_tracing_meets_by_bucket(spark):
    """Numbers of many lengths against every candidate of their document, one by one."""
    rng = random.Random(2)
    texts, facts = [], []
    for doc in range(12):
        values = [round(rng.uniform(-3, 3) * 10 ** rng.randrange(-4, 6), rng.randrange(0, 7)) for _ in range(25)]
        shown = [f"{v + rng.choice([0, 0, 10.0 ** -rng.randrange(0, 5)]):.{rng.randrange(0, 6)}f}{rng.choice(['', '', '%'])}" for v in values]
        texts.append((doc, " and ".join(shown) + " 99999999999999999999 0.00000000012345"))
        facts += [(doc, v) for v in values] + [(doc, 1e20), (doc, 1e300), (doc, -0.0)]
    found = A.numbers(spark.createDataFrame(texts, "doc int, text string"))
    cand = spark.createDataFrame(facts, "doc int, candidate double")
    own = {}
    for doc, c in facts:
        own.setdefault(doc, []).append(c)
    got = A.trace(found, cand)
    for r in got.collect():
        want = any(abs(r.value - c) <= r.window + 1e-9 or (r.as_share is not None and abs(r.as_share - c) <= r.window / 100 + 1e-9) for c in own[r.doc])
        assert r.traced == want, r
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    ranged = [line for line in plan.split("\n") if "Join" in line and "abs(" in line]
    assert ranged and all("(bucket#" in line and "= bucket#" in line.replace("(bucket#", "= bucket#") for line in ranged)


def test_direction_rules(spark):
    rules = A.Rules(metric=("usage", "share"))
    said = {
        1: "His usage rises next year.", 2: "The share of points rises. It falls later.", 3: "The interval of usage grows between the ends.",
        4: "He improves. The usage of others is known to everybody who follows the game and drops.", 5: "Usage surely falls, and share drops.", 6: "", 7: None,
    }
    docs = spark.createDataFrame(list(said.items()), "doc int, text string")
    got = {r.doc: (r.n_up, r.n_down, r.n_certain) for r in A.direction_words(docs, rules).collect()}
    assert [got.get(d) for d in range(1, 7)] == [(1, 0, 0), (1, 0, 0), (0, 0, 0), (0, 0, 0), (0, 2, 1), (0, 0, 0)]
    outcome = spark.createDataFrame([(1, -0.1, True, False), (2, 0.1, True, True), (3, -0.1, None, False), (5, 0.1, False, None), (6, None, True, False)], "doc int, change double, confident boolean, beats_baseline boolean")
    broken = sorted((r.doc, r.rule, r.n) for r in A.rule_errors(docs, outcome, rules).collect())
    assert broken == [(1, "confidence", 1), (1, "direction", 1), (5, "certainty", 1), (5, "direction", 2), (6, "confidence", 1)]
