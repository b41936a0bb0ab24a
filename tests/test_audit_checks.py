import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit as A
from tidemark.operators import checks as C

FACTS = "doc int, fact_id string, statement string, value double, unit string"


def test_numbers_trace_to_facts(spark):
    docs = spark.createDataFrame([(1, "In 1,180 minutes the rate rose to 21.4% from 0.19; -3 is not there, nor 77."), (2, "nothing")], "doc int, text string")
    facts = spark.createDataFrame([(1, "F1", "minutes", 1180.0, "count"), (1, "F2", "rate", 0.2137, "fraction"), (1, "F3", "old", 0.1911, "fraction")], FACTS)
    got = {r.token: r.traced for r in A.trace(A.numbers(docs), A.candidates(facts)).collect()}
    assert got == {"1,180": True, "21.4%": True, "0.19": True, "-3": False, "77": False}
    body = A.render(facts).first().body.split("\n")
    assert body == ["[F1] minutes: 1180", "[F2] rate: 21.4%", "[F3] old: 19.1%"]


def test_distractor_control_breaks_the_audit(spark):
    docs = spark.createDataFrame([(1, "value 41.5"), (2, "value 93.2")], "doc int, text string")
    facts = spark.createDataFrame([(1, "F", "v", 41.5, "x"), (2, "F", "v", 93.2, "x")], FACTS)
    assert {(r.doc, r.other) for r in A.distractors(docs).collect()} == {(1, 2), (2, 1)}
    swapped = A.distractors(docs).join(facts.withColumnRenamed("doc", "other"), "other").drop("other")
    assert A.trace(A.numbers(docs), A.candidates(facts)).where("not traced").count() == 0
    assert A.trace(A.numbers(docs), A.candidates(swapped)).where("traced").count() == 0


def test_citations_leaks_names_rules(spark):
    claims = spark.createDataFrame([(1, 1, ["F1", "F9"]), (1, 2, []), (1, 3, None)], "doc int, claim_no int, cited array<string>")
    facts = spark.createDataFrame([(1, "F1")], "doc int, fact_id string")
    assert sorted((r.claim_no, r.problem) for r in A.citation_errors(claims, facts).collect()) == [(1, "unknown fact"), (2, "uncited"), (3, "uncited")]
    docs = spark.createDataFrame([(1, "Yesterday the team met Jokić in Anna-Maria. Belgrade rises certainly.")], "doc int, text string")
    terms = docs.select("doc", F.explode(F.array(F.lit("Jokic"), F.lit("joki"), F.lit("THE TEAM"), F.lit("Jok"))).alias("term"))
    assert sorted(r.term for r in A.leaks(docs, terms).collect()) == ["Jokic", "THE TEAM"]
    evidence = spark.createDataFrame([(1, "anna met jokic")], "doc int, body string")
    assert [r.word for r in A.unsupported_names(docs, evidence).collect()] == ["Anna-Maria"]
    row = spark.createDataFrame([("Ann de Marco",)], "n string").select(A.redaction_terms("n").alias("t")).first()
    assert row.t == ["Ann de Marco", "Marco"]


@pytest.mark.parametrize("pairs,want", [([(1, 1), (0, 0)], 1.0), ([(1, 0), (0, 0)], 0.0), ([(1, 1), (1, 1)], None)])
def test_kappa(spark, pairs, want):
    assert A.kappa(spark.createDataFrame(pairs, "a int, b int"), "a", "b").first().kappa == want


def test_checks(spark):
    df = spark.createDataFrame([(1, 1.0), (1, float("nan")), (2, float("inf")), (2, -3.0)], "k int, x double")
    n = lambda c: c.first().violations
    assert n(C.not_finite("f", df, ["x"])) == 2 and n(C.not_unique("u", df, ["k"])) == 2 and n(C.not_functional("d", df, ["k"], "x")) == 2
    assert n(C.out_of_range("r", df.where("x < 9"), {"x": (0, 5)})) == 1 and n(C.too_many("t", df, F.col("k") == 1, 1)) == 2 and n(C.too_many("t", df, F.col("k") == 1, 2)) == 0
    assert n(C.orphans("o", df, spark.createDataFrame([(1,)], "k int"), ["k"])) == 2
    assert C.content_hash(df).first() == C.content_hash(df.repartition(3)).first() != C.content_hash(df.where("k = 1")).first()
    texts = lambda *rows: C.content_hash(spark.createDataFrame(rows, "a string, b string")).first().content_hash
    assert len({texts(("a|b", "c")), texts(("a", "b|c")), texts(("~", "c")), texts((None, "c")), texts(("1:a", "c"))}) == 5
    prof = C.profile(df.withColumn("s", F.lit(None).cast("string")))
    assert {r["column"]: r.null_rate for r in prof.collect()} == {"k": 0.0, "x": 0.0, "s": 1.0}
    assert C.compare_contracts(prof, prof, bounds=True).count() == 0
    assert C.snapshot_id({"b": "2", "a": "1"}) == C.snapshot_id({"a": "1", "b": "2"}) and len(C.snapshot_id({"a": "1"})) == 12
    assert C.not_reproduced({"m": 1.0, "n": 2.0}, {"m": 1.0 + 1e-9, "n": 3.0}) == {"n": (3.0, 2.0)}
    pairs = spark.createDataFrame([("e", "A", "B", 1, 2, 1), ("e", "A", "B", 1, 3, 2)], "entity string, source_group string, target_group string, source_period int, target_period int, gap int")
    panel = spark.createDataFrame([("e", "A", 1)], "entity string, grp string, period int")
    assert {r.name: r.violations for r in C.pair_checks(pairs, panel).collect()} == {"pair_changes_group": 0, "pair_gap": 0, "pair_landing": 0, "pair_departure": 1, "pair_source_exists": 0, "pair_target_exists": 2}


def test_distractors_when_rows_come_in_another_order_each_run(spark):
    """Ranges are cut by a sample of the rows: another order of them makes other cuts."""
    import numpy as np
    import pyarrow as pa

    def shuffled(batches):
        import os

        yield from pa.Table.from_batches(batches).take(pa.array(np.random.default_rng(list(os.urandom(8))).permutation(30_000))).to_batches()

    docs = spark.range(0, 30_000, numPartitions=1).mapInArrow(shuffled, "id long").withColumnRenamed("id", "doc")
    got = {(r.doc, r.other) for r in A.distractors(docs, ranges=20).collect()}
    assert got == {(i, (i + 1) % 30_000) for i in range(30_000)}


def test_unsupported_names_send_letters_to_python(spark, monkeypatch):
    """Python gets the evidence's different letters outside ASCII, not the evidence."""
    from tidemark.functions import names

    sent, told = [], names._decomposed
    monkeypatch.setattr(names, "_decomposed", lambda letters: sent.append(letters) or told(letters))
    docs = spark.createDataFrame([(1, "We met José Müller and Zoë.")], "doc int, text string")
    evidence = spark.createDataFrame([(1, "jose muller é ü " * 3000)], "doc int, body string")
    assert [r.word for r in A.unsupported_names(docs, evidence).collect()] == ["Zoë"]
    assert evidence.select(F.length(sent[-1])).first()[0] == 2
