import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import serving as S
from tidemark.sources import tables as T


def test_scans(spark, tmp_path):
    (tmp_path / "o.csv").write_text("a,b\n007,1\n")
    assert T.csv_or_empty(spark, str(tmp_path / "o.csv"), "a string, b string").first().a == "007"
    assert T.csv_or_empty(spark, str(tmp_path / "none.csv"), "a string, b string").count() == 0
    for i in (1, 2):
        (tmp_path / f"run{i}.json").write_text(json.dumps({"v": i}))
    assert [r.v for r in T.latest_json(spark, str(tmp_path / "run*.json")).collect()] == [2]


def test_cache_and_contract(spark, tmp_path):
    calls = []

    def fetch():
        calls.append(1)
        return spark.range(3)

    folder = str(tmp_path / "bronze")
    for _ in range(2):
        assert T.cached(spark, folder, "s", "e", {"b": 1, "a": 2}, fetch).count() == 3
    assert len(calls) == 1 and T.cache_key("s", "e", {"a": 2, "b": 1}) == T.cache_key("s", "e", {"b": 1, "a": 2})
    assert T.manifest(spark, folder).count() == 1
    with pytest.raises(FileNotFoundError):
        T.cached(spark, folder, "s", "e", {"a": 3})
    assert T.all_files(spark, f"{folder}/s/*.parquet").count() == 3
    T.write_with_contract(spark.range(5), str(tmp_path / "t.parquet"))
    assert spark.read.json(str(tmp_path / "t.parquet.contract")).first().n_rows == 5
    assert T.read_run_log(spark, T.run_log(spark, str(tmp_path), "r1", {"b": 1, "a": 2})) == {"a": 2, "b": 1}


def test_slice(spark):
    persons = spark.createDataFrame([(f"p{i}", i) for i in range(10)], "person_id string, n int")
    movers = persons.where("n > 3")
    out = T.test_slice({"persons": persons, "other": spark.range(2)}, "person_id", ["p9", "p1"], movers, 4)
    assert sorted(r.person_id for r in out["persons"].collect()) == ["p1", "p4", "p5", "p9"] and out["other"].count() == 2
    with pytest.raises(ValueError):
        T.test_slice({"persons": persons}, "person_id", ["nobody"], movers, 4)


def test_serving(spark):
    persons = spark.createDataFrame([(1, "Ana", "ana", "A"), (2, "Anab", "anab", "A+B"), (3, "Bo", "bo", "A")], "person_id int, display_name string, normalized_name string, systems string")
    assert [r.person_id for r in S.search(persons, " ANA ").collect()] == [2, 1]
    assert [r.person_id for r in S.search(persons, "Äna").collect()] == [2, 1]
    rows = spark.createDataFrame([(i % 3 + 1, "A->B", float(i % 4), i % 2 == 0) for i in range(40)], "person_id int, direction string, predicted double, in_support boolean").withColumn("k", F.monotonically_increasing_id())
    seen = [r.k for o in range(0, 40, 10) for r in S.projection_page(rows, persons, limit=10, offset=o, ties=["k"]).rows.collect()]
    assert len(seen) == len(set(seen)) == 40
    page = S.projection_page(rows, persons, direction="A->B", least=2.0, supported=True)
    assert page.totals.first().total == page.rows.count() == 10 and page.totals.first().out_of_support == 0
    for bad in (0, 501):
        with pytest.raises(ValueError):
            S.projection_page(rows, persons, limit=bad)
    assert [r.predicted for r in S.leaderboard(rows, persons, "predicted", limit=3, direction="A->B").collect()] == [3.0, 3.0, 3.0]
    ids = spark.createDataFrame([(1, "A", "x", 1.0), (1, "B", "y", 0.7)], "person_id int, system string, source_id string, confidence double")
    found = S.profile(1, persons, spark.createDataFrame([(1, "g", 3), (1, "g", 2)], "person_id int, grp string, period int"), ids)
    assert [r.period for r in found["career"].collect()] == [2, 3] and found["warnings"].count() == 1
    models = spark.createDataFrame([("m1", "2024-01-01"), ("m2", "2024-02-01")], "model_version string, trained_at string")
    assert S.newest_first(models).first().model_version == "m2" and S.evaluation("m1", models, models, models)["model"].count() == 1
    defs = spark.createDataFrame([("m1", 0, 0.4, False), ("m1", 2, None, None), ("m1", 1, 0.6, True)], "model_version string, cluster int, stability double, reportable boolean")
    assert [(r.cluster, r.warning is None) for r in S.archetypes(defs).collect()] == [(1, True), (0, False), (2, False)]
    labels = spark.createDataFrame([(1, "m1", 1, 2020)], "person_id int, model_version string, cluster int, period int")
    assert S.archetypes(defs).first().cluster == 1 and S.archetype_of(1, labels, defs).first().stability == 0.6
    shots = spark.createDataFrame([(1, 2020, 0.3), (1, 2019, 0.8)], "person_id int, period int, data_weight double")
    assert S.shooting_of(1, shots).totals.first().mostly_prior == 1
    reports = spark.createDataFrame([(1, False, "2024-01", '[{"text":"a","facts":["F1"]}]'), (1, False, "2024-02", '[{"text":"b","facts":[]}]'), (1, True, "2024-03", "[]")], "person_id int, anonymized boolean, created_at string, claims string")
    assert S.latest_report(1, reports).first().claims[0].text == "b" and S.listing({"p": persons}) == [("p", 4)]
