import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import ingest as IN
from tidemark.sources import publish as PB
from tidemark.sources import statements as ST
from tidemark.sources import tables as T


def greedy(values, head, rows, size):
    """Statements of rows taken one after the other."""
    out, own = [], []
    for v in values:
        if own and (len(own) == rows or len(head.encode()) + len(",\n".join([*own, v]).encode()) + 1 > size):
            out.append(own)
            own = []
        own.append(v)
    return [head + ",\n".join(x) + ";" for x in ([*out, own] if own else [])]


@pytest.mark.parametrize("ranges, rows, size", [(1, 7, 400), (5, 7, 400), (40, 9, 260), (90, 400, 900), (3, 1, 90), (25, 50, 60)])
def test_packing_is_greedy_across_ranges(spark, ranges, rows, size):
    """Full by rows, by bytes, or one long row; ranges shorter than a statement."""
    rng = random.Random(ranges)
    data = [(i, "é" * rng.choice([0, 1, 5, 30, 30, 200])) for i in range(300)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "id int, name string").repartition(4)
    made = ST.insert_statements(df, "t", ["id"], rows=rows, size=size, ranges=ranges).orderBy("nth").collect()
    want = greedy([f"({i}, '{n}')" for i, n in sorted(data)], 'INSERT INTO "t" ("id", "name") VALUES\n', rows, size)
    assert [r.statement for r in made] == want and [r.n_rows for r in made] == [s.count("\n(") for s in want]
    assert all(len(s.encode()) <= size or s.count("\n(") == 1 for s in want)


def test_literals_and_empty_tables(spark):
    df = spark.createDataFrame([(i, f"it's {i}\x00", 1.5 if i else None, i % 2 == 0) for i in range(50)], "id int, name string, x double, ok boolean")
    got = [r.statement for r in ST.insert_statements(df, 'we"ird', ["id"], rows=7).orderBy("nth").collect()]
    assert len(got) == 8 and got[0].startswith('INSERT INTO "we""ird" ("id", "name", "x", "ok") VALUES')
    text = "".join(got)
    assert "(0, 'it''s 0', NULL, 1)" in text and "(1, 'it''s 1', 1.5, 0)" in text
    assert ST.insert_statements(df.limit(0), "t", ["id"]).count() == 0
    with pytest.raises(Exception, match="not finite"):
        ST.insert_statements(spark.createDataFrame([(1, float("nan"))], "id int, x double"), "t", ["id"]).collect()


def whole(spark, folder):
    """The version that a reader sees: both tables are of one run."""
    now = PB.current(spark, folder)
    runs = {r.run for name in ("parents", "children") for r in PB.published(spark, folder, name, now).collect()}
    assert len(runs) == 1
    return runs.pop()


REFERS = {"children": {"parent": ("parents", "id")}}


def version(spark, run, child=1):
    return {"children": spark.createDataFrame([(1, run), (child, run), (None, run)], "parent int, run int"), "parents": spark.createDataFrame([(1, run), (2, run)], "id int, run int")}


def test_a_reader_sees_one_version_at_every_step(spark, tmp_path):
    gold = str(tmp_path / "gold")
    assert PB.current(spark, gold) is None
    with pytest.raises(FileNotFoundError):
        PB.published(spark, gold, "parents")
    PB.publish(version(spark, 1), gold, REFERS)
    seen = []

    def look(step):
        seen.append((step, whole(spark, gold)))

    PB.publish(version(spark, 2), gold, REFERS, look)
    assert seen == [("write parents", 1), ("write children", 1), ("check children.parent", 1), ("point", 1), ("clean", 2)]
    assert whole(spark, gold) == 2
    held = PB.current(spark, gold)
    PB.publish(version(spark, 3), gold, REFERS)
    assert {r.run for r in PB.published(spark, gold, "parents", held).collect()} == {2}  # who has begun can read on
    PB.publish(version(spark, 4), gold, REFERS)
    assert not T.exists(spark, held) and whole(spark, gold) == 4


@pytest.mark.parametrize("step", ["write parents", "write children", "check children.parent", "point"])
def test_a_failure_at_any_step_changes_nothing(spark, tmp_path, step):
    gold = str(tmp_path / "gold")
    PB.publish(version(spark, 1), gold, REFERS)

    def fail(now):
        if now == step:
            raise OSError(f"lost at {step}")

    with pytest.raises(OSError, match="lost at"):
        PB.publish(version(spark, 2), gold, REFERS, fail)
    assert whole(spark, gold) == 1
    PB.publish(version(spark, 3), gold, REFERS)
    assert whole(spark, gold) == 3


def test_orphans_and_circles(spark, tmp_path):
    gold = str(tmp_path / "gold")
    with pytest.raises(ValueError, match=r"children.parent .*\[7\]"):
        PB.publish(version(spark, 1, child=7), gold, REFERS)
    assert PB.current(spark, gold) is None
    with pytest.raises(ValueError, match="refer to each other"):
        PB.order_of(["a", "b"], {"a": {"x": ("b", "y")}, "b": {"x": ("a", "y")}})
    assert PB.order_of(["c", "b", "a"], {"c": {"x": ("b", "y")}, "b": {"x": ("a", "y"), "z": ("b", "y")}}) == ["a", "b", "c"]


def test_one_bad_unit_spoils_no_other(spark, tmp_path):
    for name, text in (("good", '{"id": 1, "name": "a"}\n{"id": 2, "name": null}\n'), ("cut", '{"id": 3, "name": "c"}\n{"id": 4, "na\n{"id": "x", "name": "y"}\n'), ("empty", "")):
        (tmp_path / f"{name}.json").write_text(text)
    units = {n: str(tmp_path / f"{n}.json") for n in ("cut", "missing", "good", "empty")}
    got = IN.ingest(spark, units, "id long, name string", str(tmp_path / "out"))
    status = {r.unit: (r.state, r.n_rows, r.n_bad) for r in got.status.collect()}
    assert status == {"cut": ("partial", 1, 2), "missing": ("failed", 0, 0), "good": ("ok", 2, 0), "empty": ("ok", 0, 0)} and not got.ok
    assert sorted((r.unit, r.id, r.name) for r in got.rows.collect()) == [("cut", 3, "c"), ("good", 1, "a"), ("good", 2, None)]
    assert {r.record for r in got.bad.collect()} == {'{"id": 4, "na', '{"id": "x", "name": "y"}'}
    failed = got.status.where("state = 'failed'").first()
    assert failed.error and failed.seconds > 0 and failed.digest is None
    again = IN.ingest(spark, {"good": units["good"]}, "id long, name string", str(tmp_path / "again"))
    assert again.ok and again.status.first().digest == got.status.where("unit = 'good'").first().digest
    none = IN.ingest(spark, {"missing": units["missing"]}, "id long, name string", str(tmp_path / "none"))
    assert none.rows.count() == 0 and not none.ok


def test_a_broken_parquet_file_among_good_ones(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "a.parquet"))
    (tmp_path / "b.parquet").write_bytes(b"PAR1 is not enough")
    got = IN.ingest(spark, {n: str(tmp_path / f"{n}.parquet") for n in ("b", "a")}, "id long", str(tmp_path / "out"), kind="parquet")
    assert {r.unit: r.state for r in got.status.collect()} == {"b": "failed", "a": "ok"} and got.rows.agg(F.sum("id")).first()[0] == 10
