import inspect
import math

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.operators import linmod, roles
from tidemark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else x + 0.0 if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    rel = con.sql(catalog.SQL[name])
    assert sorted(rel.columns) == cols
    want = [tuple(plain(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark, sf):
    plan = catalog.QUERIES["flt_prj_filters"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), IsNotNull(o_orderpriority)" in plan or "GreaterThanOrEqual(o_totalprice" in plan
    assert "o_custkey" not in plan.split("ReadSchema")[1]


def test_groups_are_combined_before_they_meet_their_rows(spark, sf):
    for name in ("ent6_standardized_panel", "ent5_common_denominators", "ml10_beta_shrink", "ml12_supplier_z"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "partial_" in plan and "BroadcastHashJoin" in plan, name


def test_many_groups_are_joined_by_their_keys(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tidemark.operators import grouped

    rows = spark.range(100).select((F.col("id") % 7).alias("k"), F.col("id").alias("x")).union(spark.createDataFrame([(None, 1), (None, 2)], "k long, x long"))
    for most in (50_000, 3):
        monkeypatch.setattr(grouped, "MAX_GROUPS", most)
        got = {(r.k, r.n) for r in grouped.with_groups(rows, ["k"], n=F.sum("x")).select("k", "n").collect()}
        assert got == {(k, sum(range(k, 100, 7))) for k in range(7)} | {(None, 3)}


def test_name_keys_cover_whole_texts(spark, sf):
    words = {r.doc_id: len(r.key.split()) for r in catalog.QUERIES["str1_name_keys_whole"](spark, sf).collect()}
    assert max(words.values()) > 1000


def test_registered_models_run_at_the_defaults(spark, sf, monkeypatch):
    seen = {}

    def watch(module, name, out):
        f = getattr(module, name)

        def stub(*args, **kwargs):
            bound = inspect.signature(f).bind(*args, **kwargs)
            bound.apply_defaults()
            seen[name] = bound.arguments
            return out

        monkeypatch.setattr(module, name, stub)

    class Labelled:
        def transform(self, df):
            return df

    watch(roles, "mixture", Labelled())
    watch(roles, "stability", None)
    watch(linmod, "cluster_bootstrap", None)
    catalog.QUERIES["ml15_role_stability"](spark, sf)
    catalog.QUERIES["ml8_bootstrap_interval"](spark, sf)
    assert (seen["mixture"]["k"], seen["mixture"]["starts"]) == (roles.CLUSTERS, roles.STARTS)
    assert (seen["stability"]["k"], seen["stability"]["draws"]) == (roles.CLUSTERS, roles.DRAWS)
    assert seen["cluster_bootstrap"]["draws"] == linmod.DRAWS


def test_ml14_fits_only_its_candidates(spark, sf, monkeypatch):
    from tidemark.operators import roles

    def unasked(*args, **kwargs):
        raise AssertionError("a mixture that nothing reads")

    monkeypatch.setattr(roles, "mixture", unasked)
    monkeypatch.setattr(roles, "held_out_log_likelihood", lambda df, time, candidates: [(k, 0.0) for k in candidates])
    assert [r.k for r in catalog.QUERIES["ml14_held_out_log_likelihood"](spark, sf).collect()] == list(range(3, 11))
