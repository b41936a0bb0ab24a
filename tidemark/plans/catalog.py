"""Registered queries over the driver tables, and their SQL.

The cohort operators run over a panel of customers (entity) by order priority
(group) and year (period), weighted by revenue; other operators over the tables whose
shape fits. Doubles are rounded on both sides; money is summed as decimals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.functions import names as N
from tidemark.operators import audit as A
from tidemark.operators import checks as C
from tidemark.operators import cohort, identity, linmod, moments, roles, serving, shrink
from tidemark.operators.quantiles import grouped_quantiles
from tidemark.plans.closed_form import least_squares
from tidemark.plans.registry import QUERIES, SQL, query
from tidemark.sources.shared import kept
from tidemark.sources.statements import sql_literal
from tidemark.sources.tables import csv_or_empty, table

# ---- the panel -------------------------------------------------------------

SOURCE, TARGET, QUALIFIED = 200_000, 150_000, 150_000


def panel(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("grp"), F.year("o_orderdate").alias("period"))
    rows = rows.agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("weight"), F.count("*").alias("n"))
    return rows.withColumns({"price": F.col("weight") / F.col("n"), "qualified": F.col("weight") >= QUALIFIED})


def standardized(spark: SparkSession, d: str) -> DataFrame:
    return moments.standardize(panel(spark, d), ["grp", "period"], ["price"], "weight", "qualified")


def z_panel(spark: SparkSession, d: str) -> DataFrame:
    """Written once: sources, targets, presence and moments all read it."""
    return kept(standardized(spark, d))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return cohort.transition_pairs(panel(spark, d), source_weight=SOURCE, target_weight=TARGET)


def transitions(spark: SparkSession, d: str) -> DataFrame:
    z = z_panel(spark, d)
    return cohort.transition_frame(cohort.transition_pairs(z, source_weight=SOURCE, target_weight=TARGET), z, moments.moments(z, ["grp", "period"], "price", "weight", "qualified"), "price", covariates=["n"])


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


PANEL = f"""with panel as (select *, weight / n as price, weight >= {QUALIFIED} as qualified from (
  select o_custkey as entity, o_orderpriority as grp, cast(year(o_orderdate) as integer) as period,
         cast(sum(cast(o_totalprice as decimal(18, 2))) as double) as weight, count(*) as n from orders group by 1, 2, 3)),
zp as (select *, case when sd > 0 then (price - mean) / sd end as z_price from (
  select *, sum(case when qualified then price * weight end) over w / nullif(sum(case when qualified then weight end) over w, 0) as mean,
         stddev_samp(case when qualified then price end) over w as sd from panel window w as (partition by grp, period))),
mom as (select grp, period, sum(price * weight) / nullif(sum(weight), 0) as mean, stddev_samp(price) as sd, count(*) as n from panel where qualified group by 1, 2),
cand as (select s.entity, s.grp as source_group, t.grp as target_group, s.period as source_period, t.period as target_period, s.weight as source_weight,
         t.weight as target_weight, t.period - s.period as gap, s.grp || '->' || t.grp as direction from panel s join panel t on s.entity = t.entity and s.grp <> t.grp
  where s.weight >= {SOURCE} and t.weight >= {TARGET} and t.period - s.period between 1 and 2
    and not exists (select 1 from panel x where x.entity = s.entity and x.grp = t.grp and x.period = s.period)),
pairs as (select * exclude (gs, gt) from (select *, min(gap) over (partition by entity, source_group, target_group, source_period) as gs,
         min(gap) over (partition by entity, source_group, target_group, target_period) as gt from cand) where gap = gs and gap = gt),
trans as (select p.*, s.price as source_value, s.z_price as z_source, s.n as n, t.price as target_value, t.z_price as z_target, m.mean as target_mean, m.sd as target_sd
  from pairs p join zp s on s.entity = p.entity and s.grp = p.source_group and s.period = p.source_period
  join zp t on t.entity = p.entity and t.grp = p.target_group and t.period = p.target_period
  left join mom m on m.grp = p.target_group and m.period = p.target_period where m.sd > 0)
"""


@query(PANEL + "select entity, source_group, target_group, source_period, target_period, gap, direction, round(source_weight, 2) as source_weight, round(target_weight, 2) as target_weight from pairs")
def ent7_transition_pairs(spark, d):
    return pairs(spark, d).select("entity", "source_group", "target_group", "source_period", "target_period", "gap", "direction", F.round("source_weight", 2).alias("source_weight"), F.round("target_weight", 2).alias("target_weight"))


@query(PANEL + "select direction, count(*) as n_pairs, count(distinct entity) as n_entities, min(source_period) as first_period, max(source_period) as last_period from pairs group by 1")
def ent8_cohort_summary(spark, d):
    return cohort.cohort_summary(pairs(spark, d))


@query(PANEL + """select a.entity, a.grp, a.period, round(a.z_price, 6) as z_from, round(b.z_price, 6) as z_to, round(ln(a.weight), 6) as log_weight
from zp a join zp b on a.entity = b.entity and a.grp = b.grp and b.period = a.period + 1
where a.weight >= 100000 and b.weight >= 100000 and a.z_price is not null and b.z_price is not null""")
def ent9_persistence_frame(spark, d):
    return cohort.persistence_frame(z_panel(spark, d), "z_price", least=100_000).select("entity", "grp", "period", *r6("z_from", "z_to", "log_weight"))


@query(PANEL + "select entity, direction, source_period, target_period, gap, n, round(z_source, 6) as z_source, round(z_target, 6) as z_target, round(target_mean, 4) as target_mean, round(target_sd, 4) as target_sd from trans")
def ent10_transition_frame(spark, d):
    return transitions(spark, d).select("entity", "direction", "source_period", "target_period", "gap", "n", *r6("z_source", "z_target"), F.round("target_mean", 4).alias("target_mean"), F.round("target_sd", 4).alias("target_sd"))


@query(PANEL + "select entity, grp, period, round(weight, 2) as weight, qualified, round(z_price, 6) as z_price from zp")
def ent6_standardized_panel(spark, d):
    return standardized(spark, d).select("entity", "grp", "period", F.round("weight", 2).alias("weight"), "qualified", *r6("z_price"))


@query(PANEL + "select grp, period, round(mean, 4) as mean, round(sd, 4) as sd, n from mom")
def ag7_period_moments(spark, d):
    return moments.moments(panel(spark, d), ["grp", "period"], "price", "weight", "qualified").select("grp", "period", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "n")


COUNTER = """, moved as (select * from trans where direction = '1-URGENT->2-HIGH'),
latest as (select * from (select *, row_number() over (partition by entity order by period desc) as k from zp where grp = '1-URGENT' and weight >= 150000 and z_price is not null) where k = 1)
select l.entity, '1-URGENT->2-HIGH' as direction, l.period as source_period, round(l.z_price, 6) as z_source, cast(1 as integer) as gap, (select max(period) from mom where grp = '2-HIGH') as target_period,
  coalesce(l.z_price between (select min(z_source) from moved) and (select max(z_source) from moved), false) as in_support, exists (select 1 from pairs p where p.entity = l.entity) as moved_before
from latest l where l.entity not in (select entity from pairs where direction = '1-URGENT->2-HIGH')"""


@query(PANEL + COUNTER)
def ent11_counterfactuals(spark, d):
    z = z_panel(spark, d)
    moves = cohort.transition_pairs(z, source_weight=SOURCE, target_weight=TARGET)
    m = moments.moments(z, ["grp", "period"], "price", "weight", "qualified")
    out = cohort.counterfactuals(z, moves, m, "price", "1-URGENT", "2-HIGH", least=150_000)
    return out.select("entity", "direction", "source_period", *r6("z_source"), "gap", "target_period", "in_support", "moved_before")


@query(PANEL + "select direction, round(min(z_source), 6) as z_min, round(max(z_source), 6) as z_max, count(z_source) as n_movers from trans group by 1")
def ent12_support_ranges(spark, d):
    return cohort.support_ranges(transitions(spark, d)).select("direction", *r6("z_min", "z_max"), "n_movers")


@query(PANEL + "select grp, max(period) as period from panel group by 1")
def ent13_latest_period(spark, d):
    return cohort.latest_period(panel(spark, d))


@query(PANEL + """, cells as (select distinct direction, source_group as grp, source_period as period from trans)
select m.direction, n_movers, round(mover_mean, 6) as mover_mean, n_peers, round(peer_mean, 6) as peer_mean, round(mover_mean - peer_mean, 6) as selection
from (select direction, count(*) as n_movers, avg(z_source) as mover_mean from trans group by 1) m
left join (select direction, count(*) as n_peers, avg(z_price) as peer_mean from zp join cells using (grp, period) where qualified and z_price is not null group by 1) p on p.direction = m.direction""")
def ent14_selection_summary(spark, d):
    out = cohort.selection_summary(transitions(spark, d), z_panel(spark, d), "price", F.col("qualified"))
    return out.select("direction", "n_movers", "n_peers", *r6("mover_mean", "peer_mean", "selection"))


@query("select c_custkey, list_aggregate(list_sort(list_distinct(list_filter(list_concat([c_name], string_split_regex(c_name, '[#\\s]+')), lambda x: length(x) >= 4))), 'string_agg', ',') as terms from customer")
def ent16_redaction_terms(spark, d):
    spaced = F.regexp_replace("c_name", "#", " ")
    terms = F.array_distinct(F.concat(F.array("c_name"), F.filter(F.split(spaced, r"\s+"), lambda w: F.length(w) >= 4)))
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.array_sort(F.filter(terms, lambda w: F.length(w) >= 4)), ",").alias("terms"))


# ---- rates, covariates, identity --------------------------------------------


@query("""with t as (select l_suppkey as entity, year(l_shipdate)::integer as period, sum(l_quantity) as fga, sum(l_linenumber) as fta, count(*) filter (l_returnflag = 'R') as tov, count(*) as minutes,
  cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as pts from lineitem group by 1, 2),
g as (select *, sum(fga) over w as a, sum(fta) over w as f, sum(tov) over w as o, sum(minutes) over w as m from t window w as (partition by period))
select entity, period, round(case when 2 * (fga + 0.44 * fta) > 0 then pts / (2 * (fga + 0.44 * fta)) end, 6) as efficiency,
 round(case when minutes > 0 and a + 0.44 * f + o > 0 then (fga + 0.44 * fta + tov) * (m / 5) / (minutes * (a + 0.44 * f + o)) end, 6) as usage,
 round(case when minutes > 0 then pts / minutes end * 36, 4) as per_unit, round(case when fga > 0 then tov / fga end, 6) as tov_rate from g""")
def ent5_common_denominators(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("period")).agg(
        F.sum("l_quantity").alias("fga"), F.sum("l_linenumber").cast("double").alias("fta"), F.count_if(F.col("l_returnflag") == "R").cast("double").alias("tov"), F.count("*").cast("double").alias("minutes"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("pts"))
    rows = moments.group_totals(rows, ["period"], ["fga", "fta", "tov", "minutes"])
    return rows.select(
        "entity", "period", F.round(X.efficiency("pts", "fga", "fta"), 6).alias("efficiency"), F.round(X.usage("fga", "fta", "tov", "minutes", "all_fga", "all_fta", "all_tov", "all_minutes"), 6).alias("usage"),
        F.round(X.per_unit("pts", "minutes"), 4).alias("per_unit"), F.round(X.ratio("tov", "fga"), 6).alias("tov_rate"))


@query("""select c_custkey, round(coalesce(age, case when c_nationkey is not null then 2000 - m end), 4) as age from (
 select *, median(cast(2000 - age as double)) over (partition by c_nationkey) as m from (select c_custkey, c_nationkey, case when c_custkey % 4 > 0 then round(c_acctbal, 2) end as age from customer))""")
def ent4_recovered_covariate(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 4 > 0, F.round("c_acctbal", 2)).alias("age"), F.lit(2000).alias("period"))
    return identity.fill_covariate(rows, "c_nationkey", "period", "age").select("c_custkey", F.round("age", 4).alias("age"))


def _systems(spark, d):
    """Suppliers are the anchor system, parts of customers share its ids or have none."""
    s = table(spark, d, "supplier").select(F.lit("A").alias("system"), F.col("s_suppkey").cast("string").alias("id"), F.col("s_nationkey").cast("string").alias("match_key"), F.round("s_acctbal", 0).alias("birth"), F.col("s_name").alias("name"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("match_key"), F.round("c_acctbal", 0).alias("birth"), F.col("c_name").alias("name"))
    shared = c.where("c_custkey % 10 = 0").select(F.lit("B").alias("system"), (F.col("c_custkey") / 10).cast("long").cast("string").alias("id"), "match_key", "birth", "name")
    other = c.where("c_custkey % 10 > 0").select(F.lit("C").alias("system"), F.col("c_custkey").cast("string").alias("id"), "match_key", "birth", "name")
    return s, shared, other


SYSTEMS = """with anchor as (select 'A' as system, cast(s_suppkey as varchar) as id, cast(s_nationkey as varchar) as match_key, round(s_acctbal, 0) as birth, s_name as name from supplier),
shared as (select 'B' as system, cast(c_custkey // 10 as varchar) as id, cast(c_nationkey as varchar) as match_key, round(c_acctbal, 0) as birth, c_name as name from customer where c_custkey % 10 = 0),
other as (select 'C' as system, cast(c_custkey as varchar) as id, cast(c_nationkey as varchar) as match_key, round(c_acctbal, 0) as birth, c_name as name from customer where c_custkey % 10 > 0),
known as (select id as c_id, match_key, max(birth) as c_birth from (select * from anchor union all select * from shared) group by 1, 2),
met as (select o.system, o.id, count(distinct c_id) as n, count(distinct case when abs(birth - c_birth) <= 60 then c_id end) as n_agree, max(case when abs(birth - c_birth) <= 60 then c_id end) as agreed, max(c_id) as only_id
  from other o left join known k on k.match_key = o.match_key group by 1, 2),
ruled as (select *, case when id in ('1', '2') then 'override' when n_agree = 1 then 'name_and_age' when n = 1 and n_agree = 0 then 'name_only_unique' when n > 1 then 'name_ambiguous' else 'unmatched' end as method from met),
ids as (select distinct 'a_' || id as person_id, system, id as source_id, 'anchor' as method from anchor union all select distinct 'a_' || id, system, id, 'shared_id' from shared
  union all select coalesce('a_' || case method when 'override' then '7' when 'name_and_age' then agreed when 'name_only_unique' then only_id end, 'o_' || id), system, id, method from ruled)
"""


def _identities(spark, d):
    s, shared, other = _systems(spark, d)
    fixed = spark.createDataFrame([("1", "7"), ("2", "7")], "other_id string, anchor_id string")
    return identity.crosswalk(s, shared, other, fixed, tolerance=60)


@query(SYSTEMS + "select *, case method when 'name_and_age' then 0.95 when 'name_only_unique' then 0.7 when 'name_ambiguous' then 0.3 else 1.0 end::double as confidence from ids")
def ent1_identity_crosswalk(spark, d):
    return _identities(spark, d)


@query(SYSTEMS + "select count(*) as n_shared, round(avg((l.match_key = r.match_key)::integer), 6) as agreement from anchor l join shared r using (id)")
def ent2_shared_id_evidence(spark, d):
    s, shared, _ = _systems(spark, d)
    return identity.shared_id_evidence(s, shared).select("n_shared", *r6("agreement"))


@query(SYSTEMS + """, people as (select * from anchor union all select * from shared union all select * from other),
rows as (select i.*, p.name, p.birth, case i.system when 'A' then 0 when 'B' then 1 else 2 end as rank from ids i left join people p on p.system = i.system and p.id = i.source_id)
select person_id, arg_min(name, (rank, name)) as display_name, arg_min(birth, (rank, source_id)) as birth, string_agg(distinct system, '+' order by system) as systems from rows group by 1""")
def ent3_golden_persons(spark, d):
    s, shared, other = _systems(spark, d)
    return identity.golden_persons(_identities(spark, d), s.union(shared).union(other), ["A", "B", "C"])


@query("""select o_custkey as id, arg_max(o_orderpriority, (year(o_orderdate), o_orderpriority)) as name, min(year(o_orderdate))::integer as first_period, max(year(o_orderdate))::integer as last_period from orders group by 1""")
def ag2_latest_name(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("name"), F.year("o_orderdate").alias("period"))
    return identity.distinct_entities(o, "id", "name", "period")


@query("""select doc_id, list_aggregate(list_sort(list_filter(string_split_regex(trim(regexp_replace(regexp_replace(lower(replace(replace(replace(strip_accents(translate(w, 'đĐðÐøØłŁ', 'dDdDoOlL')), 'ß', 'ss'), '’', ''), '`', '')), '[.''´]', '', 'g'), '[^a-z0-9_\\s]', ' ', 'g')), '\\s+'), lambda x: x <> '' and x not in ('jr', 'sr', 'ii', 'iii', 'iv', 'v') and length(x) > 1)), 'string_agg', ' ') as key
from (select doc_id, array_to_string(list_filter(string_split_regex(regexp_replace(text, '[^a-zA-ZÀ-ÖØ-öø-ÿ ]', ' ', 'g'), ' +'), lambda x: length(x) > 1), ' ') as w from documents) where key is not null and key <> ''""")
def str1_name_keys_whole(spark, d):
    letters = F.split(F.regexp_replace("text", "[^a-zA-ZÀ-ÖØ-öø-ÿ ]", " "), " +")
    words = F.filter(letters, lambda w: F.length(w) > 1)
    keys = table(spark, d, "documents").select("doc_id", N.normalized(F.array_join(words, " ")).alias("k"))
    return keys.select("doc_id", F.array_join(F.array_sort(F.filter(F.split("k", " "), lambda w: F.length(w) > 1)), " ").alias("key")).where("key <> ''")


@query("""select s_suppkey, upper(substr(l, 1, 1)) || substr(l, 2) as name, 'S_' || (2000 + s_suppkey % 30) as period_id, (2000 + s_suppkey % 30)::varchar || '-' || lpad(((2001 + s_suppkey % 30) % 100)::varchar, 2, '0') as label, (2000 + s_suppkey % 30)::integer as period
from (select s_suppkey, lower(replace(s_name, '#', '_')) as l from supplier)""")
def str6_period_labels(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", N.titled(F.replace("s_name", F.lit("#"), F.lit("_"))).alias("name"), (2000 + F.col("s_suppkey") % 30).cast("int").alias("p"))
    s = s.withColumn("period_id", N.period_id(F.lit("S"), "p"))
    return s.select("s_suppkey", "name", "period_id", N.period_label("p").alias("label"), N.parse_period("period_id", ["S"])["period"].alias("period"))


# ---- relational families -------------------------------------------------------


@query("""select o_orderkey, o_totalprice, case when o_totalprice >= 100000 then 'large' else 'small' end as size, coalesce(nullif(o_orderstatus, 'P'), '?') as status, cast(null as double) as age
from orders where o_totalprice between 50000 and 150000 and o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderkey is not null""")
def flt_prj_filters(spark, d):
    rows = table(spark, d, "orders").where(F.col("o_totalprice").between(50000, 150000) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_orderkey").isNotNull())
    return rows.select("o_orderkey", "o_totalprice", F.when(F.col("o_totalprice") >= 100000, "large").otherwise("small").alias("size"), F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("?")).alias("status"), F.lit(None).cast("double").alias("age"))


@query("""select c.c_custkey, n.n_name, r.r_name, count(o.o_orderkey) as n_orders from customer c left join nation n on n.n_nationkey = c.c_nationkey left join region r on r.r_regionkey = n.n_regionkey
left join orders o on o.o_custkey = c.c_custkey group by 1, 2, 3""")
def jn_star_left(spark, d):
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.join(orders, "c_custkey", "left").select("c_custkey", "n_name", "r_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query("select d.doc_id, d.lang from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def jn12_orphans(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("""select l_returnflag, count(*) as n, count(distinct l_suppkey) as n_supp, round(median(l_quantity), 4) as mid, round(quantile_cont(l_extendedprice, 0.75), 4) as q75, round(stddev_samp(l_quantity), 6) as sd, round(var_pop(l_quantity), 6) as vp,
 count(*) filter (l_discount > 0.05) as n_discount, string_agg(distinct l_linestatus, '+' order by l_linestatus) as states, round(avg((l_tax > 0.03)::integer), 6) as taxed from lineitem group by 1""")
def ag_aggregates(spark, d):
    lines = table(spark, d, "lineitem")
    plain = lines.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("n_supp"),
        F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.round(F.var_pop("l_quantity"), 6).alias("vp"), F.count_if(F.col("l_discount") > 0.05).alias("n_discount"),
        F.array_join(F.array_sort(F.collect_set("l_linestatus")), "+").alias("states"), F.round(F.avg((F.col("l_tax") > 0.03).cast("double")), 6).alias("taxed"))
    mid = grouped_quantiles(lines, ["l_returnflag"], "l_quantity", {"mid": 0.5})
    high = grouped_quantiles(lines, ["l_returnflag"], "l_extendedprice", {"q75": 0.75})
    return plain.join(mid, "l_returnflag").join(high, "l_returnflag").withColumns({c: F.round(c, 4) for c in ("mid", "q75")})


@query("""select o_custkey as id, round(median(cast(year(o_orderdate) as double) - (o_orderkey % 40)), 4) as birth, count(*) as n from orders group by 1""")
def ag3_implied_births(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("period"), (F.col("o_orderkey") % 40).alias("age"))
    n = rows.groupBy("id").agg(F.count("*").alias("n"))
    return identity.implied_birth(rows, "id", "period", "age").join(n, "id").select("id", F.round("birth", 4).alias("birth"), "n")


@query("""select lang, source, round(quantile_cont(length(text), 0.1), 4) as low, round(median(length(text)), 4) as mid, round(quantile_cont(length(text), 0.99), 4) as high from documents group by all""")
def ag16_text_lengths(spark, d):
    found = grouped_quantiles(table(spark, d, "documents"), ["lang", "source"], F.length("text"), {"low": 0.1, "mid": 0.5, "high": 0.99})
    return found.select("lang", "source", *[F.round(c, 4).alias(c) for c in ("low", "mid", "high")])


@query("""select l_suppkey, round(sum(l_extendedprice * l_quantity) / nullif(sum(l_quantity), 0), 4) as wmean, round(avg(abs(l_tax - l_discount)), 6) as mad from lineitem group by 1""")
def ag4_weighted_mean(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(moments.weighted_mean("l_extendedprice", "l_quantity"), 4).alias("wmean"), F.round(F.avg(F.abs(F.col("l_tax") - F.col("l_discount"))), 6).alias("mad"))


@query("""select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id) as k from events) where k <= 3""")
def wn_top_rows(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), "event_id")
    return table(spark, d, "events").withColumn("k", F.row_number().over(w)).where("k <= 3").select("user_id", "event_id")


@query("""select c_custkey as id, 'c' as kind, round(c_acctbal, 2) as balance from customer where c_acctbal > 0 union all select s_suppkey, 's', round(s_acctbal, 2) from supplier""")
def so1_union(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.lit("c").alias("kind"), F.round("c_acctbal", 2).alias("balance"))
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("s").alias("kind"), F.round("s_acctbal", 2).alias("balance")))


@query("""(select c_nationkey as nation, 'both' as part from customer intersect select s_nationkey, 'both' from supplier) union all (select distinct o_custkey::integer, 'ordered' from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0))""")
def so4_set_operations(spark, d):
    both = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("both").alias("part")).intersect(table(spark, d, "supplier").select("s_nationkey", F.lit("both")))
    ordered = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().join(table(spark, d, "customer").where("c_acctbal < 0"), "c_custkey", "left_anti")
    return both.union(ordered.select(F.col("c_custkey").cast("int"), F.lit("ordered")))


@query("select event_id, json_extract_string(props, '$.' || k) as v, k from events, (select unnest(json_keys(props)) as k, event_id as e from events) x where x.e = event_id")
def src_json_props(spark, d):
    rows = table(spark, d, "events").select("event_id", "props", F.explode(F.json_object_keys("props")).alias("k"))
    return rows.select("event_id", F.from_json("props", "map<string,string>")[F.col("k")].alias("v"), "k")


@query("""select '(' || s_suppkey || ', ''' || replace(s_name, '''', '''''') || ''', NULL, ' || case when s_suppkey % 2 = 0 then '1' else '0' end || ')' as line from supplier""")
def snk3_sql_literals(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", F.lit(None).cast("string").alias("none"), (F.col("s_suppkey") % 2 == 0).alias("even"))
    parts = [sql_literal(F.col(c), k) for c, k in s.dtypes]
    return s.select(F.concat(F.lit("("), F.concat_ws(", ", *parts), F.lit(")")).alias("line"))


@query("select c_custkey, c_name, c_name as shown from customer")
def src3_missing_file(spark, d):
    """Names with corrections from a file that does not exist."""
    fixed = csv_or_empty(spark, f"{d}/no-such-names.csv", "c_custkey long, better string")
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return c.join(fixed, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("better", "c_name").alias("shown"))


# ---- models ----------------------------------------------------------------------


@query("""with t as (select l_suppkey as entity, year(l_shipdate)::integer as period, count(*) as attempts, count(*) filter (l_returnflag = 'R') as makes from lineitem group by 1, 2),
m as (select *, avg(case when attempts >= 50 then makes / attempts end) over w as mu, var_pop(case when attempts >= 50 then makes / attempts end) over w as v, count(case when attempts >= 50 then 1 end) over w as k from t window w as (partition by period)),
f as (select *, k >= 20 and v > 0 and mu > 0 and mu < 1 as fitted from m), s as (select *, greatest(case when fitted then mu * (1 - mu) / v - 1 end, 1.0) as size from f),
p as (select *, case when fitted then mu * size else 1.0 end as alpha, case when fitted then (1 - mu) * size else 1.0 end as beta from s)
select entity, period, round(alpha, 4) as alpha, round(beta, 4) as beta, round((makes + alpha) / (attempts + alpha + beta), 6) as shrunk_rate, round(attempts / (attempts + alpha + beta), 6) as data_weight, attempts >= 20 as reportable from p""")
def ml10_beta_shrink(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("period")).agg(F.count("*").alias("attempts"), F.count_if(F.col("l_returnflag") == "R").alias("makes"))
    out = shrink.beta_shrink(rows, "period", "makes", "attempts")
    return out.select("entity", "period", F.round("alpha", 4).alias("alpha"), F.round("beta", 4).alias("beta"), *r6("shrunk_rate", "data_weight"), "reportable")


@query(PANEL + "select direction, count(*) as n, round(regr_slope(z_target, z_source), 6) as slope from trans group by 1 having count(*) >= 5")
def ml4_direction_slopes(spark, d):
    return linmod.direction_slopes(transitions(spark, d), "z_source", "z_target", least=5).select("direction", "n", *r6("slope"))


# the first stage, and every move with its prediction by persistence (z_persist)
STAGE1 = (
    PANEL
    + """, pf as (select a.entity, a.grp, a.period, a.z_price as z_from, b.z_price as z_to, a.n - 27.0 as age, ln(a.weight) as lw from zp a join zp b on a.entity = b.entity and a.grp = b.grp and b.period = a.period + 1
  where a.weight >= 50000 and b.weight >= 50000 and a.z_price is not null and b.z_price is not null),
"""
    + least_squares("s1", "pf", ["z_from", "age", "age * age", "lw"], "z_to", [], [])
    + """,
st as (select t.*, level + b1 * z_source + b2 * (t.n - 27) + b3 * (t.n - 27) * (t.n - 27) + b4 * ln(source_weight) as z_persist, ln(source_weight) as lw from trans t cross join s1 cross join s1_level)"""
)
STAGE2 = STAGE1 + ",\n" + least_squares("s2", "st", ["z_persist", "lw", "gap"], "z_target", [], ["direction"])


def _stage1(spark, d):
    return linmod.fit_persistence(cohort.persistence_frame(z_panel(spark, d).withColumn("age", F.col("n").cast("double")), "z_price", least=50_000, covariates=["age"]))


@query(STAGE1 + """ select entity, grp, period, round(z_to - (level + b1 * z_from + b2 * age + b3 * age * age + b4 * lw), 6) as residual, (select count(*) from pf) as n from pf cross join s1 cross join s1_level""")
def ml1_persistence_residuals(spark, d):
    rows = cohort.persistence_frame(z_panel(spark, d).withColumn("age", F.col("n").cast("double")), "z_price", least=50_000, covariates=["age"])
    fit = linmod.fit_persistence(rows)
    z = linmod.linear(fit, linmod.persistence_features("z_from", "age", "log_weight", fit.extra["mean_log_weight"]))
    return rows.select("entity", "grp", "period", F.round(F.col("z_to") - z, 6).alias("residual"), F.lit(fit.n).cast("long").alias("n"))


@query(STAGE2 + """ select direction, n_level as n, round(level, 5) as level, round(b1, 5) as persisted, round(b2, 5) as log_weight, round(b3, 5) as gap, round(sqrt(rss / (s2.n - 3 - (select count(*) from s2_level))), 6) as residual_sd from s2_level cross join s2""")
def ml2_translation_levels(spark, d):
    fit = linmod.fit_translation(transitions(spark, d), _stage1(spark, d), age="n")
    return fit.extra["levels"].select("direction", "n", F.round("level", 5).alias("level"), *[F.round(F.lit(fit[c]), 5).alias(c) for c in fit.names], F.round(F.lit(fit.residual_sd), 6).alias("residual_sd"))


@query(STAGE1 + """, e as (select count(*) as n, avg(abs(target_mean - target_value)) as b_mean, avg(abs(source_value * 0.75 - target_value)) as b_folk, avg(abs(z_source * target_sd + target_mean - target_value)) as b_same_z, avg(abs(z_persist * target_sd + target_mean - target_value)) as b_persist from st),
l as (select n, b_mean, unnest([{'b': 'b_mean', 'm': b_mean}, {'b': 'b_folk', 'm': b_folk}, {'b': 'b_same_z', 'm': b_same_z}, {'b': 'b_persist', 'm': b_persist}]) as x from e)
select n, x.b as baseline, round(x.m, 4) as mae, round(1 - x.m / b_mean, 6) as skill from l""")
def ml5_baseline_errors(spark, d):
    frame = linmod.baselines(transitions(spark, d), linmod.persisted(_stage1(spark, d), "n"))
    errors = linmod.baseline_errors(frame, ["b_mean", "b_folk", "b_same_z", "b_persist"])
    reference = errors.where("baseline = 'b_mean'").select(F.col("mae").alias("r"))  # one row
    return errors.crossJoin(F.broadcast(reference)).select("n", "baseline", F.round("mae", 4).alias("mae"), F.round(1 - F.col("mae") / F.col("r"), 6).alias("skill"))


@query(STAGE2 + """, p as (select st.*, level + b1 * z_persist + b2 * lw + b3 * gap as z_hat, sqrt(rss / (s2.n - 3 - (select count(*) from s2_level))) as sd from st join s2_level using (direction) cross join s2)
select entity, direction, source_period, target_period, round(z_hat, 6) as z_hat, round(z_hat * target_sd + target_mean, 0) as value_hat, round((z_hat - 1.2815515655446004 * sd) * target_sd + target_mean, 0) as low, round((z_hat + 1.2815515655446004 * sd) * target_sd + target_mean, 0) as high from p""")
def ml3_predicted_transitions(spark, d):
    frame = transitions(spark, d)
    fit = linmod.fit_translation(frame, _stage1(spark, d), age="n")
    return linmod.predict(frame, fit, age="n").select("entity", "direction", "source_period", "target_period", *r6("z_hat"), *[F.round(c, 0).alias(c) for c in ("value_hat", "low", "high")])


FOLDS = (
    STAGE1
    + """, folds as (select target_period as fold from st where target_period >= 1996 group by 1 having count(*) >= 5),
tr as (select fold, st.* from st join folds on target_period < fold where not exists (select 1 from trans x where x.entity = st.entity and x.target_period = fold)),
"""
    + least_squares("s2", "tr", ["z_persist", "lw", "gap"], "z_target", ["fold"], ["direction"])
    + """, p as (select st.*, coalesce(level, 0) + b1 * z_persist + b2 * lw + b3 * gap as z_hat from st join s2 on s2.fold = target_period and s2.n >= 40 left join s2_level l on l.fold = target_period and l.direction = st.direction)
"""
)


@query(FOLDS + """select entity, direction, source_period, target_period, round(z_hat * target_sd + target_mean, 0) as value_hat, round(z_hat * target_sd + target_mean - target_value, 0) as error, round(target_mean, 2) as b_mean, round(source_value * 0.75 + 1.3e-5, 2) as b_folk, round(z_source * target_sd + target_mean, 2) as b_same_z, round(z_persist * target_sd + target_mean, 2) as b_persist from p""")
def ml6_walk_forward(spark, d):
    errors = linmod.walk_forward(kept(transitions(spark, d)), _stage1(spark, d), 1996, age="n")
    return errors.select("entity", "direction", "source_period", "target_period", F.round(F.col("b_folk") + 1.3e-5, 2).alias("b_folk"), *[F.round(c, 0).alias(c) for c in ("value_hat", "error")], *[F.round(c, 2).alias(c) for c in ("b_mean", "b_same_z", "b_persist")])


@query()
def ml7_shuffled_control(spark, d):
    return linmod.shuffled_control(kept(transitions(spark, d)), _stage1(spark, d), 1996, ["entity", "direction", "source_period"], age="n")


@query()
def ml8_bootstrap_interval(spark, d):
    errors = linmod.baselines(transitions(spark, d)).withColumn("error", F.col("b_mean") - F.col("target_value"))
    return linmod.cluster_bootstrap(errors, "entity", "error")


@query()
def ml9_inverse_mills(spark, d):
    moved = pairs(spark, d).select("entity", F.lit(1.0).alias("moved")).distinct()
    rows = z_panel(spark, d).where("z_price is not null").join(moved, "entity", "left").withColumn("moved", F.coalesce("moved", F.lit(0.0)))
    features = {"one": F.lit(1.0), "z": F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.col("z_price"))), "n": F.col("n").cast("double")}
    fit = linmod.probit(rows, features, F.col("moved"))
    return rows.select("entity", "grp", "period", linmod.inverse_mills(fit, features).alias("mills"))


EVENTS = """with u as (select user_id, date_trunc('week', ts)::date as week, count(*) filter (event_type = 'click')::double as a, count(*) filter (event_type = 'view')::double as b, count(*) filter (event_type not in ('click', 'view'))::double as c, avg(value) as v, count(*) as n from events group by 1, 2),
s as (select *, a / (a + b + c) as sa, b / (a + b + c) as sb, c / (a + b + c) as sc from u where n >= 5), l as (select *, ln((sa + 0.005) / 1.015) as la, ln((sb + 0.005) / 1.015) as lb, ln((sc + 0.005) / 1.015) as lc from s)
"""


def _features(spark, d):
    kind = lambda cond: F.count_if(cond).cast("double")
    e = table(spark, d, "events").groupBy("user_id", F.date_trunc("week", "ts").cast("date").alias("week")).agg(
        kind(F.col("event_type") == "click").alias("a"), kind(F.col("event_type") == "view").alias("b"), kind(~F.col("event_type").isin("click", "view")).alias("c"), F.avg("value").alias("v"), F.count("*").alias("n"))
    return roles.feature_frame(e, ["a", "b", "c"], ["v"], "n", 5)


@query(EVENTS + "select user_id, week, round(la - (la + lb + lc) / 3, 6) as clr_a, round(lb - (la + lb + lc) / 3, 6) as clr_b, round(lc - (la + lb + lc) / 3, 6) as clr_c from l")
def ml11_role_features(spark, d):
    return _features(spark, d).select("user_id", "week", *r6("clr_a", "clr_b", "clr_c"))


@query(EVENTS + "select user_id, week, round(case when stddev_pop(v) over w > 0 then (v - avg(v) over w) / stddev_pop(v) over w else 0.0 end, 5) as v from l window w as (partition by week)")
def ml12_population_z(spark, d):
    return moments.standardize_population(_features(spark, d), ["week"], ["v"]).select("user_id", "week", F.round("v", 5).alias("v"))


def _reduced(spark, d):
    """Written once: the components and every mixture read it."""
    z = kept(moments.standardize_population(_features(spark, d), ["week"], ["clr_a", "clr_b", "clr_c", "v"]))
    return roles.reduce_dimensions(z, ["clr_a", "clr_b", "v"])[0]


def _clustered(spark, d):
    reduced = _reduced(spark, d)
    return reduced, roles.mixture(reduced).transform(reduced)


@query()
def ml13_roles(spark, d):
    _, labelled = _clustered(spark, d)
    return labelled.select("user_id", "week", "cluster")


@query()
def ml15_role_stability(spark, d):
    reduced, labelled = _clustered(spark, d)
    return roles.stability(reduced, labelled, ["user_id", "week"])


@query()
def ml16_role_descriptions(spark, d):
    _, labelled = _clustered(spark, d)
    return roles.describe_clusters(labelled, ["clr_a", "clr_b", "clr_c", "v"], "user_id", "n")


@query("""with p as (select a.label, a.vec_id, b.vec_id as neighbour, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: cast(x[1] - x[2] as double) * cast(x[1] - x[2] as double)))) as distance from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id)
select label, vec_id, neighbour, round(distance, 5) as distance, rank::integer as rank from (select *, row_number() over (partition by label, vec_id order by distance, neighbour) as rank from p) where rank <= 10""")
def ml17_neighbours(spark, d):
    return roles.neighbours(table(spark, d, "embeddings"), "vec_id", "embedding", "label").select("label", "vec_id", "neighbour", F.round("distance", 5).alias("distance"), "rank")


@query("""with t as (select count(*) as n, avg((quality = toxic)::integer) as acc, avg(quality) as pa, avg(toxic) as pb from labels where quality is not null and toxic is not null)
select n, round(acc, 6) as accuracy, round(case when pa * pb + (1 - pa) * (1 - pb) < 1 then (acc - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) end, 6) as kappa from t""")
def ml18_kappa(spark, d):
    return A.kappa(table(spark, d, "labels"), "quality", "toxic").select("n", *r6("accuracy", "kappa"))


# ---- text audit ---------------------------------------------------------------------


def _texts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")


def _facts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.lit("F001").alias("fact_id"), F.lit("characters").alias("statement"), F.col("n_chars").cast("double").alias("value"), F.lit("count").alias("unit"))


@query("""select doc_id as doc, '[F001] characters: ' || n_chars || '' as body, substr(sha256('[F001] characters: ' || n_chars), 1, 16) as digest from documents""")
def str8_rendered_facts(spark, d):
    return A.render(_facts(spark, d)).withColumn("digest", A.digest())


@query("""select doc_id as doc, 1 as claim_no, 'unknown fact' as problem, 'L' || (doc_id % 7) as fact_id from documents where doc_id % 7 > 0 union all select doc_id, 2, 'uncited', null from documents""")
def tx4_citation_errors(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"))
    facts = docs.select("doc", F.lit("L0").alias("fact_id"))
    one = docs.select("doc", F.lit(1).alias("claim_no"), F.array(F.concat(F.lit("L"), (F.col("doc") % 7).cast("string"))).alias("cited"))
    return A.citation_errors(one.union(docs.select("doc", F.lit(2), F.array().cast("array<string>"))), facts)


@query("""select doc_id as doc, term from documents, (values ('the'), ('idiot'), ('Apache License')) t(term) where case when contains(term, ' ') then regexp_matches(strip_accents(text), '(?i)(^|[^\\p{L}\\p{N}_])' || term || '([^\\p{L}\\p{N}_]|$)') else regexp_matches(strip_accents(text), '(^|[^\\p{L}\\p{N}_])' || term || '([^\\p{L}\\p{N}_]|$)') end""")
def tx5_leaks(spark, d):
    docs = _texts(spark, d)
    terms = docs.select("doc", F.explode(F.array(F.lit("the"), F.lit("idiot"), F.lit("Apache License"))).alias("term"))
    return A.leaks(docs, terms)


@query("""select doc, coalesce(lead(doc) over (order by doc), first_value(doc) over (order by doc)) as other from (select distinct item_id as doc from benchmark)""")
def tx7_distractors(spark, d):
    return A.distractors(table(spark, d, "benchmark").select(F.col("item_id").alias("doc")))


@query("""select doc_id as key, md5(text) as digest, case when doc_id % 3 = 0 then md5(text || '!') end as now from documents where doc_id % 3 = 0 or doc_id % 3 = 1""")
def tx8_stale_entries(spark, d):
    docs = table(spark, d, "documents")
    current = docs.where("doc_id % 3 <> 1").select(F.col("doc_id").alias("key"), F.when(F.col("doc_id") % 3 == 0, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text")).alias("digest"))
    return A.stale(docs.select(F.col("doc_id").alias("key"), F.md5("text").alias("digest")), current)


# ---- contracts and checks ---------------------------------------------------------------


@query(PANEL + """select 'changes' as name, count(*) filter (source_group = target_group) as violations from pairs union all select 'gap', count(*) filter (not gap between 1 and 2) from pairs
union all select 'unique', count(*) from (select 1 from panel group by entity, grp, period having count(*) > 1) union all select 'functional', count(*) from (select grp from panel group by grp having count(distinct period) > 1)
union all select 'weights', count(*) filter (weight < 0) from panel union all select 'range', count(*) filter (not n between 1 and 3) from panel
union all select 'agreement', case when avg(abs(weight / n - price)) > 0.01 then 1 else 0 end::bigint from panel
union all select 'orphans', count(*) from panel where entity not in (select c_custkey from customer where c_custkey % 2 = 0)""")
def va_integrity_checks(spark, d):
    p, pr = panel(spark, d), pairs(spark, d)
    even = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("entity"))
    parts = [
        C.count_where("changes", pr, F.col("source_group") == F.col("target_group")), C.count_where("gap", pr, ~F.col("gap").between(1, 2)), C.not_unique("unique", p, ["entity", "grp", "period"]),
        C.not_functional("functional", p, ["grp"], "period"), C.count_where("weights", p, F.col("weight") < 0), C.out_of_range("range", p, {"n": (1, 3)}),
        C.agreement("agreement", p.withColumn("again", F.col("weight") / F.col("n")), "again", "price", 0.01), C.orphans("orphans", p, even, ["entity"]),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


@query("""select 'c_custkey' as "column", round(1 - count(c_custkey) / count(*), 6) as null_rate, min(c_custkey)::varchar as min, max(c_custkey)::varchar as max, count(*) as n_rows from customer
union all select 'c_name', round(1 - count(c_name) / count(*), 6), min(c_name), max(c_name), count(*) from customer union all select 'c_nationkey', round(1 - count(c_nationkey) / count(*), 6), min(c_nationkey)::varchar, max(c_nationkey)::varchar, count(*) from customer""")
def va10_profile(spark, d):
    return C.profile(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")).drop("dtype")


@query("""with h as (select md5(len(c_custkey::varchar) || ':' || c_custkey || '|' || len(c_name) || ':' || c_name) as m from customer) select count(*) as n_rows, substr(sha256(count(*) || '-' || sum(('0x' || substr(m, 1, 8))::bigint) || '-' || sum(('0x' || substr(m, 9, 8))::bigint) || '-' || sum(('0x' || substr(m, 17, 8))::bigint) || '-' || sum(('0x' || substr(m, 25, 8))::bigint)), 1, 32) as content_hash from h""")
def va11_content_hash(spark, d):
    return C.content_hash(table(spark, d, "customer").select("c_custkey", "c_name"))


@query("""with n as (select count(*) as n, count(*) filter (c_custkey <= 5) as few, count(*) filter (c_custkey % 3 = 0) as third from customer),
x as (select unnest([{'c': 'c_acctbal', 'p': 'removed', 'r': null::double}, {'c': 'c_name', 'p': case when few > 0 then 'null_rate' end, 'r': few / n}, {'c': 'c_mktsegment', 'p': case when third > 0 then 'null_rate' end, 'r': third / n}, {'c': 'extra', 'p': 'added', 'r': 0.0}]) as x from n)
select x.c as "column", x.p as problem, round(x.r, 6) as null_rate from x where x.p is not null""")
def va12_contract_differences(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal")
    thirds = F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("c_mktsegment")
    changed = c.select("c_custkey", F.when(F.col("c_custkey") > 5, F.col("c_name")).alias("c_name"), thirds, "c_nationkey", F.lit(1).alias("extra"))
    now = C.profile(changed)
    return C.compare_contracts(C.profile(c), now).join(now.select("column", "null_rate"), "column", "left").select("column", "problem", F.round("null_rate", 6).alias("null_rate"))


# ---- serving -----------------------------------------------------------------------------


def _persons(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("display_name"), F.lower("c_name").alias("normalized_name"), F.when(F.col("c_custkey") % 5 == 0, "A+B").otherwise("A").alias("systems"))


@query("""with p as (select c_custkey as person_id, (['Renée', 'Zoë', 'Ðiego', 'Ann'])[c_custkey % 4 + 1] || ' ' || c_name as display_name, (['renee', 'zoe', 'diego', 'ann'])[c_custkey % 4 + 1] || ' ' || lower(replace(c_name, '#', ' ')) as normalized_name, case when c_custkey % 5 = 0 then 'A+B' else 'A' end as systems from customer)
select *, row_number() over (order by case when systems = 'A+B' then 0 else 1 end, display_name, person_id)::integer as place from p where contains(normalized_name, 'zoe customer') qualify place <= 20""")
def q1_search(spark, d):
    first = F.element_at(F.array(*[F.lit(x) for x in ("Renée", "Zoë", "Ðiego", "Ann")]), (F.col("person_id") % 4 + 1).cast("int"))
    named = _persons(spark, d).withColumn("display_name", F.concat_ws(" ", first, "display_name"))
    return serving.search(named.withColumn("normalized_name", N.normalized("display_name")), " ZÖE Customer ")


@query(PANEL + "select entity as person_id, grp, period, round(weight, 2) as weight from panel where entity = 7")
def q2_career(spark, d):
    seasons = panel(spark, d).withColumnRenamed("entity", "person_id")
    return serving.profile(7, _persons(spark, d), seasons, _identities(spark, d))["career"].select("person_id", "grp", "period", F.round("weight", 2).alias("weight"))


def _predictions(spark, d):
    return transitions(spark, d).select(F.col("entity").alias("person_id"), "direction", "target_period", F.lit("price").alias("metric"), F.round(F.col("z_source") * F.col("target_sd") + F.col("target_mean"), 2).alias("predicted"), (F.col("z_source") < 1).alias("in_support"))


PREDICTED = PANEL + ", pr as (select entity as person_id, direction, target_period, 'price' as metric, round(z_source * target_sd + target_mean, 2) as predicted, z_source < 1 as in_support from trans)\n"


@query(PREDICTED + "select * from pr where person_id = (select min(person_id) from pr)")
def q3_predictions(spark, d):
    rows = _predictions(spark, d)
    first = rows.agg(F.min("person_id")).first()[0]
    return serving.predictions_of(rows, first)


@query(PREDICTED + "select pr.*, c_name as display_name from pr join customer on c_custkey = person_id where direction = '1-URGENT->2-HIGH' order by predicted desc, person_id limit 25")
def q6_leaderboard(spark, d):
    return serving.leaderboard(_predictions(spark, d), _persons(spark, d), "predicted", direction="1-URGENT->2-HIGH")


@query(PREDICTED + "select pr.*, c_name as display_name from pr left join customer on c_custkey = person_id where predicted >= 100000 order by predicted desc, person_id, direction, target_period limit 40 offset 20")
def q7_projection_page(spark, d):
    page = serving.projection_page(_predictions(spark, d), _persons(spark, d), least=100_000.0, limit=40, offset=20, ties=["direction", "target_period"])
    return page.rows


@query(PREDICTED + "select pr.*, c_name as display_name from pr left join customer on c_custkey = person_id order by predicted desc, person_id, direction, target_period limit 60 offset (select count(*) * 3 // 4 from pr)")
def q7_deep_page(spark, d):
    rows = _predictions(spark, d)
    deep = serving.projection_page(rows, _persons(spark, d), limit=60, offset=rows.count() * 3 // 4, ties=["direction", "target_period"], top=500)
    return deep.rows


@query(PREDICTED + "select count(*) as total, count(*) filter (not in_support) as out_of_support from pr where predicted >= 100000")
def q7_projection_totals(spark, d):
    return serving.projection_page(_predictions(spark, d), _persons(spark, d), least=100_000.0).totals


@query("""with p as (select a.label as period, a.vec_id as person_id, b.vec_id as neighbour, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: cast(x[1] - x[2] as double) * cast(x[1] - x[2] as double)))) as distance from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id = 3)
select neighbour, person_id, rank::integer as rank, c_name as display_name from (select *, row_number() over (order by distance, neighbour) as rank from p) join customer on c_custkey = neighbour where rank <= 10""")
def q10_comparables(spark, d):
    comps = roles.neighbours(table(spark, d, "embeddings"), "vec_id", "embedding", "label", of=F.col("vec_id") == 3).withColumnRenamed("vec_id", "person_id").withColumnRenamed("label", "period")
    return serving.comparables(3, comps, _persons(spark, d)).select("neighbour", "person_id", "rank", "display_name")


@query("""with t as (select l_suppkey as person_id, year(l_shipdate)::integer as period, count(*) as attempts from lineitem group by 1, 2) select person_id, period, attempts, s_name as display_name from t join supplier on s_suppkey = person_id where period = 1996 order by attempts desc, person_id limit 25""")
def q12_shooting_leaders(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("person_id"), F.year("l_shipdate").alias("period")).agg(F.count("*").alias("attempts"))
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("display_name"))
    return serving.leaderboard(t, names, "attempts", period=1996)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tidemark.plans import extended, intake  # noqa: F401  (they register their own)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from tidemark.plans import extended, intake  # noqa: F401

    return dict(SQL)
