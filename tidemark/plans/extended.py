"""More registered queries: fact tables, number tracing, serving, checks, sources and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.functions import names as N
from tidemark.operators import audit as A
from tidemark.operators import checks as C
from tidemark.operators import evidence as E
from tidemark.operators import identity, linmod, moments, roles, serving, shrink
from tidemark.plans import catalog as K
from tidemark.plans.registry import query
from tidemark.sources.shared import kept
from tidemark.sources.tables import table


# ---- fact tables ------------------------------------------------------------------

FACTS = K.PANEL + """, q as (select count(*) as n_evaluated, avg(abs(z_source * target_sd + target_mean - target_value)) as mae, avg(abs(target_mean - target_value)) as b_mean, avg(abs(source_value * 0.75 - target_value)) as b_folk from trans),
slopes as (select direction, regr_slope(z_target, z_source) as slope from trans group by 1 having count(*) >= 5), dirs as (select direction, count(*) as n_direction from pairs group by 1),
cells as (select distinct direction, source_group as grp, source_period as period from trans),
sel as (select m.direction, mover_mean - peer_mean as selection from (select direction, avg(z_source) as mover_mean from trans group by 1) m left join (select direction, avg(z_price) as peer_mean from zp join cells using (grp, period) where qualified and z_price is not null group by 1) p on p.direction = m.direction),
fr as (select t.*, z_source * target_sd + target_mean as projected, q.*, least(b_mean, b_folk) as best_mae, case when b_folk <= b_mean then 'b_folk' else 'b_mean' end as best, slope, n_direction, selection
  from trans t cross join q left join slopes using (direction) left join dirs using (direction) left join sel using (direction)),
fl as (select *, unnest([
 {'at': 1, 's': 'Forecast of price after the move', 'v': projected, 'u': 'number', 'src': 'model', 'm': 'price', 'r': 'projected'},
 {'at': 2, 's': '10th percentile of the forecast of price', 'v': projected - 1.2815515655446004 * target_sd, 'u': 'number', 'src': 'model', 'm': 'price', 'r': 'low80'}, {'at': 3, 's': '90th percentile of the forecast of price', 'v': projected + 1.2815515655446004 * target_sd, 'u': 'number', 'src': 'model', 'm': 'price', 'r': 'high80'},
 {'at': 4, 's': '2.5th percentile of the forecast of price', 'v': projected - 1.959963984540054 * target_sd, 'u': 'number', 'src': 'model', 'm': 'price', 'r': 'low95'}, {'at': 5, 's': '97.5th percentile of the forecast of price', 'v': projected + 1.959963984540054 * target_sd, 'u': 'number', 'src': 'model', 'm': 'price', 'r': 'high95'},
 {'at': 6, 's': 'Observed price before the move', 'v': source_value, 'u': 'number', 'src': 'panel.price', 'm': 'price', 'r': 'source'}, {'at': 7, 's': 'Observed price less the mean of its cell, in standard deviations', 'v': z_source, 'u': 'sd', 'src': 'panel.z_price', 'm': 'price', 'r': 'z'},
 {'at': 8, 's': 'Mean price where the move leads, by weight', 'v': target_mean, 'u': 'number', 'src': 'moments', 'm': 'price', 'r': 'mean'}, {'at': 9, 's': 'Spread of price where the move leads', 'v': target_sd, 'u': 'number', 'src': 'moments', 'm': 'price', 'r': 'sd'},
 {'at': 10, 's': 'price at an unchanged number of standard deviations', 'v': projected, 'u': 'number', 'src': 'baselines', 'm': 'price', 'r': 'same_z'}, {'at': 11, 's': 'price by the fixed multiplier', 'v': source_value * 0.75, 'u': 'number', 'src': 'baselines', 'm': 'price', 'r': 'folk'},
 {'at': 12, 's': 'Mean miss of price forecasts (' || n_evaluated || ' moves)', 'v': mae, 'u': 'number', 'src': 'run', 'm': 'price', 'r': 'mae'},
 {'at': 13, 's': 'Mean miss of price by rule ' || best || ', ' || case when mae < best_mae then 'more than the forecast''s' else 'no more than the forecast''s, so the rule is preferred' end, 'v': best_mae, 'u': 'number', 'src': 'run', 'm': 'price', 'r': 'best_mae'},
 {'at': 14, 's': case when slope is not null then 'Gain of price standing per unit of earlier standing, ' || direction end, 'v': slope, 'u': 'none', 'src': 'run', 'm': 'price', 'r': 'slope'},
 {'at': 15, 's': 'Moves along ' || direction, 'v': n_direction::double, 'u': 'count', 'src': 'pairs', 'm': null, 'r': null}, {'at': 16, 's': case when selection is not null then 'Lead of movers along ' || direction || ' over those who stayed, before moving' end, 'v': selection, 'u': 'sd', 'src': 'selection', 'm': null, 'r': null},
 {'at': 17, 's': 'Orders, last period before the move', 'v': n::double, 'u': 'count', 'src': 'panel.n', 'm': null, 'r': null}, {'at': 18, 's': 'Revenue, last period before the move', 'v': source_weight, 'u': 'number', 'src': 'panel.source_weight', 'm': null, 'r': null},
 {'at': 19, 's': case when gap > 1 then 'Periods from the last one before the move to the first one after it' end, 'v': gap::double, 'u': 'count', 'src': 'pairs.gap', 'm': null, 'r': null},
 {'at': 20, 's': source_group || ' left after ' || source_period || ' for ' || target_group, 'v': null::double, 'u': 'period', 'src': 'pairs', 'm': null, 'r': null}]) as f from fr),
facts as (select entity, direction, source_period, target_period, 'f' || lpad(row_number() over (partition by entity, direction, source_period, target_period order by f.at)::varchar, 2, '0') as fact_id, f.s as statement, f.v as value, f.u as unit, f.src as source, f.m as metric, f.r as role from fl where f.s is not null)
"""
# values as they are compared: few enough digits that the order of a sum does not show, and no halves
SHORT = "case when abs(value) >= 1000 then round(value + 1.3e-5, 1) else round(value + 1e-7, 4) end"
KEY = ["entity", "direction", "source_period", "target_period"]


def _facts(spark, d) -> DataFrame:
    """The whole fact table of every move, with the standing-preserving prediction as the model."""
    t = kept(K.transitions(spark, d))
    one, wide = X.normal_quantile(0.8), X.normal_quantile(0.95)
    t = linmod.baselines(t).withColumns({"price_source": F.col("source_value"), "price_z": F.col("z_source"), "price_projected": F.col("b_same_z"), "price_mean": F.col("target_mean"), "price_sd": F.col("target_sd"), "price_same_z": F.col("b_same_z"), "price_folk": F.col("b_folk")})
    t = t.withColumns({f"price_{side}{level}": F.col("price_projected") + sign * q * F.col("target_sd") for level, q in ((80, one), (95, wide)) for side, sign in (("low", -1), ("high", 1))})
    model = linmod.baseline_errors(t, ["b_same_z"]).select(F.col("n").alias("price_n_evaluated"), F.col("mae").alias("price_mae"))
    best = linmod.best_baseline(linmod.baseline_errors(t, ["b_mean", "b_folk"])).select(F.col("baseline").alias("price_best"), F.col("mae").alias("price_best_mae"))
    # one row each, whatever the input
    t = t.crossJoin(F.broadcast(model)).crossJoin(F.broadcast(best))
    slopes = linmod.direction_slopes(t, "z_source", "z_target", least=5).select("direction", F.col("slope").alias("price_slope"))
    counts = K.pairs(spark, d).groupBy("direction").agg(F.count("*").alias("n_direction"))
    chosen = K.cohort.selection_summary(t, K.z_panel(spark, d), "price", F.col("qualified")).select("direction", "selection")
    frame = t.join(slopes, "direction", "left").join(counts, "direction", "left").join(chosen, "direction", "left")
    say = E.Facts()
    facts = [*say.metric("price", "price", "number", folk=True), *say.quality("price", "price", "number"), *say.cohort(), *say.move({"n": ("Orders", "count"), "source_weight": ("Revenue", "number")})]
    return E.fact_table(frame, KEY, facts)


def _short():
    return F.when(F.abs("value") >= 1000, F.round(F.col("value") + 1.3e-5, 1)).otherwise(F.round(F.col("value") + 1e-7, 4))


@query(FACTS + "select entity, direction, source_period, target_period, fact_id, statement, " + SHORT + " as value, unit, source, metric, role from facts")
def ent15_fact_table(spark, d):
    return _facts(spark, d).withColumn("value", _short())


def _bundles(spark, d) -> DataFrame:
    return _facts(spark, d).select(F.concat_ws("|", *KEY).alias("doc"), "fact_id", "statement", (_short() + 3e-5).alias("value"), "unit", "metric", "role")


@query(FACTS + """, v as (select concat_ws('|', entity, direction, source_period, target_period) as doc, role, x.shown, x.v from (select *, unnest([{'shown': 0, 'v': value}, {'shown': 1, 'v': round(value, 2)}]) as x from (select * replace (""" + SHORT + """ + 3e-5 as value) from facts) where metric is not null and value is not null)),
p as (select doc, shown, max(v) filter (role = 'low80') as l8, max(v) filter (role = 'high80') as h8, max(v) filter (role = 'low95') as l9, max(v) filter (role = 'high95') as h9, max(v) filter (role = 'mean') as m, max(v) filter (role = 'sd') as s, max(v) filter (role = 'source') as a, max(v) filter (role = 'projected') as b from v group by 1, 2),
f as (select doc, unnest([h8 - l8, h9 - l9, abs(b - a), abs(case when s > 0 then (b - m) / s end)]) as form from p)
select doc, round(c + 3e-5, 2) as candidate from (select doc, unnest([form, form * 100]) as c from f where form is not null) group by 1, 2""")
def tx2_derived_candidates(spark, d):
    return A.derived(_bundles(spark, d)).select("doc", F.round(F.col("candidate") + 3e-5, 2).alias("candidate")).distinct()


# ---- numbers and names in texts --------------------------------------------------------

NUMBERS = """with lists as (select doc_id as doc, regexp_extract_all(text, '(^|[^\\w%])([-+]?\\d[\\d,]*(?:\\.\\d+)?%?)', 2) as l from documents),
tokens as (select doc, unnest(l) as token, unnest(generate_series(0, len(l) - 1))::integer as token_no from lists),
numbers as (select doc, token_no, token, try_cast(regexp_replace(token, '[,%+]', '', 'g') as double) as value, 0.5 * pow(10.0, -length(regexp_extract(token, '\\.(\\d+)', 1))) as w, case when token like '%\\%' escape '\\' then try_cast(regexp_replace(token, '[,%+]', '', 'g') as double) / 100 end as as_share from tokens),
cand as (select doc_id as doc, n_chars * c as candidate from documents, (values (1.0::double), (100.0), (0.01), (1000.0), (0.001)) t(c))
"""


@query(NUMBERS + """select doc, token_no, token, value, round(w, 12) as "window", as_share from numbers""")
def tx1_numbers(spark, d):
    return A.numbers(K._texts(spark, d)).select("doc", "token_no", "token", "value", F.round("window", 12).alias("window"), "as_share")


@query(NUMBERS + """select doc, token_no, token, coalesce(bool_or(abs(value - candidate) <= w + 1e-9 or abs(as_share - candidate) <= w / 100 + 1e-9), false) as traced from numbers left join cand using (doc) group by 1, 2, 3""")
def tx3_traced_numbers(spark, d):
    return A.trace(A.numbers(K._texts(spark, d)), A.candidates(K._facts(spark, d), A.render(K._facts(spark, d)))).select("doc", "token_no", "token", "traced")


@query(NUMBERS + """, turns as (select doc, coalesce(lead(doc) over (order by doc), min(doc) over ()) as other from (select distinct doc_id as doc from documents)),
own as (select doc, token_no, coalesce(bool_or(abs(value - candidate) <= w + 1e-9 or abs(as_share - candidate) <= w / 100 + 1e-9), false) as ok from numbers left join cand using (doc) group by 1, 2),
oth as (select n.doc, token_no, coalesce(bool_or(abs(value - candidate) <= w + 1e-9 or abs(as_share - candidate) <= w / 100 + 1e-9), false) as ok from numbers n join turns t on t.doc = n.doc left join cand c on c.doc = t.other group by 1, 2)
select doc, count(*) as n_numbers, count(*) filter (own.ok) as own, count(*) filter (oth.ok) as other from own join oth using (doc, token_no) group by 1""")
def tx7_distractor_scores(spark, d):
    return A.distractor_scores(K._texts(spark, d), K._facts(spark, d), A.render(K._facts(spark, d)))


# the texts are invented, so the rules look for words that they have
RULES = A.Rules(metric=("the",), up=("that", "than"), down=("for", "with"), spread=("which", "are"), certain=("was",), reach=3)
_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(f"""with s as (select doc_id as doc, unnest(string_split_regex(lower(text), '[.!?\n]+')) as s from documents),
w as (select doc, list_filter(string_split_regex(s, '[^\\p{{L}}]+'), lambda x: x <> '') as w from s),
p as (select doc, w, unnest(generate_series(1, len(w))) as i from w),
a as (select doc, w[i] as x, w[greatest(i - 3, 1):i + 3] as around from p),
n as (select doc, count(*) filter (list_contains({_list(RULES.up)}, x) and list_has_any(around, {_list(RULES.metric)}) and not list_has_any(around, {_list(RULES.spread)})) as n_up,
  count(*) filter (list_contains({_list(RULES.down)}, x) and list_has_any(around, {_list(RULES.metric)}) and not list_has_any(around, {_list(RULES.spread)})) as n_down, count(*) filter (list_contains({_list(RULES.certain)}, x)) as n_certain from a group by 1),
r as (select doc, unnest([{{'rule': 'direction', 'n': case when doc % 3 - 1 < 0 then n_up when doc % 3 - 1 > 0 then n_down end}}, {{'rule': 'certainty', 'n': n_certain}}, {{'rule': 'confidence', 'n': case when doc % 5 = 0 and doc % 2 = 1 then 1 end}}]) as b from n)
select doc, b.rule as rule, b.n as n from r where b.n > 0""")
def tx6_rule_errors(spark, d):
    docs = K._texts(spark, d)
    outcome = docs.select("doc", (F.col("doc") % 3 - 1).alias("change"), (F.col("doc") % 5 == 0).alias("confident"), (F.col("doc") % 2 == 0).alias("beats_baseline"))
    return A.rule_errors(docs, outcome, RULES)


PLAIN = "lower(replace(strip_accents(translate({}, 'đĐðÐøØłŁ', 'dDdDoOlL')), 'ß', 'ss'))"
WORD = "\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}"


@query("""with sentences as (select doc_id as doc, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) as sentence from documents),
words as (select doc, unnest((regexp_extract_all(sentence, '[""" + WORD + """''’-]+'))[2:]) as word from sentences),
names as (select distinct doc, word from words where regexp_matches(word, '^\\p{Lu}\\p{Ll}')),
parts as (select doc, word, unnest(string_split(regexp_replace(""" + PLAIN.format("word") + """, '[''’]s$', ''), '-')) as part from names),
known as (select distinct doc_id as doc, unnest(regexp_extract_all(""" + PLAIN.format("substr(text, 1, length(text) // 2)") + """, '[""" + WORD + """]+')) as part from documents)
select distinct doc, word from parts anti join known using (doc, part)""")
def tx5_unsupported_names(spark, d):
    """The first half of each text is taken as the evidence for the whole."""
    docs = K._texts(spark, d)
    return A.unsupported_names(docs, docs.select("doc", F.col("text").substr(F.lit(1), F.length("text") / 2).alias("body")))


@query("""select c_custkey, case c_custkey % 4 when 3 then 'smith ' || ab else ab || ' smith' end as name, ab || ' smith' as key from (select c_custkey, lower(substr('ABCDEFGHIJ', (c_custkey % 10 + 1)::integer, 1) || substr('KLMNOPQRST', (c_custkey % 7 + 1)::integer, 1)) as ab from customer)""")
def str2_initials(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.substring(F.lit("ABCDEFGHIJ"), (F.col("c_custkey") % 10 + 1).cast("int"), 1).alias("a"), F.substring(F.lit("KLMNOPQRST"), (F.col("c_custkey") % 7 + 1).cast("int"), 1).alias("b"))
    kind = F.col("c_custkey") % 4
    name = F.when(kind == 0, F.format_string("%s. %s. Smith Jr.", "a", "b")).when(kind == 1, F.format_string(" %s%s  SMITH", "a", "b")).when(kind == 2, F.format_string("%s %s Smith III", "a", "b")).otherwise(F.format_string("Smith, %s.%s.", "a", "b"))
    return c.select("c_custkey", N.normalized(name).alias("name"), N.match_key(name).alias("key"))


# names of parts as LAST, FIRST: what follows the first comma comes first
@query("""with w as (select p_partkey, string_split(lower(p_name), ' ') as w from part), t as (select p_partkey, list_transform(w, lambda x: upper(substr(x, 1, 1)) || substr(x, 2)) as w from w)
select p_partkey, case when p_partkey % 3 = 0 then w[2] || '-' || w[1] || ' ' || w[1] when p_partkey % 3 = 1 then w[2] || ', Jr ' || w[1] else w[1] || ' ' || w[2] end as name from t""")
def str4_first_last(spark, d):
    p = table(spark, d, "part").withColumn("w", F.split(F.upper("p_name"), " "))
    one, two, kind = F.get("w", F.lit(0)), F.get("w", F.lit(1)), F.col("p_partkey") % 3
    raw = F.when(kind == 0, F.concat(one, F.lit(", "), two, F.lit("-"), one)).when(kind == 1, F.concat(one, F.lit(",  "), two, F.lit(", JR"))).otherwise(F.concat(F.lit(" "), one, F.lit(" "), two, F.lit(" ")))
    return p.select("p_partkey", N.first_last(raw).alias("name"))


@query("""select l_orderkey, l_linenumber, printf('%.1f', round(l_tax * 100, 1)) || '%' as share, printf('%.0f', l_quantity) as whole, printf('%.2f', round(l_discount, 2)) as number, 'n/a' as missing from lineitem""")
def str8_display(spark, d):
    shown = lambda c, u: A.display(c, F.lit(u))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", shown("l_tax", "fraction").alias("share"), shown("l_quantity", "count").alias("whole"), shown("l_discount", "number").alias("number"), shown(F.lit(None).cast("double"), "count").alias("missing"))


# ---- expressions, unions, models -----------------------------------------------------------


@query("""select l_orderkey, l_linenumber, round(case when q > 0 and l_quantity / (q / 5) * 40 - l_linenumber > 0 then l_discount / (l_quantity / (q / 5) * 40 - l_linenumber) end, 8) as share, 1998 - l_linenumber::double as born,
 round(case when l_tax > 0 then ln(l_tax) end, 8) as log_tax, round(1.2815515655446004 * l_tax + l_discount, 8) as high from (select *, case when l_linenumber < 7 then 50.0 else 0.0 end as q from lineitem)""")
def ma_expressions(spark, d):
    rows = table(spark, d, "lineitem").withColumns({"q": F.when(F.col("l_linenumber") < 7, 50.0).otherwise(0.0), "makes": F.lit(40.0), "age": F.col("l_linenumber").cast("double"), "at": F.lit(1998)})
    return rows.select(
        "l_orderkey", "l_linenumber", F.round(X.share_while_active("l_discount", "l_quantity", "q", "makes", "age"), 8).alias("share"), X.birth_period("at", "age").alias("born"),
        F.round(X.log_weight("l_tax"), 8).alias("log_tax"), F.round(X.from_z(F.lit(X.normal_quantile(0.8)), "l_discount", "l_tax"), 8).alias("high"))


@query("select c_custkey as id, c_acctbal as balance, null::integer as size from customer union all by name select p_partkey as id, p_size as size from part union all by name select s_suppkey as id, s_acctbal as balance from supplier")
def so2_union_of_differing(spark, d):
    c, p, s = (table(spark, d, t) for t in ("customer", "part", "supplier"))
    return identity.union_of([c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")), p.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size")), s.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))])


@query(K.PANEL + """, e as (select avg(abs(target_mean - target_value)) as b_mean, avg(abs(source_value * 0.75 - target_value)) as b_folk, avg(abs(z_source * target_sd + target_mean - target_value)) as b_same_z from trans),
l as (select unnest([{'b': 'b_mean', 'm': b_mean}, {'b': 'b_folk', 'm': b_folk}, {'b': 'b_same_z', 'm': b_same_z}]) as x from e)
select x.b as baseline, round(x.m, 4) as mae, round(1 - x.m / (select b_mean from e), 6) as skill from l order by x.m, x.b limit 1""")
def ag15_best_baseline(spark, d):
    errors = linmod.baseline_errors(linmod.baselines(K.transitions(spark, d)), ["b_mean", "b_folk", "b_same_z"])
    reference = errors.where("baseline = 'b_mean'").select(F.col("mae").alias("r"))
    return linmod.best_baseline(errors).crossJoin(F.broadcast(reference)).select("baseline", F.round("mae", 4).alias("mae"), F.round(1 - F.col("mae") / F.col("r"), 6).alias("skill"))


@query()
def ml14_held_out_log_likelihood(spark, d):
    found = roles.held_out_log_likelihood(K._reduced(spark, d).withColumn("day", F.unix_date("week")), "day", list(range(3, 11)))
    return spark.createDataFrame(found, "k int, log_likelihood double")


# ---- serving ----------------------------------------------------------------------------------


@query("select n_name as model_version, n_nationkey * 7 % 25 as trained_at, row_number() over (order by n_nationkey * 7 % 25 desc, n_name)::integer as place from nation")
def q4_models(spark, d):
    return serving.newest_first(table(spark, d, "nation").select(F.col("n_name").alias("model_version"), (F.col("n_nationkey") * 7 % 25).alias("trained_at")))


@query("""with v as (select min(n_nationkey) as k from nation where n_nationkey > 2) select 'model' as part, n_name as name, 1 as n from nation, v where n_nationkey = k union all select 'evaluations', c_mktsegment, count(*) from customer, v where c_nationkey = k group by 2 union all select 'selection', 's', count(*) from supplier, v where s_nationkey = k having count(*) > 0""")
def q5_evaluation(spark, d):
    version = table(spark, d, "nation").where("n_nationkey > 2").agg(F.min("n_nationkey")).first()[0]
    models = table(spark, d, "nation").select(F.col("n_nationkey").alias("model_version"), F.col("n_name").alias("name"), F.lit(1).cast("long").alias("n"))
    runs = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("model_version"), F.col("c_mktsegment").alias("name")).agg(F.count("*").alias("n"))
    chosen = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("model_version"), F.lit("s").alias("name")).agg(F.count("*").alias("n"))
    found = serving.evaluation(version, models, runs, chosen)
    return reduce(DataFrame.union, [df.select(F.lit(part).alias("part"), "name", "n") for part, df in found.items()])


DEFINITIONS = "select n_nationkey as cluster, n_name as label, case when n_nationkey % 6 <> 5 then (n_nationkey * 7 % 25) / 25.0::double end as stability, n_nationkey % 6 <> 5 and n_nationkey * 7 % 25 >= 12 as reportable from nation"


def _definitions(spark, d):
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select(n.alias("cluster"), F.col("n_name").alias("label"), F.when(n % 6 != 5, (n * 7 % 25) / 25.0).alias("stability"), ((n % 6 != 5) & (n * 7 % 25 >= 12)).alias("reportable"))


@query(f"select row_number() over (order by stability desc nulls last, cluster) as place, cluster, label, stability, case when not reportable then 'not stable enough to report' end as warning from ({DEFINITIONS})")
def q8_archetypes(spark, d):
    ordered = serving.placed(serving.archetypes(_definitions(spark, d)), [*serving.descending("stability"), F.col("cluster")], 100)
    return ordered.select("place", "cluster", "label", "stability", "warning")


@query("""with defs as (select c_mktsegment as model_version, c_nationkey as cluster, count(*) as members from customer group by 1, 2) select c_custkey as person_id, model_version, cluster, c_custkey % 5 as period, members from customer join defs on model_version = c_mktsegment and cluster = c_nationkey where c_custkey = 7""")
def q9_archetype_of(spark, d):
    c = table(spark, d, "customer")
    defs = c.groupBy(F.col("c_mktsegment").alias("model_version"), F.col("c_nationkey").alias("cluster")).agg(F.count("*").alias("members"))
    labels = c.select(F.col("c_custkey").alias("person_id"), F.col("c_mktsegment").alias("model_version"), F.col("c_nationkey").alias("cluster"), (F.col("c_custkey") % 5).alias("period"))
    return serving.archetype_of(7, labels, defs).select("person_id", "model_version", "cluster", "period", "members")


SHOTS = "with s as (select l_suppkey as person_id, year(l_shipdate)::integer as period, count(*) as attempts, count(*) / (count(*) + 100.0)::double as data_weight from lineitem group by 1, 2)\n"


def _shots(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("person_id"), F.year("l_shipdate").alias("period")).agg(F.count("*").alias("attempts"))
    return rows.withColumn("data_weight", F.col("attempts") / (F.col("attempts") + 100.0))


@query(SHOTS + "select person_id, period, attempts, round(data_weight, 8) as data_weight from s where person_id = 3 order by period")
def q11_shooting(spark, d):
    return serving.shooting_of(3, _shots(spark, d)).rows.select("person_id", "period", "attempts", F.round("data_weight", 8).alias("data_weight"))


@query(SHOTS + "select count(*) as total, count(*) filter (data_weight < 0.5) as mostly_prior from s where person_id = 3")
def q11_shooting_totals(spark, d):
    return serving.shooting_of(3, _shots(spark, d)).totals


@query("""select o_custkey as person_id, max(o_orderkey) as created_at, arg_max(o_orderpriority, o_orderkey) as text, 'f' || max(o_orderkey) as fact from orders where o_orderkey % 3 > 0 and o_custkey = (select min(o_custkey) from orders where o_orderkey % 3 > 0) group by 1""")
def q13_latest_report(spark, d):
    o = table(spark, d, "orders")
    person = o.where("o_orderkey % 3 > 0").agg(F.min("o_custkey")).first()[0]
    claims = F.to_json(F.array(F.struct(F.col("o_orderpriority").alias("text"), F.array(F.concat(F.lit("f"), F.col("o_orderkey").cast("string"))).alias("facts"))))
    reports = o.select(F.col("o_custkey").alias("person_id"), (F.col("o_orderkey") % 3 == 0).alias("anonymized"), F.col("o_orderkey").alias("created_at"), claims.alias("claims"))
    return serving.latest_report(person, reports).select("person_id", "created_at", F.col("claims")[0]["text"].alias("text"), F.col("claims")[0]["facts"][0].alias("fact"))


@query("""select 'customer' as "table", (select count(*) from information_schema.columns where table_name = 'customer')::integer as n_columns, (select count(*) from customer) as n_rows union all select 'nation', (select count(*) from information_schema.columns where table_name = 'nation')::integer, (select count(*) from nation)
union all select 'orders', (select count(*) from information_schema.columns where table_name = 'orders')::integer, (select count(*) from orders)""")
def q14_listing(spark, d):
    tables = {t: table(spark, d, t) for t in ("orders", "nation", "customer")}
    columns = spark.createDataFrame(serving.listing(tables), "table string, n_columns int")
    rows = reduce(DataFrame.union, [df.agg(F.lit(t).alias("table"), F.count("*").alias("n_rows")) for t, df in tables.items()])
    return columns.join(rows, "table")


@query(K.SYSTEMS + "select (select count(*) from ids where person_id = 'a_1') as n_identities, (select count(*) from ids where person_id = 'a_1' and method in ('name_only_unique', 'name_ambiguous')) as n_warnings, (select count(*) from customer where c_custkey = 1) as n_persons")
def q2_profile_parts(spark, d):
    persons = K._persons(spark, d).withColumn("person_id", F.concat(F.lit("a_"), "person_id"))
    seasons = spark.createDataFrame([], "person_id string, grp string, period int")
    parts = serving.profile("a_1", persons, seasons, K._identities(spark, d))
    count = lambda part, name: parts[part].agg(F.count("*").alias(name))
    return count("identities", "n_identities").crossJoin(count("warnings", "n_warnings")).crossJoin(count("person", "n_persons"))  # one row each


# ---- checks ------------------------------------------------------------------------------------


@query(K.PANEL + """select 'pair_changes_group' as name, count(*) filter (source_group = target_group) as violations from pairs union all select 'pair_gap', count(*) filter (not gap between 1 and 2) from pairs
union all select 'pair_landing', count(*) from (select 1 from pairs group by entity, source_group, target_group, target_period having count(*) > 1) union all select 'pair_departure', count(*) from (select 1 from pairs group by entity, source_group, target_group, source_period having count(*) > 1)
union all select 'pair_source_exists', count(*) from pairs p where not exists (select 1 from panel x where x.entity = p.entity and x.grp = p.source_group and x.period = p.source_period and x.n > 1)
union all select 'pair_target_exists', count(*) from pairs p where not exists (select 1 from panel x where x.entity = p.entity and x.grp = p.target_group and x.period = p.target_period and x.n > 1)""")
def va8_pair_checks(spark, d):
    return C.pair_checks(K.pairs(spark, d), K.panel(spark, d).where("n > 1"))


@query("""select 'not_finite' as name, count(*) filter (l_linenumber in (6, 7)) as violations from lineitem union all select 'unnamed', (select case when count(*) > 10 then count(*) else 0 end from customer where c_acctbal < 0)
union all select 'unnamed_allowed', 0 union all select 'periods_resolve', (select count(*) from orders where year(o_orderdate) not in (1995, 1996, 1997)) union all select 'makes', (select count(*) from (select count(*) filter (l_returnflag = 'R') as makes, count(*) filter (l_linestatus = 'O') as tries from lineitem group by l_suppkey) where makes > tries)""")
def va_more_checks(spark, d):
    odd = F.when(F.col("l_linenumber") == 7, float("inf")).when(F.col("l_linenumber") == 6, float("nan")).otherwise(F.col("l_tax"))
    lines, c, o = (table(spark, d, t) for t in ("lineitem", "customer", "orders"))
    made = lines.groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("makes"), F.count_if(F.col("l_linestatus") == "O").alias("tries"))
    known = spark.createDataFrame([(1995,), (1996,), (1997,)], "period int")
    parts = [
        C.not_finite("not_finite", lines.select(odd.alias("x"), "l_discount"), ["x", "l_discount"]), C.too_many("unnamed", c, F.col("c_acctbal") < 0, 10), C.too_many("unnamed_allowed", c, F.col("c_acctbal") < 0, 10**9),
        C.orphans("periods_resolve", o.select(F.year("o_orderdate").alias("period")), known, ["period"]), C.count_where("makes", made, F.col("makes") > F.col("tries")),
    ]
    return reduce(DataFrame.union, parts)


HASH = "(select substr(sha256(count(*) || '-' || sum(('0x' || substr(m, 1, 8))::bigint) || '-' || sum(('0x' || substr(m, 9, 8))::bigint) || '-' || sum(('0x' || substr(m, 17, 8))::bigint) || '-' || sum(('0x' || substr(m, 25, 8))::bigint)), 1, 32) from (select md5(len(a) || ':' || a || '|' || len(b) || ':' || b) as m from {}))"


@query("select substr(sha256('nation=' || " + HASH.format("(select n_name as a, n_nationkey::varchar as b from nation)") + " || ';region=' || " + HASH.format("(select r_name as a, r_regionkey::varchar as b from region)") + " || ';'), 1, 12) as snapshot_id")
def va13_snapshot_id(spark, d):
    hashes = {t: C.content_hash(table(spark, d, t), [f"{t[0]}_name", f"{t[0]}_{t}key"]).first().content_hash for t in ("nation", "region")}
    return spark.createDataFrame([(C.snapshot_id(hashes),)], "snapshot_id string")


@query("""select 'mean' as metric, null::double as committed, round((select avg(l_tax) from lineitem), 8) as now union all select 'n', 1.0, (select count(*) from lineitem)::double""")
def va14_not_reproduced(spark, d):
    row = table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.avg("l_tax").alias("mean"), F.max("l_linenumber").alias("most")).first()
    off = C.not_reproduced({"n": float(row.n), "mean": round(row["mean"], 8), "most": float(row.most)}, {"n": 1.0, "most": 7.0})
    return spark.createDataFrame([(k, a, b) for k, (a, b) in sorted(off.items())], "metric string, committed double, now double")


@query("""with o as (select o_custkey as entity, year(o_orderdate) as period from orders), early as (select * from o where period < 1998), late as (select * from o where period >= 1998)
select 'apart' as fold, (select max(period) from early) >= (select min(period) from late) as leaks union all select 'later', (select max(period) from late) >= (select min(period) from early)
union all select 'shared', exists (select entity from early intersect select entity from late) union all select 'own', exists (select entity from early where entity % 2 = 0 intersect select entity from late where entity % 2 = 1) union all select 'empty', (select count(*) from early where false) > 0""")
def va15_leakage(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("period"))
    early, late = o.where("period < 1998"), o.where("period >= 1998")

    def leaks(check, *args) -> bool:
        try:
            check(*args)
        except ValueError:
            return True
        return False

    found = [("apart", leaks(linmod.assert_earlier, early, late, "period")), ("later", leaks(linmod.assert_earlier, late, early, "period")), ("shared", leaks(linmod.assert_no_overlap, early, late, "entity")), ("own", leaks(linmod.assert_no_overlap, early.where("entity % 2 = 0"), late.where("entity % 2 = 1"), "entity")), ("empty", leaks(linmod.assert_earlier, early.where(F.lit(False)), late, "period"))]
    return spark.createDataFrame(found, "fold string, leaks boolean")


@query("""with t as (select l_partkey % 40 as entity, count(*) as attempts, count(*) filter (l_returnflag = 'R') as makes from lineitem group by 1) select entity, round(makes / attempts, 8) as raw_rate, attempts >= 20 as reportable from t""")
def ml10_single_period(spark, d):
    rows = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 40).alias("entity")).agg(F.count("*").alias("attempts"), F.count_if(F.col("l_returnflag") == "R").alias("makes"))
    return shrink.beta_shrink(rows.withColumn("period", F.lit(1)), "period", "makes", "attempts").select("entity", F.round("raw_rate", 8).alias("raw_rate"), "reportable")


@query("""select l_suppkey, l_linenumber, round(case when s > 0 then (q - m) / s else 0.0 end, 5) as q from (select *, avg(q) over w as m, stddev_pop(q) over w as s from (select l_suppkey, l_linenumber, sum(l_quantity) as q from lineitem group by 1, 2) window w as (partition by l_linenumber))""")
def ml12_supplier_z(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    return moments.standardize_population(rows, ["l_linenumber"], ["q"]).select("l_suppkey", "l_linenumber", F.round("q", 5).alias("q"))
