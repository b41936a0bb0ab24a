"""Registered queries of sources and sinks: files read and written, statements, publishing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.plans.extended import HASH
from tidemark.plans.registry import query
from tidemark.sources import ingest as IN
from tidemark.sources import publish as PB
from tidemark.sources import statements as ST
from tidemark.sources import tables as T
from tidemark.sources.shared import folder
from tidemark.sources.tables import table


@query("select lpad(c_custkey::varchar, 9, '0') as id, c_name as name from customer")
def src2_csv_round_trip(spark, d):
    path = f"{folder(spark)}/customers.csv"
    table(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("id"), F.col("c_name").alias("name")).write.csv(path, header=True)
    return T.csv_or_empty(spark, path, "id string, name string")


@query("select n_nationkey as id, n_name as name, 2 as run from nation where n_regionkey = 2")
def src4_latest_json(spark, d):
    path = folder(spark)
    n = table(spark, d, "nation")
    for run in (1, 2):
        n.where(F.col("n_regionkey") == run).select(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(run).alias("run")).alias("row")).agg(F.to_json(F.collect_list("row"))).coalesce(1).write.text(f"{path}/run{run}.json")
    return T.latest_json(spark, f"{path}/run*.json/*.txt", "id int, name string, run int")


@query("select r_regionkey, r_name, (select count(*) from region) as n_rows, 2 as n_columns, 1 as n_fetches, true as timed, " + HASH.format("(select r_name as a, r_regionkey::varchar as b from region)") + " as digest from region")
def src5_cached_request(spark, d):
    path, fetched = folder(spark), []

    def fetch():
        fetched.append(1)
        return table(spark, d, "region").select("r_regionkey", "r_name")

    T.cached(spark, path, "api", "regions", {"b": 1, "a": 2}, fetch)
    rows = T.cached(spark, path, "api", "regions", {"a": 2, "b": 1}, fetch)
    log = T.manifest(spark, path).select("n_rows", F.col("n_columns").cast("int").alias("n_columns"), "digest", (F.col("seconds") > 0).alias("timed"))
    return rows.crossJoin(F.broadcast(log)).withColumn("n_fetches", F.lit(len(fetched)))  # the manifest has one line


@query("select n_nationkey, n_name, n_regionkey::varchar || '.parquet' as file from nation")
def src7_all_files(spark, d):
    path = folder(spark)
    n = table(spark, d, "nation")
    for r in range(5):
        n.where(F.col("n_regionkey") == r).select("n_nationkey", "n_name").write.parquet(f"{path}/{r}.parquet")
    return T.all_files(spark, f"{path}/*.parquet").select("n_nationkey", "n_name", F.regexp_extract("source_file", r"/(\d+\.parquet)/", 1).alias("file"))


@query("""select 'c_acctbal' as "column", 'double' as dtype, 0.0::double as null_rate, count(*) as n_rows from customer union all select 'c_custkey', 'bigint', 0.0, count(*) from customer""")
def snk1_contract_beside_the_table(spark, d):
    path = f"{folder(spark)}/customers.parquet"
    T.write_with_contract(table(spark, d, "customer").select("c_custkey", "c_acctbal"), path)
    return spark.read.json(f"{path}.contract").select("column", "dtype", "null_rate", "n_rows")


# rows of two lengths: some statements are full by rows, others by bytes
@query("""with recursive r as (select row_number() over (order by c_custkey) as i, '(' || c_custkey || ', ''' || c_name || repeat('x', (case when c_custkey % 400 < 200 then c_custkey % 3 else 20 + c_custkey % 90 end)::integer) || ''', ' || c_nationkey || ')' as v from customer),
c as (select i, v, sum(length(v) + 2) over (order by i) as t from r),
s as (select 1::bigint as a union all select (select min(n.i) from c n where n.i > s.a and (n.i - s.a >= 40 or 68 + n.t - (select t - length(v) - 2 from c where i = s.a) - 1 > 2500)) from s where s.a is not null),
e as (select a, lead(a) over (order by a) as b from s where a is not null)
select 'INSERT INTO "customers" ("c_custkey", "name", "c_nationkey") VALUES' || chr(10) || string_agg(v, ',' || chr(10) order by i) || ';' as statement, count(*) as n_rows, row_number() over (order by a)::integer as nth from e join c on i >= a and (b is null or i < b) group by a""")
def snk2_insert_statements(spark, d):
    longer = F.when(F.col("c_custkey") % 400 < 200, F.col("c_custkey") % 3).otherwise(20 + F.col("c_custkey") % 90).cast("int")
    c = table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.repeat(F.lit("x"), longer)).alias("name"), "c_nationkey")
    made = ST.insert_statements(c, "customers", ["c_custkey"], rows=40, size=2500, ranges=16)
    return made.select("statement", "n_rows", F.row_number().over(Window.orderBy("nth")).alias("nth"))  # of statements, for comparison


@query("select n_nationkey, n_name, false as old_left, 5 as n_regions from nation")
def snk4_replaced_tables(spark, d):
    path = folder(spark)
    PB.publish({"old": table(spark, d, "region")}, path)
    nations = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    PB.publish({"nations": nations, "regions": table(spark, d, "region")}, path, {"nations": {"n_regionkey": ("regions", "r_regionkey")}})
    now = PB.current(spark, path)
    regions = PB.published(spark, path, "regions", now).agg(F.count("*").cast("int").alias("n_regions"))
    nations = PB.published(spark, path, "nations", now).select("n_nationkey", "n_name", F.lit(T.exists(spark, f"{now}/old.parquet")).alias("old_left"))
    return nations.crossJoin(F.broadcast(regions))  # one row


@query("""with u as (select c_nationkey % 4 as u, count(*) as n, count(*) filter (c_custkey % 10 = 0 and c_nationkey % 4 < 2) as bad from customer group by 1)
select 'unit' || u as unit, case when u = 3 then 'failed' when bad > 0 then 'partial' else 'ok' end as state, case when u = 3 then 0 else n - bad end as n_rows, case when u = 3 then 0 else bad end as n_bad from u""")
def src10_isolated_units(spark, d):
    """Customers as four units of JSON lines: of two, every tenth record is cut off in the
    middle, and the files of the last are missing."""
    path, c = folder(spark), table(spark, d, "customer").select("c_custkey", "c_name", (F.col("c_nationkey") % 4).alias("u"))
    line = F.to_json(F.struct("c_custkey", "c_name"))
    broken = F.when((F.col("c_custkey") % 10 == 0) & (F.col("u") < 2), F.substring(line, 1, 12)).otherwise(line)
    c.where("u < 3").select("u", broken.alias("value")).write.partitionBy("u").text(path)
    found = IN.ingest(spark, {f"unit{u}": f"{path}/u={u}" for u in range(4)}, "c_custkey long, c_name string", folder(spark))
    told = found.rows.select("unit", F.lit(0).alias("bad")).union(found.bad.select("unit", F.lit(1))).groupBy("unit").agg(F.count_if(F.col("bad") == 0).alias("n_rows"), F.sum("bad").alias("n_bad"))
    return found.status.select("unit", "state").join(told, "unit", "left").fillna(0, ["n_rows", "n_bad"])


@query("""with few as (select * from (select c_custkey::varchar as person_id from customer where c_acctbal < 0 and c_custkey not in (3, 1)) order by person_id limit 8) select person_id from few union all select '3' union all select '1'""")
def snk5_test_slice(spark, d):
    persons = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("person_id"), "c_acctbal")
    return T.test_slice({"persons": persons}, "person_id", ["3", "1"], persons.where("c_acctbal < 0"), 10)["persons"].select("person_id")


@query("""select '{"a": 2, "n": ' || count(*) || '}' as record from region""")
def snk6_run_log(spark, d):
    name = T.run_log(spark, folder(spark), "run", {"n": table(spark, d, "region").count(), "a": 2})
    return spark.read.text(name).select(F.col("value").alias("record"))
