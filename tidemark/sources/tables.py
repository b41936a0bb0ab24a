"""Reading and writing tables: scans with declared schemas, content-addressed
caches, contracts beside the data."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def csv_or_empty(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A CSV file in its declared schema (ids stay text); no file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, header=True, schema=schema)


def latest_json(spark: SparkSession, pattern: str, schema: str | None = None) -> DataFrame:
    """The rows of the last file, by name, of a pattern."""
    reader = spark.read.option("multiLine", True)
    rows = (reader.schema(schema) if schema else reader).json(pattern).withColumn("__file", F.input_file_name())
    last = rows.agg(F.max("__file").alias("__file"))
    return rows.join(F.broadcast(last), "__file").drop("__file")


def all_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Every Parquet file of a pattern, with its name as ``source_file``."""
    return spark.read.parquet(pattern).withColumn("source_file", F.input_file_name())


def cache_key(source: str, endpoint: str, params: dict) -> str:
    text = json.dumps({"source": source, "endpoint": endpoint, "params": params}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def cached(spark: SparkSession, folder: str, source: str, endpoint: str, params: dict, fetch: Callable[[], DataFrame] | None = None, refresh: bool = False) -> DataFrame:
    """The cached answer to a request; ``fetch`` makes a missing one and a line is
    appended to the manifest: size, content hash and the seconds it took. Without ``fetch`` a miss is an error."""
    from tidemark.operators.checks import content_hash

    key = cache_key(source, endpoint, params)
    path = f"{folder}/{source}/{endpoint}-{key}.parquet"
    if refresh or not exists(spark, path):
        if fetch is None:
            raise FileNotFoundError(f"not cached: {source} {endpoint} {params}")
        began = time.time()
        got = fetch()
        got.write.mode("overwrite").parquet(path)
        held = content_hash(spark.read.parquet(path)).first()
        line = spark.createDataFrame(
            [(key, source, endpoint, json.dumps(params, sort_keys=True), held.n_rows, len(got.columns), held.content_hash, time.time() - began)],
            "key string, source string, endpoint string, params string, n_rows long, n_columns int, digest string, seconds double")
        line.coalesce(1).write.mode("append").json(f"{folder}/manifest")
    return spark.read.parquet(path)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.json(f"{folder}/manifest")


def write_with_contract(df: DataFrame, path: str) -> None:
    """zstd Parquet and its profile beside it."""
    from tidemark.operators.checks import profile

    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    profile(df.sparkSession.read.parquet(path)).coalesce(1).write.mode("overwrite").json(f"{path}.contract")


def test_slice(tables: dict[str, DataFrame], key: str, anchors: list[str], movers: DataFrame, n: int) -> dict[str, DataFrame]:
    """Every table cut to ``n`` entities: the anchors in their order (all must exist),
    then movers sorted."""
    spark = movers.sparkSession
    people = tables["persons"].select(key)
    first = spark.createDataFrame([(a, 0, i) for i, a in enumerate(anchors)], f"{key} string, part int, at int")
    missing = first.join(people, key, "left_anti").collect()
    if missing:
        raise ValueError(f"anchors without a row: {sorted(r[0] for r in missing)}")
    rest = movers.select(key).distinct().join(first, key, "left_anti").orderBy(key).limit(n).select(key, F.lit(1).alias("part"), F.lit(0).alias("at"))
    chosen = first.union(rest).orderBy("part", "at", key).limit(n).select(key)
    return {name: df.join(F.broadcast(chosen), key, "left_semi") if key in df.columns else df for name, df in tables.items()}


def run_log(spark: SparkSession, path: str, run_id: str, metrics: dict) -> str:
    """A sorted-key JSON record of a run, on any file system that Spark writes."""
    name = f"{path}/{run_id}.json"
    spark.createDataFrame([(json.dumps(metrics, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(name)
    return name


def read_run_log(spark: SparkSession, name: str) -> dict:
    return json.loads(spark.read.text(name).first().value)
