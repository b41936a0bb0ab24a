"""Ingest of many units (files or folders of files) in which a bad one spoils no other.

Each unit is read with a declared schema. Records that do not fit it are set aside with their
text; a unit that cannot be read at all is recorded as failed. The run goes on either way,
and its status says so."""

from __future__ import annotations

import hashlib
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"
STATUS = "unit string, state string, n_rows long, n_bad long, digest string, seconds double, error string"


@dataclass
class Ingested:
    """``rows`` and ``bad`` (unit, record) of all units that could be read; ``status``: a row a
    unit, in their order: ok, partial (records were set aside) or failed."""

    rows: DataFrame
    bad: DataFrame
    status: DataFrame

    @property
    def ok(self) -> bool:
        return self.status.where("state <> 'ok'").isEmpty()


def ingest(spark: SparkSession, units: dict[str, str], schema: str, folder: str, kind: str = "json", **options) -> Ingested:
    """Read every unit ({name: path pattern}) into Parquet below ``folder``, one after the
    other; no unit's failure stops the next. ``kind``: json or csv (records that do not fit are
    set aside), or any other format of Spark (the unit is read whole or fails). ``digest`` is a
    checksum of a unit's rows that their order does not change."""
    fields = T.StructType.fromDDL(schema)
    loose = kind in ("json", "csv")
    wide = T.StructType([*fields.fields, T.StructField(CORRUPT, T.StringType())]) if loose else fields
    status, done = [], []
    for number, (unit, path) in enumerate(units.items()):
        began = time.time()
        to = f"{folder}/unit-{number:05d}.parquet"
        try:
            reader = spark.read.schema(wide).options(**options)
            if loose:
                reader = reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
            got = reader.format(kind).load(path)
            got = got if loose else got.withColumn(CORRUPT, F.lit(None).cast("string"))
            got.withColumn("unit", F.lit(unit)).write.mode("overwrite").parquet(to)
            told = spark.read.parquet(to).where(F.col(CORRUPT).isNull()).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*fields.names).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
            bad = spark.read.parquet(to).where(F.col(CORRUPT).isNotNull()).count()
            digest = hashlib.sha256(f"{told.n}-{told.h}".encode()).hexdigest()[:16]
            status.append((unit, "partial" if bad else "ok", told.n, bad, digest, time.time() - began, None))
            done.append(to)
        except Exception as failed:  # whatever a unit's files do to the reader is that unit's failure
            status.append((unit, "failed", 0, 0, None, time.time() - began, f"{type(failed).__name__}: {str(failed).splitlines()[0][:300]}"))
    whole = T.StructType([*fields.fields, T.StructField(CORRUPT, T.StringType()), T.StructField("unit", T.StringType())])
    every = spark.read.schema(whole).parquet(*done) if done else spark.createDataFrame([], whole)
    rows = every.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return Ingested(rows, every.where(F.col(CORRUPT).isNotNull()).select("unit", F.col(CORRUPT).alias("record")), spark.createDataFrame(status, STATUS))
