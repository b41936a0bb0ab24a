"""Intermediate tables in the folder that all executors share.

A job that reads an intermediate result more than once, or iterates on it,
writes it as Parquet below ``spark.checkpoint.dir`` and reads it back: the
lineage is cut, a lost executor only repeats the tasks it was running, and the
next plan sees the table's real size.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset and the master
    is local (tests, a laptop) a temporary folder of this machine is made and
    remembered. A cluster without the setting is an error: no folder is shared."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give the Python workers this package where their path does not have it."""
    package = Path(__file__).resolve().parent.parent
    here = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    context = spark.sparkContext
    if str(package.parent) in here or context.applicationId in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="tidemark-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in package.rglob("*.py"):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with this package where the workers find it: a function
    names the code it needs when it is made."""
    ship_code(df.sparkSession)
    return df.mapInArrow(run, schema)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "table", replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back with the same schema. A
    settled table that it ``replaces`` (the last round of an iteration) is removed."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    if replaces is not None:
        discard(replaces)
    return out


def discard(settled: DataFrame) -> None:
    """Remove a settled table that nothing reads any more."""
    if old := getattr(settled, "_settled_at", None):
        spark = settled.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(old)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
