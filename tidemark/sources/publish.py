"""Publishing a set of tables at once: versions in folders of their own, and one pointer.

A version is written and checked before anybody can see it. Then the pointer, one small file,
is put in place by a rename that replaces the old one, and that is the moment of
publication: a reader resolves the pointer once and reads that version's tables, so it sees all
of the old set or all of the new one. Old versions stay until KEEP newer ones stand before them,
for those who still read them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINTER, KEEP = "_current", 2


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, folder: str) -> str | None:
    """The folder of the published version; None before the first."""
    path, fs = _files(spark, folder)
    at = path(f"{folder}/{POINTER}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return f"{folder}/{bytes(stream.readAllBytes()).decode()}"
    finally:
        stream.close()


def published(spark: SparkSession, folder: str, name: str, version: str | None = None) -> DataFrame:
    """A table of the published version, or of the ``version`` that ``current`` gave before:
    tables that belong together are read with one."""
    at = version or current(spark, folder)
    if at is None:
        raise FileNotFoundError(f"nothing is published in {folder}")
    return spark.read.parquet(f"{at}/{name}.parquet")


def order_of(names: list[str], references: dict[str, dict[str, tuple[str, str]]]) -> list[str]:
    """Tables with those that they refer to before them."""
    out: list[str] = []
    while len(out) < len(names):
        ready = [n for n in names if n not in out and all(parent in out or parent == n for parent, _ in references.get(n, {}).values())]
        if not ready:
            raise ValueError(f"tables refer to each other or to none: {sorted(set(names) - set(out))}")
        out += ready
    return out


def publish(frames: dict[str, DataFrame], folder: str, references: dict[str, dict[str, tuple[str, str]]] | None = None, at_step: Callable[[str], None] = lambda step: None) -> str:
    """Publish ``frames`` as the only tables of ``folder``; the new version's folder.

    ``references``: {table: {column: (parent table, its column)}}. Parents are written and
    checked first; a value without a parent row (nulls are none) is an error, after which, as after any
    other failure, the published version is what it was. ``at_step`` is told what comes next."""
    spark = next(iter(frames.values())).sparkSession
    references = references or {}
    path, fs = _files(spark, folder)
    number = max((int(v.split("-")[1]) for v in _versions(spark, folder)), default=0) + 1
    version = f"v-{number:08d}-{uuid.uuid4().hex[:8]}"
    read = {}
    for name in order_of(list(frames), references):
        at_step(f"write {name}")
        frames[name].write.parquet(f"{folder}/{version}/{name}.parquet")
        read[name] = spark.read.schema(frames[name].schema).parquet(f"{folder}/{version}/{name}.parquet")
        for column, (parent, key) in references.get(name, {}).items():
            at_step(f"check {name}.{column}")
            orphans = read[name].where(read[name][column].isNotNull()).join(read[parent].select(read[parent][key].alias(column)), column, "left_anti").limit(3).collect()
            if orphans:
                raise ValueError(f"{name}.{column} has values without a row of {parent}: {[r[column] for r in orphans]}")
    at_step("point")
    _point(spark, folder, version)
    at_step("clean")
    for old in sorted(_versions(spark, folder))[:-KEEP]:
        if old != version:
            fs.delete(path(f"{folder}/{old}"), True)
    return f"{folder}/{version}"


def _versions(spark: SparkSession, folder: str) -> list[str]:
    path, fs = _files(spark, folder)
    if not fs.exists(path(folder)):
        return []
    return [s.getPath().getName() for s in fs.listStatus(path(folder)) if s.getPath().getName().startswith("v-")]


def _point(spark: SparkSession, folder: str, version: str) -> None:
    """Write the pointer beside the old one and rename it over that."""
    jvm = spark._jvm
    path, fs = _files(spark, folder)
    new, at = path(f"{folder}/{POINTER}.{uuid.uuid4().hex}"), path(f"{folder}/{POINTER}")
    out = fs.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(new, at, over)
