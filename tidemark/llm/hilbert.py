"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised into equally filled cells, the cell coordinates
become an index on the Hilbert curve, rows are range-sorted by that index, and
the sorted run is cut into shards with row counts at most one apart. Neighbours
on the curve are neighbours in every dimension, so a filter on any of them
prunes shards and row groups by their min/max statistics.

The order is total (curve index, then text checksum, then id), so a curve cell
that holds a third of all rows still spreads over many range partitions. Ranks
come from partition sizes: one count a partition goes to the driver.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.llm.scratch import new_path, settle, ship_code

SHARDS, BITS = 24, 8


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the curve of each row of ``cells`` (rows, dims), after Skilling's
    transpose form; ``bits * dims`` bits, at most 63."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            inverted = (x[i] & q) > 0
            swap = np.where(inverted, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(inverted, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    fix = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        fix ^= np.where((x[dims - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= fix
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def cuts_of(df: DataFrame, dimensions: dict[str, Column], bits: int = BITS) -> list[list]:
    """Ascending cell borders of each dimension, at most 2^bits: approximate
    quantiles of numbers; of strings, the first of each range of their different values
    (whole strings decide, whatever their common beginning)."""
    named = df.select(*[c.alias(n) for n, c in dimensions.items()])
    texts = {f.name for f in named.schema.fields if isinstance(f.dataType, StringType)}
    numbers = [n for n in dimensions if n not in texts]
    probs = [i / (1 << bits) for i in range(1, 1 << bits)]
    quantiles = dict(zip(numbers, named.select(*[F.col(n).cast("double") for n in numbers]).approxQuantile(numbers, probs, 0.002), strict=True)) if numbers else {}

    def firsts(n: str) -> list[str]:
        ranges = named.select(n).where(F.col(n).isNotNull()).distinct().repartitionByRange(1 << bits, n)
        return sorted(r[0] for r in ranges.groupBy(F.spark_partition_id()).agg(F.min(n).alias("first")).select("first").collect())  # one a range

    return [firsts(n) if n in texts else np.unique(np.array(quantiles[n])).tolist() for n in dimensions]


def curve(df: DataFrame, dimensions: dict[str, Column], bits: int = BITS) -> Column:
    """The curve index as a column of ``df``. The cells' borders are on the driver
    (see cuts_of); null is cell 0."""
    cuts = cuts_of(df, dimensions, bits)
    types = df.select(*[c.alias(n) for n, c in dimensions.items()]).schema
    columns = [c if isinstance(f.dataType, StringType) else c.cast("double") for c, f in zip(dimensions.values(), types.fields, strict=True)]
    ship_code(df.sparkSession)

    @F.pandas_udf("long")
    def index(*columns: pd.Series) -> pd.Series:
        cells = []
        for c, k in zip(columns, cuts, strict=True):
            codes, values = pd.factorize(c)
            # few borders are spread over the whole side: the curve tells its upper half from its lower first
            cell = np.array([(bisect.bisect_right(k, v) << bits) // (len(k) + 1) for v in values] + [0], np.int64)
            cells.append(cell[codes])
        return pd.Series(hilbert_index(np.stack(cells, 1), bits))

    return index(*columns)


def slim(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with size and text_crc32. Drop the text after this where only the
    assignment is wanted: the sort then moves no texts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumn("size", F.octet_length(text).cast("long") + 8).withColumn("text_crc32", F.crc32(F.encode(text, "UTF-8")))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, dimensions: dict[str, Column] | None = None, partitions: int | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with size, text_crc32, law ("rows"),
    curve_index, shard (0 to shards - 1), slot (gapless from 0 in each shard,
    along the curve) and grown_shard (null: growing the count moves the cuts).

    Size is the text's UTF-8 bytes plus 8. Defined cases: a null text has no
    bytes and checksum 0; null ids sort first; repeated ids and rows keep one
    slot each; missing dimension columns are not used; without the text
    column, size and text_crc32 are taken as given; an empty table gives an
    empty result; columns of the added names are replaced.
    """
    added = ["size", "text_crc32", "law", "curve_index", "shard", "slot", "grown_shard"]
    rows = slim(docs, text_col) if text_col in docs.columns else docs
    docs = docs.drop(*[c for c in added if c in docs.columns])
    rows = rows.select(*docs.columns, "size", "text_crc32")
    if dimensions is None:
        dimensions = {"size": F.col("size"), "id": F.col(id_col)} | {c: F.col(c).cast("string") for c in ("lang", "source") if c in docs.columns}
    rows = rows.withColumn("curve_index", curve(rows, dimensions))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [F.col("curve_index"), F.col("text_crc32"), F.col(id_col)]
    ordered = rows.repartitionByRange(n, *key).sortWithinPartitions(*key)
    ordered = ordered.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ordered = settle(ordered, "curve-order")
    counts = sorted(ordered.groupBy("__part").count().collect())  # one row a range partition
    before, total = [], 0
    for part, count in counts:
        before.append((part, total))
        total += count
    offsets = docs.sparkSession.createDataFrame(before, "__part int, __before long")
    rank = F.col("__before") + F.col("__at")
    out = ordered.join(F.broadcast(offsets), "__part").withColumn("__rank", rank)  # at most n rows
    cut = f"cast((__rank * {shards}L) div {max(total, 1)}L as int)"
    out = out.withColumn("law", F.lit("rows")).withColumn("shard", F.expr(cut))
    out = out.withColumn("slot", F.expr(f"__rank - (shard * {total}L + {shards - 1}L) div {shards}L")).withColumn("grown_shard", F.lit(None).cast("int"))
    return out.select(*docs.columns, *added)


def write_shards(sharded: DataFrame, path: str | None = None, partitions: int | None = None) -> str:
    """Write a folder per shard, its rows in slot order over as many files as there
    are ranges of (shard, slot) in it, and return the path. No task writes a shard by
    itself unless it is small; each file covers a run of the curve, so a filter on any
    dimension skips files by their statistics. An empty table writes an empty folder."""
    spark = sharded.sparkSession
    path = path or new_path(spark, "shards")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sharded.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path
