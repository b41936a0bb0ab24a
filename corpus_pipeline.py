"""The corpus pipeline over ``documents``: quality classifier, near-duplicates,
benchmark decontamination, mixing sources to target weights, sharding.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. The stages' outputs
are written as Parquet and read again as the next stage's documents, so a lost
executor repeats tasks of one stage only. All but the last return the columns of
``documents``, whatever other columns there are and however they are named.

Defined cases of every stage: an empty table gives an empty result; repeated rows are
treated alike and stay repeated where they stay; a null in any other column than
those read changes nothing. What a stage does with null ids, null or empty texts,
very long texts and ties is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.hilbert import shard
from tidemark.llm.minmax import near_duplicates
from tidemark.llm.mixing import mix
from tidemark.llm.phrase_index import decontaminate
from tidemark.llm.resample import keep_selected
from tidemark.llm.scratch import settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects; the rest go. A null or wordless text
    goes; a null id is weighed like any other; a text counts whole, whatever its length;
    ties at the threshold all stay."""
    return keep_selected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each class of near-duplicates (five-word shingles,
    similarity 0.8). Rows without an id, a text or a word stay; an id with several texts
    goes only if each of them has a smaller id in its class; similarity is that of whole
    texts, and exactly 0.8 counts."""
    classes = near_duplicates(docs, size=5, percent=80)
    gone = classes.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept").select("doc_id")
    return docs.join(settle(gone, "duplicates"), "doc_id", "left_anti").select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item. Rows without an id stay, as
    do those without words; an id goes with all its texts if one has a window; windows are
    looked for in whole texts."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10)
    gone = settle(found.where("n_hit > 0").select("doc_id").distinct(), "contaminated")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, 0 to 3 times. A null source is a source;
    a text without words has size 0 and is taken once; null ids and ties are rounded one by
    one in hash order. Columns named like those that the mix adds stay as they are."""
    own = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    out = mix(docs.withColumnsRenamed(own), own["doc_id"], own["source"], own["text"]).where("copies > 0")
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col(n).alias(c) for c, n in own.items()])


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with shard and slot along the Hilbert curve. A null text has size 8; null ids
    sort first; each copy has a slot of its own; a document column named like one that
    sharding adds (size, text_crc32, law, curve_index, shard, slot, grown_shard) is replaced."""
    return shard(docs)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]

#: The fitted classifier, the rounding and the curve are no SQL; the stages are tested
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
