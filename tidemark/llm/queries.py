"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.resample import resample

    return resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_entropy_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix

    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op3_line_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.lines import remove_repeated_lines

    kept = remove_repeated_lines(_read(spark, sf_dir, "documents"), size=3)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op4_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.secrets import BASE, RULES, listed, scan

    found = scan(_read(spark, sf_dir, "documents"))
    # F.filter gives a lambda's second argument, even one with a default, the place in the array
    number = lambda k: F.size(F.filter("found", lambda s: s["kind_no"] == k))
    counts = [number(k).cast("long").alias(f"n_{RULES[k][0]}") for k in range(BASE)]
    base = F.filter("found", lambda s: s["kind_no"] < BASE)
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.hilbert import shard, slim

    return shard(slim(_read(spark, sf_dir, "documents")).drop("text")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve_index")


def op6_local_descriptor_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no pictures: each vector of ``embeddings`` is rendered as one."""
    from tidemark.llm.media import copies, vector_pictures

    return copies(_read(spark, sf_dir, "embeddings"), vector_pictures, "vec_id", "embedding")


def op7_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.phrase_index import decontaminate, items_digest

    found = decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), size=10, slop=20)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items_digest("items").alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"))


def op8_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.warc import round_trip

    return round_trip(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "ok")


def op9_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.minmax import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), size=4, percent=80)


def op10_fm_index_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.fm_index import remove_repeats

    found = remove_repeats(_read(spark, sf_dir, "documents"), size=20)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("spans").cast("long").alias("n_spans"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.divergence import source_divergence

    return source_divergence(_read(spark, sf_dir, "documents"))


def op12_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.hmm import score_documents

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    found = score_documents(_read(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.periodic import described, periodic_runs, with_planted_tails

    return described(periodic_runs(with_planted_tails(_read(spark, sf_dir, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from tidemark.llm import divergence, lines

    return {"op3_line_window_dedup": lines.ORACLE, "op11_source_divergence": divergence.ORACLE}
