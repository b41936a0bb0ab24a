"""Parameterised read queries over serving tables. Each returns a DataFrame; bounds are
checked first. ``persons`` (person_id, display_name, normalized_name, systems) and the
other tables are those that the cohort operators write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.names import normalized


def checked(value: int, low: int, high: int, name: str) -> int:
    if not isinstance(value, int) or not low <= value <= high:
        raise ValueError(f"{name} must lie in [{low}, {high}], not {value!r}")
    return value


def clamped(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


#: Rows up to which a page is the top of a sort that every task cuts short; ranges beyond.
TOP, RANGES = 20_000, 256


def page(rows: DataFrame, order: list[Column], limit: int, offset: int, top: int = TOP, ranges: int = RANGES) -> DataFrame:
    """``limit`` rows after the first ``offset`` in ascending ``order``, sorted.

    A shallow page is a top-k: each task keeps as many rows. For a deep one the sort keys are
    cut into ranges and counted; the counts say which ranges hold the page, and these are
    cut again until few rows are left to be sorted. Only ``ranges`` counts with their ends reach
    the driver. Rows of one key stay together, so let the order end with what tells rows
    apart."""
    keyed = rows.withColumn("__key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    skip = offset
    while skip + limit > top:
        cut = keyed.select("__key").repartitionByRange(ranges, "__key").groupBy(F.spark_partition_id().alias("range"))
        counts = cut.agg(F.count("*").alias("n"), F.min("__key").alias("lo"), F.max("__key").alias("hi")).orderBy("lo").collect()
        total, past, within = sum(r.n for r in counts), 0, []
        for r in counts:
            if past + r.n > skip and past < skip + limit:
                within.append((past, r))
            past += r.n
        if not within:
            return rows.limit(0)
        kept = sum(r.n for _, r in within)
        ends = keyed.sparkSession.createDataFrame([(within[0][1].lo, within[-1][1].hi)], T.StructType([T.StructField(c, keyed.schema["__key"].dataType) for c in ("__lo", "__hi")]))
        keyed = keyed.crossJoin(F.broadcast(ends)).where(F.col("__key").between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")  # one row of ends
        skip -= within[0][0]
        if kept <= top or kept == total:
            break
    return keyed.orderBy("__key").offset(skip).limit(limit).drop("__key")


def descending(name: str) -> list[Column]:
    """Largest first and nulls last, as ascending keys of ``page``."""
    return [F.col(name).isNull(), -F.col(name)]


def search(persons: DataFrame, needle: str, limit: int = 20) -> DataFrame:
    """Names that contain the needle (normalised on both sides); entities of several
    systems first. ``place`` counts the rows from 1."""
    rows = persons.where(F.contains("normalized_name", normalized(F.lit(needle))))
    return placed(rows, [F.when(F.instr("systems", "+") > 0, 0).otherwise(1), F.col("display_name"), F.col("person_id")], clamped(limit, 1, 50))


def placed(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows with their ``place``, from 1."""
    few = rows.orderBy(*order).limit(limit)
    return few.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # of at most ``limit`` rows


def profile(person: str, persons: DataFrame, seasons: DataFrame, identities: DataFrame) -> dict[str, DataFrame]:
    """The person, its career in period order, its identities and a warning where one
    of them is uncertain."""
    own = identities.where(F.col("person_id") == person)
    return {"person": persons.where(F.col("person_id") == person), "career": seasons.where(F.col("person_id") == person).orderBy("period", "grp"), "identities": own.orderBy("system", "source_id"), "warnings": own.where("confidence < 0.8")}


def predictions_of(predictions: DataFrame, person: str) -> DataFrame:
    return predictions.where(F.col("person_id") == person).orderBy("target_period", "metric")


def newest_first(models: DataFrame, limit: int = 1000) -> DataFrame:
    """The last trained first, with their ``place``."""
    return placed(models, [F.col("trained_at").desc_nulls_last(), F.col("model_version")], limit)


def evaluation(version: str, models: DataFrame, evaluations: DataFrame, selection: DataFrame) -> dict[str, DataFrame]:
    return {n: t.where(F.col("model_version") == version) for n, t in (("model", models), ("evaluations", evaluations), ("selection", selection))}


def leaderboard(rows: DataFrame, persons: DataFrame, by: str, limit: int = 25, **equal) -> DataFrame:
    """The largest ``by`` of rows with the given values, with names."""
    for c, v in equal.items():
        rows = rows.where(F.col(c) == v)
    return rows.join(persons.select("person_id", "display_name"), "person_id").orderBy(F.col(by).desc(), "person_id").limit(clamped(limit, 1, 100))


@dataclass
class Page:
    rows: DataFrame
    totals: DataFrame


def projection_page(rows: DataFrame, persons: DataFrame, direction: str | None = None, least: float | None = None, supported: bool | None = None, limit: int = 50, offset: int = 0, ties: list[str] | None = None, top: int = TOP) -> Page:
    """A page by predicted value (ties by id, then ``ties``) with the count of all matches and of those
    outside the model's support, one aggregation."""
    checked(limit, 1, 500, "limit")
    checked(offset, 0, 10**9, "offset")
    if direction is not None:
        rows = rows.where(F.col("direction") == direction)
    if least is not None:
        rows = rows.where(F.col("predicted") >= least)
    if supported is not None:
        rows = rows.where(F.col("in_support") == supported)
    totals = rows.agg(F.count("*").alias("total"), F.count_if(~F.col("in_support")).alias("out_of_support"))
    named = rows.join(persons.select("person_id", "display_name"), "person_id", "left")
    order = [*descending("predicted"), F.col("person_id"), *[F.col(t) for t in ties or []]]
    return Page(page(named, order, limit, offset, top), totals)


def archetypes(definitions: DataFrame) -> DataFrame:
    """The most stable first (null last), with a warning where one is not reportable."""
    warning = F.when(~F.coalesce("reportable", F.lit(False)), "not stable enough to report")
    return definitions.withColumn("warning", warning).orderBy(F.col("stability").desc_nulls_last(), "cluster")


def archetype_of(person: str, labels: DataFrame, definitions: DataFrame) -> DataFrame:
    return labels.where(F.col("person_id") == person).join(definitions, ["model_version", "cluster"]).orderBy("period")


def comparables(person: str, comps: DataFrame, persons: DataFrame, limit: int = 10) -> DataFrame:
    named = persons.select(F.col("person_id").alias("neighbour"), "display_name")
    return comps.where(F.col("person_id") == person).join(named, "neighbour").orderBy("period", "rank").limit(clamped(limit, 1, 25))


def shooting_of(person: str, shooting: DataFrame) -> Page:
    own = shooting.where(F.col("person_id") == person)
    return Page(own.orderBy("period"), own.agg(F.count("*").alias("total"), F.count_if(F.col("data_weight") < 0.5).alias("mostly_prior")))


def latest_report(person: str, reports: DataFrame, schema: str = "array<struct<text:string,facts:array<string>>>") -> DataFrame:
    """The newest named report, its claims decoded."""
    own = reports.where((F.col("person_id") == person) & ~F.col("anonymized"))
    last = own.groupBy("person_id").agg(F.max_by(F.struct(*own.columns), "created_at").alias("r")).select("r.*")
    return last.withColumn("claims", F.from_json("claims", schema))


def listing(tables: dict[str, DataFrame]) -> list[tuple[str, int]]:
    """Tables and their column counts (a probe that reads no rows)."""
    return sorted((n, len(t.columns)) for n, t in tables.items())
