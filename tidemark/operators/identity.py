"""Entity resolution across id systems with auditable confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quantiles import grouped_quantiles

# Confidence of each way to match, floor for cohorts, tolerance in periods.
CONFIDENCE = {"anchor": 1.0, "shared_id": 1.0, "override": 1.0, "name_and_age": 0.95, "name_only_unique": 0.70, "name_ambiguous": 0.30, "unmatched": 1.0}
CONFIDENCE_FLOOR, BIRTH_TOLERANCE = 0.80, 1


def distinct_entities(rows: DataFrame, id_col: str, name_col: str, period: str) -> DataFrame:
    """id, the name in its latest period (largest name on a tie), first and last period."""
    return rows.groupBy(id_col).agg(F.max(F.struct(period, name_col))[name_col].alias(name_col), F.min(period).alias("first_period"), F.max(period).alias("last_period"))


def implied_birth(rows: DataFrame, id_col: str, period: str, age: str) -> DataFrame:
    """(id, birth): median of period - age of each id, exact and interpolated."""
    return grouped_quantiles(rows, [id_col], F.col(period) - F.col(age), {"birth": 0.5})


def crosswalk(anchor: DataFrame, shared: DataFrame, other: DataFrame, overrides: DataFrame | None = None, tolerance: float = BIRTH_TOLERANCE) -> DataFrame:
    """person_id, system, source_id, method, confidence of every id.

    ``anchor``, ``shared`` and ``other``: system, id (string), match_key, birth. Anchor
    and shared ids are one namespace. Each other id takes the first rule that holds: an
    override (other_id, anchor_id); exactly one candidate of its key whose birth agrees;
    exactly one candidate and none that agrees; several candidates (a person of its own);
    none (likewise). Candidates are distinct anchor and shared ids; null keys match none.
    (system, id) of ``other`` is unique.

    Candidates are counted by (key, birth) and by key before anything is joined: a key that
    half of all ids share costs its different births, not its ids. Births within the
    tolerance lie in the same band or a neighbouring one, which makes the join an equi-join."""
    known = anchor.select("id", "match_key", "birth").union(shared.select("id", "match_key", "birth")).groupBy("id", "match_key").agg(F.max("birth").alias("birth")).where("match_key is not null")
    by_birth = known.groupBy("match_key", F.col("birth").alias("c_birth")).agg(F.count("*").alias("n"), F.max("id").alias("c_id"))
    by_key = by_birth.groupBy("match_key").agg(F.sum("n").alias("n"), F.max("c_id").alias("only"))
    band = lambda c: F.floor(F.col(c) / max(float(tolerance), 1e-9))
    asked = other.select("match_key", "birth").where("match_key is not null and birth is not null").distinct().withColumn("band", band("birth"))
    near = by_birth.where("c_birth is not null").withColumn("band", F.explode(F.array(*[band("c_birth") + i for i in (-1, 0, 1)])))
    agree = asked.join(near, ["match_key", "band"]).where(F.abs(F.col("birth") - F.col("c_birth")) <= tolerance)
    agree = agree.groupBy("match_key", "birth").agg(F.sum("n").alias("n_agree"), F.max("c_id").alias("agreed"))
    met = other.select("system", "id", "match_key", "birth").join(by_key, "match_key", "left").join(agree, ["match_key", "birth"], "left")
    met = met.withColumns({"n": F.coalesce("n", F.lit(0)), "n_agree": F.coalesce("n_agree", F.lit(0))})
    if overrides is None:
        met = met.withColumn("anchor_id", F.lit(None).cast("string"))
    else:
        met = met.join(overrides.select(F.col("other_id").alias("id"), "anchor_id"), "id", "left")
    method = (
        F.when(F.col("anchor_id").isNotNull(), "override").when(F.col("n_agree") == 1, "name_and_age")
        .when((F.col("n") == 1) & (F.col("n_agree") == 0), "name_only_unique").when(F.col("n") > 1, "name_ambiguous").otherwise("unmatched"))
    linked = F.when(method == "override", F.col("anchor_id")).when(method == "name_and_age", F.col("agreed")).when(method == "name_only_unique", F.col("only"))
    person = F.coalesce(F.concat(F.lit("a_"), linked), F.concat(F.lit("o_"), F.col("id")))
    others = met.select(person.alias("person_id"), "system", F.col("id").alias("source_id"), method.alias("method"))
    own = lambda df, how: df.select(F.concat(F.lit("a_"), F.col("id")).alias("person_id"), "system", F.col("id").alias("source_id"), F.lit(how).alias("method")).distinct()
    every = own(anchor, "anchor").union(own(shared, "shared_id")).union(others)
    score = F.element_at(F.create_map(*[x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))]), F.col("method"))
    return every.withColumn("confidence", score)


def shared_id_evidence(left: DataFrame, right: DataFrame) -> DataFrame:
    """How many ids two systems share, and the rate at which their keys agree."""
    both = left.select("id", F.col("match_key").alias("l")).join(right.select("id", F.col("match_key").alias("r")), "id")
    return both.agg(F.count("*").alias("n_shared"), F.avg((F.col("l") == F.col("r")).cast("double")).alias("agreement"))


def golden_persons(identities: DataFrame, people: DataFrame, priority: list[str]) -> DataFrame:
    """One row per person of ``identities``: display_name of the first system in
    ``priority`` (a NULL only where all of that system's are), birth of the first that
    has one, systems
    sorted and joined by "+". Derived from identities, so nobody is an orphan."""
    rank = F.coalesce(*[F.when(F.col("system") == s, i) for i, s in enumerate(priority)], F.lit(len(priority)))
    rows = identities.join(people.select("system", F.col("id").alias("source_id"), "name", "birth"), ["system", "source_id"], "left").withColumn("rank", rank)
    name = F.min(F.struct("rank", F.col("name").isNull().alias("unnamed"), "name"))["name"]
    birth = F.min(F.when(F.col("birth").isNotNull(), F.struct("rank", "source_id", "birth")))["birth"]
    return rows.groupBy("person_id").agg(name.alias("display_name"), birth.alias("birth"), F.array_join(F.array_sort(F.collect_set("system")), "+").alias("systems"))


def union_of(frames: list[DataFrame]) -> DataFrame:
    """The rows of frames whose columns differ: by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def fill_covariate(rows: DataFrame, entity: str, period: str, age: str) -> DataFrame:
    """Missing ages from the entity's median birth; known ages stay, a null entity
    recovers nothing."""
    birth = implied_birth(rows.where(F.col(entity).isNotNull()), entity, period, age).select(F.col(entity).alias("__of"), F.col("birth").alias("__birth"))
    out = rows.join(birth, F.col(entity) == F.col("__of"), "left").withColumn(age, F.coalesce(F.col(age), F.col(period) - F.col("__birth")))
    return out.drop("__of", "__birth")
