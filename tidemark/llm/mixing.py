"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Every source has a token target. Among all document rates r with
sum(r * tokens) = target and r <= cap, the one closest to "every document once"
in relative entropy is r = min(cap, exp(lambda * tokens / mean)): one dual
variable a source, found by Newton steps on the convex dual. Each step is one
aggregation over the (source, size) histogram, which is made once. Rates are
rounded to copies systematically along (size, hash) order within each source,
so the words taken miss the target by less than the source's largest document.

No group is handled whole: the histogram is pre-aggregated, and within a
(source, size) class, ranks are counted inside hashed salts plus the salts'
offsets, so a source or a class that holds a third of all rows stays spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import settle

#: A dual solution within TOLERANCE of its target is done; after MAX_STEPS one beyond LOOSE is an error.
SALTS, MAX_STEPS, TOLERANCE, LOOSE = 256, 60, 1e-9, 1e-6


def word_count(text: str) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source_col: str, weights: tuple = (1, 2, 3), share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) of each source. Sources in code point
    order, null last, weigh ``weights`` in turn and share ``share`` of all
    tokens; a target stops at ``cap`` times its source's size and the excess is
    shared by weight again until none is above.

    Any number of sources: places come from sorted ranges and the ranges' counts (one row a
    range on the driver), and the excess is shared anew by one aggregation a round."""
    spark = sizes.sparkSession
    order = F.col(source_col).asc_nulls_last()
    per = sizes.groupBy(source_col).agg(F.sum("size").alias("source_size"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = per.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id())
    ranged = settle(ranged.withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "sources")
    before, rows = 0, []
    for part, count in sorted(ranged.groupBy("__part").count().collect()):
        rows.append((part, before))
        before += count
    offsets = F.broadcast(spark.createDataFrame(rows, "__part int, __before long"))
    turn = F.pmod(F.col("__before") + F.col("__at"), F.lit(len(weights))).cast("int") + 1
    per = ranged.join(offsets, "__part").withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn))
    per = settle(per.select(source_col, "source_size", "w", (F.col("source_size") * cap).alias("most")), "source-weights")

    level, closed = 0.0, -1
    while True:
        full = F.col("most") <= F.col("w") * level
        r = per.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("most"))).alias("held"), F.sum(F.when(~full, F.col("w"))).alias("open"), F.count_if(full).alias("n")).first()
        if not r.open or r.n == closed:
            break
        # the level only rises, and every round but the last closes a source
        level, closed = ((r["all"] or 0) * share - (r.held or 0.0)) / r.open, r.n
    target = F.col("most") if not r.open else F.least("most", F.col("w") * level)
    return per.select(source_col, "source_size", target.alias("target"))


def balance(histogram: DataFrame, goals: DataFrame, source_col: str, cap: float = 3.0) -> DataFrame:
    """(source, lambda, all) of each source: the dual solution; ``all`` marks
    sources whose target is the cap itself. ``histogram``: source, size, n."""
    stats = histogram.groupBy(source_col).agg(F.sum("n").alias("docs"))
    state = goals.join(stats, goals[source_col].eqNullSafe(stats[source_col])).drop(stats[source_col])
    mean = F.col("source_size") / F.col("docs")
    state = state.select(
        source_col, "target", F.greatest(mean, F.lit(1e-9)).alias("mean"),
        (F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)).alias("all"),
        F.when((F.col("target") > 0) & (F.col("source_size") > 0), F.expr("ln(target / source_size)")).otherwise(0.0).alias("lambda"),
        F.lit(-1e7).alias("lo"), F.lit(1e7).alias("hi"), F.lit(1.0).alias("error"),
    )
    state = settle(state, "dual")
    for _ in range(MAX_STEPS):
        s, h = state.alias("s"), histogram.alias("h")
        x = F.col("h.size") / F.col("s.mean")
        raw = F.exp(F.least(F.col("lambda") * x, F.lit(50.0)))
        words = F.col("h.n") * F.col("h.size")
        sums = h.join(s, F.col(f"h.{source_col}").eqNullSafe(F.col(f"s.{source_col}")))
        sums = sums.groupBy(F.col(f"s.{source_col}").alias("__s")).agg(
            F.sum(words * F.least(raw, F.lit(cap))).alias("value"), F.sum(F.when(raw < cap, words * raw * x).otherwise(0.0)).alias("slope"))
        step = state.join(sums, state[source_col].eqNullSafe(sums["__s"])).drop("__s")
        gap = F.col("value") - F.col("target")
        lo = F.when(gap < 0, F.col("lambda")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lambda")).otherwise(F.col("hi"))
        step = step.withColumn("gap", gap).withColumn("lo", lo).withColumn("hi", hi)
        newton = F.col("lambda") - F.try_divide("gap", "slope")
        # a clipped rate makes the dual flat in places: fall back to halving the bracket, signs apart
        half = F.when(F.col("lo") * F.col("hi") > 0, (F.col("lo") + F.col("hi")) / 2).when(F.col("lo") < -1, F.col("lo") / 10).when(F.col("hi") > 1, F.col("hi") / 10).otherwise((F.col("lo") + F.col("hi")) / 2)
        inside = newton.isNotNull() & (newton > F.col("lo")) & (newton < F.col("hi"))
        error = F.when(F.col("all") | (F.col("target") <= 0), 0.0).otherwise(F.abs("gap") / F.col("target"))
        step = step.withColumn("error", error)
        step = step.withColumn("lambda", F.when(F.col("error") <= TOLERANCE, F.col("lambda")).when(inside, newton).otherwise(half))
        state = settle(step.select(state.columns), "dual", replaces=state)
        worst = state.agg(F.max("error")).first()[0] or 0.0
        if worst <= TOLERANCE:
            break
    else:
        if worst > LOOSE:
            raise RuntimeError(f"the dual is off by {worst:.1e} of a target after {MAX_STEPS} steps")
    return state.select(source_col, "mean", "lambda", "all")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple = (1, 2, 3), share: float = 1.0, cap: int = 3) -> DataFrame:
    """All rows and columns of ``docs`` with size, source_size, target, rate,
    copies (0 to cap) and taken = copies * size.

    Defined cases: a null or blank text has size 0; null is a source of its own,
    last in order; a source without words has target 0; repeated ids and rows
    are rounded one by one, ties in hash order, so reruns agree; an empty table
    gives an empty result; columns of the added names are replaced.
    """
    added = ["size", "source_size", "target", "rate", "copies", "taken"]
    docs = docs.drop(*[c for c in added if c in docs.columns])
    # the source as a key that is never null and has no clashing name
    rows = docs.withColumn("size", word_count(text_col)).withColumn("__key", F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("~")))
    salt = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(7)), F.lit(SALTS)).cast("int")
    fine = settle(rows.withColumn("__salt", salt).groupBy("__key", "size", "__salt").agg(F.count("*").alias("n")), "size-counts")
    histogram = settle(fine.groupBy("__key", "size").agg(F.sum("n").alias("n")), "histogram")
    # "=" sorts before "~": the null source is last
    totals = histogram.withColumn("size", F.col("size") * F.col("n"))
    goals = settle(targets(totals, "__key", weights, share, cap), "targets")
    dual = balance(histogram, goals, "__key", cap)

    tilted = F.least(F.exp(F.least(F.col("lambda") * F.col("size") / F.col("mean"), F.lit(50.0))), F.lit(float(cap)))
    rate = F.when(F.col("all"), F.lit(float(cap))).when(F.col("target") <= 0, F.when(F.col("size") == 0, 1.0).otherwise(0.0)).otherwise(tilted)
    classes = histogram.join(dual, "__key").join(goals, "__key").withColumn("rate", rate)
    along = Window.partitionBy("__key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("__base", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(along), F.lit(0.0))).drop("n", "lambda", "mean", "all")
    inside = Window.partitionBy("__key", "size").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.withColumn("__before", F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("n")
    plan = settle(fine.join(classes, ["__key", "size"]), "rates")

    nth = F.row_number().over(Window.partitionBy("__key", "size", "__salt").orderBy(F.col(id_col), F.col("__tie")))
    out = rows.withColumn("__salt", salt).withColumn("__tie", F.xxhash64(F.col(text_col).cast("string"))).withColumn("__nth", nth).join(plan, ["__key", "size", "__salt"])
    upto = F.col("__base") + F.col("rate") * (F.col("__before") + F.col("__nth"))
    copies = (F.floor(upto + 0.5) - F.floor(upto - F.col("rate") + 0.5)).cast("int")
    out = out.withColumn("copies", F.greatest(F.lit(0), F.least(F.lit(cap), copies))).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
    return out.select(*docs.columns, *added)
