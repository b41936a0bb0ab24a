"""Does every number and name in a text trace to a table of facts?

Documents: (doc, text). Facts: (doc, fact_id, statement, value, unit)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.names import strip_marks
from tidemark.sources.shared import kept

# What is a number in a text, and the readings of a fact's value in other units.
NUMBER = r"(?<![\w%])[-+]?\d[\d,]*(?:\.\d+)?%?"
CONVERSIONS = [1.0, 100.0, 0.01, 1000.0, 0.001]


def display(value: str | Column, unit: str | Column) -> Column:
    """A value as it is written: percentages from fractions, whole counts, else 2 places."""
    v = F.col(value) if isinstance(value, str) else value
    u = F.col(unit) if isinstance(unit, str) else unit
    return (
        F.when(v.isNull(), "n/a").when(u == "fraction", F.concat(F.format_string("%.1f", F.round(v * 100, 1)), F.lit("%")))
        .when(u == "count", F.format_string("%.0f", F.round(v, 0))).otherwise(F.format_string("%.2f", F.round(v, 2))))


def render(facts: DataFrame) -> DataFrame:
    """(doc, body): one line a fact, "[id] statement: value", in id order."""
    line = F.concat(F.lit("["), F.col("fact_id"), F.lit("] "), F.col("statement"), F.lit(": "), display("value", "unit"))
    lines = F.array_sort(F.collect_list(F.struct("fact_id", line.alias("line"))))
    return facts.groupBy("doc").agg(F.array_join(F.transform(lines, lambda s: s["line"]), "\n").alias("body"))


def digest(body: str = "body", length: int = 16) -> Column:
    return F.substring(F.sha2(F.col(body), 256), 1, length)


def numbers(docs: DataFrame) -> DataFrame:
    """(doc, token_no, token, value, window, as_share): every number written in a text;
    ``window`` is half of its last written decimal, ``as_share`` the reading of a
    percentage as a fraction."""
    tokens = docs.select("doc", F.posexplode(F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0))).alias("token_no", "token"))
    bare = F.regexp_replace("token", "[,%+]", "")
    decimals = F.length(F.regexp_extract("token", r"\.(\d+)", 1))
    out = tokens.withColumns({"value": bare.try_cast("double"), "window": 0.5 * F.pow(F.lit(10.0), -decimals)})
    return out.withColumn("as_share", F.when(F.col("token").endswith("%"), F.col("value") / 100))


def candidates(facts: DataFrame, rendered: DataFrame | None = None) -> DataFrame:
    """(doc, candidate): each fact's value in every unit, its size where negative,
    and numbers in the rendered text."""
    base = facts.where("value is not null").select("doc", F.explode(F.array(*[F.col("value") * c for c in CONVERSIONS])).alias("candidate"))
    base = base.union(base.where("candidate < 0").select("doc", -F.col("candidate")))
    if rendered is not None:
        base = base.union(numbers(rendered.select("doc", F.col("body").alias("text"))).select("doc", "value"))
    return base.where("candidate is not null").distinct()


def derived(facts: DataFrame) -> DataFrame:
    """(doc, candidate): what a correct text may compute from its facts, per metric: the
    width of an interval, the change from source to projection, and the projection's
    distance from the target mean in standard deviations; from the stored values and from
    the values as they are written. ``facts`` also have ``metric`` and ``role`` (low80,
    high80, low95, high95, mean, sd, source, projected)."""
    shown = F.when(F.col("unit") == "fraction", F.round(F.col("value") * 100, 1) / 100).when(F.col("unit") == "count", F.round("value", 0)).otherwise(F.round("value", 2))
    both = facts.where("value is not null and metric is not null").select("doc", "metric", "role", F.explode(F.array(F.struct(F.lit(0).alias("shown"), F.col("value").alias("v")), F.struct(F.lit(1).alias("shown"), shown.alias("v")))).alias("r"))
    at = lambda role: F.max(F.when(F.col("role") == role, F.col("r.v"))).alias(role)
    one = both.groupBy("doc", "metric", "r.shown").agg(*[at(x) for x in ("low80", "high80", "low95", "high95", "mean", "sd", "source", "projected")])
    forms = [F.col("high80") - F.col("low80"), F.col("high95") - F.col("low95"), F.abs(F.col("projected") - F.col("source")), F.abs(F.when(F.col("sd") > 0, (F.col("projected") - F.col("mean")) / F.col("sd")))]
    return one.select("doc", F.explode(F.array_compact(F.array(*forms))).alias("form")).select("doc", F.explode(F.array(F.col("form"), F.col("form") * 100)).alias("candidate")).distinct()


#: Decimal places beyond which numbers share the width of their buckets.
PLACES = 8


def trace(found: DataFrame, cand: DataFrame) -> DataFrame:
    """Add traced: some candidate of the document lies within the window of the value
    or of its reading as a share.

    A window is half of the last written decimal, so a number meets the candidates in at most
    three buckets of that width: candidates are dealt to buckets once for each number of decimals
    that their document writes, and both sides meet by (document, decimals, bucket)."""
    at = lambda v, places: F.floor(v * F.pow(F.lit(10.0), places))
    slack = F.lit(1e-9)
    places = F.least(F.greatest(F.round(-F.log10(2 * F.col("w"))).cast("int"), F.lit(0)), F.lit(PLACES))
    reading = F.explode(F.array(F.struct(F.col("value").alias("v"), F.col("window").alias("w")), F.struct(F.col("as_share").alias("v"), (F.col("window") / 100).alias("w"))))
    read = found.select("doc", "token_no", reading.alias("r")).select("doc", "token_no", "r.v", "r.w").where("v is not null").withColumn("places", places)
    asked = read.withColumn("bucket", F.explode(F.sequence(at(F.col("v") - F.col("w") - slack, F.col("places")), at(F.col("v") + F.col("w") + slack, F.col("places")))))
    held = cand.join(read.select("doc", "places").distinct(), "doc").select("doc", "places", "candidate", at(F.col("candidate"), F.col("places")).alias("bucket"))
    met = asked.join(held, ["doc", "places", "bucket"]).where(F.abs(F.col("v") - F.col("candidate")) <= F.col("w") + slack)
    hits = met.select("doc", "token_no").distinct().withColumn("traced", F.lit(True))
    return found.join(hits, ["doc", "token_no"], "left").withColumn("traced", F.coalesce("traced", F.lit(False)))


def citation_errors(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Claims (doc, claim_no, cited array) that cite nothing, or ids that are no facts."""
    none = claims.where("cited is null or size(cited) = 0").select("doc", "claim_no", F.lit("uncited").alias("problem"), F.lit(None).cast("string").alias("fact_id"))
    cited = claims.select("doc", "claim_no", F.explode("cited").alias("fact_id"))
    return none.union(cited.join(facts.select("doc", "fact_id"), ["doc", "fact_id"], "left_anti").select("doc", "claim_no", F.lit("unknown fact").alias("problem"), "fact_id"))


def redaction_terms(name: str | Column, least: int = 4) -> Column:
    """The name and its words of at least ``least`` characters."""
    n = F.col(name) if isinstance(name, str) else name
    return F.array_distinct(F.filter(F.concat(F.array(n), F.split(n, r"\s+")), lambda w: F.length(w) >= least))


def leaks(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc, term) where a redacted term (doc, term) stands in the text as whole words,
    accents apart; single words match case, phrases do not."""
    both = docs.join(terms, "doc").withColumns({"__t": strip_marks("text"), "__w": strip_marks("term")})
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.col("__w"), F.lit(r"\E(?!\w)"))
    phrase = F.contains(F.col("__w"), F.lit(" "))
    return both.where(F.when(phrase, F.regexp_like("__t", F.concat(F.lit("(?i)"), quoted))).otherwise(F.regexp_like("__t", quoted))).select("doc", "term")


def unsupported_names(docs: DataFrame, evidence: DataFrame) -> DataFrame:
    """(doc, word): capitalised words that do not start a sentence and whose folded form
    (or its parts around a hyphen) is not in the evidence text (doc, body)."""
    sentences = docs.select("doc", F.explode(F.split("text", r"(?<=[.!?])\s+")).alias("sentence"))
    words = sentences.select("doc", F.posexplode(F.regexp_extract_all("sentence", F.lit(r"(?U)[\w'’-]+"), F.lit(0))).alias("at", "word")).where("at > 0")
    names = words.where(F.regexp_like("word", F.lit(r"^\p{Lu}\p{Ll}"))).select("doc", "word").distinct()
    parts = names.select("doc", "word", F.explode(F.split(F.regexp_replace(F.lower(strip_marks("word")), "['’]s$", ""), "-")).alias("part"))
    known = evidence.select("doc", F.explode(F.regexp_extract_all(F.lower(strip_marks("body")), F.lit(r"(?U)\w+"), F.lit(0))).alias("part")).distinct()
    return parts.join(known, ["doc", "part"], "left_anti").select("doc", "word").distinct()


@dataclass(frozen=True)
class Rules:
    """Words, lower-case, that the rules look for, and how many words a statement reaches."""

    metric: tuple[str, ...]
    up: tuple[str, ...] = ("rise", "rises", "rising", "grow", "grows", "growing", "climb", "climbs", "gain", "gains", "improve", "improves")
    down: tuple[str, ...] = ("fall", "falls", "falling", "drop", "drops", "shrink", "shrinks", "slip", "slips", "decline", "declines")
    spread: tuple[str, ...] = ("percentile", "percentiles", "uncertainty", "margin", "deviation", "deviations", "between")
    certain: tuple[str, ...] = ("undoubtedly", "inevitably", "surely", "definitely", "certainly")
    reach: int = 6


def direction_words(docs: DataFrame, rules: Rules) -> DataFrame:
    """(doc, n_up, n_down, n_certain): statements that the metric rises or falls, and words
    of certainty. A direction word speaks of the metric if the metric's name stands within
    ``reach`` words of it in the same sentence, and of its spread, which is no direction, if a
    word for that stands within the same reach on either side."""
    sentences = docs.select("doc", F.explode(F.split(F.lower("text"), r"[.!?\n]+")).alias("s"))
    words = sentences.select("doc", F.filter(F.split("s", r"[^\p{L}]+"), lambda w: w != "").alias("words"))
    holds = lambda part, of: F.arrays_overlap(part, F.array(*[F.lit(w) for w in of]))
    w, n = F.col("words"), F.size("words")
    around = lambda i: F.slice(w, F.greatest(i - rules.reach, F.lit(0)) + 1, F.least(i, F.lit(rules.reach)) + 1 + rules.reach)

    def said(of: tuple[str, ...]) -> Column:
        about = lambda i: F.get(w, i).isin(*of) & holds(around(i), rules.metric) & ~holds(around(i), rules.spread)
        hits = F.filter(F.sequence(F.lit(0), n - 1), about)
        return F.when((n > 0) & holds(w, of) & holds(w, rules.metric), F.size(hits)).otherwise(0)

    certain = F.size(F.filter(w, lambda x: x.isin(*rules.certain)))
    return words.groupBy("doc").agg(*[F.sum(c).alias(name) for c, name in ((said(rules.up), "n_up"), (said(rules.down), "n_down"), (certain, "n_certain"))])


def rule_errors(docs: DataFrame, outcome: DataFrame, rules: Rules) -> DataFrame:
    """(doc, rule, n): texts that say n times that the metric moves against its projected
    change, that sound certain n times, or that are confident of a model that loses to its
    baseline. ``outcome``: doc, change, confident, beats_baseline; what is null breaks no rule."""
    t = direction_words(docs, rules).join(outcome, "doc")
    against = F.when(F.col("change") < 0, F.col("n_up")).when(F.col("change") > 0, F.col("n_down"))
    bold = F.when(F.col("confident") & ~F.col("beats_baseline"), 1)
    broken = [F.struct(F.lit(name).alias("rule"), n.cast("long").alias("n")) for name, n in (("direction", against), ("certainty", F.col("n_certain")), ("confidence", bold))]
    return t.select("doc", F.explode(F.array(*broken)).alias("b")).select("doc", "b.*").where("n > 0")


def distractors(docs: DataFrame, ranges: int = 200) -> DataFrame:
    """(doc, other): each document with the next one, the last with the first.

    Ids are cut into sorted ranges; inside a range the next id is the following row, and
    the last row of a range takes the first id of the next range (one row a range on
    the driver)."""
    # written once: another run of the same shuffle may cut ranges elsewhere
    ids = kept(docs.select("doc").where("doc is not null").distinct().repartitionByRange(ranges, "doc").withColumn("__r", F.spark_partition_id()))
    firsts = sorted((r[1], r[0]) for r in ids.groupBy("__r").agg(F.min("doc").alias("first")).select("__r", "first").collect())
    after = [(r, firsts[(i + 1) % len(firsts)][0]) for i, (_, r) in enumerate(firsts)]
    kind = dict(docs.dtypes)["doc"]
    turns = docs.sparkSession.createDataFrame(after, f"__r int, __after {kind}")
    inside = F.lead("doc").over(Window.partitionBy("__r").orderBy("doc"))
    return ids.withColumn("__next", inside).join(F.broadcast(turns), "__r").select("doc", F.coalesce("__next", "__after").alias("other"))


def distractor_scores(docs: DataFrame, facts: DataFrame, rendered: DataFrame | None = None) -> DataFrame:
    """(doc, n_numbers, own, other): how many numbers of each document trace to its own
    facts, and to those of the next document. A check that accepts the latter is blind."""
    found, cand = numbers(docs), candidates(facts, rendered)
    pairs = distractors(docs)
    swapped = pairs.join(cand.withColumnRenamed("doc", "other"), "other").select("doc", "candidate")
    hits = lambda c, name: trace(found, c).groupBy("doc").agg(F.count("*").alias("n_numbers"), F.count_if("traced").alias(name))
    other = hits(swapped.distinct(), "other").drop("n_numbers")
    return hits(cand, "own").join(other, "doc", "left").select("doc", "n_numbers", "own", F.coalesce("other", F.lit(0)).alias("other"))


def stale(cached: DataFrame, current: DataFrame) -> DataFrame:
    """Cache entries (key, digest) whose digest is not that of the rebuilt bundle."""
    now = current.select("key", F.col("digest").alias("now"))
    return cached.join(now, "key", "left").where(~F.col("digest").eqNullSafe(F.col("now"))).select("key", "digest", "now")


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, accuracy, kappa) of two yes/no raters (0/1); kappa NULL where both use one
    class only."""
    n, both, pa, pb = F.count("*"), F.avg((F.col(a) == F.col(b)).cast("double")), F.avg(F.col(a).cast("double")), F.avg(F.col(b).cast("double"))
    t = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(n.alias("n"), both.alias("accuracy"), pa.alias("pa"), pb.alias("pb"))
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return t.select("n", "accuracy", F.when(chance < 1, (F.col("accuracy") - chance) / (1 - chance)).alias("kappa"))
