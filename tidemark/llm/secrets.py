"""Secret scan over a trigram inverted index (DataFrame functions only).

Each rule's regex is turned into a Boolean query: any of several alternatives,
each of which needs all of its trigrams. Postings (trigram, text key) hold the
trigrams that some rule asks for; equal texts share one key and are aggregated
before the shuffle. Intersecting an alternative's postings is a grouped count
that reaches its number of trigrams. Only those candidates meet their texts again
and are verified with the regex. A rule without mandatory trigrams is run on every
text, in the scan that makes the keys.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import settle

#: kind, regex, least length, group whose length counts. In order of report; the
#: first three are fixed by the query's contract. Patterns and names are fixed values.
RULES = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    ("access", r"AKIA[A-Z0-9]+", 16, 0),
    ("hex", r"[0-9a-f]{32,}", 32, 0),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("github", r"gh[ps]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", r"xox[bp]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
]
BASE = 3
#: Trigrams an alternative asks for at most; those of the rarest letters are the most selective.
ASKED = 4
#: Matches of one text that are placed one after the other.
RUN = 256
_COMMON = "etaoinshrdlcumwfgypbvk"


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of mandatory lower-case trigrams, or None where a match may
    have none. Every match's lower-cased text holds all trigrams of some alternative."""
    states = _walk(parser.parse(pattern), {("", frozenset())})
    found = {need for _, need in states}
    if not found or frozenset() in found:
        return None
    rarity = lambda t: (sum(len(_COMMON) - _COMMON.find(c) if c in _COMMON else 0 for c in t), t)
    return sorted({frozenset(sorted(need, key=rarity)[:ASKED]) for need in found}, key=sorted)


def _walk(tree, states: set) -> set:
    """States are (literal run so far, trigrams so far); a run's last two
    characters are all that a next trigram needs."""
    for op, value in tree:
        if op is C.LITERAL:
            states = {_extended(s, chr(value).lower()) for s in states}
        elif op is C.SUBPATTERN:
            states = _walk(value[3], states)
        elif op is C.BRANCH:
            states = set().union(*(_walk(x, states) for x in value[1]))
        elif op is C.IN and len(value) <= 6 and all(o is C.LITERAL for o, _ in value):
            states = {_extended(s, chr(v).lower()) for s in states for _, v in value}
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] == 0 and value[1] == 1:
            states = states | _walk(value[2], states)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] >= 1:
            states = {("", need) for _, need in _walk(value[2], states)}
        elif op is not C.AT:
            states = {("", need) for _, need in states}
        if len(states) > 64:  # weaker, still mandatory
            states = {("", frozenset.intersection(*(need for _, need in states)))}
    return states


def _extended(state: tuple, c: str) -> tuple:
    run, need = state[0] + c, state[1]
    return run[-2:], need | {run} if len(run) == 3 else need


def spans(text: Column, kind_no: int, rule: tuple) -> Column:
    """array<struct<start, kind_no, end>> of the rule's matches, in code points.
    The text between matches comes from splitting by the same regex.

    Matches are placed in runs of RUN, each from the place where the run before it ends,
    so a text with very many matches never grows one array match by match."""
    _, pattern, least, group = rule
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    shape = "struct<start:int,kind_no:int,end:int,size:int>"

    def step(acc, m):
        start = acc["at"] + m["gap"]
        end = start + m["whole"]
        one = F.struct(start.alias("start"), F.lit(kind_no).alias("kind_no"), end.alias("end"), m["part"].alias("size"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def length(x):
        return F.transform(x, F.length)

    def run(acc, first):
        """Add a run as one array; ``at`` is where it ends."""
        own = F.slice(acc["left"], first, RUN)
        begin = F.struct(acc["at"].alias("at"), F.array().cast(f"array<{shape}>").alias("out"))
        done = F.aggregate(own, begin, step)
        return F.struct(done["at"].alias("at"), F.concat(acc["runs"], F.array(done["out"])).alias("runs"), acc["left"].alias("left"))

    zipped = F.arrays_zip(F.slice(length(gaps), 1, F.size(whole)).alias("gap"), length(whole).alias("whole"), length(part).alias("part"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{shape}>>").alias("runs"), zipped.alias("left"))
    firsts = F.when(F.size(whole) > 0, F.sequence(F.lit(1), F.size(whole), F.lit(RUN))).otherwise(F.array().cast("array<int>"))
    found = F.flatten(F.aggregate(firsts, begin, run, lambda acc: acc["runs"]))
    return F.filter(found, lambda s: s["size"] >= least)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list | None = None) -> DataFrame:
    """One row per row of ``docs``: id_col and found, an array of
    struct<start, kind_no, end, size> by start, then kind.

    Matches are leftmost and do not overlap within a rule; those shorter than the
    rule's least length are dropped afterwards. Defined cases: a null text is
    empty; equal texts are searched once; null and repeated ids are answered row by
    row; an empty table gives an empty result; other columns are ignored.
    """
    rules = rules or RULES
    asked = [trigram_query(r[1]) for r in rules]
    vocabulary = sorted({t for q in asked if q for alt in q for t in alt})
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    raw = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(5), "text"))
    empty = F.array().cast("array<struct<start:int,kind_no:int,end:int,size:int>>")
    full = [F.when(F.col("text").rlike(r[1]), spans(F.col("text"), i, r)).otherwise(empty) for i, r in enumerate(rules) if asked[i] is None]
    slim = settle(raw.select("id", "k1", "k2", F.concat(*full, empty).alias("full")), "keys")

    # lower-cased once a text: a column used many times stays a step of its own
    has = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(n)) for n, t in enumerate(vocabulary)]))
    postings = raw.select("k1", "k2", F.lower("text").alias("low")).select("k1", "k2", F.explode(has).alias("trigram")).distinct()
    query = [(i, a, vocabulary.index(t), len(alt)) for i, q in enumerate(asked) if q for a, alt in enumerate(q) for t in alt]
    query = docs.sparkSession.createDataFrame(query, "rule int, alternative int, trigram int, need int")
    met = postings.join(F.broadcast(query), "trigram")  # as many rows as the rules have trigrams
    met = met.groupBy("k1", "k2", "rule", "alternative", "need").agg(F.count("*").alias("n")).where("n = need")
    # written, so that their real size decides how they meet the texts: while they are few, no text moves for it
    candidates = settle(met.groupBy("k1", "k2").agg(F.collect_set("rule").alias("rules")), "candidates")

    # one text a key, chosen before the shuffle: copies of a hot text stay where they are
    texts = raw.join(candidates, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("text").alias("text"), F.first("rules").alias("rules"))
    verified = F.concat(*[F.when(F.array_contains("rules", i), spans(F.col("text"), i, r)).otherwise(empty) for i, r in enumerate(rules) if asked[i]])
    verified = settle(texts.select("k1", "k2", verified.alias("verified")).where(F.size("verified") > 0), "verified")
    out = slim.join(verified, ["k1", "k2"], "left")
    return out.select(F.col("id").alias(id_col), F.array_sort(F.concat("full", F.coalesce("verified", empty))).alias("found"))


def listed(found: Column, rules: list | None = None) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(r[0]) for r in rules or RULES])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"], s["end"])), ",")
