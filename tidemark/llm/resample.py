"""Quality classifier by importance resampling over hashed n-gram models.

A document's features are its different words and pairs of adjacent words, as hashes.
Its importance weight is p_target(x) / p_raw(x):

* p_target is the model of the labelled documents that are good and not toxic.
* p_raw is a mixture. Its main part is the n-gram model of all documents, copies
  included, over BUCKETS hash buckets. What the labels say of low quality and of toxic text are two
  further parts, models of their own over single n-grams.

Every part is compared with the target n-gram by n-gram, where a likelihood-ratio
test says that the difference is real (RAW_Z, Z); elsewhere the ratio is 1. Counting and
testing are Spark's; only the n-grams that pass are gathered and broadcast: at most BUCKETS
of the raw model (5 MB) and the single n-grams of at most LABELLED texts, whatever the size
of the corpus. The raw part weighs in p_raw as the target does among the labelled rows, the
other two as theirs do: for a document that is likelier under a labelled part than under the
corpus, that part decides, and otherwise the corpus.

Documents are drawn without replacement by Gumbel top-k: the k largest values of
log weight / temperature + Gumbel noise, the noise being a hash of the document. A low
temperature sharpens the draw: noise decides only between neighbours. k is the number of
documents at or above a floor: the lowest weight that separates the labelled documents
nearly as well as the best one (largest true minus false positive rate), and never one
that gives up more than 1 - KEEP of the good ones.

Counts of the raw model cover every document. Only the labelled rows that the other
models are fitted on are a bounded sample, LABELLED at most; there, copies of one
text are one example. The k-th largest key is found by counting keys in ever finer
bins, not by a global sort; only the bins' counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.scratch import map_arrow, settle

#: Bits of an n-gram's hash; buckets of the raw model, for a corpus of any size.
GRAM_BITS, BUCKETS = 42, 1 << 18
#: At most so many labelled documents are fitted on (smallest hashes first).
LABELLED = 40_000
#: Pseudo-counts that tie the target to the raw model, and the labelled models to each other;
#: z-scores from which an n-gram's ratio counts.
RAW_PRIOR, PRIOR, RAW_Z, Z = 5_000.0, 500.0, 8.0, 7.0
TEMPERATURE = 0.25
#: Separation (true minus false positive rate) given up for keeping more good documents, and
#: the share of labelled good documents that the floor keeps at least.
SLACK, KEEP = 0.01, 0.99
TARGET, LOW, TOXIC, LEAD = 0, 1, 2, 3
#: Keys of single n-grams stand behind those of buckets; entries of a tally before it is summed.
SINGLE, TALLY = 1 << 50, 2_000_000
_SEEN = (1 << 22) - 1


def features(block: W.Block) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash of GRAM_BITS) of the different words and pairs of adjacent words of
    each text, and one for how often (in powers of two) a word follows itself.
    Presence, not counts: words come in bursts, documents hardly do."""
    text, h = block.text_of(), block.hash
    if not len(h):
        return text, np.zeros(0, np.uint64)
    inside = text[1:] == text[:-1]
    with np.errstate(over="ignore"):
        pair = W.mix(h[:-1] * W.GRAM[0, 0] + h[1:] * W.GRAM[0, 1])[inside]
        again = np.bincount(text[1:][inside & (h[1:] == h[:-1])], minlength=block.n)
        full = np.flatnonzero(block.count > 0)
        stutter = W.mix(np.floor(np.log2(1 + again[full])).astype(np.uint64) * W.GRAM[0, 2])
    gram = np.concatenate([h, pair, stutter]) & np.uint64((1 << GRAM_BITS) - 1)
    # a block has fewer than 2^22 texts
    keyed = (np.concatenate([text, text[1:][inside], full]).astype(np.uint64) << np.uint64(GRAM_BITS)) | gram
    keyed.sort()
    keyed = keyed[np.r_[True, keyed[1:] != keyed[:-1]]]
    return (keyed >> np.uint64(GRAM_BITS)).astype(np.int64), keyed & np.uint64((1 << GRAM_BITS) - 1)


class Tally:
    """Counts by key, three a key, summed when many have come together."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, keys: np.ndarray, *marks: np.ndarray) -> None:
        own, at = np.unique(keys, return_inverse=True)
        self.parts.append((own, np.stack([np.bincount(at[m], minlength=len(own)) for m in marks], 1)))
        self.n += len(own)

    def rows(self, more_than: int) -> Iterator[pa.RecordBatch]:
        if self.n > more_than:
            keys, counts = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
            order = np.argsort(keys)
            begin = np.flatnonzero(np.r_[True, np.diff(keys[order]) > 0])
            self.parts = [(keys[order][begin], np.add.reduceat(counts[order], begin, axis=0))]
            self.n = len(begin)
        if self.n > more_than / 2:
            for own, sums in self.parts:
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), *(pa.array(sums[:, i]) for i in range(3))], ["key", "a", "b", "c"])
            self.parts, self.n = [], 0


def gram_counts(docs: DataFrame, text_col: str, buckets: int) -> DataFrame:
    """(key, a, b, c) summed over all documents. Keys below SINGLE are buckets: ``a``
    counts all documents, ``b`` those of the target. Others are SINGLE + n-gram, over the
    labelled lead documents: counts of target, low quality and toxic. ``__class`` has a
    document's bits (1 << TARGET and so on; LEAD marks one of each labelled text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            classes = np.nan_to_num(batch.column(1).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            for block in W.blocks(batch.column(0), W.LOWER):
                text, gram = features(block)
                own = classes[block.at : block.at + block.n][text]
                target = own & (1 << TARGET) > 0
                tally.add(gram & np.uint64(buckets - 1), np.ones(len(gram), bool), target, np.zeros(len(gram), bool))
                lead = own & (1 << LEAD) > 0
                if lead.any():
                    tally.add(gram[lead] | np.uint64(SINGLE), *(own[lead] & (1 << c) > 0 for c in (TARGET, LOW, TOXIC)))
                yield from tally.rows(TALLY)
        yield from tally.rows(0)

    part = map_arrow(docs.select(F.col(text_col).cast("string"), F.col("__class").cast("int")), run, "key long, a long, b long, c long")
    return part.groupBy("key").agg(*[F.sum(c).alias(c) for c in "abc"])


def _real(a: Column, b: Column, all_a: float, all_b: float, z: float) -> Column:
    """Likelihood-ratio test of equal rates a / all_a and b / all_b: is its root, a
    z-score also for few counts, at least z?"""
    share = all_a / max(1.0, all_a + all_b)
    term = lambda x, p: F.when(x > 0, x * F.log(x / ((a + b) * max(p, 1e-300)))).otherwise(0.0)
    return 2 * (term(a, share) + term(b, 1 - share)) >= z * z


def log_ratios(counts: DataFrame, buckets: int) -> DataFrame:
    """(key, raw, low, toxic) of the n-grams that pass a test: log of the part's
    probability over the target's. ``counts`` are those of gram_counts."""
    sums = {r.single: r for r in counts.groupBy((F.col("key") >= SINGLE).alias("single")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c"), F.count("*").alias("n")).collect()}  # two rows
    a, b, c, none = F.col("a"), F.col("b"), F.col("c"), F.lit(0.0)
    out = []
    if r := sums.get(False):
        raw = (a + 0.5) / (r.a + 0.5 * buckets)
        ratio = F.log(raw) - F.log((b + RAW_PRIOR * raw) / (r.b + RAW_PRIOR))
        out.append(counts.where((F.col("key") < SINGLE) & _real(b, a, r.b, r.a, RAW_Z)).select("key", ratio.alias("raw"), none.alias("low"), none.alias("toxic")))
    if r := sums.get(True):
        base = PRIOR * (a + b + c + 0.5) / (r.a + r.b + r.c + 0.5 * r.n)
        target = F.log((a + base) / (r.a + PRIOR))
        part = lambda x, total: F.when(_real(x, a, total, r.a, Z), F.log((x + base) / (total + PRIOR)) - target).otherwise(0.0)
        single = counts.where(F.col("key") >= SINGLE).select("key", none.alias("raw"), part(b, r.b).alias("low"), part(c, r.c).alias("toxic"))
        out.append(single.where("low <> 0 or toxic <> 0"))
    return out[0] if len(out) == 1 else out[0].union(out[1])


def gumbel(h: np.ndarray) -> np.ndarray:
    u = ((W.mix(h) >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)
    return -np.log(-np.log(u))


class Model(NamedTuple):
    """What a draw needs: the sorted keys that have a ratio, the ratios (raw, low,
    toxic), a filter of the keys, and a threshold."""

    keys: np.ndarray
    ratios: np.ndarray
    seen: np.ndarray
    buckets: int
    log_prior: np.ndarray
    seed: int
    temperature: float
    least: float = float("inf")

    def sums(self, text: np.ndarray, keys: np.ndarray, rows: tuple, n: int) -> list[np.ndarray]:
        """Per text, the sum of each of the ratios ``rows`` over its ``keys``."""
        at = np.flatnonzero(self.seen[keys & np.uint64(_SEEN)])
        found = np.minimum(np.searchsorted(self.keys, keys[at]), max(0, len(self.keys) - 1))
        hit = self.keys[found] == keys[at] if len(self.keys) else np.zeros(0, bool)
        return [np.bincount(text[at[hit]], self.ratios[i][found[hit]], minlength=n) for i in rows]

    def weigh(self, block: W.Block, ids: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of features, log weight, sample key, posterior) of each text; the posterior
        of the target is that among the three labelled parts alone."""
        text, gram = features(block)
        # p_target cancels: every part of p_raw is relative to it
        raw = self.sums(text, gram & np.uint64(self.buckets - 1), (0,), block.n)
        parts = self.log_prior[:, None] + np.array(raw + self.sums(text, gram | np.uint64(SINGLE), (1, 2), block.n))
        top = np.max(parts, axis=0)
        weight = -(top + np.log(np.sum(np.exp(parts - top), axis=0)))
        n = np.bincount(text, minlength=block.n)
        # a document without words is no text to learn from
        weight = np.where(n > 0, weight, -1e6) + 0.0  # no negative zero: file statistics order it below zero
        k1, _ = block.sequence_keys()
        own = W.mix(np.asarray(ids.cast(pa.int64()).fill_null(-1)).view(np.uint64) + np.uint64(self.seed)) ^ k1
        labelled = np.stack([np.full(block.n, self.log_prior[TARGET]), parts[LOW], parts[TOXIC]])
        top = labelled.max(axis=0)
        posterior = np.where(n > 0, np.exp(labelled[0] - top) / np.exp(labelled - top).sum(axis=0), 0.0)
        return n, weight, weight / self.temperature + gumbel(own), posterior

    def chosen(self, n: np.ndarray, key: np.ndarray) -> np.ndarray:
        return (n > 0) & (key >= self.least)


def score(docs: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """(id, n_features, log_weight, posterior, sample_key) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in W.blocks(batch.column(1), W.LOWER):
                ids = batch.column(0).slice(block.at, block.n)
                n, weight, key, posterior = shared.value.weigh(block, ids)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (n, weight, posterior, key))], ["id", "n_features", "log_weight", "posterior", "sample_key"])

    schema = "id long, n_features long, log_weight double, posterior double, sample_key double"
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, schema)


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The largest threshold with at least k rows at or above it: counts in bins,
    then in the bin that holds the k-th row, until it has one value."""
    lo, hi, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if k <= 0 or not n:
        return float("inf")
    if k >= n:
        return lo
    above = 0
    while lo < hi:
        width = (hi - lo) / bins
        if lo + width <= lo:
            break
        at = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)).cast("int")
        inside = df.where(F.col(column).between(lo, hi)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
        for row in sorted(inside.collect(), reverse=True):  # at most ``bins`` rows
            if above + row.n >= k:
                lo, hi = row.lo, row.hi
                break
            above += row.n
    return lo


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 11, labelled: int = LABELLED, temperature: float = TEMPERATURE) -> tuple[Model, DataFrame]:
    """Count, weigh and set the draw's threshold: (model, scored rows of ``docs``)."""
    worst = labels.where("quality is not null or toxic is not null").groupBy(F.col(id_col).cast("long").alias("__label")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    bad, toxic = F.coalesce(F.col("quality") == 0, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False))
    marks = F.when(~bad & ~toxic, 1 << TARGET).otherwise(0) + F.when(bad, 1 << LOW).otherwise(0) + F.when(toxic, 1 << TOXIC).otherwise(0)
    sample = worst.where("__label is not null").select("__label", marks.alias("__class"))
    sample = settle(sample.orderBy(F.xxhash64("__label", F.lit(seed)), "__label").limit(labelled), "labels")
    # copies of one text are one example (bounded by the sample); the first of them leads
    keyed = docs.select(F.col(id_col).cast("long").alias("__label"), F.xxhash64(F.col(text_col).cast("string")).alias("__key")).join(F.broadcast(sample), "__label")
    leads = keyed.groupBy("__key").agg(F.min(F.struct("__label", "__class")).alias("one")).select("one.*").distinct()
    leads = settle(leads, "leads")
    sample = sample.join(leads.select("__label", F.lit(1 << LEAD).alias("__lead")), "__label", "left").select("__label", F.col("__class").bitwiseOR(F.coalesce("__lead", F.lit(0))).alias("__class"))
    seen = leads.agg(*[F.sum(F.col("__class").bitwiseAND(1 << c).cast("boolean").cast("int")) for c in (TARGET, LOW, TOXIC)]).first()

    buckets = BUCKETS
    marked = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    marked = marked.join(F.broadcast(sample), F.col("__id") == F.col("__label"), "left")  # at most ``labelled`` rows
    counts = settle(gram_counts(marked, "__text", buckets), "gram-counts")
    table = log_ratios(counts, buckets).orderBy("key").toArrow() if not counts.isEmpty() else None  # the n-grams that pass a test
    keys = table["key"].to_numpy().astype(np.uint64) if table else np.zeros(0, np.uint64)
    ratios = np.stack([table[c].to_numpy() for c in ("raw", "low", "toxic")]).astype(np.float32) if table else np.zeros((3, 0), np.float32)
    known = np.zeros(_SEEN + 1, bool)
    known[keys & np.uint64(_SEEN)] = True
    n = np.array([(seen[c] or 0) + 1.0 for c in range(3)])
    model = Model(keys, ratios, known, buckets, np.log(n / n.sum()), seed, temperature)
    scored = settle(score(docs, id_col, text_col, model), "weights")

    own = scored.where("n_features > 0").join(F.broadcast(leads), F.col("id") == F.col("__label"))
    step = F.floor(F.greatest(F.lit(-30.0), F.col("log_weight")) * 8)
    good = F.col("__class") == 1 << TARGET
    bins = own.groupBy(step.alias("step")).agg(F.sum(good.cast("int")).alias("good"), F.sum((~good).cast("int")).alias("bad")).collect()  # at most 300 rows
    n_good, n_bad = (max(1, sum(r[c] for r in bins)) for c in ("good", "bad"))
    steps, hits, ahead = [], 0.0, 0.0
    for r in sorted(bins, reverse=True):
        hits += r.good / n_good
        ahead += r.good / n_good - r.bad / n_bad
        steps.append((ahead, r.step / 8 if r.step > -240 else -1e5, hits))
    best = max([a for a, _, _ in steps], default=0.0)
    # of floors that separate nearly as well, the lowest; and none that loses more of the good than KEEP allows
    near = [f for a, f, _ in steps if a >= best - SLACK] + [max((f for _, f, h in steps if h >= KEEP), default=-1e5)]
    floor = min(near)
    k = scored.where((F.col("n_features") > 0) & (F.col("log_weight") >= floor)).count()
    return model._replace(least=kth_largest(scored.where("n_features > 0"), "sample_key", k)), scored


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: id_col, n_features, log_weight, posterior
    (that it is target text, of the three labelled kinds), sample_key and selected (the k largest keys).
    ``options`` are those of fit().

    ``labels``: id_col, quality, toxic. Defined cases: a null or wordless text is
    never selected; a null id is scored but matches no label; several labels of
    one id combine to the worst; labels with both fields null are left out;
    without labels no bucket has a ratio and every document with words is
    selected; ties at the threshold are all selected; repeated rows are scored
    alike; an empty table gives an empty result; other columns are ignored.
    """
    model, scored = fit(docs, labels, id_col, text_col, **options)
    chosen = (F.col("n_features") > 0) & (F.col("sample_key") >= F.lit(float(model.least)))
    return scored.select(F.col("id").alias(id_col), "n_features", "log_weight", "posterior", "sample_key", chosen.alias("selected"))


def keep_selected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The selected rows of ``docs`` with all their columns, whatever their names. Rows are
    weighed once more where they are, so that no text is shuffled to meet its decision. Cases
    are those of resample(): null, empty and wordless texts go, null ids are weighed, repeated
    rows and ties at the threshold are decided alike, an empty table stays empty."""
    model, _ = fit(docs, labels, id_col, text_col, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_id, at_text = docs.columns.index(id_col), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for block in W.blocks(batch.column(at_text), W.LOWER):
                n, _, key, _ = shared.value.weigh(block, batch.column(at_id).slice(block.at, block.n))
                keep[block.at : block.at + block.n] = shared.value.chosen(n, key)
            yield batch.filter(pa.array(keep))

    return map_arrow(docs, run, docs.schema)
