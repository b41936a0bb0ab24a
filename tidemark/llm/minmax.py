"""MinHash near-duplicates by min-max hashing.

Every permutation gives two signature values, the smallest and the largest
hashed shingle, so 64 hash evaluations a shingle make 128 values: either extreme
agrees between two sets with probability equal to their Jaccard similarity, and
the pair has lower variance than two independent minima. The 128 values form 32
bands of 4. Two sets with similarity 0.8 share no band with probability
(1 - 0.8^4)^32 = 5e-8.

Plan: (1) one Arrow pass makes a slim table (id, set size, 128-bit key of the
word sequence, bands); (2) texts with the same word sequence become one
representative; (3) representatives that share a band are compared with the
band's smallest id (a star, never all pairs of a bucket) and links are confirmed
on the full shingle sets; (4) where a bucket still holds different components,
its members meet once more by prefix filtering: with shingles ordered from rare
to frequent, two sets of similarity 0.8 share one of their first few shingles,
far enough ahead to reach the overlap that they need. That join is exact, and
edited copies of one text, whose rarest shingles are their own, hardly meet in
it. Nothing is collected; buckets are never capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.graph import components
from tidemark.llm.scratch import map_arrow, settle

PERMUTATIONS, ROWS = 64, 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Counters that order shingles from rare to frequent.
SLOTS = 1 << 18
#: Pairs of one text that meet one copy of it; a text with more has more copies.
HUB = 512
_rng = np.random.Generator(np.random.PCG64(977))
_MUL = _rng.integers(1, 2**62, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64)

SIGNATURE = "id long, n_shingles long, k1 long, k2 long, bands array<long>"


def band_keys(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys. Texts without shingles get rows of zeros."""
    full = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((len(first) - 1, BANDS), np.uint64)
    if not len(full):
        return out
    at = first[full]
    values = np.empty((2 * PERMUTATIONS, len(full)), np.uint64)
    with np.errstate(over="ignore"):
        for p in range(PERMUTATIONS):
            h = shingles * _MUL[p]
            h += _ADD[p]
            h ^= h >> np.uint64(32)
            # minima fill the first half of the bands, maxima the second
            values[p] = np.minimum.reduceat(h, at)
            values[PERMUTATIONS + p] = np.maximum.reduceat(h, at)
        for b in range(BANDS):
            key = np.full(len(full), b + 1, np.uint64)
            for r in range(ROWS):
                key = W.mix(key * W.GRAM[0, r] + values[b * ROWS + r])
            out[full, b] = key
    return out


def distinct_counts(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of different shingles of each text."""
    n = np.diff(first)
    text = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    rough = (text << np.uint64(40)) | (shingles >> np.uint64(24))
    order = np.argsort(rough)
    same = rough[order][1:] == rough[order][:-1]
    if np.any(same & (shingles[order][1:] != shingles[order][:-1])):
        order = np.lexsort((shingles, text))
        same = (shingles[order][1:] == shingles[order][:-1]) & (text[order][1:] == text[order][:-1])
    repeated = np.bincount(text[order][1:][same].astype(np.int64), minlength=len(n))
    return n - repeated


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """One slim row per row of ``docs`` (see SIGNATURE)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in W.blocks(batch.column(1), W.LOWER):
                grams, first = block.grams(size)
                k1, k2 = block.sequence_keys()
                keys = W.signed(band_keys(grams, first).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS), pa.int32()), pa.array(keys))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.at, block.n), pa.array(distinct_counts(grams, first)), pa.array(W.signed(k1)), pa.array(W.signed(k2)), lists],
                    ["id", "n_shingles", "k1", "k2", "bands"],
                )

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, SIGNATURE)


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Keep the (a, b) pairs whose full shingle sets satisfy
    100 * intersection >= percent * union. ``texts``: id, text of every id named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            # both sides of a pair in one column, so that they meet in one block
            left, right = batch.column(2).cast(pa.large_string()), batch.column(3).cast(pa.large_string())
            both = pa.concat_arrays([left, right]).take(pa.array(np.arange(2 * batch.num_rows).reshape(2, -1).T.reshape(-1)))
            for i in range(0, batch.num_rows, 64):
                for block in W.blocks(both.slice(2 * i, min(128, 2 * (batch.num_rows - i))), W.LOWER, 1 << 62):
                    grams, first = block.grams(size)
                    for j in range(block.n // 2):
                        x = np.unique(grams[first[2 * j] : first[2 * j + 1]])
                        y = np.unique(grams[first[2 * j + 1] : first[2 * j + 2]])
                        z = np.sort(np.concatenate([x, y]))
                        inter = int(np.count_nonzero(z[1:] == z[:-1]))
                        keep[i + j] = inter > 0 and 100 * inter >= percent * (len(x) + len(y) - inter)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    # the pivot of a large group is in very many pairs: they are dealt over several copies of its text
    hubs = settle(pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts")).where("parts > 1"), "hubs")
    dealt = pairs.join(hubs, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    t = texts.select("id", "text")
    left = t.select(F.col("id").alias("a"), F.col("text").alias("ta")).join(hubs, "a", "left")
    left = left.select("a", "ta", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    both = dealt.join(t.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(left, ["a", "part"])
    return map_arrow(both.select("a", "b", "ta", "tb"), run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 80) -> DataFrame:
    """Classes of near-duplicates: one row per row of ``docs``, with
    id_col, n_shingles (set size), component_id (smallest id reachable over
    links, itself included), n_links (confirmed links compared for its class
    representative, 0 without any) and kept (id = component_id).

    Texts are lower-cased (A-Z) and cut at ASCII white space; a set is the
    distinct ``size``-word shingles, or the whole sequence where there are fewer
    words. Defined cases: null or blank text has an empty set and links with
    nothing; a null id links with nothing, gets component_id null and is kept;
    repeated ids with different texts count as one node whose links are those of
    any of its texts; repeated rows come back repeated; an empty table gives an
    empty result. Columns other than the two named are ignored.
    """
    sig = settle(signatures(docs, id_col, text_col, size), "signatures")
    live = sig.where("n_shingles > 0 and id is not null")
    # one representative for each word sequence; hot copies are combined before the shuffle
    reps = settle(live.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "reps")
    slots = reps.select("rep", "n", F.explode(F.array_distinct("bands")).alias("key"))
    shared = slots.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("top"), F.min(F.struct("rep", "n"))["n"].alias("pivot_n")).where("pivot < top")
    slots = settle(slots.join(shared, "key").select("key", "rep", "n", "pivot", "pivot_n"), "buckets")

    star = slots.where("rep <> pivot").where(_sizes_fit("n", "pivot_n", percent)).select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    named = slots.select(F.col("rep").alias("id")).distinct()
    raw = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # a repeated id has several texts: only those of its representatives' sequences matter, so all are kept
    texts = settle(raw.join(named, "id", "left_semi"), "texts")
    links = settle(confirm(star, texts, size, percent).distinct(), "confirmed")
    comp = components(links)
    state = slots.select("key", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = state.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    unsettled = state.join(mixed, "key").select(F.col("rep").alias("id"), "component").distinct()
    more = rare_prefix_pairs(settle(texts.join(unsettled, "id"), "unsettled"), size, percent)
    links = settle(links.union(confirm(settle(more, "cross"), texts, size, percent)).distinct(), "confirmed")
    comp = components(links)

    degree = links.select(F.col("a").alias("rep")).union(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    classes = reps.select("k1", "k2", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    classes = classes.select("k1", "k2", F.coalesce("component", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = sig.join(classes, ["k1", "k2"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), "n_shingles", own.alias("component_id"),
        F.when(F.col("n_shingles") > 0, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        (F.col("id").isNull() | (F.col("id") == own)).alias("kept"),
    )


def _sizes_fit(x: str, y: str, percent: int):
    """No pair whose sizes alone rule the similarity out."""
    return F.expr(f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})")


def rare_prefix_pairs(sets: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) pairs of different components that may have the similarity: an
    exact filter. ``sets``: id, text, component.

    Shingles are ordered by the count of their hash slot over ``sets`` (SLOTS
    numbers, whatever the input) and then by hash. In that order a set of n
    shingles must meet an at least equally large partner among its first
    n - ceil(2t/(1+t) n) + 1 shingles and the partner's first n - ceil(t n) + 1.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for block in W.blocks(batch.column(0), W.LOWER):
                total += np.bincount((block.grams(size)[0] & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    slots = map_arrow(sets.select("text"), count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most SLOTS rows
    often = np.zeros(SLOTS, np.int64)
    often[slots["slot"].to_numpy()] = slots["n"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(often)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in W.blocks(batch.column(2), W.LOWER):
                grams, first = block.grams(size)
                text = np.repeat(np.arange(block.n), np.diff(first))
                n_of = shared.value[(grams & np.uint64(SLOTS - 1)).astype(np.int64)]
                order = np.lexsort((grams, n_of, text))
                grams, text, n_of = grams[order], text[order], n_of[order]
                fresh = np.r_[True, (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])] if len(grams) else np.zeros(0, bool)
                grams, text, n_of = grams[fresh], text[fresh], n_of[fresh]
                n = np.bincount(text, minlength=block.n)
                place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
                long = n + (-percent * n) // 100 + 1
                short = n + (-2 * percent * n) // (100 + percent) + 1
                # a slot that was counted once holds a shingle of one set: it has no partner
                use = np.flatnonzero((place < long[text]) & (n_of > 1))
                at = pa.array(text[use] + block.at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(W.signed(grams[use])), batch.column(0).take(at), batch.column(1).take(at), pa.array(n[text[use]]), pa.array(place[use]), pa.array(place[use] < short[text[use]])],
                    ["shingle", "id", "component", "n", "place", "short"],
                )

    rows = settle(map_arrow(sets.select("id", "component", "text"), prefixes, "shingle long, id long, component long, n long, place long, short boolean"), "prefixes")
    x = rows.where("short").select("shingle", *[F.col(c).alias(f"x_{c}") for c in ("id", "component", "n", "place")])
    y = rows.select("shingle", *[F.col(c).alias(f"y_{c}") for c in ("id", "component", "n", "place")])
    fits = F.expr(
        f"x_component <> y_component and (x_n < y_n or (x_n = y_n and x_id < y_id)) and 100 * x_n >= {percent} * y_n"
        f" and {100 + percent} * least(x_n - x_place, y_n - y_place) >= {percent} * (x_n + y_n)"
    )
    return x.join(y, "shingle").where(fits).select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()
