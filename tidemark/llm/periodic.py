"""Periodic runs of words, from longest previous factors.

A run is a stretch of words with smallest period q, at least ``exponent`` periods and
``least`` words long, that no neighbouring word extends with period q. Texts are worked
on in blocks; a word belongs to its text, so nothing is found across texts.

1. Prefix doubling sorts the suffixes. The name that a position has after round k stands
   for the 2^k words from there, so two positions are compared over any length, forwards
   and backwards, in as many steps as there were rounds.
2. The longest previous factor of a position is the larger of its common prefixes with
   the next suffixes above and below it in the suffix array that start earlier: minima of
   the LCP array over the gap. Windows of doubled length find both neighbours.
3. Cutting a text greedily by that array gives its Lempel-Ziv blocks.
4. A run that touches a block boundary b has, between the blocks of length k and m on
   either side, a period of at most (k + m) / 3 when it holds four of them (in general
   (k + m) / (exponent - 1)): a larger one would have made the former block longer. Each such
   (b, q) is extended to both sides.
5. A run strictly inside a block is a copy of an earlier one: runs lie in buckets by their
   start, and blocks copy, from left to right, those of the stretch they repeat.

Every text is a row of its own; one task holds the names of one block of texts (2 MB of
text, or one longer text): 4 bytes a word and round.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.scratch import map_arrow

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Suffixes:
    """The suffixes of all texts of a block in order (``order``), and the names of each
    round. ``words``: any numbers that say which words are equal; ``first``: where each
    text begins, one more entry than texts."""

    def __init__(self, words: np.ndarray, first: np.ndarray):
        n, count = len(words), np.diff(first)
        self.n = n
        text = np.repeat(np.arange(len(count), dtype=np.uint64), count)
        stop = np.repeat(first[1:], count)
        with np.errstate(over="ignore"):
            own = W.mix(words ^ W.mix(text * W.GRAM[1, 20] + W.GRAM[1, 21]))
        self.order = np.argsort(own, kind="stable")
        new = np.ones(n, bool)
        new[1:] = own[self.order[1:]] != own[self.order[:-1]]
        group = np.flatnonzero(new)
        rank = np.full(n + 1, -1, np.int64)  # one more that equals no word
        rank[self.order] = np.repeat(group, np.diff(np.r_[group, n]))
        self.names = [rank.astype(np.int32)]
        size = np.repeat(np.diff(np.r_[group, n]), np.diff(np.r_[group, n]))
        self.repeated = size > 1  # by place in the order, of first words
        self.largest = int(size.max()) if n else 0
        active, step = self.order[self.repeated], 1
        while len(active):
            after = active + step
            inside = after < stop[active]
            key = (rank[active] << 32) | np.where(inside, rank[np.where(inside, after, n)] + 1, 0)
            by = np.argsort(key, kind="stable")
            active, key = active[by], key[by]
            old = rank[active]
            place = np.arange(len(active))
            head = np.r_[True, old[1:] != old[:-1]]
            sub = np.r_[True, key[1:] != key[:-1]]
            from_head = place - np.maximum.accumulate(np.where(head, place, 0))
            self.order[old + from_head] = active
            lead = np.flatnonzero(sub)
            sizes = np.diff(np.r_[lead, len(active)])
            rank[active] = np.repeat(old[lead] + from_head[lead], sizes)
            active = active[np.repeat(sizes, sizes) > 1]
            step *= 2
            if len(active):
                self.names.append(rank.astype(np.int32))

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are the same."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for k in range(len(self.names) - 1, -1, -1):
            same = np.where(self.names[k][i] == self.names[k][j], 1 << k, 0)
            i += same
            j += same
        return i - begin

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j are the same (i below j)."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for k in range(len(self.names) - 1, -1, -1):
            there = i >= 1 << k
            a, b = np.where(there, i - (1 << k), 0), np.where(there, j - (1 << k), self.n)
            same = np.where(self.names[k][a] == self.names[k][b], 1 << k, 0)
            i -= same
            j -= same
        return begin - i


def nearest_smaller(place: np.ndarray, lcp: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each entry, the nearest one before it with a smaller place, and the least of
    ``lcp`` between (``lcp[r]`` stands between r - 1 and r; 0 where nothing is found
    within ``reach``)."""
    n, levels = len(place), max(1, int(reach).bit_length())
    lows, gaps = [place], [lcp]
    for k in range(levels - 1):
        w = 1 << k
        for made, last in ((lows, lows[-1]), (gaps, gaps[-1])):
            wider = last.copy()
            wider[w:] = np.minimum(last[w:], last[:-w])
            made.append(wider)
    at, low = np.arange(n) - 1, lcp.copy()
    for k in range(levels - 1, -1, -1):
        past = (at >= 0) & (lows[k][at] > place)
        low = np.where(past, np.minimum(low, gaps[k][at]), low)
        at = np.where(past, at - (1 << k), at)
    found = (at >= 0) & (place[at] < place)
    return np.where(found, place[at], -1), np.where(found, low, 0)


def previous_factors(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """LPF array: the longest stretch from each position that also starts earlier, and
    where (-1: none)."""
    length, source = np.zeros(s.n, np.int64), np.full(s.n, -1, np.int64)
    place = s.order[s.repeated]
    if not len(place):
        return length, source
    lcp = np.zeros(len(place), np.int64)
    lcp[1:] = s.ahead(place[:-1], place[1:])
    up, up_low = nearest_smaller(place, lcp, s.largest)
    down, down_low = nearest_smaller(place[::-1].copy(), np.r_[0, lcp[:0:-1]], s.largest)
    down, down_low = down[::-1], down_low[::-1]
    better = down_low > up_low
    length[place] = np.where(better, down_low, up_low)
    source[place] = np.where(length[place] > 0, np.where(better, down, up), -1)
    return length, source


def blocks_of(length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the Lempel-Ziv blocks of all texts begin."""
    step, out = np.maximum(length, 1).tolist(), []
    for at, stop in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        while at < stop:
            out.append(at)
            at += step[at]
    return np.asarray(out, np.int64)


def find_runs(words: np.ndarray, first: np.ndarray, exponent: int = 4, least: int = 6) -> list[list[tuple[int, int, int]]]:
    """For each text its runs (start, end, period), by start, then period; places are
    those of ``words``. ``exponent`` is 2 or more."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(first) - 1)]
    if not len(words):
        return out
    s = Suffixes(words, first)
    length, source = previous_factors(s)
    begin = blocks_of(length, first)
    text = np.searchsorted(first, begin, side="right") - 1
    own = np.maximum(length[begin], 1)
    # boundaries: the begin of every block but a text's first, and the end of a text
    inner = np.flatnonzero(begin > first[text])
    last = np.flatnonzero(np.r_[text[1:] != text[:-1], True])
    at = np.r_[begin[inner], begin[last] + own[last]]
    both = np.r_[own[inner - 1] + own[inner], own[last]]
    most = both // (exponent - 1)
    ask = np.repeat(np.arange(len(at)), most)
    q = np.arange(len(ask)) - np.repeat(np.cumsum(most) - most, most) + 1
    b, t = at[ask], np.r_[text[inner], text[last]][ask]
    made = []
    for i, j in ((b - q, b), (b, b + q)):
        ok = (i >= first[t]) & (j <= first[t + 1])
        i, j, p = i[ok], j[ok], q[ok]
        back, ahead = s.behind(i, j), s.ahead(i, j)
        ok = back + ahead + p >= np.maximum(least, exponent * p)
        made.append(np.stack([i - back, j + ahead, p], axis=1)[ok])
    made = np.unique(np.concatenate(made), axis=0)
    if not len(made):
        return out
    # one stretch may have been found with multiples of its period: the smallest comes first
    made = made[np.r_[True, np.any(made[1:, :2] != made[:-1, :2], axis=1)]]
    where = np.searchsorted(first, made[:, 0], side="right") - 1
    for k, run in zip(where.tolist(), made.tolist(), strict=True):
        out[k].append(tuple(run))
    wide = np.flatnonzero(own >= least + 2)
    for k, a, m, p in zip(text[wide].tolist(), begin[wide].tolist(), own[wide].tolist(), source[begin[wide]].tolist(), strict=True):
        runs = out[k]
        r = bisect_right(runs, (p, 1 << 62, 0))
        while r < len(runs) and runs[r][0] < p + m:
            start, end, period = runs[r]
            r += 1
            if end < p + m:
                copy = (start + a - p, end + a - p, period)
                x = bisect_right(runs, copy)
                if not x or runs[x - 1] != copy:
                    insort(runs, copy)
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapse(block: W.Block, runs: list[list[tuple[int, int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words that stay, each followed by a space, and where each text's end: a
    word goes if a run holds it after the run's first period."""
    change = np.zeros(len(block.start) + 1, np.int64)
    for start, end, period in (r for own in runs for r in own):
        change[start + period] += 1
        change[end] -= 1
    stays = np.cumsum(change)[:-1] == 0
    begin, size = block.start[stays], (block.end - block.start)[stays]
    to = np.cumsum(size + 1)
    out = np.full(int(to[-1]) if len(to) else 0, 0x20, np.uint8)
    letters = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[letters + np.repeat(to - size - 1, size)] = block.data[letters + np.repeat(begin, size)]
    kept = np.zeros(len(stays) + 1, np.int64)
    np.cumsum(stays, out=kept[1:])
    return out, np.r_[0, to][kept[block.first]]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """One row per row of ``docs``: id_col, n_words, runs (start and length in words,
    period; by start, then period) and collapsed (the words left when every run keeps its
    first period, joined by one space).

    Words are what ASCII white space separates, compared as they are. Defined cases: null,
    empty and blank texts have no words, no runs and an empty collapsed text; a text is
    worked on whole, whatever its length; runs may overlap and lie in one another; a null
    id stays null; repeated rows are rows of their own; an empty table gives an empty
    result; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in W.blocks(batch.column(1), W.PLAIN):
                found = find_runs(block.hash, block.first, exponent, least)
                data, ends = collapse(block, found)
                data, ends = data.tobytes(), ends.tolist()
                rows = [[{"start": s - at, "length": e - s, "period": q} for s, e, q in own] for own, at in zip(found, block.first.tolist(), strict=False)]
                texts = [data[a : max(a, b - 1)].decode() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[block.at : block.at + block.n], pa.array(block.count.astype(np.int64)), pa.array(rows, pa.list_(RUN)), pa.array(texts, pa.string())],
                    ["id", "n_words", "runs", "collapsed"],
                )

    raw = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(raw, run, f"id {raw.schema['id'].dataType.simpleString()}, {SCHEMA}").withColumnRenamed("id", id_col)


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs``; of one document in ten, told by the checksum of its id,
    the words from a certain one on repeat the first few of them to the end."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    h = F.crc32(F.col("doc_id").cast("string"))
    told = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words"))
    g = F.floor(F.col("h") / 10)
    told = told.withColumn("a", F.when(F.col("n") > 0, g % F.col("n")).cast("int"))
    told = told.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    planted = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), F.col("n") - F.col("a")))
    return told.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def described(found: DataFrame) -> DataFrame:
    """The digest columns of ``periodic_runs``: how many runs, the one with the most
    periods (ties: the first), and checksums of all runs and of what is left."""
    run = "struct<start:bigint,length:bigint,period:bigint>"
    top = F.aggregate("runs", F.lit(None).cast(run), lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.withColumn("top", top)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("top.length * 1000 div top.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
