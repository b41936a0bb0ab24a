"""Removal of repeated passages with an FM-index per shard.

A window is ``size`` consecutive words of one document. Windows are routed by
their minimizer (the smallest hash of the 5-word grams inside them), so all
occurrences of one word sequence meet in one shard and every shard answers for
its own windows alone: no document has to be streamed against every shard.

1. One pass makes a slim row a document: word count, 128-bit key of the word
   sequence, hash of the whole text, and its different minimizers.
2. Documents equal word by word are one: the smallest id is searched, the others
   are repeats as a whole. A minimizer counts as shared if two searched documents
   have it, or one has it in two places. Everything else cannot hold a repeated
   window and is not looked at again.
3. The searched documents emit segments: runs of windows with the same shared
   minimizer. Equal segments are combined (before and after the shuffle) to their
   first place. A minimizer that very many documents share (HOT) would make one
   large group; its windows are emitted singly and routed by their own hash.
4. A shard concatenates its different segments and keeps their Burrows-Wheeler
   transform as a wavelet matrix of packed bits with rank samples, and every
   SAMPLE-th place of the suffix array. Its segments are streamed against it: for
   every word, backward search over the wavelet matrix gives the matching statistic,
   the length (up to ``size``) of the longest run of words that ends there and also
   stands elsewhere in the shard. Where it reaches the threshold ``size``, the
   interval's suffixes are located by walking to the next sampled place, and the
   first of them is the window's first occurrence.
5. Occurrences later than the first become covered word ranges, and the searched
   texts are written without them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.scratch import discard, map_arrow, settle, ship_code

GRAM = 5
#: Documents that may share a minimizer before its windows are routed singly.
HOT = 20_000
#: Words that one shard's index covers, about; text places between two kept suffixes.
SHARD_WORDS, SAMPLE = 1 << 18, 8
#: Segments that a task remembers as written, so that it writes their text once.
REMEMBERED = 500_000
#: Where a null id stands in document order: behind all others.
LAST = (1 << 63) - 1

SLIM = "id long, n_words long, k1 long, k2 long, sha string, own array<struct<m:long,twice:boolean>>"
SEGMENT = "p1 long, p2 long, id long, k1 long, start long, n long, route long, payload string"
FIRST = "p1 long, p2 long, first_id array<long>, first_start array<long>"


def window_minimizers(block: W.Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The minimizer of each full window, and where each text's windows begin."""
    gram = min(GRAM, size)
    n = np.maximum(0, block.count - gram + 1)
    first = np.concatenate([[0], np.cumsum(n)])
    grams = W.windows(block.hash, block.first, first, gram)
    span, have = size - gram + 1, 1
    low = grams
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:]) if len(low) > step else low[:0]
        have += step
    wins = np.maximum(0, block.count - size + 1)
    at = np.concatenate([[0], np.cumsum(wins)])
    index = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], wins)
    return low[index] if len(index) else np.zeros(0, np.uint64), at


def distinct(text: np.ndarray, values: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, value) of the values that a text has ``least`` times, each once."""
    order = np.lexsort((values, text))
    text, values = text[order], values[order]
    if not len(text):
        return text, values
    begin = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]) | (text[1:] != text[:-1])])
    begin = begin[np.diff(np.r_[begin, len(text)]) >= least]
    return text[begin], values[begin]


def again_soon(block: W.Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram) of grams that come again within the reach of one window."""
    gram = min(GRAM, size)
    n = np.maximum(0, block.count - gram + 1)
    first = np.concatenate([[0], np.cumsum(n)])
    grams, text = W.windows(block.hash, block.first, first, gram), np.repeat(np.arange(block.n), n)
    again = np.zeros(len(grams), bool)
    for lag in range(1, size - gram + 1):
        again[lag:] |= grams[lag:] == grams[:-lag]
    return text[again], grams[again]


def joined(block: W.Block, text: int) -> bytes:
    return b" ".join(block.data[block.offsets[text] : block.offsets[text + 1]].tobytes().split())


def slim_rows(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in W.blocks(batch.column(1), W.PLAIN):
                mins, at = window_minimizers(block, size)
                k1, k2 = block.sequence_keys()
                text = np.repeat(np.arange(block.n), np.diff(at))
                opens = np.r_[True, mins[1:] != mins[:-1]] if len(mins) else np.zeros(0, bool)
                opens[at[:-1][np.diff(at) > 0]] = True
                begin = np.flatnonzero(opens)
                long = np.diff(np.r_[begin, len(mins)]) > size - min(GRAM, size) + 1
                own = distinct(text[begin], mins[begin], block.n, 1)
                # a minimizer has two places in a text if it has two runs, a run too long for one place,
                # or a gram that comes again inside one window
                again_text, again = again_soon(block, size)
                runs = distinct(text[begin], mins[begin], block.n, 2)
                twice = distinct(np.concatenate([runs[0], text[begin][long], again_text]), np.concatenate([runs[1], mins[begin][long], again]), block.n, 1)
                counts = np.bincount(own[0], minlength=block.n)
                pairs = np.rec.fromarrays(own, names="t,m")
                flags = np.isin(pairs, np.rec.fromarrays(twice, names="t,m")) if len(twice[0]) else np.zeros(len(pairs), bool)
                uses = pa.StructArray.from_arrays([pa.array(W.signed(own[1])), pa.array(flags)], ["m", "twice"])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), uses)
                shas = [hashlib.sha256(joined(block, t)).hexdigest() for t in range(block.n)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.at, block.n), pa.array(block.count.astype(np.int64)), pa.array(W.signed(k1)), pa.array(W.signed(k2)), pa.array(shas), lists],
                    ["id", "n_words", "k1", "k2", "sha", "own"],
                )

    return map_arrow(docs, run, SLIM)


def run_keys(block: W.Block, word: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit fingerprints of each run of ``length`` words from ``word``, out of
    running sums over the block: overlapping runs cost nothing more."""
    power, unpower = W.power_tables(len(block.hash))
    out = []
    with np.errstate(over="ignore"):
        for salt in (0, 1):
            sums = np.zeros(len(block.hash) + 1, np.uint64)
            np.cumsum(W.mix(block.hash * W.GRAM[salt, 23]) * power[: len(block.hash)], out=sums[1:])
            out.append(W.mix((sums[word + length] - sums[word]) * unpower[word] + length.astype(np.uint64) * W.GRAM[salt, 22]))
    return out


def segments(texts: DataFrame, size: int) -> DataFrame:
    """``texts``: id, text, wanted (shared minimizers), hot (those to be routed by
    window). Of a block's equal segments, the first in document order carries the
    route; a task writes a segment's text once as far as it remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written: set[int] = set()
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for block in W.blocks(batch.column(1), W.PLAIN):
                k1, _ = block.sequence_keys()
                mins, at = window_minimizers(block, size)
                wins = np.diff(at)
                doc = np.repeat(np.arange(block.n), wins)
                wanted, is_hot = np.zeros(len(mins), bool), np.zeros(len(mins), bool)
                for t in np.flatnonzero(wins):
                    own = mins[at[t] : at[t + 1]]
                    for mark, column in ((wanted, 2), (is_hot, 3)):
                        mark[at[t] : at[t + 1]] = np.isin(own, batch.column(column)[block.at + int(t)].values.to_numpy().view(np.uint64))
                if not wanted.any():
                    continue
                turns = (mins[1:] != mins[:-1]) | is_hot[1:] | (doc[1:] != doc[:-1])
                opens, closes = wanted.copy(), wanted.copy()
                opens[1:] &= ~wanted[:-1] | turns
                closes[:-1] &= ~wanted[1:] | turns
                begin, end = np.flatnonzero(opens), np.flatnonzero(closes)
                n, d = end - begin + 1, doc[begin]
                start = begin - at[d]
                word, length = block.first[d] + start, n + size - 1
                keys = run_keys(block, word, length)
                route = np.where(is_hot[begin], keys[0], mins[begin])
                own_id = ids[block.at + d]
                order = np.lexsort((start, own_id, keys[1], keys[0]))
                lead = np.zeros(len(begin), bool)
                lead[order[np.r_[True, (keys[0][order][1:] != keys[0][order][:-1]) | (keys[1][order][1:] != keys[1][order][:-1])]]] = True
                payload: list[str | None] = [None] * len(begin)
                for i in np.flatnonzero(lead).tolist():
                    if (key := int(keys[0][i])) not in written:
                        written.add(key)
                        payload[i] = block.data[block.start[word[i]] : block.end[word[i] + length[i] - 1]].tobytes().decode()
                if len(written) > REMEMBERED:
                    written.clear()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(W.signed(keys[0])), pa.array(W.signed(keys[1])), pa.array(own_id), pa.array(W.signed(k1)[d]), pa.array(start), pa.array(n), pa.array(W.signed(route), mask=~lead), pa.array(payload, pa.string())],
                    ["p1", "p2", "id", "k1", "start", "n", "route", "payload"],
                )

    return map_arrow(texts.select("id", "text", "wanted", "hot"), run, SEGMENT)


def sort_suffixes(text: np.ndarray) -> np.ndarray:
    """Suffix order of ``text`` by prefix doubling."""
    n = len(text)
    rank, have = text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while have < n:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - have)] = rank[have:] + 1
        key = rank * (max(n, int(rank.max())) + 2) + ahead
        order = np.argsort(key, kind="stable")
        sorted_keys = key[order]
        rank[order] = np.cumsum(np.r_[False, sorted_keys[1:] != sorted_keys[:-1]])
        have *= 2
        if rank[order[-1]] == n - 1:
            break
    return order


class WaveletMatrix:
    """Access and rank over a large alphabet: one packed bit plane a level, with a
    count of ones before every 64-bit word."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.planes, self.before, self.zeros = [], [], []
        current = symbols
        for level in range(self.levels - 1, -1, -1):
            bits = ((current >> level) & 1).astype(bool)
            packed = np.packbits(np.r_[bits, np.zeros(-len(bits) % 64 + 64, bool)], bitorder="little").view(np.uint64)
            self.planes.append(packed)
            self.before.append(np.r_[0, np.cumsum(np.bitwise_count(packed))].astype(np.int32))
            self.zeros.append(int(len(bits) - bits.sum()))
            current = np.concatenate([current[~bits], current[bits]])
        self.start = self._trace(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[k][word] + np.bitwise_count(self.planes[k][word] & mask)

    def _trace(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self._ones(k, at)
            at = np.where((symbol >> level) & 1 == 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each ``symbol`` before position ``at``."""
        return self._trace(symbol, at) - self.start[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its occurrences before it."""
        symbol = np.zeros(len(at), np.int64)
        for k in range(self.levels):
            ones = self._ones(k, at)
            bit = (self.planes[k][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            symbol = symbol * 2 + bit
            at = np.where(bit, self.zeros[k] + ones, at - ones)
        return symbol, at - self.start[symbol]


class FmIndex:
    """Backward search over segments of words (symbols from 2), each closed by a
    separator 1, the last one by 0, which makes the text's rotations sort as its suffixes. Kept are
    the wavelet matrix, symbol counts and sampled suffixes; ``stream`` has the
    segments' symbols, which are the documents streamed against the index."""

    def __init__(self, parts: list[np.ndarray]):
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.vocabulary, codes = np.unique(np.concatenate(parts), return_inverse=True)
        self.first = np.r_[0, np.cumsum(self.lengths + 1)]
        self.stream = np.ones(self.first[-1], np.int32)
        inside = np.ones(self.first[-1], bool)
        inside[self.first[1:] - 1] = False
        self.stream[inside] = codes + 2
        self.stream[-1] = 0
        suffixes = sort_suffixes(self.stream)
        n_symbols = len(self.vocabulary) + 2
        self.before = np.r_[0, np.cumsum(np.bincount(self.stream, minlength=n_symbols))]
        self.tree = WaveletMatrix(self.stream[suffixes - 1], n_symbols)
        kept = suffixes % SAMPLE == 0
        self.marks = np.packbits(np.r_[kept, np.zeros(-len(kept) % 64 + 64, bool)], bitorder="little").view(np.uint64)
        self.marks_before = np.r_[0, np.cumsum(np.bitwise_count(self.marks))].astype(np.int32)
        self.samples = suffixes[kept].astype(np.int32)

    def matching_statistics(self, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, lo, hi) for each stream position in ``ends``: the longest run of
        words, of ``most`` at most, that ends there and stands elsewhere in the index as
        well, and its suffix interval. A run never crosses a separator."""
        length, lo, hi = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64), np.full(len(ends), self.first[-1])
        alive = np.arange(len(ends))
        for j in range(most):
            alive = alive[ends[alive] >= j]
            symbol = self.stream[ends[alive] - j]
            alive, symbol = alive[symbol > 1], symbol[symbol > 1]
            low = self.before[symbol] + (self.tree.rank(symbol, lo[alive]) if j else 0)
            high = self.before[symbol] + self.tree.rank(symbol, hi[alive]) if j else self.before[symbol + 1]
            more = high - low > 1
            alive, low, high = alive[more], low[more], high[more]
            length[alive], lo[alive], hi[alive] = j + 1, low, high
        return length, lo, hi

    def locate(self, ranks: np.ndarray) -> np.ndarray:
        """Stream position of each suffix rank: back to the next sampled place."""
        out, at, todo = np.empty(len(ranks), np.int64), ranks.copy(), np.arange(len(ranks))
        for steps in range(SAMPLE):
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            kept = (self.marks[word] >> bit) & np.uint64(1) == 1
            nth = self.marks_before[word] + np.bitwise_count(self.marks[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[kept]] = self.samples[nth[kept]] + steps
            todo, at = todo[~kept], at[~kept]
            if not len(todo):
                break
            symbol, before = self.tree.access(at)
            at = self.before[symbol] + before
        return out


def first_places(payloads: pa.Array, ids: np.ndarray, starts: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each segment, the first place (id, word) of each of its windows."""
    parts = [block.hash[block.first[t] : block.first[t + 1]] for block in W.blocks(payloads, W.PLAIN) for t in range(block.n)]
    index = FmIndex(parts)
    n = index.lengths - size + 1
    ends = np.r_[0, np.cumsum(n)]
    part = np.repeat(np.arange(len(n)), n)
    offset = np.arange(ends[-1]) - ends[part]
    at = index.first[part] + offset
    length, lo, hi = index.matching_statistics(at + size - 1, size)
    own_id, own_start = ids[part], starts[part] + offset
    order = np.lexsort((own_start, own_id))
    place = np.full(len(index.stream), len(at), np.int32)
    place[at[order]] = np.arange(len(at))
    best = place[at].astype(np.int64)
    many = np.flatnonzero(length >= size)
    if len(many):
        spans, which, back = np.unique(lo[many], return_index=True, return_inverse=True)
        sizes = hi[many][which] - spans
        begin = np.cumsum(sizes) - sizes
        ranks = np.arange(int(sizes.sum())) + np.repeat(spans - begin, sizes)
        best[many] = np.minimum.reduceat(place[index.locate(ranks)], begin)[back]
    return [(own_id[order[best[a:b]]], own_start[order[best[a:b]]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def search_shards(parts: DataFrame, shards: int, size: int) -> DataFrame:
    """``parts``: route, p1, p2, id, start, payload. Equal parts of different
    batches are combined where they arrive. Shards are groups, as many as the words ask for; the
    tasks that work on them one after the other are no more than the shuffle partitions."""

    def run(table: pa.Table) -> pa.Table:
        got = first_places(table["payload"], table["id"].to_numpy(), table["start"].to_numpy(), size)
        lists = (pa.array([x[k] for x in got], pa.list_(pa.int64())) for k in (0, 1))
        return pa.table([table["p1"], table["p2"], *lists], names=["p1", "p2", "first_id", "first_start"])

    ship_code(parts.sparkSession)
    tasks = min(shards, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    routed = parts.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards)).cast("int")).repartition(tasks, "shard")
    once = routed.groupBy("shard", "p1", "p2").agg(F.min(F.struct("id", "start")).alias("at"), F.min("payload").alias("payload"))
    return once.select("shard", "p1", "p2", "at.id", "at.start", "payload").groupBy("shard").applyInArrow(run, FIRST)


def covered(members: DataFrame, size: int) -> DataFrame:
    """Word ranges of each member segment that occur earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, starts = (np.asarray(batch.column(i)) for i in range(3))
            lists = batch.column(3)
            ends = np.asarray(lists.offsets)
            f_id = np.asarray(lists.values)[ends[0] : ends[-1]]
            f_start = np.asarray(batch.column(4).values)[batch.column(4).offsets[0].as_py() : batch.column(4).offsets[-1].as_py()]
            n = np.diff(ends)
            row = np.repeat(np.arange(len(n)), n)
            word = starts[row] + np.arange(len(row)) - np.repeat(ends[:-1] - ends[0], n)
            later = (f_id < ids[row]) | ((f_id == ids[row]) & (f_start < word))
            row, word = row[later], word[later]
            opens = np.r_[True, (row[1:] != row[:-1]) | (word[1:] != word[:-1] + 1)] if len(row) else np.zeros(0, bool)
            closes = np.r_[opens[1:], True] if len(row) else opens
            own = row[opens]
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(keys[own]), pa.array(word[opens]), pa.array(word[closes] + size)], ["id", "k1", "begin", "end"])

    return map_arrow(members.select("id", "k1", "start", "first_id", "first_start"), run, "id long, k1 long, begin long, end long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 20, shard_words: int = SHARD_WORDS, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: id_col, n_words, n_removed, kept_sha256
    and spans (the removed word ranges, merged; null for a document that equals
    an earlier one as a whole, which goes as a whole).

    A word goes if a window over it has a word sequence that also starts earlier:
    in a smaller id, or earlier in the same document; judged on the input. Defined
    cases: null and blank texts have no words; a null id stands behind all others;
    repeated rows start at the same place, so neither removes the other; of
    different texts under one id the earlier start counts; texts of fewer than
    ``size`` words are left alone; an empty table gives an empty result; other
    columns are ignored.
    """
    raw = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.col(text_col).cast("string").alias("text"))
    full = settle(slim_rows(raw, id_col, text_col, size), "minimizers")
    slim = settle(full.drop("own"), "documents")
    lead = settle(slim.where(F.col("n_words") >= size).groupBy("k1", "k2").agg(F.min("id").alias("lead")), "leads")

    copies = slim.select("id", "k1", "k2").join(lead, ["k1", "k2"]).where("id > lead").select("id", "k1")
    searched = full.select("id", "k1", "own").join(copies, ["id", "k1"], "left_anti")
    uses = searched.select("id", F.inline("own"))
    shared = uses.groupBy("m").agg(F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("n")).where("n > 1")
    wanted = uses.select("id", "m").join(shared.select("m", (F.col("n") > hot).alias("hot")), "m")
    wanted = wanted.groupBy("id").agg(F.collect_set("m").alias("wanted"), F.collect_set(F.when(F.col("hot"), F.col("m"))).alias("hot"))
    texts = settle(raw.where("text is not null").join(wanted, "id"), "searched")
    discard(full)  # minimizers have done their work

    found = settle(segments(texts, size), "segments")
    n_words = found.where("payload is not null").agg(F.sum(F.col("n") + (size - 1))).first()[0] or 0
    parts = found.where("route is not null").select("route", "p1", "p2", "id", "start", "payload")
    first = search_shards(parts, -(-n_words // shard_words) or 1, size)
    ranges = covered(found.select("p1", "p2", "id", "k1", "start").join(first, ["p1", "p2"]), size)
    # written, so that its real size decides how it meets the texts
    ranges = settle(ranges.groupBy("id", "k1").agg(F.collect_list(F.struct("begin", "end")).alias("ranges")), "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key, _ = next(W.blocks(pa.array([row["text"]]), W.PLAIN)).sequence_keys()
                if W.signed(key)[0] != row["k1"]:
                    continue  # another text under a repeated id
                words = row["text"].encode().split()
                cover = np.zeros(len(words) + 1, np.int64)
                for x in row["ranges"]:
                    cover[x["begin"]] += 1
                    cover[x["end"]] -= 1
                gone = np.cumsum(cover)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
                spans = [{"begin": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]
                out.append((row["k1"], row["id"], int(gone.sum()), hashlib.sha256(kept).hexdigest(), spans))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))))],
                ["c1", "c_id", "gone", "cut_sha", "spans"],
            )

    met = texts.join(ranges, "id").select("id", "k1", "text", "ranges")
    done = map_arrow(met, cut, "c1 long, c_id long, gone long, cut_sha string, spans array<struct<begin:long,end:long>>").dropDuplicates(["c1", "c_id"])
    out = slim.join(lead, ["k1", "k2"], "left").join(done, (F.col("k1") == F.col("c1")) & (F.col("id") == F.col("c_id")), "left")
    copy = F.col("id") > F.col("lead")
    return out.select(
        F.when(F.col("id") < LAST, F.col("id")).alias(id_col), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        F.when(~F.coalesce(copy, F.lit(False)), F.coalesce("spans", F.array().cast("array<struct<begin:long,end:long>>"))).alias("spans"),
    )
