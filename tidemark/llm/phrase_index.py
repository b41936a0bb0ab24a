"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document, as search engines do it: each row indexes
a block of whole documents (their ids, their word counts, and for every term of
the block the sorted list of its positions). A phrase lies inside one document,
so every block answers all queries by itself and postings are never shuffled.
A query takes the lists of its terms from the rarest up, shifts them by the
terms' offsets and intersects; a test term that a block lacks ends the phrase
there at once. Queries are the benchmark's word windows, shipped to the blocks
in chunks of a fixed byte bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.scratch import map_arrow, settle

#: Text bytes that one index row covers (a longer document has a row of its own).
INDEX_BYTES = 8 << 20
#: Benchmark text bytes that are on the driver and in a task at a time; a larger benchmark is
#: searched chunk after chunk.
CHUNK_BYTES = 4 << 20
#: Candidate positions that are intersected at once.
_STEP = 1 << 21

INDEX = "block string, ids array<long>, n_words array<int>, n_terms long, terms binary, postings binary"
MATCHES = "block string, doc int, id long, n_words long, n_hit long, items array<string>, near_items array<string>, spans array<struct<start:long,end:long>>"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = INDEX_BYTES) -> DataFrame:
    """Index rows (see INDEX) over all words of all documents. Null texts are
    documents without words; null and repeated ids stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for block in W.blocks(batch.column(1), W.ALNUM, block_bytes):
                order = np.argsort(block.hash, kind="stable").astype(np.int32)
                sorted_terms = block.hash[order]
                opens = np.flatnonzero(np.r_[True, sorted_terms[1:] != sorted_terms[:-1]]) if len(order) else np.zeros(0, np.int64)
                steps = np.diff(order, prepend=order[:1] * 0)
                steps[opens] = order[opens]
                counts = np.diff(np.r_[opens, len(order)]).astype(np.int32)
                ids, terms = batch.column(0).slice(block.at, block.n), sorted_terms[opens].tobytes() + counts.tobytes()
                postings = pack(steps.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())
                # a name that a repeated task gives again; blocks of one name have the same documents
                name = hashlib.blake2b(repr(ids.to_pylist()).encode() + block.count.tobytes() + terms + postings, digest_size=16).hexdigest()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name]),
                        pa.ListArray.from_arrays(pa.array([0, block.n], pa.int32()), ids),
                        pa.ListArray.from_arrays(pa.array([0, block.n], pa.int32()), pa.array(block.count.astype(np.int32))),
                        pa.array([len(opens)], pa.int64()),
                        pa.array([terms], pa.binary()),
                        pa.array([postings], pa.binary()),
                    ],
                    ["block", "ids", "n_words", "n_terms", "terms", "postings"],
                )

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, INDEX)


class _Block:
    """An index row in memory. Postings are term-major, so rank * N + position
    is one sorted array that answers every (term, position) question."""

    def __init__(self, n_words, n_terms: int, terms: bytes, postings: bytes):
        self.first = np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64)
        self.n = int(self.first[-1])
        self.terms = np.frombuffer(terms, np.uint64, n_terms)
        self.df = np.frombuffer(terms, np.int32, n_terms, 8 * n_terms)
        self.ptr = np.concatenate([[0], np.cumsum(self.df)]).astype(np.int64)
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(postings, max_output_size=max(1, 4 * self.n)), np.uint8)
        steps = np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").reshape(-1).astype(np.int64)
        run = np.cumsum(steps)
        base = np.concatenate([[0], run])[self.ptr[:-1]]
        self.positions = run - np.repeat(base, self.df)
        self.keys = np.repeat(np.arange(n_terms, dtype=np.int64), self.df) * (self.n + 1) + self.positions

    def ranks(self, terms: np.ndarray) -> np.ndarray:
        """Rank of each term in this block, -1 where absent."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(len(terms), -1)

    def has(self, rank: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Does the term occur at a position in [low, high]?"""
        base = rank * (self.n + 1)
        at = np.searchsorted(self.keys, base + low)
        found = self.keys[np.minimum(at, len(self.keys) - 1)]
        return (at < len(self.keys)) & (found <= base + high)


class _Queries:
    """The distinct windows of a chunk of benchmark items."""

    def __init__(self, ids: list, texts: list, size: int):
        wins, owner = [], []
        self.items = [str(x) for x in ids]
        for block in W.blocks(pa.array(texts, pa.string()), W.ALNUM):
            for t in range(block.n):
                own = block.hash[block.first[t] : block.first[t + 1]]
                n = min(size, len(own))
                for s in range(len(own) - n + 1 if n else 0):
                    wins.append(own[s : s + n])
                    owner.append(block.at + t)
        lengths = np.array([len(x) for x in wins], np.int64)
        table = np.zeros((len(wins), size), np.uint64)
        for i, x in enumerate(wins):
            table[i, : len(x)] = x
        keyed, inverse = np.unique(np.c_[table, lengths.astype(np.uint64)], axis=0, return_inverse=True) if len(wins) else (np.zeros((0, size + 1), np.uint64), np.zeros(0, int))
        self.size, self.windows, self.length = size, keyed[:, :size], keyed[:, size].astype(np.int64)
        self.vocabulary, where = np.unique(self.windows, return_inverse=True)
        self.term = where.reshape(self.windows.shape)
        self.used = np.arange(size)[None, :] < self.length[:, None]
        order = np.argsort(np.asarray(inverse).reshape(-1), kind="stable")
        self.owner = np.array(owner, np.int64)[order]
        self.owner_at = np.searchsorted(np.asarray(inverse).reshape(-1)[order], np.arange(len(keyed) + 1))


def _answers(block: _Block, q: _Queries, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(window, start or anchor position, is it exact?) in steps."""
    if not len(block.terms) or not len(q.windows):
        return
    rank = block.ranks(q.vocabulary)[q.term]
    alive = np.flatnonzero(np.all((rank >= 0) | ~q.used, axis=1))
    rank, used = rank[alive], q.used[alive]
    weight = np.where(used, block.df[np.maximum(rank, 0)], np.iinfo(np.int32).max)
    by_rarity = np.argsort(weight, axis=1, kind="stable")
    rarest = by_rarity[:, 0]
    n = weight[np.arange(len(alive)), rarest].astype(np.int64)
    cuts = np.searchsorted(np.cumsum(n), np.arange(1, int(n.sum()) // _STEP + 1) * _STEP).tolist()
    for lo, hi in zip([0, *cuts], [*cuts, len(alive)], strict=True):
        if lo == hi:
            continue
        w = np.repeat(np.arange(lo, hi), n[lo:hi])
        begin = block.ptr[rank[np.arange(lo, hi), rarest[lo:hi]]]
        p = block.positions[np.arange(len(w)) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi]) + np.repeat(begin, n[lo:hi])]
        start = p - rarest[w]
        doc = np.searchsorted(block.first, p, side="right") - 1
        ok = (start >= block.first[doc]) & (start + q.length[alive[w]] <= block.first[doc + 1])
        cw, cs = w[ok], start[ok]
        for k in range(1, q.size):
            off = by_rarity[cw, k]
            at = cs + off
            ok = ~used[cw, off] | block.has(np.maximum(rank[cw, off], 0), at, at)
            cw, cs = cw[ok], cs[ok]
        yield alive[cw], cs, True
        if slop:
            for k in range(1, q.size):
                off = by_rarity[w, k]
                ok = ~used[w, off] | block.has(np.maximum(rank[w, off], 0), np.maximum(p - slop, block.first[doc]), np.minimum(p + slop, block.first[doc + 1] - 1))
                w, p, doc = w[ok], p[ok], doc[ok]
            yield alive[w], p, False


def search(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = 10, slop: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Search every window of ``size`` item words in every document.

    One row per document (see MATCHES): n_hit words lie inside an occurrence of
    a window; ``items`` have a window that occurs; ``spans`` are the merged hit
    word ranges; with ``slop`` > 0, ``near_items`` have a window whose words all
    lie within ``slop`` words of an occurrence of its rarest word, in any order.
    Item ids are compared as strings, nulls as "null"; items without a word have no window;
    repeated items are one. Without items, or without documents, nothing is hit.
    """
    items = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n_chunks = -(-total // chunk_bytes) or 1
    chunk = F.pmod(F.xxhash64("item", "text"), F.lit(n_chunks))
    if n_chunks == 1:
        return _search_chunk(index, items.collect(), size, slop).drop("block", "doc")  # at most chunk_bytes
    parts = []
    for c in range(n_chunks):
        rows = items.where(chunk == c).collect()  # about chunk_bytes
        hit = _search_chunk(index, rows, size, slop).where("n_hit > 0 or size(near_items) > 0").select("block", "doc", "items", "near_items", "spans")
        parts.append(settle(hit, "chunk-matches"))
    lists = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items", "spans")]
    merged = _merged(reduce(DataFrame.union, parts).groupBy("block", "doc").agg(*lists))
    docs = index.select("block", F.posexplode(F.arrays_zip("ids", "n_words")).alias("doc", "d")).select("block", "doc", F.col("d.ids").alias("id"), F.col("d.n_words").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    out = docs.join(merged, ["block", "doc"], "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"), "spans")


def _merged(found: DataFrame) -> DataFrame:
    """``found`` (block, doc, items, near_items, spans by start) with spans that meet or
    overlap made one."""
    names = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            ends = np.asarray(lists.offsets).astype(np.int64)
            own = lists.values.slice(ends[0], ends[-1] - ends[0])
            start, end = (np.asarray(own.field(k)) for k in (0, 1))
            row = np.repeat(np.arange(len(lists)), np.diff(ends))
            # rows lie one behind the other, so a running maximum never reaches into the next
            gap = int(end.max(initial=0)) + 1
            reach = np.maximum.accumulate(end + row * gap)
            opens = np.r_[True, start[1:] + row[1:] * gap > reach[:-1]] | np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
            first = np.flatnonzero(opens)
            last = np.r_[first[1:], len(row)] - 1 if len(first) else first
            values = pa.StructArray.from_arrays([pa.array(start[first]), pa.array((reach[last] - row[last] * gap).astype(np.int64))], ["start", "end"])
            offsets = np.searchsorted(row[first], np.arange(len(lists) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.ListArray.from_arrays(pa.array(offsets), values)], names)

    return map_arrow(found, run, found.schema)


def _search_chunk(index: DataFrame, rows: list, size: int, slop: int) -> DataFrame:
    """(see MATCHES) of one chunk of the benchmark: a task builds its queries once."""
    shared = index.sparkSession.sparkContext.broadcast(([r.item for r in rows], [r.text for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Queries(*shared.value, size)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, n_words = batch.column(1)[row].values, batch.column(2)[row].values.to_numpy()
                block = _Block(n_words, batch.column(3)[row].as_py(), batch.column(4)[row].as_py(), batch.column(5)[row].as_py())
                cover = np.zeros(block.n + 1, np.int64)
                found: dict[bool, list[set]] = {True: [set() for _ in n_words], False: [set() for _ in n_words]}
                for win, at, exact in _answers(block, held, slop):
                    if exact:
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + held.length[win], -1)
                    doc = np.searchsorted(block.first, at, side="right") - 1
                    for d, w in np.unique(np.c_[doc, win], axis=0).tolist():
                        found[exact][d].update(held.items[i] for i in held.owner[held.owner_at[w] : held.owner_at[w + 1]])
                hit = np.cumsum(cover)[:-1] > 0
                sums = np.concatenate([[0], np.cumsum(hit)])
                spans = [[] for _ in n_words]
                if hit.any():
                    opens = hit & ~np.r_[False, hit[:-1]]
                    opens[block.first[:-1][n_words > 0]] |= hit[block.first[:-1][n_words > 0]]
                    begin = np.flatnonzero(opens)
                    limit = np.r_[begin[1:], block.n]
                    for s, e in zip(begin.tolist(), limit.tolist(), strict=True):
                        d = int(np.searchsorted(block.first, s, side="right")) - 1
                        spans[d].append({"start": s - int(block.first[d]), "end": s - int(block.first[d]) + int(sums[e] - sums[s])})
                n = len(n_words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[row].as_py()] * n), pa.array(np.arange(n, dtype=np.int32)), ids, pa.array(n_words.astype(np.int64)), pa.array(sums[block.first[1:]] - sums[block.first[:-1]]),
                     *(pa.array([sorted(x) for x in found[k]], pa.list_(pa.string())) for k in (True, False)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    ["block", "doc", "id", "n_words", "n_hit", "items", "near_items", "spans"],
                )

    return map_arrow(index, run, MATCHES)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 10, slop: int = 0) -> DataFrame:
    """Build the stored index over ``docs`` and search ``benchmark`` in it: one
    row per row of ``docs``. Defined cases: null or wordless texts have no words
    and no hits; an item of fewer than ``size`` words is one window, an item
    without words none; repeated ids and rows are answered one by one; an empty
    table on either side gives no hits or no rows; other columns are ignored."""
    index = settle(build_index(docs, id_col, text_col), "positional-index")
    return search(index, benchmark, size=size, slop=slop).withColumnRenamed("id", id_col)


def items_digest(items: str) -> Column:
    return F.sha2(F.array_join(items, ","), 256)
