"""Hidden Markov language model: Baum-Welch over partitions, exact likelihoods by the
scaled forward recursion.

A document is its words and one end token. A token depends on a hidden state that moves
along a chain. A state emits symbols: every word that makes up at least SHARE of the
training tokens (and LEAST of them) is a symbol of its own, of which there are at most
1 / SHARE however large the corpus is; all other words fall into KINDS classes by their last
letters; unknown words are one symbol, the end another. A word of a class is as likely
within it as its count among all training tokens says. So the counts grow with the corpus,
while transitions and emissions are a table of proven size (1 / SHARE + KINDS rows of STATES
numbers, 32 MB at most) that can be broadcast and summed on the driver.

1. Texts are cut into words once: a row a block of documents, with the block's different
   words and its documents as numbers of them. Counts by word are one aggregation.
2. Each round of Baum-Welch maps the blocks: forward and backward recursion of all
   training documents of a block in step, longest first. Expected counts are added up by
   task, then by symbol, as whole multiples of 2^-20, in which the order does not matter.
3. For scoring, blocks meet the counts of their different words (by word, then by block)
   and the forward recursion is run over every whole document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.scratch import map_arrow, settle

STATES, ROUNDS = 8, 3
SHARE, LEAST, KINDS = 2e-6, 8, 512
#: Tokens of the smoothed word frequencies that each state counts as seen, and moves
#: between each two states.
PRIOR, MOVES = 1000.0, 1.0
STICKY, NOISE, FIXED = 0.98, 0.3, float(1 << 20)
BLOCK_TOKENS = 2_000_000


def text_blocks(docs: DataFrame, id_col: str, text_col: str, train: Column) -> DataFrame:
    """A row for about BLOCK_TOKENS words of whole documents: ids, learn (whether the
    document is learnt from), count (its words), tokens (their places in the block's
    words, 4 bytes each), and the block's different words with class and training count."""
    raw = docs.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("learn"), F.col(text_col).cast("string").alias("text"))
    id_type = raw.schema["id"].dataType.simpleString()

    def packed(parts: list, number: int) -> pa.RecordBatch:
        ids = pa.concat_arrays([p[0] for p in parts])
        learn = pa.concat_arrays([p[1] for p in parts])
        count, hashes, kinds = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))
        words, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        often = np.bincount(which, minlength=len(words))
        by = np.argsort(-often, kind="stable")  # small numbers for frequent words
        place = np.empty(len(by), np.int32)
        place[by] = np.arange(len(by), dtype=np.int32)
        seen = np.repeat(learn.to_numpy(zero_copy_only=False), count)
        n = np.bincount(which[seen], minlength=len(words))[by]
        lists = [ids, learn, pa.array(count.astype(np.int32)), pa.array(W.signed(words[by])), pa.array(kinds[one][by].astype(np.int32)), pa.array(n.astype(np.int64))]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
        key = (TaskContext.get().partitionId() << 32) + number
        tokens = pa.array([place[which].tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([key]), *lists[:3], tokens, *lists[3:]], ["block", "ids", "learn", "count", "tokens", "words", "kinds", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, number = [], 0, 0
        for batch in batches:
            for b in W.blocks(batch.column(2), W.LOWER):
                own = slice(b.at, b.at + b.n)
                parts.append((batch.column(0)[own], batch.column(1)[own], b.count, b.hash, endings(b)))
                size += len(b.hash)
                if size >= BLOCK_TOKENS:
                    yield packed(parts, number)
                    parts, size, number = [], 0, number + 1
        if parts:
            yield packed(parts, number)

    schema = f"block long, ids array<{id_type}>, learn array<boolean>, count array<int>, tokens binary, words array<long>, kinds array<int>, n array<long>"
    return map_arrow(raw, run, schema)


def endings(b: W.Block) -> np.ndarray:
    """Class of each word by its last three bytes."""
    out = np.zeros(len(b.start), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, 4):
            at = b.end - k
            letter = np.where(at >= b.start, W.LOWER[1][b.data[np.maximum(at, 0)]], 0)
            out = out * np.uint64(257) + letter.astype(np.uint64)
    return (W.mix(out) % np.uint64(KINDS)).astype(np.int16)


@dataclass
class Model:
    """``own``: fingerprints of the words that are symbols 0.. (sorted); then KINDS classes,
    the end, unknown. ``mass``: smoothed frequency of each symbol. ``tokens``, ``types`` and
    ``ends``: training tokens, different ones, and documents."""

    own: np.ndarray
    mass: np.ndarray
    tokens: int
    types: int
    ends: int
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @property
    def end(self) -> int:
        """Symbol of the end token, which is unknown when nothing was learnt from."""
        return len(self.own) + KINDS + (0 if self.ends else 1)

    @property
    def unknown(self) -> int:
        return len(self.own) + KINDS + 1

    def symbols(self, words: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Symbol of each word that is known."""
        if not len(self.own):
            return len(self.own) + kinds
        at = np.minimum(np.searchsorted(self.own, words), len(self.own) - 1)
        return np.where(self.own[at] == words, at, len(self.own) + kinds)


def first_model(own: np.ndarray, own_n: np.ndarray, class_n: np.ndarray, class_types: np.ndarray, ends: int, states: int = STATES) -> Model:
    """Before the first round: every state emits nearly the smoothed frequencies."""
    tokens = int(own_n.sum() + class_n.sum()) + ends
    types = len(own) + int(class_types.sum()) + (ends > 0)
    mass = np.r_[own_n + 1, class_n + class_types, ends + 1 if ends else 0, 1].astype(float) / (tokens + types + 1)
    keys = np.r_[own.astype(np.uint64), np.arange(KINDS + 2, dtype=np.uint64)]
    with np.errstate(over="ignore"):
        noise = np.stack([W.mix(keys * W.GRAM[0, 40] + W.GRAM[0, 41 + z % 20] * np.uint64(z + 1)) for z in range(states)], axis=1)
    emit = mass[:, None] * np.exp(NOISE * np.sqrt(12) * (noise / 2.0**64 - 0.5))
    move = np.full((states, states), (1 - STICKY) / states) + STICKY * np.eye(states)
    return Model(own, mass, tokens, types, ends, np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def in_step(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents of ``count`` tokens, longest first, token by token: the order of the
    documents, where each step begins, and the place of each token of the given order."""
    by = np.argsort(-count, kind="stable")
    alive = np.searchsorted(-count[by], -np.arange(1, int(count.max(initial=0)) + 1), side="right")
    steps = np.r_[0, np.cumsum(alive)]
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return by, steps, steps[at] + np.repeat(rank, count)


def forward(o: np.ndarray, steps: np.ndarray, m: Model, keep: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Scales of all tokens, in step, whose logarithms add up to the likelihood; the state
    probabilities of each token too, if wanted."""
    scale = np.empty(len(o))
    alpha = np.empty((len(o), len(m.start))) if keep else None
    bounds, last = steps.tolist(), None
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        x = m.emit.take(o[a:b], axis=0)
        x *= m.start if last is None else last[: b - a] @ m.move
        s = np.add.reduce(x, axis=1)
        x /= s[:, None]
        scale[a:b], last = s, x
        if keep:
            alpha[a:b] = x
    return scale, alpha


def expected(o: np.ndarray, steps: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of first states, moves, and states by symbol."""
    k = len(m.start)
    moves, first = np.zeros((k, k)), np.zeros(k)
    if not len(o):
        return first, moves, np.zeros((len(m.mass), k))
    scale, alpha = forward(o, steps, m, True)
    bounds = steps.tolist()
    beta = np.ones((bounds[1], k))
    back = np.ascontiguousarray(m.move.T)
    for t in range(len(bounds) - 2, 0, -1):
        a, b = bounds[t], bounds[t + 1]
        n, before = b - a, bounds[t - 1]
        w = m.emit.take(o[a:b], axis=0)
        w *= beta[:n]
        w /= scale[a:b, None]
        moves += alpha[before : before + n].T @ w
        alpha[a:b] *= beta[:n]
        beta[:n] = w @ back
    alpha[: bounds[1]] *= beta
    first += alpha[: bounds[1]].sum(axis=0)
    by_symbol = np.stack([np.bincount(o, weights=alpha[:, z], minlength=len(m.mass)) for z in range(k)], axis=1)
    return first, moves * m.move, by_symbol


def block_symbols(row: dict, m: Model, local: np.ndarray, learnt: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of a block's documents with their ends, in step; steps; the documents' order.
    ``learnt``: only the documents that are learnt from."""
    count = row["count"].astype(np.int64)
    tokens = np.frombuffer(row["tokens"], np.int32)
    if learnt:
        tokens = tokens[np.repeat(row["learn"], count)]
        count = count[row["learn"]]
    by, steps, place = in_step(count + 1)
    o = np.full(len(place), m.end, np.int32)
    ends = np.cumsum(count + 1) - 1
    inner = np.ones(len(place), bool)
    inner[ends] = False
    o[place[inner]] = local[tokens]
    return o, steps, by


def rows_of(batch: pa.RecordBatch | pa.Table, names: list[str]) -> Iterator[dict]:
    for r in range(batch.num_rows):
        row = {}
        for name in names:
            x = batch.column(name)[r]
            row[name] = x.as_buffer() if name == "tokens" else x if name == "ids" else x.values.to_numpy(zero_copy_only=False)
        yield row


def baum_welch(blocks: DataFrame, model: Model) -> Model:
    """One round over all training documents."""
    spark, states = blocks.sparkSession, len(model.start)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        total = None
        for batch in batches:
            for row in rows_of(batch, ["learn", "count", "tokens", "words", "kinds"]):
                local = m.symbols(row["words"].view(np.uint64), row["kinds"])
                first, moves, by_symbol = expected(*block_symbols(row, m, local, True)[:2], m)
                own = np.concatenate([by_symbol, first[None], moves])
                total = own if total is None else total + own
        if total is not None:
            some = np.flatnonzero(total.any(axis=1))
            whole = np.rint(total[some] * FIXED).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(np.ascontiguousarray(whole[:, z])) for z in range(states)]], ["symbol", *[f"z{z}" for z in range(states)]])

    read = blocks.select("learn", "count", "tokens", "words", "kinds")
    sums = map_arrow(read, run, "symbol long, " + ", ".join(f"z{z} long" for z in range(states))).groupBy("symbol").agg(*[F.sum(f"z{z}").alias(f"z{z}") for z in range(states)])
    got = sums.toArrow()
    sent.destroy()
    counts = np.zeros((len(model.mass) + 1 + states, states))
    counts[got["symbol"].to_numpy()] = np.stack([got[f"z{z}"].to_numpy() for z in range(states)], axis=1) / FIXED if got.num_rows else 0
    by_symbol, first, moves = counts[: len(model.mass)], counts[len(model.mass)], counts[len(model.mass) + 1 :]
    emit = by_symbol + PRIOR * model.mass[:, None]
    move = moves + MOVES
    start = first + MOVES
    return Model(model.own, model.mass, model.tokens, model.types, model.ends, start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def word_counts(blocks: DataFrame) -> DataFrame:
    """word, kind, c: training occurrences of all words that have any."""
    own = blocks.select(F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("kinds").alias("kind"), F.col("n").alias("n")))).where("n > 0")
    return own.groupBy("word").agg(F.min("kind").alias("kind"), F.sum("n").alias("c"))


def train(blocks: DataFrame, counts: DataFrame, states: int = STATES, rounds: int = ROUNDS, share: float = SHARE) -> Model:
    """Fit the model to the blocks' training documents; ``counts``: their ``word_counts``."""
    ends = blocks.agg(F.sum(F.size(F.filter("learn", lambda x: x)))).first()[0] or 0
    words = counts.agg(F.sum("c")).first()[0] or 0
    least = max(LEAST, share * (words + ends))
    own = counts.where(F.col("c") >= least).select("word", "c").toArrow()  # at most 1 / share rows
    keys, n = own["word"].to_numpy().view(np.uint64), own["c"].to_numpy()
    by = np.argsort(keys)
    rest = counts.where(F.col("c") < least).groupBy("kind").agg(F.sum("c").alias("c"), F.count("*").alias("types")).toArrow()
    class_n, class_types = np.zeros(KINDS, np.int64), np.zeros(KINDS, np.int64)
    class_n[rest["kind"].to_numpy()], class_types[rest["kind"].to_numpy()] = rest["c"].to_numpy(), rest["types"].to_numpy()
    model = first_model(keys[by], n[by], class_n, class_types, int(ends), states)
    for _ in range(rounds if ends else 0):
        model = baum_welch(blocks, model)
    return model


def likelihoods(blocks: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """id, learn, n_tokens, n_known, base_score, score of every document of the blocks."""
    spark = blocks.sparkSession
    sent = spark.sparkContext.broadcast(model)
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()
    names = ["id", "learn", "n_tokens", "n_known", "base_score", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        m: Model = sent.value
        out = []
        place, c = right["at"].to_numpy(), right["c"].to_numpy()
        for row in rows_of(left.combine_chunks(), ["ids", "learn", "count", "tokens", "local"]):
            n = np.zeros(len(row["local"]), np.int64)
            n[place] = c
            smooth = (n + 1) / (m.tokens + m.types + 1)
            local = np.where(n > 0, row["local"], m.unknown)
            within = np.log10(smooth / m.mass[local])
            within[local < len(m.own)] = 0
            within[local == m.unknown] = 0
            o, steps, by = block_symbols(row, m, local, False)
            scale = np.log10(forward(o, steps, m, False)[0])
            docs = len(by)
            rank = np.arange(len(o)) - np.repeat(steps[:-1], np.diff(steps))
            chain = np.empty(docs)
            chain[by] = np.bincount(rank, weights=scale, minlength=docs)
            count = row["count"].astype(np.int64)
            of, tokens = np.repeat(np.arange(docs), count), np.frombuffer(row["tokens"], np.int32)
            base = np.bincount(of, weights=np.log10(smooth)[tokens], minlength=docs) + np.log10((m.ends + 1) / (m.tokens + m.types + 1))
            known = np.bincount(of[n[tokens] > 0], minlength=docs) + (m.ends > 0)
            score = chain + np.bincount(of, weights=within[tokens], minlength=docs)
            out.append(pa.table([row["ids"].values, pa.array(row["learn"]), pa.array(count + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], names=names))
        return pa.concat_tables(out) if out else pa.table({"id": left["ids"].combine_chunks().flatten()[:0], "learn": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The symbols of a block's words take the words' place before the shuffle."""
        m: Model = sent.value
        for batch in batches:
            own = [m.symbols(row["words"].view(np.uint64), row["kinds"]).astype(np.int32) for row in rows_of(batch, ["words", "kinds"])]
            ends = np.r_[0, np.cumsum([len(x) for x in own])]
            local = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(own)))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in slim], local], [*slim, "local"])

    slim = ["block", "ids", "learn", "count", "tokens"]
    asked = blocks.select(F.col("block").alias("of"), F.posexplode("words").alias("at", "word"))
    known = asked.join(counts.select("word", "c"), "word").select("of", "at", "c")
    read = map_arrow(blocks.select(*slim, "words", "kinds"), symbols, f"block long, ids array<{id_type}>, learn array<boolean>, count array<int>, tokens binary, local array<int>")
    return read.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(run, f"id {id_type}, learn boolean, n_tokens long, n_known long, base_score double, score double")


def score_documents(docs: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: id_col, learn, n_tokens, n_known, train_tokens,
    base_score, score. The model is fitted to the rows where ``train_on`` holds and scores
    all of them, whole.

    Tokens are words between ASCII white space, A-Z lower-cased, and one end. base_score adds
    up log10((c + 1) / (N + V + 1)) over tokens: c a token's training count, N all, V different ones;
    score is the model's log10 probability of the text. n_known: tokens with c > 0. Defined cases:
    null, empty and blank texts are an end alone; where ``train_on`` is null the row is not
    learnt from; without any row to learn from every token is unknown and every score 0; a
    repeated row is learnt from and scored again; null ids stay null; very long texts are
    scored whole, in memory of the longest; an empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    blocks = settle(text_blocks(docs, id_col, text_col, train_on), "blocks")
    counts = settle(word_counts(blocks), "counts")
    model = train(blocks, counts, states, rounds)
    found = likelihoods(blocks, counts, model)
    return found.select(F.col("id").alias(id_col), "learn", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
