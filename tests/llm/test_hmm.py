"""The hidden Markov model against plain recursions and sums over all paths."""

import itertools
import math
import random
import zlib

import brute
import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import hmm as H
from tidemark.llm import queries as Q
from tidemark.llm import words as W


def random_model(symbols, states, seed):
    rng = np.random.default_rng(seed)
    emit, move, start = rng.random((symbols, states)) + 0.01, rng.random((states, states)), rng.random(states)
    return H.Model(np.zeros(0, np.uint64), np.full(symbols, 1 / symbols), 1, 1, 1, start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def plain_counts(seqs, m):
    """Posterior counts by summing over every path."""
    k = len(m.start)
    first, moves, by_symbol, likelihood = np.zeros(k), np.zeros((k, k)), np.zeros(m.emit.shape), []
    for o in seqs:
        paths = {}
        for path in itertools.product(range(k), repeat=len(o)):
            p = m.start[path[0]] * m.emit[o[0], path[0]]
            for t in range(1, len(o)):
                p *= m.move[path[t - 1], path[t]] * m.emit[o[t], path[t]]
            paths[path] = p
        total = sum(paths.values())
        likelihood.append(math.log(total))
        for path, p in paths.items():
            first[path[0]] += p / total
            for t, z in enumerate(path):
                by_symbol[o[t], z] += p / total
                if t:
                    moves[path[t - 1], z] += p / total
    return first, moves, by_symbol, likelihood


def test_recursions_against_all_paths():
    rng = random.Random(1)
    m = random_model(6, 3, 2)
    seqs = [[rng.randrange(6) for _ in range(rng.randrange(1, 8))] for _ in range(9)]
    count = np.array([len(s) for s in seqs])
    by, steps, place = H.in_step(count)
    o = np.empty(count.sum(), np.int32)
    o[place] = [x for s in seqs for x in s]
    first, moves, by_symbol, likelihood = plain_counts(seqs, m)
    got = H.expected(o, steps, m)
    assert all(np.allclose(a, b) for a, b in zip(got, (first, moves, by_symbol), strict=True))
    scale = np.log(H.forward(o, steps, m, False)[0])
    rank = np.concatenate([np.arange(b - a) for a, b in itertools.pairwise(steps)])
    assert np.allclose(np.bincount(rank, weights=scale), np.array(likelihood)[by])


def corpus(n, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        own = "der die das und" if i % 2 else "the of and it"
        out.append((i, " ".join(rng.choice(own.split() + [f"w{rng.randrange(40)}{own[:2]}"]) for _ in range(rng.randrange(0, 60)))))
    return out


def plain_base(rows, learn):
    counts, ends = {}, 0
    tokens = {i: brute.PLAIN.findall(brute.lower(t)) for i, t in rows}
    for i, w in tokens.items():
        if learn(i):
            ends += 1
            for x in w:
                counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    out = {}
    for i, w in tokens.items():
        c = [counts.get(x, 0) for x in w] + [ends]
        out[i] = (len(c), sum(x > 0 for x in c), n, sum(math.log10((x + 1) / (n + v + 1)) for x in c))
    return out


def test_training_raises_the_likelihood_and_follows_the_plain_recursion(spark):
    """All blocks together give the counts of one pass over all documents; a
    second split of the same rows gives the same model."""
    rows = corpus(160)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    models = []
    for parts in (1, 5):
        blocks = H.text_blocks(docs.repartition(parts, "doc_id"), "doc_id", "text", F.col("doc_id") % 7 != 2).cache()
        counts = H.word_counts(blocks).cache()
        models.append([H.train(blocks, counts, states=3, rounds=r) for r in range(4)])
        scored = [H.likelihoods(blocks, counts, m).where("learn").agg(F.sum("score")).first()[0] for m in models[-1]]
        # the prior of the emissions moves the optimum a little
        assert scored[1] > scored[0] and scored[2] > scored[1] and scored[3] > scored[2] - 5
    for a, b in zip(*models, strict=True):
        assert np.allclose(a.emit, b.emit, atol=1e-6) and np.allclose(a.move, b.move, atol=1e-6)
    m, after = models[0][0], models[0][1]
    assert np.allclose(m.mass.sum(), 1) and np.allclose(after.emit.sum(axis=0), 1) and np.allclose(after.move.sum(axis=1), 1)
    # one round by hand
    number = {int(h): k for k, h in enumerate(m.own)}
    seqs = []
    for block in W.blocks(__import__("pyarrow").array([t for i, t in rows if i % 7 != 2]), W.LOWER):
        kinds = H.endings(block)
        for a, b in itertools.pairwise(block.first):
            seqs.append([number.get(int(block.hash[x]), len(m.own) + int(kinds[x])) for x in range(a, b)] + [m.end])
    k = 3
    first, moves, by_symbol = np.zeros(k), np.zeros((k, k)), np.zeros(m.emit.shape)
    for o in seqs:
        alpha, beta = [m.start * m.emit[o[0]]], [np.ones(k)]
        for x in o[1:]:
            alpha.append(alpha[-1] @ m.move * m.emit[x])
        for x in o[:0:-1]:
            beta.append(m.move @ (m.emit[x] * beta[-1]))
        beta.reverse()
        total = alpha[-1].sum()
        first += alpha[0] * beta[0] / total
        for t, x in enumerate(o):
            by_symbol[x] += alpha[t] * beta[t] / total
            if t:
                moves += np.outer(alpha[t - 1], m.emit[x] * beta[t]) * m.move / total
    emit = by_symbol + H.PRIOR * m.mass[:, None]
    assert np.allclose(after.emit, emit / emit.sum(axis=0), atol=1e-6)
    assert np.allclose(after.move, (moves + 1) / (moves + 1).sum(axis=1, keepdims=True), atol=1e-5)
    assert np.allclose(after.start, (first + 1) / (first + 1).sum(), atol=1e-5)


def test_scores_are_a_distribution(spark):
    """One-word texts over everything that can be known, and the unknown: with the end they
    are part of all texts, so their probabilities add up to less than one, and all words in
    first place to one."""
    rows = corpus(120)
    blocks = H.text_blocks(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", F.lit(True)).cache()
    counts = H.word_counts(blocks).cache()
    m = H.train(blocks, counts, states=3, rounds=2)
    words = sorted({w for _, t in rows for w in t.split()}) + ["neverseen"]
    asked = H.text_blocks(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string"), "doc_id", "text", F.lit(False))
    p = sum(10**r.score for r in H.likelihoods(asked, counts, m).collect())
    end_after = m.move @ m.emit[m.end]
    first = m.emit[: m.end].sum(axis=0) + m.emit[m.unknown]
    assert abs(p - (m.start * first) @ end_after) < 1e-9 and abs(first + m.emit[m.end] - 1).max() < 1e-9


def test_defined_cases(spark):
    rows = [(1, None, True), (2, "", True), (3, " \t", False), (None, "a B a", True), (5, "a b c", None), (5, "a b c", None), (6, "long words " * 30000, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").withColumn("words", F.lit(1))
    got = [r for r in H.score_documents(docs, F.col("learn")).collect()]
    assert len(got) == len(rows)
    n, v = 3 + 60000 + 4, 5
    known = {r.doc_id: (r.learn, r.n_tokens, r.n_known, r.train_tokens) for r in got}
    assert known == {1: (True, 1, 1, n), 2: (True, 1, 1, n), 3: (False, 1, 1, n), None: (True, 4, 4, n), 5: (False, 4, 3, n), 6: (True, 60001, 60001, n)}
    base = {r.doc_id: r.base_score for r in got}
    assert abs(base[5] - sum(math.log10((c + 1) / (n + v + 1)) for c in (2, 1, 0, 4))) < 1e-9
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    none = H.score_documents(docs, F.lit(None).cast("boolean")).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, abs(r.score) < 1e-6) for r in none} == {(0, 0, 0.0, True)}
    assert H.score_documents(docs.limit(0), F.col("learn")).count() == 0


def test_op12(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = plain_base(rows, lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    got = Q.op12_hidden_markov_scores(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        tokens, known, n, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2, tokens, known, n)
        assert abs(r.base_score - base) < 1e-9 * abs(base)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
