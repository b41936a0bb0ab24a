"""Periodic runs against a plain search of every period, and the query over its whole table."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest

from tidemark.llm import queries as Q
from tidemark.llm.periodic import Suffixes, find_runs, periodic_runs, previous_factors


def plain_runs(w, exponent=4, least=6):
    """(start, end, period) by start, then period: every period, every stretch."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            at = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - at >= max(least, exponent * q) and i > at:
                found.setdefault((at, i + q), q)
            i = max(i, at + 1)
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def texts(rng):
    """Few different words, planted periods, copied pieces."""
    n = rng.choice([0, 1, 5, 8, 20, 60, 150])
    w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(n)]
    for _ in range(rng.randrange(4) if n else 0):
        a, p = rng.randrange(n), rng.randrange(1, 8)
        for i in range(a, min(n, a + rng.randrange(60))):
            w[i] = w[a + (i - a) % p]
        a, b = rng.randrange(n), rng.randrange(n)
        piece = w[a : a + rng.randrange(n + 1)]
        w[b : b + len(piece)] = piece
    return w


@pytest.mark.parametrize("exponent, least", [(4, 6), (2, 2), (3, 6)])
def test_runs(exponent, least):
    rng = random.Random(exponent)
    for _ in range(120):
        docs = [texts(rng) for _ in range(rng.randrange(1, 9))]
        first = np.r_[0, np.cumsum([len(d) for d in docs])]
        got = find_runs(np.array([x for d in docs for x in d], np.uint64), first, exponent, least)
        for d, own, at in zip(docs, got, first, strict=False):
            assert [(s - at, e - at, q) for s, e, q in own] == plain_runs(d, exponent, least)


def test_longest_previous_factors():
    rng = random.Random(7)
    for _ in range(60):
        w = texts(rng)
        s = Suffixes(np.array(w, np.uint64), np.array([0, len(w)]))
        length, source = previous_factors(s)
        for i in range(len(w)):
            best = 0
            for j in range(i):
                m = 0
                while i + m < len(w) and w[i + m] == w[j + m]:
                    m += 1
                best = max(best, m)
            assert length[i] == best
            if best:
                p = source[i]
                assert p < i and w[p : p + best] == w[i : i + best]
            else:
                assert source[i] == -1


def test_a_text_without_long_runs_and_a_very_long_one():
    thue = [bin(i).count("1") % 2 for i in range(1 << 14)]  # holds no word three times in a row
    rng = random.Random(3)
    long = [rng.randrange(50) for _ in range(5000)] + [1, 2, 3] * 40_000
    first = np.array([0, len(thue), len(thue) + len(long)])
    got = find_runs(np.array(thue + long, np.uint64), first)
    assert got[0] == []
    (start, end, period), *rest = [r for r in got[1] if r[1] - r[0] > 100]
    assert not rest and period == 3 and end == first[2] and abs(start - first[0] - len(thue) - 5000) < 3


def test_defined_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, " \t\n", "x"), (4, "a b " * 5, "y"), (4, "a b " * 5, "y"), (5, "é é é é é é z", "y"), (6, "A a A a A a A a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect())
    assert got == [
        (0, 0, [], ""), (1, 0, [], ""), (2, 0, [], ""), (4, 10, [(0, 10, 2)], "a b"), (4, 10, [(0, 10, 2)], "a b"),
        (5, 7, [(0, 6, 1)], "é z"), (6, 8, [(0, 8, 2)], "A a"),
    ]
    assert periodic_runs(docs.limit(0)).count() == 0


def planted(doc_id, text):
    w = brute.PLAIN.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_op13(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w = planted(r.doc_id, r.text)
        runs = plain_runs(w)
        gone = {i for s, e, q in runs for i in range(s + q, e)}
        best = max(runs, key=lambda x: ((x[1] - x[0]) / x[2], -x[0], -x[2]), default=None)
        top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[r.doc_id] = (len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in Q.op13_periodic_runs(spark, sf).collect()}
    assert got == want and sum(x[0] > 0 for x in want.values()) > 15
