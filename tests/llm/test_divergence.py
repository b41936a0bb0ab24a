"""Divergence of sources against sums over every term."""

import random
import re

import brute
import pytest

from tidemark.llm.divergence import probability, source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least_docs=30, top=50):
    rows = [[x or "" for x in r] for r in rows]
    counts, df, groups = {}, {}, {}
    for lang, source, text in rows:
        groups.setdefault(lang, set()).add(source)
        found = TERM.findall(brute.lower(text))
        for t in found:
            counts[lang, source, t] = counts.get((lang, source, t), 0) + 1
        for t in set(found):
            df[lang, t] = df.get((lang, t), 0) + 1
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for (own, t), n in df.items() if own == lang and n >= least_docs)
        n = {s: {t: counts.get((lang, s, t), 0) for t in kept} for s in sources}
        n[None] = {t: sum(n[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (x + 5) // (sum(own.values()) + 5 * len(kept)) for t, x in own.items()} for s, own in n.items()}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - p[None][t], t) for t in kept if n[s][t] and p[s][t] > p[None][t]]
            for part, own, most in (("pair", pairs, None), ("term", terms, top)):
                own.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(own[:most])]
    return sorted(out)


def got(spark, rows, **how):
    docs = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 as term", "2 as value", "3 as p")
    return sorted(tuple(r) for r in source_divergence(docs, **how).collect())


@pytest.mark.parametrize("sources, tile, terms", [(14, 4, 5), (40, 256, 4096)])
def test_heavy_and_light_terms(spark, sources, tile, terms):
    """Terms of one, few and most sources, sources of very different size, several tiles."""
    rng = random.Random(sources)
    letters = "abcdefghij"
    rows = []
    for k in range(360):
        s = 0 if rng.random() < 0.35 else rng.randrange(sources)
        own = [f"common{c}" for c in letters if rng.random() < 0.6] + [f"own{letters[s % 10]}{letters[s // 10]}"] * rng.randrange(4) + [f"É{letters[(s + k) % 3]}Z{s % 3 * 'x'}"]
        rows.append((rng.choice(["en", "de"]), f"s{s}", " ".join(own * rng.randrange(1, 4)) + "."))
    assert got(spark, rows, least_docs=6, top=5, tile=tile, terms=terms) == plain(rows, 6, 5)


def test_defined_cases(spark):
    rows = [(None, None, None), ("", "a", "x x"), ("en", "a", "Word word, w0rd"), ("en", "b", "word"), ("en", "b", "word"), ("en", "c", ""), ("fr", "a", "seul"), ("de", "a", "x"), ("de", "b", "y")]
    rows.append(("en", "a", "long " * 30000))
    for least in (1, 2, 30):
        assert got(spark, rows, least_docs=least) == plain(rows, least)
    assert got(spark, rows[:0]) == []


def test_probability_of_large_counts(spark):
    cases = [(0, 5), (10**12, 3 * 10**12 + 7), (8 * 10**14, 9 * 10**14 + 11), (10**15 - 3, 10**15 + 2), (17, 10**15)]
    rows = spark.createDataFrame(cases, "n long, total long")
    assert [r.p for r in rows.select(probability(rows.n, rows.total).alias("p")).collect()] == [1 + 10**9 * (n + 5) // t for n, t in cases]


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "source", "text").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(tuple(r) for r in source_divergence(docs, least_docs=5).collect()) == plain(rows, 5)
