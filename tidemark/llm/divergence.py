"""How far the sources of a language differ in their words: exact distances between all
pairs of sources, and the words that stand out in each.

Every kept term gets in every source the probability p = 1 + floor(SCALE * (count + ADD) /
(N + ADD * V)), a whole number, so sums come out the same in any order. Two sources differ by
the sum of abs(p - q) over all V kept terms, most of which neither source holds. Heavy and
light terms are added up separately:

- A term that more than max(8, sqrt(G)) of the language's G sources hold is heavy. Heavy
  terms fill numpy tiles of terms by sources, and each tile of two source blocks adds up
  its own differences.
- A light term stands in few sources. As a start, all light terms count as held by neither
  source: V_light * abs(p0_a - p0_b), p0 being the p of count 0. Terms of one source correct
  that by a sum over its own values of p (how often each occurs is all that is needed), and
  terms of both by one correction for each pair in the term's posting list: at most
  max(28, G / 2) of them, so no term costs more than a row of a tile.

Both partial sums are added by pair. Only counts by language, source and term are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.scratch import map_arrow, settle, ship_code

SCALE, ADD = 10**9, 5
#: Sources along one side of a tile, and terms along the other.
TILE, TERMS = 256, 512
BLOCK = 1 << 22

_letter = np.zeros(256, bool)
_letter[0x41:0x5B] = _letter[0x61:0x7B] = _letter[0x80:] = True
#: Terms: runs of a-z (after lower-casing A-Z) and non-ASCII characters.
LETTERS = (_letter, W.LOWER[1])


def folded(block: W.Block, which: np.ndarray) -> pa.Array:
    """The words ``which`` of a block, lower-cased."""
    begin, size = block.start[which], (block.end - block.start)[which]
    ends = np.r_[0, np.cumsum(size)]
    at = np.arange(int(ends[-1])) + np.repeat(begin - ends[:-1], size)
    data = LETTERS[1][block.data[at]]
    return pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), df (rows that hold it), from columns lang, source
    and text; added up by block before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sources = (batch.column(i).dictionary_encode() for i in (0, 1))
            group = np.asarray(langs.indices).astype(np.uint64) * np.uint64(len(sources.dictionary)) + np.asarray(sources.indices).astype(np.uint64)
            for block in W.blocks(batch.column(2), LETTERS, BLOCK):
                text = block.text_of()
                with np.errstate(over="ignore"):
                    own = W.mix(block.hash ^ W.mix(text.astype(np.uint64) * W.GRAM[0, 30] + W.GRAM[0, 31]))
                _, at, times = np.unique(own, return_index=True, return_counts=True)
                of = group[block.at + text[at]]
                with np.errstate(over="ignore"):
                    shared = W.mix(block.hash[at] ^ W.mix(of * W.GRAM[0, 32] + W.GRAM[0, 33]))
                _, one, which, df = np.unique(shared, return_index=True, return_inverse=True, return_counts=True)
                n = np.bincount(which, weights=times, minlength=len(one)).astype(np.int64)
                row = pa.array(block.at + text[at[one]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), folded(block, at[one]), pa.array(n), pa.array(df.astype(np.int64))], ["lang", "source", "term", "n", "df"]
                )

    found = map_arrow(docs.select("lang", "source", "text"), run, "lang string, source string, term string, n long, df long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def probability(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + ADD) / total) by long division, three digits at a time, so
    that no step leaves the range of a long. ``total`` is at least count + ADD."""
    rest, out, total = count + ADD, F.lit(0).cast("long"), F.greatest(total, F.lit(1))
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + F.call_function("div", rest, total)
        rest = rest % total
    return out + 1


def _abs_sums(values: np.ndarray, times: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of times * abs(values - x) for each x of ``at``."""
    by = np.argsort(values)
    values, times = values[by], times[by]
    n, s = np.r_[0, np.cumsum(times)], np.r_[0, np.cumsum(times * values)]
    below = np.searchsorted(values, at)
    return at * n[below] - s[below] + (s[-1] - s[below]) - at * (n[-1] - n[below])


def _tile(table: pa.Table) -> pa.Table:
    """One tile: rows of sources (no term) and of heavy terms. Sums by pair (a < b)."""
    col = {c: table[c] for c in table.column_names}
    gid, p, tb, i, j = (col[c].to_numpy() for c in ("gid", "p", "tb", "i", "j"))
    is_term = np.asarray(col["term"].is_valid())
    heads = np.flatnonzero(~is_term)
    heads = heads[np.argsort(gid[heads])]
    ids, p0 = gid[heads], p[heads]
    terms = col["term"].filter(pa.array(is_term)).combine_chunks().dictionary_encode()
    dense = np.tile(p0, (len(terms.dictionary), 1))
    dense[np.asarray(terms.indices), np.searchsorted(ids, gid[is_term])] = p[is_term]
    block = col["block"].to_numpy()[heads]
    left, right = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
    # the tile of the first terms also adds what is known by source: all light terms
    light = tb[0] == 0
    values, times, own = [], [], np.zeros(len(ids), np.int64)
    if light:
        n_light = int(col["n_light"].to_numpy()[heads[0]])
        for k, r in enumerate(heads):
            x = col["light"][int(r)].as_py() or []
            values.append(np.array([v["p"] for v in x], np.int64))
            times.append(np.array([v["times"] for v in x], np.int64))
            own[k] = times[-1].sum()
        crossed = np.stack([_abs_sums(v, t, p0) for v, t in zip(values, times, strict=True)])
    out_a, out_b, out_v = [], [], []
    for a in left:
        others = right[ids[right] > ids[a]] if i[0] == j[0] else right
        total = np.abs(dense[:, others] - dense[:, [a]]).sum(axis=0)
        if light:
            total = total + (n_light - own[a] - own[others]) * np.abs(p0[others] - p0[a]) + crossed[a, others] + crossed[others, a]
        out_a.append(np.full(len(others), ids[a]))
        out_b.append(ids[others])
        out_v.append(total)
    none = [np.zeros(0, np.int64)]
    a, b, v = (np.concatenate(x + none).astype(np.int64) for x in (out_a, out_b, out_v))
    return pa.table([pa.array([col["lang"][0].as_py()] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(v)], names=["lang", "a", "b", "value"])


def light_pairs(postings: DataFrame) -> DataFrame:
    """Corrections for light terms that two sources hold: one for each pair of a posting
    list, added up by pair within a batch. ``postings``: lang and own, the term's list of
    (gid, p, p0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            lists = batch.column(1)
            ends = np.asarray(lists.offsets)
            own = lists.values.slice(ends[0], ends[-1] - ends[0])
            gid, p, p0 = (np.asarray(own.field(k)) for k in range(3))
            row = np.repeat(np.arange(len(lists)), np.diff(ends))
            lang = np.asarray(langs.indices)[row]
            by = np.lexsort((gid, row))
            gid, p, p0 = gid[by], p[by], p0[by]
            a, b, v, of = [], [], [], []
            for d in range(1, int(np.diff(ends).max(initial=0))):
                k = np.flatnonzero(row[d:] == row[:-d])
                x, y = k, k + d
                v.append(np.abs(p[x] - p[y]) - np.abs(p[x] - p0[y]) - np.abs(p0[x] - p[y]) + np.abs(p0[x] - p0[y]))
                a.append(gid[x])
                b.append(gid[y])
                of.append(lang[x])
            if not a:
                continue
            a, b, v, of = (np.concatenate(x) for x in (a, b, v, of))
            by = np.lexsort((b, a, of))
            a, b, v, of = a[by], b[by], v[by], of[by]
            new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (of[1:] != of[:-1])]) if len(a) else np.zeros(0, np.int64)
            total = np.add.reduceat(v, new) if len(new) else v
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(of[new])), pa.array(a[new]), pa.array(b[new]), pa.array(total)], ["lang", "a", "b", "value"])

    return map_arrow(postings.select("lang", "own"), run, "lang string, a long, b long, value long")


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 30, top: int = 50, tile: int = TILE, terms: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: every other source of the
    language with its distance, all ranks. Part ``term``: kept terms that the source holds
    and that are likelier in it than in the language as a whole, by difference, ranks to ``top``.
    Ranks run from 1, by value descending, then item.

    A language keeps the terms that at least ``least_docs`` of its rows hold. Defined cases:
    null lang, source and text count as ''; texts without terms make no counts, but their
    source has its pairs; a language that keeps no term has distance 0 everywhere, one with
    a single source has no pairs; a repeated row counts again; very long texts count whole;
    ties in value go by item in UTF-8 order; an empty table gives an empty result; other
    columns are ignored, whatever their names. The result holds all pairs of sources of a language, so
    sources are taken to be few enough for that; their rows (one a source) are numbered in
    one task a language.
    """
    raw = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = settle(term_counts(raw), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("lang_n"), F.count("*").alias("held")).where(F.col("df") >= least_docs)
    kept = settle(kept.drop("df"), "terms")
    post = settle(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "postings")

    # one row a source: number within its language, total, p of count 0, and its language's figures
    every = raw.select("lang", "source").distinct().join(post.groupBy("lang", "source").agg(F.sum("n").alias("n_all")), ["lang", "source"], "left")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    every = every.select("lang", "source", F.coalesce("n_all", F.lit(0)).alias("n_all"), number.cast("long").alias("gid"))
    sizes = every.groupBy("lang").agg(F.count("*").alias("g"), F.sum("n_all").alias("lang_all"))
    sizes = sizes.withColumn("limit", F.greatest(F.lit(8), F.ceil(F.sqrt("g")))).withColumn("blocks", F.ceil(F.col("g") / tile).cast("long"))
    # terms are counted by how many sources hold them before they meet their language's row
    spread = kept.groupBy("lang", "held").agg(F.count("*").alias("m"))
    of_terms = spread.join(sizes.select("lang", "limit"), "lang").groupBy("lang").agg(F.sum("m").alias("v"), F.sum(F.when(F.col("held") <= F.col("limit"), F.col("m")).otherwise(0)).alias("n_light"))
    sizes = sizes.join(of_terms, "lang", "left").fillna(0, ["v", "n_light"])
    sizes = sizes.withColumn("term_blocks", F.greatest(F.lit(1), F.ceil((F.col("v") - F.col("n_light")) / terms)).cast("long"))
    groups = every.join(sizes, "lang").withColumn("total", F.col("n_all") + ADD * F.col("v"))
    groups = settle(groups.withColumn("p0", probability(F.lit(0), F.col("total"))), "sources")

    told = groups.select("lang", "source", "gid", "p0", "total", "limit", "lang_all", "v", "blocks", "term_blocks")
    post = post.join(told, ["lang", "source"]).withColumn("p", probability(F.col("n"), F.col("total")))
    light = post.where(F.col("held") <= F.col("limit"))
    heavy = post.where(F.col("held") > F.col("limit"))

    # tiles: sources, each with what it knows about light terms, and heavy terms
    spectrum = light.groupBy("lang", "gid", "p").agg(F.count("*").alias("times")).groupBy("lang", "gid").agg(F.collect_list(F.struct("p", "times")).alias("light"))
    block = F.floor(F.col("gid") / tile)
    heads = groups.join(spectrum, ["lang", "gid"], "left").select(
        "lang", "gid", F.col("p0").alias("p"), F.lit(None).cast("string").alias("term"), "n_light", "light", "blocks", block.alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("term_blocks") - 1)).alias("tb"))
    heads = heads.withColumn("light", F.when(F.col("tb") == 0, F.col("light")))
    cells = heavy.select(
        "lang", "gid", "p", "term", F.lit(0).cast("long").alias("n_light"), F.lit(None).cast(heads.schema["light"].dataType).alias("light"), "blocks", block.alias("block"),
        F.pmod(F.xxhash64("term"), F.col("term_blocks")).alias("tb"))
    tiles = heads.unionByName(cells).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = tiles.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other")
    ship_code(docs.sparkSession)
    sums = tiles.groupBy("lang", "tb", "i", "j").applyInArrow(_tile, "lang string, a long, b long, value long")
    lists = light.groupBy("lang", "term").agg(F.collect_list(F.struct("gid", "p", "p0")).alias("own")).where(F.size("own") > 1)
    sums = sums.unionByName(light_pairs(lists)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    both = sums.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("pair"))
    names = groups.select("lang", "gid", "source")
    pairs = both.select("lang", "value", F.col("pair.x").alias("gid"), F.col("pair.y").alias("other")).join(names, ["lang", "gid"])
    pairs = pairs.select("lang", "source", "value", F.col("other").alias("gid")).join(names.withColumnRenamed("source", "item"), ["lang", "gid"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    q = probability(F.col("lang_n"), F.col("lang_all") + ADD * F.col("v"))
    ahead = post.select("lang", "source", F.col("term").alias("item"), (F.col("p") - q).alias("value")).where("value > 0")
    ahead = ahead.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(ahead.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


ORACLE = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
w as (select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
c as (select lang, source, term, count(*) as n, count(distinct r) as df from w group by all),
t as (select lang, term, sum(n)::hugeint as n from c group by all having sum(df) >= 30),
s as (select distinct lang, source from d),
k as (select lang, source, term, c.n::hugeint as n from c semi join t using (lang, term)),
v as (select lang, count(*) as v, sum(n) as n from t group by all),
g as (select s.lang, s.source, coalesce(v.v, 0) as v, coalesce((select sum(k.n) from k where k.lang = s.lang and k.source = s.source), 0) as n from s left join v using (lang)),
p as (select g.lang, g.source, t.term, coalesce(k.n, 0) as held, 1 + (1000000000::hugeint * (coalesce(k.n, 0) + 5)) // (g.n + 5 * g.v) as p
      from g join t using (lang) left join k on k.lang = g.lang and k.source = g.source and k.term = t.term),
f as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value
          from s a join s b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
terms as (select p.lang, p.source, 'term' as part, p.term as item, (p.p - (1 + (1000000000::hugeint * (t.n + 5)) // (v.n + 5 * v.v)))::bigint as value
          from p join t using (lang, term) join v using (lang) where p.held > 0),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
           from (select * from pairs union all select * from terms where value > 0))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50
"""
