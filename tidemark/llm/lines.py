"""Line dedup over overlapping windows of consecutive lines (DataFrame functions only).

Every run of ``size`` consecutive lines is a window. Windows are hashed to 128
bits, a grouped minimum finds each repeated window's first place, and the lines
under its later places go. Windows are aggregated before the shuffle, so a very
common block of lines is one row a task, and only documents that lose lines are
put together again. Texts move once, to meet their removed positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import settle

LAST = (1 << 63) - 1


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """One row per row of ``docs``: id_col, n_lines, n_removed, kept_text.

    Lines are what newlines separate, compared as they are. A line goes if a
    window over it equals one that starts earlier (smaller id, or same id and
    earlier line); windows are judged on the input. Defined cases: a null text has
    no lines and stays null; an empty text is one empty line; documents of fewer
    than ``size`` lines are left alone; a null id stands behind all others;
    repeated rows start at the same place, so neither removes the other; an empty
    table gives an empty result; other columns are ignored.
    """
    raw = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.col(text_col).cast("string").alias("text"))
    raw = raw.withColumn("key", F.xxhash64("text")).withColumn("lines", F.split("text", "\n"))
    starts = F.sequence(F.lit(0), F.size("lines") - size)

    def window(seed: int):
        hashed = F.transform("lines", lambda line: F.xxhash64(F.lit(seed), line))
        return F.transform(F.col("starts"), lambda i: F.xxhash64(*[F.get(F.col(f"h{seed}"), i + j) for j in range(size)])), hashed

    (w1, h1), (w2, h2) = window(1), window(2)
    hashed = raw.where(F.size("lines") >= size).select("id", "key", starts.alias("starts"), h1.alias("h1"), h2.alias("h2"))
    placed = hashed.select("id", "key", F.inline(F.arrays_zip(F.col("starts").alias("at"), w1.alias("w1"), w2.alias("w2"))))
    placed = settle(placed, "windows")
    first = placed.groupBy("w1", "w2").agg(F.min(F.struct("id", "at")).alias("first"), F.max(F.struct("id", "at")).alias("last")).where("first < last")
    later = placed.join(first.select("w1", "w2", "first"), ["w1", "w2"]).where(F.struct("id", "at") > F.col("first"))
    gone = later.groupBy("id", "key").agg(F.collect_set("at").alias("gone"))
    covered = F.flatten(F.transform("gone", lambda s: F.sequence(s, s + (size - 1))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), covered)
    text = F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n")
    out = raw.join(gone.select("id", "key", "gone"), ["id", "key"], "left").withColumn("n_lines", F.coalesce(F.when(F.col("text").isNotNull(), F.size("lines")), F.lit(0)).cast("long"))
    out = out.withColumn("n_removed", F.when(F.col("gone").isNull(), 0).otherwise(F.col("n_lines") - F.size(kept)).cast("long"))
    return out.select(
        F.when(F.col("id") < LAST, F.col("id")).alias(id_col), "n_lines", "n_removed",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(text).alias("kept_text"),
    )


ORACLE = """
with docs as (select doc_id, string_split(text, chr(10)) as lines from documents),
places as (select doc_id, lines, unnest(generate_series(1, len(lines) - 2)) as pos from docs where len(lines) >= 3),
windows as (select doc_id, pos, lines[pos] || chr(10) || lines[pos + 1] || chr(10) || lines[pos + 2] as w from places),
ranked as (select doc_id, pos, row_number() over (partition by w order by doc_id, pos) as nth from windows),
covered as (select distinct doc_id, pos + j as line from ranked, (values (0), (1), (2)) as o(j) where nth > 1),
kept as (select d.doc_id, d.line, d.body from (select doc_id, unnest(generate_series(1, len(lines))) as line, unnest(lines) as body from docs) d
         anti join covered c on c.doc_id = d.doc_id and c.line = d.line)
select d.doc_id, coalesce(len(d.lines), 0)::bigint as n_lines, (coalesce(len(d.lines), 0) - count(k.line))::bigint as n_removed,
       sha256(coalesce(string_agg(k.body, chr(10) order by k.line), '')) as kept_sha256
from docs d left join kept k on k.doc_id = d.doc_id group by d.doc_id, d.lines
"""
