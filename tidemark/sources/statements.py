"""SQL text: literals, and INSERT statements packed exactly.

Rows are packed greedily in key order: a statement takes rows until the next one would exceed
its rows or its bytes. Where a statement begins depends on the one before it, but from a given
first row the next cut is fixed. So sorted ranges are worked on apart: each says, for every place
where its first statement may begin, how much its last one has taken at the range's end. These
pointers and the sizes of a range's first rows are chained on the driver (a few hundred numbers
a range), and then every range cuts its own rows. A statement that spans ranges is put
together from its parts, which are no longer than a statement."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import kept

# Rows and bytes of one INSERT statement.
CHUNK_ROWS, CHUNK_BYTES = 400, 50_000
#: Bytes of a sorted range, whose rows one task cuts.
RANGE_BYTES = 32 << 20


def sql_literal(c: Column, kind: str) -> Column:
    """A value as SQL text. NaN and infinity are errors."""
    if kind == "string":
        text = F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\x00"), F.lit("")), F.lit("'"), F.lit("''")), F.lit("'"))
    elif kind == "boolean":
        text = F.when(c, "1").otherwise("0")
    elif kind in ("double", "float"):
        bad = F.isnan(c) | (F.abs(c) == float("inf"))
        text = F.when(bad, F.raise_error(F.lit("a value is not finite")).cast("string")).otherwise(c.cast("string"))
    else:
        text = c.cast("string")
    return F.when(c.isNull(), "NULL").otherwise(text)


def cuts_from(sizes: np.ndarray, first: int, rows: int, room: int) -> list[int]:
    """Where statements begin when one begins at row ``first``. ``room``: bytes for rows."""
    ends, out, at = np.r_[0, np.cumsum(sizes)], [], first
    while at < len(sizes):
        out.append(at)
        by_size = int(np.searchsorted(ends, ends[at] + room, side="right")) - 1
        at = max(at + 1, min(at + rows, by_size))
    return out


def open_at_end(sizes: np.ndarray, rows: int, room: int) -> list[tuple[int, int]]:
    """(rows, bytes) taken at the range's end by its last statement, for each row where the
    first one may begin; the last entry is for none that begins in the range.

    Each row points to the row where the statement after it begins; following pointers from
    the back, every row is looked at once."""
    n = len(sizes)
    ends = np.r_[0, np.cumsum(sizes)]
    by_size = np.searchsorted(ends, ends[:-1] + room, side="right") - 1
    after = np.maximum(np.arange(n) + 1, np.minimum(np.arange(n) + rows, by_size)) if n else np.zeros(0, np.int64)
    last = np.empty(n, np.int64)
    # a statement that runs up to the end of the range is still open: the next range may add to it
    for i in range(n - 1, -1, -1):
        last[i] = i if after[i] >= n else last[after[i]]
    return [(int(n - last[i]), int(ends[n] - ends[last[i]])) for i in range(min(n, rows))]


def insert_statements(df: DataFrame, name: str, order: list[str], rows: int = CHUNK_ROWS, size: int = CHUNK_BYTES, ranges: int | None = None) -> DataFrame:
    """(nth, n_rows, statement): INSERTs of at most ``rows`` rows and ``size`` bytes; a row
    that is longer alone stands alone. Statements follow ``order``, whose ties go by the rows'
    text; an empty table makes none."""
    kinds = dict(df.dtypes)
    quoted = lambda n: '"' + n.replace('"', '""') + '"'
    head = f"INSERT INTO {quoted(name)} ({', '.join(quoted(c) for c in df.columns)}) VALUES\n"
    values = F.concat(F.lit("("), F.concat_ws(", ", *[sql_literal(F.col(c), kinds[c]) for c in df.columns]), F.lit(")"))
    keys = [f"o{i}" for i in range(len(order))]
    lines = df.select(values.alias("v"), *[F.col(o).alias(k) for o, k in zip(order, keys, strict=True)])
    if ranges is None:
        ranges = int((lines.agg(F.sum(F.octet_length("v") + 2)).first()[0] or 0) // RANGE_BYTES) + 1
    # written once: another run of the same shuffle may cut ranges elsewhere
    dealt = lines.repartitionByRange(ranges, *keys, "v").withColumn("part", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("part").orderBy(*keys, "v")) - 1
    lines = kept(dealt.select("part", place.alias("at"), "v", (F.octet_length("v") + 2).alias("bytes")))
    room = size - len(head.encode()) + 1  # the last row has ; in place of a comma and a newline

    def pointers(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        sizes = table["bytes"].to_numpy()
        ends = open_at_end(sizes, rows, room)
        one = lambda x, kind: pa.array([x], kind)
        return pa.table([table["part"][:1], one(len(sizes), pa.int64()), one(sizes[:rows].tolist(), pa.list_(pa.int64())), one([e[0] for e in ends], pa.list_(pa.int64())), one([e[1] for e in ends], pa.list_(pa.int64()))], names=["part", "n", "first", "open_rows", "open_bytes"])

    told = lines.select("part", "at", "bytes").groupBy("part").applyInArrow(pointers, "part int, n long, first array<long>, open_rows array<long>, open_bytes array<long>")
    starts, taken, used = {}, 0, 0
    for r in sorted(told.collect()):  # a few hundred numbers a range
        begin = 0
        if taken:  # rows that the open statement still takes
            ends = np.cumsum(r.first) + used
            begin = int(min(np.searchsorted(ends, room, side="right"), rows - taken))
        starts[r.part] = begin
        if begin < r.n:
            taken, used = r.open_rows[begin], r.open_bytes[begin]
        else:
            taken, used = taken + r.n, used + int(sum(r.first))

    def cut(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        part, texts = table["part"][0].as_py(), table["v"].to_pylist()
        begin = starts[part]
        at = cuts_from(table["bytes"].to_numpy(), begin, rows, room)
        edges = [*([0] if begin else []), *at, len(texts)]
        bodies = [",\n".join(texts[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        opens = [None] * bool(begin) + at
        return pa.table([pa.array([part] * len(bodies), pa.int32()), pa.array(opens, pa.int64()), pa.array([b - a for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.int64()), pa.array(bodies, pa.string())], names=["part", "opens", "n", "body"])

    pieces = lines.groupBy("part").applyInArrow(cut, "part int, opens long, n long, body string")
    # a piece without a beginning belongs to the last statement that began in an earlier range
    begun = {r.part: r.last for r in pieces.groupBy("part").agg(F.max("opens").alias("last")).collect()} if any(starts.values()) else {}
    owner, held = [], None
    for p in sorted(starts):
        owner.append((p, *(held or (p, 0))))
        if begun.get(p) is not None:
            held = (p, begun[p])
    sides = df.sparkSession.createDataFrame(owner, "part int, from_part int, from_opens long")
    whole = pieces.join(F.broadcast(sides), "part")  # one row a range
    own = F.col("opens").isNotNull()
    whole = whole.select(F.when(own, F.col("part")).otherwise(F.col("from_part")).alias("p"), F.when(own, F.col("opens")).otherwise(F.col("from_opens")).alias("o"), "part", "n", "body")
    whole = whole.groupBy("p", "o").agg(F.sum("n").alias("n_rows"), F.array_sort(F.collect_list(F.struct("part", "body"))).alias("b"))
    text = F.concat(F.lit(head), F.array_join(F.transform("b", lambda s: s["body"]), ",\n"), F.lit(";"))
    return whole.select(F.struct("p", "o").alias("nth"), "n_rows", text.alias("statement"))
