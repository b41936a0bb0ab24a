"""WARC archives with a two-level capture index.

Captures are range-sorted by their reversed-host URL key. Each range writes its
own gzip-member archives in that order and, beside them, an index file: the first
level, blocks of sorted capture lines, each compressed by itself. The second level is a
sparse directory with one row a block (first and last key, index file, byte range).
A lookup finds the index files whose range holds its key (one small row a file on the
driver, binary-searched), joins the directory by file, reads the one block that can
hold the key, binary-searches it and reads the record's byte range.

Archives and index files are written by the tasks into the shared folder through
pyarrow's filesystems, under names of their own attempt; only those named by the
directory of the finished job count, so a lost or repeated task leaves no trace in it.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import map_arrow, new_path, settle, ship_code

#: Payloads below this are never replaced by revisits.
REVISIT_BYTES = 1000
#: Capture lines in an index block; archive bytes before a new archive begins.
BLOCK_LINES, ARCHIVE_BYTES = 256, 64 << 20
DATE = "2024-01-01T00:00:00Z"

DIRECTORY = "first_key string, last_key string, n_captures long, file string, at long, length long"
DIRECTORY_KINDS = {"first_key": pa.string(), "last_key": pa.string(), "n_captures": pa.int64(), "file": pa.string(), "at": pa.int64(), "length": pa.int64()}
RECORD_KINDS = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "digest": pa.string(), "payload_bytes": pa.int64(), "ok": pa.bool_()}
RECORDS = "page_id long, url string, record_type string, refers_to long, digest string, payload_bytes long, ok boolean"


def surt(column: str = "url"):
    """Reversed-host key: com,example)/path?query, lower-case, without scheme,
    user, port and leading www. Null has the empty key."""
    url = F.lower(F.coalesce(F.col(column), F.lit("")))
    rest = F.regexp_replace(url, r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^[^@]*@|:\d+$", ""), r"^www\d*\.", "")
    path = F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1)
    return F.regexp_replace(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path)), r"[\s\x00]", "%20")


def record_types(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, record_type, refers_to, key. Of equal payloads
    of REVISIT_BYTES or more, the largest page_id is the response."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("n", F.octet_length("html"))
    large = rows.where(F.col("n") >= REVISIT_BYTES).groupBy("digest", "n").agg(F.max("page_id").alias("response"), F.count("*").alias("copies"))
    # a table of its own, of known size: small enough it is broadcast and no payload is shuffled for it
    large = settle(large.where("copies > 1").select("digest", "n", "response"), "repeated-payloads")
    rows = rows.join(large, ["digest", "n"], "left")
    again = F.col("page_id").isNotNull() & (F.col("response") > F.col("page_id"))
    return rows.select("page_id", "url", "html", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("response")).alias("refers_to"), surt().alias("key"))


def _header(value: str) -> str:
    return "".join(c if " " <= c and c != "\x7f" else "%" + c.encode().hex().upper() for c in value)


def record_bytes(page_id: int | None, url: str | None, html: str, digest: str, record_type: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member. A revisit has the HTTP header only."""
    payload = html.encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if record_type == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:page:{page_id if page_id is not None else 'null'}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header(url or '')}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if record_type == "revisit" else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def parse_record(member: bytes) -> dict:
    """Headers, HTTP headers and payload of one record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(headers["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    http_headers = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    return {"headers": headers, "http": http_headers, "payload": payload}


def _page(urn: str | None) -> int | None:
    return int(urn[10:-1]) if urn and urn != "<urn:page:null>" else None


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write records in key order; the result is the sparse directory (see
    DIRECTORY). Equal keys are ordered by page_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        out, name, at, lines = None, "", 0, []
        index_name, index_at, index = f"{uuid.uuid4().hex}.cdx.z", 0, None

        def block():
            nonlocal index, index_at
            if index is None:
                index = store.open_output_stream(f"{path}/{index_name}", compression=None)
            data = zlib.compress("\n".join(lines).encode(), 6)
            index.write(data)
            keys = [x.split("\t", 1)[0] for x in (lines[0], lines[-1])]
            row = (keys[0], keys[1], len(lines), index_name, index_at, len(data))
            index_at += len(data)
            return row

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                member = record_bytes(r["page_id"], r["url"], r["html"], r["digest"], r["record_type"], r["refers_to"])
                out.write(member)
                lines.append(f"{r['key']}\t{'' if r['page_id'] is None else r['page_id']}\t{name}\t{at}\t{len(member)}")
                at += len(member)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                if len(lines) == BLOCK_LINES:
                    rows.append(block())
                    lines = []
            yield _table(rows, DIRECTORY_KINDS)
        rows = [block()] if lines else []
        for stream in (out, index):
            if stream is not None:
                stream.close()
        yield _table(rows, DIRECTORY_KINDS)

    return map_arrow(records, run, DIRECTORY)


def capture_index(pages: DataFrame, folder: str | None = None, partitions: int | None = None) -> tuple[DataFrame, str]:
    """Write archives of all ``pages`` and return (sparse directory, folder)."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = record_types(pages).repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id")
    return settle(write_archives(ordered, folder), "directory"), folder


def _read_captures(store, path: str, captures: list[list[str]]) -> list[tuple]:
    """Range reads, one open file an archive, in offset order."""
    out, opened = [], {}
    for _, _, name, at, n in captures:
        if name not in opened:
            opened[name] = store.open_input_file(f"{path}/{name}")
        source = opened[name]
        source.seek(int(at))
        record = parse_record(source.read(int(n)))
        h, payload = record["headers"], record["payload"]
        digest = base64.b32decode(h["WARC-Payload-Digest"][5:]).hex()
        response = h["WARC-Type"] == "response"
        ok = not response or (hashlib.sha1(payload).hexdigest() == digest and len(payload) == int(record["http"]["Content-Length"]))
        size = len(payload) if response else None
        out.append((_page(h["WARC-Record-ID"]), h["WARC-Target-URI"], h["WARC-Type"], _page(h.get("WARC-Refers-To")), digest, size, ok))
    for source in opened.values():
        source.close()
    return out


def _table(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], list(kinds))


def _read_block(store, path: str, file: str, at: int, length: int) -> list[str]:
    with store.open_input_file(f"{path}/{file}") as source:
        source.seek(at)
        return zlib.decompress(source.read(length)).decode().split("\n")


def read_archives(directory: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives (see RECORDS), a block of captures at a time: the
    full scan. ``ok`` says that a response's payload has the digest and length of its
    headers. A revisit has no payload of its own: its payload_bytes is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                captures = [x.split("\t") for x in _read_block(store, path, row["file"], row["at"], row["length"])]
                yield _table(_read_captures(store, path, captures), RECORD_KINDS)

    return map_arrow(directory.select("file", "at", "length"), run, RECORDS)


def blocks_of(directory: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, file, at, length) of every block whose key range holds a key of ``keys``.

    Index files hold consecutive key ranges, so a key's files are a run of the sorted
    file list (one row a writing task on the driver). The keys asked of a file meet its part
    of the directory, a row a block, in one group, and each key's blocks are found there by
    binary search."""
    files = sorted((r.lo, r.hi, r.file) for r in directory.groupBy("file").agg(F.min("first_key").alias("lo"), F.max("last_key").alias("hi")).collect())
    spark = keys.sparkSession
    lows, highs = [f[0] for f in files], [f[1] for f in files]
    ship_code(spark)

    @F.pandas_udf("array<int>")
    def files_of(key: pd.Series) -> pd.Series:
        return key.map(lambda k: list(range(bisect.bisect_left(highs, k), bisect.bisect_right(lows, k))))

    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("first_key", "ascending"), ("at", "ascending")])
        first, last = right["first_key"].to_pylist(), right["last_key"].to_pylist()
        which, block = [], []
        for i, key in enumerate(left["key"].to_pylist()):
            own = range(bisect.bisect_left(last, key), bisect.bisect_right(first, key))
            which += [i] * len(own)
            block += own
        held = right.select(["file", "at", "length"]).take(pa.array(block, pa.int64()))
        return pa.table([left["key"].take(pa.array(which, pa.int64())), *held.columns], names=["key", "file", "at", "length"])

    numbered = spark.createDataFrame([(i, f[2]) for i, f in enumerate(files)], "held int, file string")
    blocks = directory.join(F.broadcast(numbered), "file")  # one row a writing task
    asked = keys.select("key", F.explode(files_of("key")).alias("number"))
    return asked.groupBy("number").cogroup(blocks.groupBy("held")).applyInArrow(found, "key string, file string, at long, length long")


def lookup(directory: DataFrame, folder: str, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """All captures (see RECORDS) whose key is that of one of ``urls``, by range reads.

    Repeated urls are one key; a url without captures gives no row; a null url has the
    empty key; other columns are ignored. A key with very many captures lies in many
    blocks, each of which is a row of its own: no task gets all of them."""
    met = blocks_of(directory, urls.select(surt(url_col).alias("key")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        held, lines, own = None, [], []
        for batch in batches:
            got = []
            for row in batch.to_pylist():
                if held != (place := (row["file"], row["at"])):
                    held, lines = place, _read_block(store, path, row["file"], row["at"], row["length"])
                    own = [x.split("\t", 1)[0] for x in lines]
                got += [x.split("\t") for x in lines[bisect.bisect_left(own, row["key"]) : bisect.bisect_right(own, row["key"])]]
                if len(got) >= BLOCK_LINES:
                    yield _table(_read_captures(store, path, got), RECORD_KINDS)
                    got = []
            yield _table(_read_captures(store, path, got), RECORD_KINDS)

    # a given number, so that the few bytes of keys are not put into one task: the work is in the range reads
    n = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(met.repartition(n, "file", "at").sortWithinPartitions("file", "at", "key"), run, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html), look every page's url up in the capture
    index, read its records back, and return page_id, payload_bytes, payload_digest, record_type,
    refers_to, url, ok. A revisit's payload is that of the response it names.

    Defined cases: null html is an empty payload; a null url has the empty key; a
    null page_id is a response that nothing refers to; of repeated page_ids with
    equal payloads of REVISIT_BYTES or more each is a response; an empty table
    gives an empty result; other columns are ignored."""
    directory, folder = capture_index(pages)
    records = settle(lookup(directory, folder, pages), "records")
    whole = records.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("target"), F.col("digest").alias("target_digest")).agg(F.max("payload_bytes").alias("target_bytes"), F.min("ok").alias("target_ok"))
    revisits = records.where("record_type = 'revisit'").join(whole, (F.col("refers_to") == F.col("target")) & (F.col("digest") == F.col("target_digest")), "left")
    revisits = revisits.withColumn("payload_bytes", F.col("target_bytes")).withColumn("ok", F.coalesce("target_ok", F.lit(False))).select(records.columns)
    both = records.where("record_type = 'response'").union(revisits)
    return both.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to", "url", "ok")
