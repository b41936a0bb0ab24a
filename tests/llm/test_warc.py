import hashlib

from pyspark.sql import functions as F

from tidemark.llm.warc import blocks_of, capture_index, lookup, parse_record, read_archives, record_bytes, round_trip, surt


def expected(rows):
    groups = {}
    for p, _, h in rows:
        groups.setdefault((h or "").encode(), []).append(p)
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        best = max((x for x in groups[raw] if x is not None), default=None)
        again = len(raw) >= 1000 and p is not None and best > p
        out.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", best if again else None))
    return out


def found(df):
    return [tuple(r)[:5] for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]


def key(row):
    return tuple((x is None, x) for x in row)


def test_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages = pages.union(pages.where("page_id % 3 = 0").select(F.col("page_id") + 1000, "url", "html"))
    got = round_trip(pages)
    assert got.where("not ok").count() == 0
    assert sorted(found(got), key=key) == sorted(expected([tuple(r) for r in pages.collect()]), key=key)


def test_defined_cases(spark):
    long = "é" * 600
    rows = [(1, "http://A.example.com/x y", long), (2, None, long), (2, "u", long), (None, "u", long), (3, "http://b.org", None), (4, "http://b.org", ""), (5, "v", "x" * 999), (6, "v", "x" * 999), (7, "w\r\nEvil: 1", "z\r\n\r\nq" * 200000)]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    got = round_trip(pages)
    assert got.where("not ok").count() == 0
    assert sorted(found(got), key=key) == sorted(expected(rows), key=key)
    assert round_trip(pages.where(F.lit(False))).count() == 0


def test_lookup_reads_only_what_is_asked(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    blocks, folder = capture_index(pages, partitions=3)
    some = pages.where("page_id in (3, 17, 40)").select("url")
    assert sorted(r.page_id for r in lookup(blocks, folder, some).collect()) == [3, 17, 40]
    missing = spark.createDataFrame([("http://nowhere.test/",), (None,)], "url string")
    assert lookup(blocks, folder, missing).count() == 0
    assert lookup(blocks, folder, some.where(F.lit(False))).count() == 0


def test_one_very_common_url_and_the_plan(spark):
    pages = spark.range(900).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 > 0, "http://hot.example/a").otherwise(F.concat(F.lit("http://x.example/"), "id")).alias("url"), F.concat(F.lit("text "), "id").alias("html"))
    directory, folder = capture_index(pages, partitions=4)
    assert directory.count() > 3
    everything = {r.page_id for r in read_archives(directory, folder).collect()}
    found = lookup(directory, folder, pages)
    assert sorted(r.page_id for r in found.collect()) == sorted(everything) == list(range(900))
    asked = pages.select(surt("url").alias("key")).distinct()
    met = blocks_of(directory, asked)
    plan = met._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "FlatMapCoGroups" in plan
    # exactly the blocks whose range holds the key
    blocks, keys = directory.collect(), [r.key for r in asked.collect()]
    want = sorted((k, b.file, b["at"], b.length) for k in keys for b in blocks if b.first_key <= k <= b.last_key)
    assert sorted(tuple(r) for r in met.collect()) == want


def test_keys_and_records(spark):
    row = spark.createDataFrame([("HTTPS://user@www2.Sub.Example.com:8080/a/b?q=1#frag", "example.org")], "url string, bare string").select(surt("url"), surt("bare")).first()
    assert tuple(row) == ("com,example,sub)/a/b?q=1", "org,example)/")
    record = parse_record(record_bytes(7, "http://x/", "body", hashlib.sha1(b"body").hexdigest(), "response", None))
    assert record["payload"] == b"body" and record["headers"]["WARC-Type"] == "response"
