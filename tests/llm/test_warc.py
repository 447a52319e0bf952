import base64
import hashlib
import random
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from bizdata.llm import queries, warc
from tests.compare import compare, connect

SCHEMA = "page_id long, url string, html string, key string, file string, payload string, sha1 string"


def brute(rows, least=0):
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each row."""
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        first.setdefault(data, []).append(i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        known = [k for k in first[data] if k is not None]
        source = min(known) if known else None
        revisit = len(data) >= least and i != source
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", source if revisit else None))
    return sorted(out, key=str)


def pages(seed: int, n: int):
    rng = random.Random(seed)
    hosts = ["example.com", "www.Example.com", "a.b.example.org:8080", "user@x.example.net:443", "one"]
    texts = [None, "", "<p>same</p>", "é" * 50, "x" * 300_000, *(f"<p>{rng.random()}</p>" for _ in range(n // 2))]
    urls = [None, "", "no scheme", "mailto:a@b.c", "http://example.com", "http://example.com/a b\nc", "http://h.example.com/" + "long" * 200,
            *(f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}/{rng.randrange(9)}?q={rng.randrange(3)}#f" for _ in range(n // 2))]
    rows = [(k, rng.choice(urls), rng.choice(texts)) for k in range(n)]
    rows += [rows[3], rows[5], (None, "http://n.example.com/", "<p>same</p>"), (None, None, "only null"), (-7, "http://example.com/", "<p>same</p>")]
    # one URL has most of the captures
    return rows + [(10_000 + k, "http://hot.example.com/", "hot") for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "?", "?", "?", "?") for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize(("least", "lines"), [(0, 3000), (12, 5)])
def test_round_trip(spark, monkeypatch, least, lines):
    monkeypatch.setattr(warc, "BLOCK_LINES", lines)
    rows = pages(least, 120)
    archives = warc.write_archives(frame(spark, rows), least)
    index = warc.build_index(archives)
    assert sum(r["captures"] for r in index.shards.collect()) == len(rows)
    found = warc.lookup(index, frame(spark, rows))
    got = warc.read_records(found, archives.folder)
    want = brute(rows, least)
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == want
    assert {r["intact"] for r in got.collect()} == {True, None}
    whole = warc.payloads(got).select("page_id", F.decode("payload", "UTF-8")).collect()
    assert sorted(map(repr, ((r[0], r[1]) for r in whole))) == sorted(repr((i, h or "")) for i, _, h in rows)


def test_archives_are_gzip_members_with_lengths(spark):
    rows = pages(3, 30)
    archives = warc.write_archives(frame(spark, rows))
    count = 0
    for path in Path(archives.folder).glob("*.warc.gz"):
        data = path.read_bytes()
        while data:
            one = zlib.decompressobj(31)
            raw, data = one.decompress(data), one.unused_data
            head, _, rest = raw.partition(b"\r\n\r\n")
            size = next(int(x.split(b": ")[1]) for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))
            assert head.startswith(b"WARC/1.1\r\n") and rest[size:] == b"\r\n\r\n"
            count += b"WARC-Type: warcinfo" not in head
    assert count == len(rows)


def test_lookup_of_some_urls(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    long = "http://h.example.com/" + "long" * 200
    rows = pages(5, 150) + [(20_000 + k, f"{long}{k % 7}", "x") for k in range(60)]  # first keys are cut before they differ
    archives = warc.write_archives(frame(spark, rows))
    index = warc.build_index(archives)
    asked = ["http://EXAMPLE.com/#x", "https://hot.example.com:443/", "http://nowhere.example.com/", "", None, long, long + "3", long + "9"]
    keys = {r[0]: r[1] for r in spark.createDataFrame([(u,) for u in {x[1] for x in rows} | set(asked)], "url string").select("url", warc.url_key(F.col("url"))).collect()}
    got = warc.lookup(index, spark.createDataFrame([(u,) for u in asked], "url string")).collect()
    want = [(i, u) for i, u, _ in rows if keys[u] in {keys[a] for a in asked}]
    assert sorted(map(str, ((r["page_id"], r["url"]) for r in got))) == sorted(map(str, want)) and len(got) > 150
    some = warc.read_records(spark.createDataFrame(got[:7]), archives.folder)
    assert sorted(str(r["page_id"]) for r in some.collect()) == sorted(str(r["page_id"]) for r in got[:7])


@pytest.mark.parametrize(("url", "key"), [
    ("http://www.Example.com:80/A?b=1#c", "com,example,www)/A?b=1"), ("https://u:p@x.org:444", "org,x:444)/"), ("//h/a b", "h)/a%20b"),
    ("path/only", ")/path/only"), ("", ")/"), (None, "-"), ("http://x.org?q", "org,x)/?q"), ("  ftp://x.org/é ", "org,x)/é")])
def test_keys(value, url, key):
    assert value(warc.url_key(F.col("url")), url=url) == key


def test_empty_table(spark):
    archives = warc.write_archives(frame(spark, []))
    found = warc.lookup(warc.build_index(archives), frame(spark, [(1, "http://a/", "x")]))
    assert warc.read_records(found, archives.folder).collect() == []


def test_query_on_pages_with_copies(spark, tmp_path):
    """The tables hold no equal pages; a copy of them with some does."""
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    more = df.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 1000)
    nulls = df.where("page_id % 10 = 0").select((F.col("page_id") + 5000).alias("page_id"), "url", F.lit(None).cast("string").alias("html"))
    df.unionByName(more).unionByName(nulls).coalesce(1).write.parquet(str(tmp_path / "x"))
    next((tmp_path / "x").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    con = connect(str(tmp_path))
    assert compare(con, queries.QUERIES["op12_warc"](spark, str(tmp_path)), warc.PAGES_SQL) is None
