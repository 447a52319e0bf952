"""WARC archives of pages, one gzip member a record, and a two-level index of their captures.

The index is a sorted list of capture lines, keyed by the URL with its host reversed. It is cut into compressed blocks,
one file a range of keys (a shard), and each shard ends in a sparse directory: the first key of every block and where
the block lies. A lookup picks shards by their first keys, searches a directory by halves, reads one range, searches that
block by halves, and then reads the ranges of the archives that the lines name.

Tasks write files through the file system of the shared folder. A file is named after the attempt that writes it, and
only the rows of attempts that ended name files, so a lost executor leaves at most files that nothing refers to.
"""

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from .lineage import settle
from .words import slices

#: An archive file is closed once it holds so much; a block is, at so many lines or bytes of lines.
FILE_BYTES = 1 << 30
BLOCK_LINES, BLOCK_BYTES = 3000, 1 << 18
#: First keys are kept up to so many bytes; longer ones are told apart inside blocks.
KEY_BYTES = 256
#: Neighbouring records are read in one range of up to so many bytes.
RANGE_BYTES = 1 << 23
CAPTURED = "1970-01-01T00:00:00Z"
#: Where a record lies.
PLACE = "file string, offset long, length long"


@dataclass
class Archives:
    """Archive files under `folder` and one row per record: page_id, url, key, record_type, and where it lies."""

    folder: str
    captures: DataFrame


@dataclass
class Index:
    """Shard files under `folder` and one row per shard: its place in the order of keys, name, first key, number of
    captures and blocks, and where its directory lies."""

    folder: str
    shards: DataFrame


def url_key(url: Column) -> Column:
    """The host from its last label to its first, `)`, path and query: `com,example,blog)/a?b=1`. Scheme, user, default port
    and fragment are left out; the host is lower-cased, white space and control characters are percent signs of their kind.
    A URL without a host has an empty one; null has `-`."""
    text = F.trim(url)
    mark = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(text, mark + "([^/?#]*)", 1)), "^.*@", ""), ":(?:80|443)?$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, mark + "[^/?#]*", ""), "#.*$", ""), r"[\s\p{Cntrl}]", "%20")
    name = F.array_join(F.reverse(F.split(F.regexp_replace(F.regexp_replace(host, ":.*$", ""), r"[\s\p{Cntrl}]", ""), r"\.")), ",")
    port = F.regexp_replace(F.regexp_extract(host, ":.*$", 0), r"[\s\p{Cntrl}]", "")
    slash = F.when(path.startswith("/"), F.lit("")).otherwise(F.lit("/"))
    return F.coalesce(F.concat(name, port, F.lit(")"), slash, path), F.lit("-"))


def kinds(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """`id`, `url`, `payload`, `sha1`, and of the record that a page revisits `first_id`, `first_url` (`revisit` says if it does)."""
    size, check = F.octet_length("payload"), F.xxhash64("payload")
    every = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                         F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    every = every.withColumn("sha1", F.sha1("payload")).withColumn("size", size).withColumn("check", check)
    same = ["sha1", "size", "check"]
    # one row a payload that repeats: counts and minima are combined before the shuffle, and Spark broadcasts the few
    # there usually are; where they are many, a payload with most of the pages is a hot key of a join with a unique side
    repeated = settle(every.where(F.col("size") >= least).groupBy(*same)
                      .agg(F.count("*").alias("n"), F.min(F.struct(F.col("id").isNull().alias("last"), "id", "url")).alias("first"))
                      .where("n > 1").select(*same, F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"), F.lit(True).alias("found")))
    joined = every.join(repeated, same, "left")
    return joined.select("id", "url", "payload", "sha1", "first_id", "first_url",
                         (F.col("found").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))).alias("revisit"))


def base32(sha1: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1)).decode()


def safe(url: str | None) -> bytes:
    """A URL fit for a header line."""
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], (url or "about:blank").encode("utf-8", "surrogatepass"))


def name_of(page_id: int | None, sha1: str) -> str:
    """The id of a record: two records share one only if they repeat page and payload."""
    return f"<urn:page:{'null' if page_id is None else page_id}:{sha1}>"


def record(page: dict) -> bytes:
    """A response or revisit record as one gzip member. A revisit has the headers of the response, so the size of the
    payload, without the payload."""
    payload = page["payload"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if page["revisit"] else b"response"),
             b"WARC-Record-ID: " + name_of(page["id"], page["sha1"]).encode(), b"WARC-Date: " + CAPTURED.encode(), b"WARC-Target-URI: " + safe(page["url"]),
             b"WARC-Payload-Digest: sha1:" + base32(page["sha1"]).encode(), b"Content-Type: application/http; msgtype=response"]
    block = http
    if page["revisit"]:
        lines += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  b"WARC-Refers-To: " + name_of(page["first_id"], page["sha1"]).encode(), b"WARC-Refers-To-Target-URI: " + safe(page["first_url"])]
    else:
        block += payload
    lines.append(b"Content-Length: %d" % len(block))
    return member(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n")


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def info() -> bytes:
    body = b"software: bizdata\r\nformat: WARC File Format 1.1\r\n"
    return member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\n"
                  b"Content-Length: %d\r\n\r\n%s\r\n\r\n" % (str(uuid.uuid4()).encode(), CAPTURED.encode(), len(body), body))


class Writer:
    """A file of gzip members in a folder; `add` says where each lies."""

    def __init__(self, folder: str, ending: str) -> None:
        system, path = pyarrow.fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        self.name, self.at = uuid.uuid4().hex + ending, 0
        self.out = system.open_output_stream(f"{path}/{self.name}", compression=None)

    def add(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def close(self) -> None:
        self.out.close()


class Reader:
    """Ranges of the files of a folder; one file is open at a time."""

    def __init__(self, folder: str) -> None:
        self.system, self.path = pyarrow.fs.FileSystem.from_uri(folder)
        self.name, self.source = None, None

    def range(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.name, self.source = name, self.system.open_input_file(f"{self.path}/{name}")
        return self.source.read_at(length, offset)

    def close(self) -> None:
        if self.source is not None:
            self.source.close()


def write_archives(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> Archives:
    """A record per page in archive files of the shared folder.

    Of pages with equal payloads (the text in UTF-8; null: empty) of at least `least` bytes, that with the smallest id is a response and the
    others revisit it; smaller payloads are responses. Payloads count as equal if their SHA-1, a second hash and their sizes
    are. Rows that repeat the smallest id and its payload are responses all of them; null ids come last, and are responses where
    all ids of a payload are null. A null URL is archived as about:blank, control characters and blanks of one are escaped. An empty
    table gives no files; other columns are ignored. A task holds the texts of a slice, or one text if that is longer.
    """
    folder = shared_folder(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for part in slices(batch, "payload"):
                rows, places = part.to_pylist(), []
                for row in rows:
                    if out is None:
                        out = Writer(folder, ".warc.gz")
                        out.add(info())
                    places.append((out.name, *out.add(record(row))))
                    if out.at >= FILE_BYTES:
                        out.close()
                        out = None
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), part.column("url"), part.column("key"), pa.array(["revisit" if r["revisit"] else "response" for r in rows]),
                    *(pa.array([p[k] for p in places], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64())))],
                    ["page_id", "url", "key", "record_type", "file", "offset", "length"])
        if out is not None:
            out.close()

    marked = kinds(pages, id_col, url_col, html_col, least).withColumn("key", url_key(F.col("url")))
    return Archives(folder, settle(marked.mapInArrow(run, f"page_id long, url string, key string, record_type string, {PLACE}")))


def line_of(row: dict) -> bytes:
    rest = {k: row[k] for k in ("page_id", "url", "record_type", "file", "offset", "length")}
    return row["key"].encode("utf-8", "surrogatepass") + b" " + json.dumps(rest, separators=(",", ":")).encode()


def build_index(archives: Archives) -> Index:
    """The captures sorted by key and page, as shards of compressed blocks with a directory each.

    A range of the sort is a shard, so there are at most as many as shuffle partitions. Captures of one key are split over
    shards by page and place; a host or a URL with most of the captures fills many blocks and shards.
    """
    folder = shared_folder(archives.captures.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, lines, size, directory, count = None, [], 0, [], 0

        def cut() -> None:
            nonlocal lines, size
            if lines:
                first = lines[0].split(b" ", 1)[0][:KEY_BYTES]
                directory.append(b"%s %d %d %d" % (first, *out.add(member(b"\n".join(lines))), len(lines)))
                lines, size = [], 0

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out = Writer(folder, ".cdx.gz")
                lines.append(line_of(row))
                size, count = size + len(lines[-1]), count + 1
                if len(lines) >= BLOCK_LINES or size >= BLOCK_BYTES:
                    cut()
        if out is None:
            return
        cut()
        place = out.add(member(b"\n".join(directory)))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (TaskContext.get().partitionId(), out.name, directory[0].split(b" ", 1)[0], count, len(directory), *place)],
                                         ["part", "shard", "first_key", "captures", "blocks", "offset", "length"])

    ordered = archives.captures.orderBy("key", "page_id", "file", "offset").select("key", "page_id", "url", "record_type", "file", "offset", "length")
    return Index(folder, settle(ordered.mapInArrow(run, "part long, shard string, first_key binary, captures long, blocks long, offset long, length long")))


def candidates(firsts: list[bytes], key: bytes) -> range:
    """Which of some sorted pieces, known by their first keys up to KEY_BYTES, may hold a key."""
    key = key[:KEY_BYTES]
    return range(max(bisect_left(firsts, key) - 1, 0), bisect_right(firsts, key))


class Blocks:
    """Search in the shards of an index. One directory and one block are held at a time."""

    def __init__(self, folder: str, shards: list[tuple[str, int, int]]) -> None:
        self.reader, self.shards = Reader(folder), shards
        self.shard, self.block = None, None

    def open(self, shard: int) -> None:
        if shard != self.shard:
            name, offset, length = self.shards[shard]
            rows = [x.rsplit(b" ", 3) for x in zlib.decompress(self.reader.range(name, offset, length), 31).split(b"\n")]
            self.firsts, self.places = [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]
            self.shard, self.block = shard, None

    def load(self, block: int) -> None:
        if block != self.block:
            self.lines = zlib.decompress(self.reader.range(self.shards[self.shard][0], *self.places[block]), 31).split(b"\n")
            self.keys, self.block = [x.split(b" ", 1)[0] for x in self.lines], block

    def find(self, shard: int, key: bytes) -> Iterator[bytes]:
        self.open(shard)
        for block in candidates(self.firsts, key):
            self.load(block)
            yield from self.lines[bisect_left(self.keys, key):bisect_right(self.keys, key)]


def lookup(index: Index, wanted: DataFrame, url_col: str = "url") -> DataFrame:
    """The captures of some URLs through the index: `key`, page_id, url, record_type, and where each record lies.

    URLs that share a key are one; a key that the index lacks gives no row. Keys are sorted by shard and key, so each block is read once
    or twice; the range partitioning splits a shard that most keys fall in. To tasks go the first keys of shards, at most
    KEY_BYTES each and no more than there were shuffle partitions when the index was built.
    """
    spark = wanted.sparkSession
    # bounded: one row a shard
    shards = [tuple(r) for r in index.shards.orderBy("part").select("first_key", "shard", "offset", "length").collect()]
    keys = wanted.select(url_key(F.col(url_col).cast("string")).alias("key")).distinct()
    shape = f"key string, page_id long, url string, record_type string, {PLACE}"
    if not shards:
        return spark.createDataFrame([], shape)
    firsts, places, folder = [bytes(s[0]) for s in shards], [s[1:] for s in shards], index.folder

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [candidates(firsts, k.encode("utf-8", "surrogatepass")) for k in batch.column("key").to_pylist()]
            sizes = [len(f) for f in found]
            yield pa.RecordBatch.from_arrays([pa.array([i for f in found for i in f], pa.int32()), batch.column("key").take(pa.array(np.repeat(np.arange(len(found)), sizes)))],
                                             ["shard", "key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(folder, places)
        names, kind = ["page_id", "url", "record_type", "file", "offset", "length"], [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

        def rows(held: list[tuple[str, bytes]]) -> pa.RecordBatch:
            read = [json.loads(line.split(b" ", 1)[1]) for _, line in held]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.string()), *(pa.array([r[n] for r in read], t) for n, t in zip(names, kind, strict=True))], ["key", *names])

        held = []
        for batch in batches:
            for shard, key in zip(batch.column("shard").to_pylist(), batch.column("key").to_pylist(), strict=True):
                for line in blocks.find(shard, key.encode("utf-8", "surrogatepass")):
                    held.append((key, line))
                    if len(held) >= BLOCK_LINES:
                        yield rows(held)
                        held = []
        if held:
            yield rows(held)
        blocks.reader.close()

    dealt = keys.mapInArrow(deal, "shard int, key string").repartitionByRange("shard", "key").sortWithinPartitions("shard", "key")
    return settle(dealt.mapInArrow(search, shape))  # small rows, sorted anew by those who read records


def parsed(raw: bytes) -> dict:
    """A record as read: its kind, page, URL, digest, the size of the payload, what it refers to, and the payload itself (null in a revisit)."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    block = block[:int(fields[b"Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?mi)^Content-Length: (\d+)", http)[1])
    kind = fields[b"WARC-Type"].decode()

    def page(field: bytes) -> int | None:
        text = fields[field].split(b":")[2]
        return None if text == b"null" else int(text)

    digest = fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
    response = kind == "response"
    return {"page_id": page(b"WARC-Record-ID"), "url": fields[b"WARC-Target-URI"].decode("utf-8", "replace"), "record_type": kind, "payload_bytes": size,
            "payload_digest": digest, "refers_to": None if response else page(b"WARC-Refers-To"),
            "payload": body if response else None,
            "intact": len(body) == size and base32(hashlib.sha1(body).hexdigest()) == digest if response else None}


def read_records(found: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records that the rows of `found` (with `file`, `offset`, `length`) name, one each: page_id, url, record_type, payload_bytes,
    payload_digest, refers_to, `intact` (the payload has the size and digest that the record tells; null in a revisit), and the payload if asked for.

    Rows are sorted by file and place, and neighbours are read in one range of at most RANGE_BYTES, or one record if that is longer.
    """
    names = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
             "refers_to": pa.int64(), "intact": pa.bool_()} | ({"payload": pa.binary()} if payload else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)

        def read(held: list[tuple[str, int, int]]) -> pa.RecordBatch:
            start = held[0][1]
            data = reader.range(held[0][0], start, held[-1][1] + held[-1][2] - start)
            rows = [parsed(zlib.decompress(data[at - start:at - start + size], 31)) for _, at, size in held]
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in names.items()], list(names))

        held = []
        for batch in batches:
            for place in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if held and (place[0] != held[0][0] or place[1] > held[-1][1] + held[-1][2] or place[1] + place[2] - held[0][1] > RANGE_BYTES):
                    yield read(held)
                    held = []
                held.append(place)
        if held:
            yield read(held)
        reader.close()

    order = ["file", "offset"]
    shape = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, intact boolean" + (", payload binary" if payload else "")
    return found.select("file", "offset", "length").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, shape)


def payloads(records: DataFrame) -> DataFrame:
    """Records with the payload of the response in each revisit of it (as `payload`). A revisit is joined with one row, so a
    payload that most pages share is a hot key of a join with a unique side."""
    first = records.where(F.col("record_type") == "response").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.first("payload").alias("shared"))
    return records.join(first, ["refers_to", "payload_digest"], "left").withColumn("payload", F.coalesce("payload", "shared")).drop("shared").select(*records.columns)


#: What the query returns, in DuckDB over the table `pages`: SHA-1 from hexadecimal digits to letters of five bits.
PAGES_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((
    CAST(('0x' || substr(hex, CAST((i // 4) * 5 + 1 AS BIGINT), 5)) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN p.page_id IS NOT DISTINCT FROM f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id IS NOT DISTINCT FROM f.first_id THEN NULL ELSE f.first_id END AS refers_to
FROM p JOIN f ON p.html = f.html
"""
