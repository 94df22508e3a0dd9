"""WARC archives with revisit records, and a two-level capture index over them.

Archive files hold one gzip member per record, a warcinfo record first. A record's id is made of its place, so none is
used twice; the page's id, and that of the response that a revisit refers to, are in header fields of their own.
Captures are sorted by URL key (host labels reversed, then path and query; then time) into compressed blocks of LINES
lines, many blocks to an index shard; the shard ends with its block directory, the first key, the place and the size of
each block, and a footer that tells where that starts. A lookup knows the first key of each shard; it finds the shard,
then the block in the shard's directory, by bisection, reads the block's range, and then the record's range. Reading
everything back goes the same way: directories, blocks, records in the order of their places in each file.

Pages stay where they are read: only digests are grouped, and the ids of those that several pages share are sent to all
tasks, if there are no more than SENT of them; if there are, pages are joined with them by digest. Shards have about
CAPTURES captures, tasks that read records about READ.

Of records with equal payloads of at least LEAST bytes, that with the smallest page_id is the response and the others
revisit it. Defined results: a null html is an empty payload; a null url has the key "-"; rows that repeat both
page_id and payload are each written as the first of them is; null page_ids are never referred to unless nothing
else holds the payload, and then each such row is a response; of equal payloads, ties don't occur, as the smallest id is one
page's; very long payloads are written whole; an empty table gives files without pages and no rows; other columns,
whatever their names, aren't read. All records have the date DATE, as pages have none. A file's name is the writing
attempt's own, so a task that runs again leaves at most a file that nothing refers to.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import math
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from showloom.llm.common import cut, file_system, only, put_file, python_rows

LEAST, LINES = 100, 1024
SENT, CAPTURES, READ = 200_000, 1 << 20, 1 << 16
MAGIC = b"SLCDX01\n"
FOOTER = "<QQ8s"
DATE, STAMP = "2024-01-01T00:00:00Z", "20240101000000"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "urlkey string, page_id long, url string, record_type string, file string, offset long, length long"
DIRECTORY = "first string, shard string, offset long, length long, lines long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
PAGE_ID, REFERS_TO = "Showloom-Page-Id", "Showloom-Refers-To-Page-Id"
BAD = re.compile(r"[\x00-\x20\x7f]")


def url_key(url: str | None) -> str:
    """com,example,www:8080)/path?query of http://www.example.com:8080/path?query#part, lower-case; "-" for none."""
    if not url or "://" not in url:
        return "-" if not url else f"-){quoted(url)}"
    rest = url.split("://", 1)[1].split("#", 1)[0]
    host = re.match(r"[^/?]*", rest)[0]
    name, _, port = host.rpartition("@")[2].partition(":")
    port = f":{port}" if port and port not in ("80", "443") else ""
    return quoted((",".join(reversed(name.rstrip(".").split("."))) + port + ")" + (rest[len(host) :] or "/")).lower())


def quoted(text: str) -> str:
    return BAD.sub(lambda m: f"%{ord(m[0]):02X}", text)


def urn(file: str, offset: int) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{offset}').urn}>"


def member(head: list[str], block: bytes) -> bytes:
    lines = ["WARC/1.1", *head, f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def info(file: str) -> bytes:
    """The record that a file starts with."""
    head = ["WARC-Type: warcinfo", f"WARC-Record-ID: {urn(file, 0)}", f"WARC-Date: {DATE}", f"WARC-Filename: {file}", "Content-Type: application/warc-fields"]
    return member(head, b"software: showloom\r\nformat: WARC File Format 1.1\r\n")


def record(record_id: str, page_id: int | None, url: str | None, html: str, digest: str, refers_to: int | None) -> bytes:
    """A record's gzip member."""
    payload = html.encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {quoted(url)}"] if url else []
    head += [f"{PAGE_ID}: {page_id}"] if page_id is not None else []
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    head += [f"{REFERS_TO}: {refers_to}", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []
    return member(head, block)


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of a record, headers of its HTTP message, payload as stored."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def number(text: str | None) -> int | None:
    return int(text) if text else None


def row_of(member: bytes) -> tuple:
    """RECORD's columns of a stored record; a stored payload is checked against its digest."""
    fields, http, payload = parse(member)
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload doesn't match its digest")
    return number(fields.get(PAGE_ID)), int(http["Content-Length"]), digest, kind, number(fields.get(REFERS_TO))


def write_archive(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, html) to WARC files in folder; returns CAPTURE, one row a record, already computed."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = only(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    many = F.octet_length("html") >= LEAST
    first = cut(rows.filter(many).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("digest", "first"))
    # Past SENT, the right side is a written table, so Spark can split a digest that many rows share.
    joined = rows.join(F.broadcast(first) if first.count() <= SENT else first, "digest", "left").select("page_id", "url", "html", "digest", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, found = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", []

        def write(out: pa.NativeFile) -> None:
            out.write(start := info(name))
            at = len(start)
            for _, columns in python_rows(batches, "page_id", "url", "html", "digest", "refers_to"):
                for page_id, url, text, digest, refers_to in zip(*columns, strict=True):
                    data = record(urn(name, at), page_id, url, text, digest, refers_to)
                    out.write(data)
                    found.append((url_key(url), page_id, url, "response" if refers_to is None else "revisit", name, at, len(data)))
                    at += len(data)

        first_batch = next(batches, None)
        if first_batch is None:
            return
        batches = chain_one(first_batch, batches)
        put_file(folder, name, write)
        schema = pa.schema([("urlkey", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        for i in range(0, len(found), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[i : i + 20_000], strict=True), schema.types, strict=True)], schema=schema)

    return cut(joined.mapInArrow(run, CAPTURE))


def chain_one(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sorts captures by URL key into index shards in folder; returns DIRECTORY, one row a block, already computed."""
    n = partitions(captures.sparkSession, captures.count(), CAPTURES)
    order = ["urlkey", "page_id", "file", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, blocks = f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.cdx.gz", []

        def write(out: pa.NativeFile) -> None:
            at, lines = 0, []

            def flush() -> None:
                nonlocal at, lines
                if lines:
                    data = gzip.compress("".join(lines).encode(), 6, mtime=0)
                    out.write(data)
                    blocks.append((lines[0].split(" ", 1)[0], name, at, len(data), len(lines)))
                    at, lines = at + len(data), []

            for _, columns in python_rows(batches, "urlkey", "page_id", "url", "record_type", "file", "offset", "length"):
                for key, page_id, url, kind, file, offset, length in zip(*columns, strict=True):
                    lines.append(f"{key} {STAMP} {json.dumps({'page_id': page_id, 'url': url, 'type': kind, 'filename': file, 'offset': offset, 'length': length})}\n")
                    if len(lines) >= LINES:
                        flush()
            flush()
            directory = gzip.compress(json.dumps([(first, offset, length) for first, _, offset, length, _ in blocks]).encode(), 6, mtime=0)
            out.write(directory + struct.pack(FOOTER, at, len(directory), MAGIC))

        put_file(folder, name, write)
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*blocks, strict=True)], ["first", "shard", "offset", "length", "lines"])

    return cut(captures.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, DIRECTORY))


def partitions(spark: SparkSession, rows: int, each: int) -> int:
    """As many as the session's shuffles have, or more for about so many rows each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / each))


def block_lines(data: bytes) -> Iterator[tuple[str, dict]]:
    for line in gzip.decompress(data).decode().split("\n")[:-1]:
        key, _, rest = line.split(" ", 2)
        yield key, json.loads(rest)


def captures_of(directory: DataFrame, folder: str) -> DataFrame:
    """CAPTURE, from the index's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        for _, columns in python_rows(batches, "shard", "offset", "length"):
            for shard, offset, length in zip(*columns, strict=True):
                with fs.open_input_file(f"{path}/{shard}") as file:
                    rows = [(k, x["page_id"], x["url"], x["type"], x["filename"], x["offset"], x["length"]) for k, x in block_lines(file.read_at(length, offset))]
                types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["urlkey", "page_id", "url", "record_type", "file", "offset", "length"])

    return directory.mapInArrow(run, CAPTURE)


#: Bytes of an archive file that one task reads in turn.
SPAN = 8 << 20


def read_records(captures: DataFrame, folder: str, n: int) -> DataFrame:
    """RECORD of each capture, by range reads in ascending order of place, in n tasks; a task has spans of files, not
    whole ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, path), name, file = file_system(folder), None, None
        for _, columns in python_rows(batches, "file", "offset", "length"):
            rows = []
            for own, offset, length in zip(*columns, strict=True):
                if own != name:
                    name, file = own, fs.open_input_file(f"{path}/{own}")
                rows.append(row_of(file.read_at(length, offset)))
            if rows:
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    span = F.floor(F.col("offset") / SPAN)
    return captures.select("file", "offset", "length", span.alias("span")).repartition(n, "file", "span").sortWithinPartitions("file", "offset").mapInArrow(run, RECORD)


class Lookup:
    """Captures and payloads by URL. Holds a key for each index shard, and the directories of KEPT shards."""

    KEPT = 16

    def __init__(self, directory: DataFrame, folder: str):
        rows = directory.groupBy("shard").agg(F.min("first").alias("first")).collect()  # one small row a shard
        self.shards = sorted((r["first"].encode(), r["shard"]) for r in rows)
        self.fs, self.path = file_system(folder)
        self.directories: dict[str, list[tuple[bytes, int, int]]] = {}

    def read(self, name: str, offset: int, length: int) -> bytes:
        with self.fs.open_input_file(f"{self.path}/{name}") as file:
            return file.read_at(length, offset)

    def directory(self, shard: str) -> list[tuple[bytes, int, int]]:
        """First key, place and size of each of a shard's blocks."""
        if shard not in self.directories:
            with self.fs.open_input_file(f"{self.path}/{shard}") as file:
                offset, length, magic = struct.unpack(FOOTER, file.read_at(size := struct.calcsize(FOOTER), file.size() - size))
                if magic != MAGIC:
                    raise ValueError(f"{shard} isn't an index shard")
                rows = json.loads(gzip.decompress(file.read_at(length, offset)))
            if len(self.directories) >= self.KEPT:
                self.directories.pop(next(iter(self.directories)))
            self.directories[shard] = [(first.encode(), at, size) for first, at, size in rows]
        return self.directories[shard]

    @staticmethod
    def from_key(firsts: list[tuple], key: bytes) -> Iterator[tuple]:
        """Of entries in order of their first keys, those that may hold key."""
        i = max(0, bisect.bisect_left(firsts, (key,)) - 1)
        while i < len(firsts) and firsts[i][0] <= key:
            yield firsts[i]
            i += 1

    def captures(self, url: str) -> list[dict]:
        key = url_key(url)
        out: list[dict] = []
        for _, shard in self.from_key(self.shards, key.encode()):
            for _, offset, length in self.from_key(self.directory(shard), key.encode()):
                out += [x for k, x in block_lines(self.read(shard, offset, length)) if k == key]
        return out

    def payload(self, capture: dict) -> bytes:
        return parse(self.read(capture["filename"], capture["offset"], capture["length"]))[2]


def archive(pages: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Writes archive and index; returns the block directory and what reading everything back gives."""
    captures = write_archive(pages, folder)
    directory = write_index(captures, folder)
    return directory, read_records(captures_of(directory, folder), folder, partitions(pages.sparkSession, captures.count(), READ))
