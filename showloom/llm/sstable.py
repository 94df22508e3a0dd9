"""Token ids in sorted-string-table shards, and their lookup by binary search.

A shard holds documents in ascending key order. Layout (integers little-endian):

    block*          zstd of entries: varint shared prefix, varint rest of key, varint value bytes, rest, value
    block index     per block: varint length of its last key, the key, u64 offset, u32 length, u32 entries
    Bloom filter    u8 number of hashes, then the bits
    footer          u64 offset of the index, u64 offset of the filter, u64 documents, u64 tokens, u32 id width, magic

A key is the document's id, sign flipped and big-endian (empty for a null id, which so sorts first), then the row's
place among the shard's rows of that id. A value is the document's ids, 2 or 4 bytes each, end id included. The
sparse index keeps one key per block of about BLOCK bytes; it, the filter and one block are all that a lookup reads.

Rows are dealt to shards by ranges of (id, hash of the text) and written by the task that encodes them; a shard's
name is the attempt's own and it appears whole by a rename, so a task that runs twice disturbs nothing. Repeated ids are all kept, ordered by the
text's hash, none twice in a block index; rows alike in both come in any order.

Defined results: a null or empty text has the end id alone; a null id is the least; very long texts are encoded whole
and have a block of their own; repeated rows are all written and read; an empty table gives shards without documents
and no rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import json
import math
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showloom.llm.common import SPACES, TO_BLANK, cut, file_system, offsets, only, put_file, running_starts, small_batches, text_slices

MAGIC = b"SLSST01\n"
#: Bytes of values in a block before it is packed; bits of the filter for a document; entries of a task's word table.
BLOCK, BITS, TABLE = 256 << 10, 10, 160_000
HASHES = 7
#: Bytes of text in a shard.
SHARD = 64 << 20
FOOTER = struct.Struct("<QQQQI8s")
SUMMARY = "number long, shard string, n_docs long, n_tokens long"


#: bytes.translate: A-Z to lower case and white space to blanks, or white space alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b in SPACES.encode() else b for b in range(256))
#: Which bytes are stops, letters or digits, for the splitting of words.
STOP, ALNUM = np.isin(np.arange(256), [ord("."), ord(",")]), np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))
LATIN = re.compile("[a-zß-öø-ÿ]+")


#: The normalizer and pre-tokenizer for which words can be encoded apart.
SPLITTING = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def byte_alphabet() -> dict[int, int]:
    """Byte -> character of the byte-level alphabet: printable bytes stand for themselves, the rest follow at 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: b if b in plain else 256 + rest.index(b) for b in range(256)}


class WordEncoder:
    """Ids of texts by a tokenizers file. One that drops white space and never looks across it, as SPLITTING says, is
    applied word by distinct word; any other one to whole texts.

    A stop after a letter or digit and before white space is a token of its own, so it is a word of its own here, and
    A-Z go to lower case first as the tokenizer would have them: words repeat more. A slice of texts becomes distinct
    words and their places; a word is encoded once while one of two tables of TABLE entries holds it.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        spec = json.loads(self.tokenizer.to_str())
        self.by_words = all(spec[k] == v for k, v in SPLITTING.items()) and spec["model"]["type"] == "BPE" and not spec["model"]["dropout"] and all("<|" in t["content"] for t in spec["added_tokens"])
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.alphabet = byte_alphabet()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, 4 bytes each."""
        if len(self.young) > TABLE:
            self.young, self.old = {}, self.young
        young, old, rest, model = self.young, self.old, [], self.tokenizer.model
        for w in [w for w in words if w not in young]:
            if (ids := old.get(w)) is not None:
                young[w] = ids
                continue
            # Letters of which NFC and lower case are plain: one pre-token, in the byte alphabet.
            if w.isalpha() and w.islower():
                found = model.tokenize(w.decode())
            elif len(w) < 64 and LATIN.fullmatch(low := w.decode().lower()):
                found = model.tokenize(low.encode().decode("latin-1").translate(self.alphabet))
            else:
                rest.append(w)
                continue
            young[w] = array("I", [t.id for t in found]).tobytes()
        for w, e in zip(rest, self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
            young[w] = array("I", e.ids).tobytes()
        out = [young[w] for w in words]
        for w in rest:
            if len(w) > 64:
                del young[w]
        return out

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (uint32, no end ids), and where each text's end."""
        if not self.by_words:
            each = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for ids in each for i in ids], np.uint32), np.cumsum([len(ids) for ids in each], dtype=np.int64)
        at = offsets(texts)
        raw = bytes(texts.buffers()[2][int(at[0]) : int(at[-1])]) if texts.buffers()[2] else b""
        at -= at[0]
        named = b"<|" in raw  # perhaps a special token's name, which is one in its own case only
        data = np.frombuffer(raw.translate(TO_BLANK if named else LOWER), np.uint8)
        solid = data != 32
        first = np.zeros(len(data) + 1, bool)  # of a text
        first[at[:-1]] = True
        breaks = np.ones(len(data), bool)
        breaks[1:] = ~solid[:-1]
        breaks |= first[:-1]
        if not named and len(data):
            ends = np.ones(len(data), bool)
            ends[:-1] = ~solid[1:] | first[1:-1]
            stops = STOP[data] & ends
            stops[1:] &= ALNUM[data[:-1]]
            stops[0] = False
            breaks |= stops & ~first[:-1]
        starts = np.flatnonzero(breaks & solid)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        packed = data[solid]
        begins_at = np.append((np.cumsum(solid) - 1)[starts], len(packed)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(begins_at), pa.py_buffer(packed)]).dictionary_encode()
        parts, place = self.ids_of(words.dictionary.to_pylist()), words.indices.to_numpy()
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat, begins = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(sizes) - sizes
        each = sizes[place]
        ends = np.cumsum(each)
        ids = flat[np.repeat(begins[place] - (ends - each), each) + np.arange(ends[-1])]
        return ids, np.append(0, ends)[np.searchsorted(starts, at[1:])]


@lru_cache(maxsize=1)
def encoder_at(path: str, end_id: int) -> WordEncoder:
    """A Python worker's encoder, its tables kept for all of the worker's tasks."""
    return WordEncoder(path, end_id)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return n, at


def key_of(doc_id: int | None, place: int = 0) -> bytes:
    return (b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))) + (varint(place) if place else b"")


def id_of(key: bytes) -> int | None:
    return None if len(key) < 8 else struct.unpack(">Q", key[:8])[0] - (1 << 63)


class Writer:
    """Writes one shard to an open file; add() takes ascending ids, finish() ends it."""

    def __init__(self, out: pa.NativeFile, width: int):
        self.out, self.width, self.at, self.index, self.pack = out, width, 0, bytearray(), zstandard.ZstdCompressor(level=1)
        self.block, self.in_block, self.last, self.doc, self.place = bytearray(), 0, b"", (), 0
        self.hashes: list[bytes] = []
        self.docs = self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.place = self.place + 1 if self.doc == (doc_id,) else 0
        self.doc = (doc_id,)
        key = key_of(doc_id, self.place)
        shared = 0 if not self.in_block else next((i for i, (a, b) in enumerate(zip(key, self.last, strict=False)) if a != b), min(len(key), len(self.last)))
        value = ids.astype(f"<u{self.width}").tobytes()
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.in_block, self.last, self.docs, self.tokens = self.in_block + 1, key, self.docs + 1, self.tokens + len(ids)
        if not self.place:
            self.hashes.append(struct.pack("<Q", xxhash.xxh64_intdigest(key)))
        if len(self.block) >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.in_block:
            data = self.pack.compress(bytes(self.block))
            self.index += varint(len(self.last)) + self.last + struct.pack("<QII", self.at, len(data), self.in_block)
            self.out.write(data)
            self.at, self.block, self.in_block = self.at + len(data), bytearray(), 0

    def finish(self) -> None:
        self.flush()
        bits = max(64, BITS * len(self.hashes) + 7 & ~7)
        field, a = np.zeros(bits, bool), np.frombuffer(b"".join(self.hashes), "<u8")
        for i in range(HASHES):
            field[(a % np.uint64(bits) + np.uint64(i) * ((a >> np.uint64(32) | np.uint64(1)) % np.uint64(bits))) % np.uint64(bits)] = True
        bloom = bytes([HASHES]) + np.packbits(field).tobytes()
        self.out.write(bytes(self.index) + bloom + FOOTER.pack(self.at, self.at + len(self.index), self.docs, self.tokens, self.width, MAGIC))


class Shard:
    """A shard's file, open for lookups and for reading in order. Only the index and the filter are held."""

    def __init__(self, folder: str, name: str):
        fs, path = file_system(folder)
        self.file = fs.open_input_file(f"{path}/{name}")
        size = self.file.size()
        index, bloom, self.docs, self.tokens, self.width, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{name} isn't a shard")
        tail = self.file.read_at(size - FOOTER.size - index, index)
        field = tail[bloom - index :]
        self.bits, self.unpack = np.frombuffer(field, np.uint8)[1:], zstandard.ZstdDecompressor()
        self.keys: list[bytes] = []
        self.places: list[tuple[int, int, int]] = []
        at = 0
        while at < bloom - index:
            n, at = read_varint(tail, at)
            self.keys.append(tail[at : at + n])
            self.places.append(struct.unpack_from("<QII", tail, at + n))
            at += n + 16

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        offset, size, entries = self.places[i]
        data, at, key = self.unpack.decompress(self.file.read_at(size, offset)), 0, b""
        for _ in range(entries):
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            n, at = read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest + n
            yield key, np.frombuffer(data, f"<u{self.width}", n // self.width, at - n).astype("<u4")

    def rows(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.places)):
            for key, ids in self.block(i):
                yield id_of(key), ids

    def may_hold(self, doc_id: int | None) -> bool:
        bits = len(self.bits) * 8
        a = xxhash.xxh64_intdigest(key_of(doc_id))
        step = (a >> 32 | 1) % bits
        return all(self.bits[p >> 3] >> (7 - (p & 7)) & 1 for p in ((a % bits + i * step) % bits for i in range(HASHES)))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of all rows with this id: filter, binary search in the sparse index, then the blocks that hold it."""
        if not self.may_hold(doc_id):
            return []
        first, low, high = key_of(doc_id), 0, len(self.keys)
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.keys[middle] < first else (low, middle)
        out: list[np.ndarray] = []
        for i in range(low, len(self.keys)):
            held = [(id_of(k), ids) for k, ids in self.block(i)]
            out += [ids for d, ids in held if d == doc_id]
            if held[-1][0] != doc_id:
                break
        return out


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int, shards: int | None = None) -> DataFrame:
    """Writes docs (doc_id, text) to shards in folder, which is new and shared; returns SUMMARY, one row a shard, whose
    numbers ascend with the ids.

    A row is dealt by a range of (doc_id, hash of text), so no single id's rows have to meet in one task. There are as many shards as the session has shuffle partitions, and more where a shard
    would have over SHARD bytes of text. The returned rows are computed: the files are there.
    """
    spark, docs = docs.sparkSession, only(docs, "doc_id", "text")
    small_batches(spark)
    text = F.coalesce(docs["text"], F.lit(""))
    if not shards:
        size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / SHARD))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        name, found = f"shard-{number:06d}-{uuid.uuid4().hex}.sst", []

        def write(out: pa.NativeFile) -> None:
            encoder = encoder_at(path, end_id)
            writer = Writer(out, encoder.width)
            end = np.array([end_id], np.uint32)
            for part, texts in text_slices(batches, "text"):
                ids, ends = encoder.encode(texts)
                for doc_id, start, stop in zip(part.column(0).to_pylist(), np.append(0, ends[:-1]), ends, strict=True):
                    writer.add(doc_id, np.concatenate([ids[start:stop], end]))
            writer.finish()
            found.append((number, name, writer.docs, writer.tokens))

        put_file(folder, name, write)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["number", "shard", "n_docs", "n_tokens"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h")).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return cut(rows.select("doc_id", "text").mapInArrow(run, SUMMARY))  # a written table of one small row a shard


def read_shards(summary: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files in ascending order of id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for doc_id, ids in Shard(folder, name).rows():
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                for i in range(0, len(rows), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 50_000], strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    starts = summary.filter("n_docs > 0").join(running_starts(summary, "number", "n_tokens"), "number").select("shard", F.col("first").alias("start"))
    n = max(1, int(summary.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return starts.repartition(n, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
