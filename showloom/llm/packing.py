"""Packing documents into sequences of one size: concatenate and cut.

Pass one: each task encodes its documents one after another and writes, with their ids, the task's number and how many of
the task's tokens are before them. Pass two: prefix sums over the tasks' totals, in two steps (blocks of tasks, then tasks
of a block), say where a task's tokens start among all tokens. The stream of all tokens is then cut at every multiple of
the size, so no sequence but the last is short, nothing is sorted and texts are never shuffled.

A piece is what one sequence has of one document. Sequences themselves are put together where their tokens are read; only a
sequence that is cut by the edge of a task leaves boundary records, which are joined by its number.

Defined results: a null or empty text has the end id alone; a null id is kept; repeated rows are packed each for itself; a
very long text is encoded whole and goes over as many sequences as it takes; a table without rows has no sequences; other
columns, whatever their names, aren't read. The order of documents is that of the tasks and their rows, fixed by pass one's
files. The last sequence is padded to the size, unless its length is a power of two.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showloom.llm.common import fresh_dir, only, running_starts, text_slices

SIZE = 2048
#: Tasks whose starts are broadcast at most (24 bytes each); past that they are joined.
SENT = 200_000
#: Texts with so much white space in one piece are encoded by the tokenizer itself; the faster splitting recurses there.
LONG_SPACE = 100_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: How such tokenizers split texts, which bytes stand for themselves in their alphabet.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
PROBES = ["", " ", "a  b ", "\n\n a\t\tb　c", "It's I'LL we've 12,345.67 ...!? _x_", "é 漢字 😀😀 é ​\x00", "x" * 500, "aaaa bbbb" * 20]


class ByteEncoder:
    """Ids of texts by a tokenizers file. For plain byte-level BPE whose ids ascend with its merges, texts go through a
    faster encoder over the same vocabulary, once it agrees on PROBES; any other tokenizer is applied as it is."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        spec = json.loads(self.tokenizer.to_str())
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        self.added = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.fast = self.opened(spec)
        if self.fast and any(self.ids(t) != self.whole(t) for t in PROBES):
            self.fast = None

    def opened(self, spec: dict):
        import tiktoken

        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        if not plain or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        merged = [model["vocab"].get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
        if None in merged or merged != sorted(set(merged)):
            return None
        rest = [b for b in range(256) if b not in PLAIN]
        byte = {chr(b): b for b in PLAIN} | {chr(256 + k): b for k, b in enumerate(rest)}
        added = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(map(byte.__getitem__, t)): k for t, k in model["vocab"].items() if t not in added}
        return tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        if self.fast is None or self.added.search(text) or len(text) > LONG_SPACE and re.search(rf"\s{{{LONG_SPACE}}}", text):
            return self.whole(text)
        return self.fast.encode_ordinary(text)


@lru_cache(maxsize=1)
def encoder_at(path: str, end_id: int) -> ByteEncoder:
    return ByteEncoder(path, end_id)


def encode(docs: DataFrame, folder: str, path: str, end_id: int) -> DataFrame:
    """Pass one: doc_id, n, ids (little-endian, 2 or 4 bytes each, end id included), part and before (tokens of the task
    ahead of the document) of every row of docs (doc_id, text), written in folder, which is new and shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, encoder = TaskContext.get().partitionId(), 0, encoder_at(path, end_id)
        kind = f"<u{encoder.width}"
        for rows, texts in text_slices(batches, "text"):
            ids = [np.array([*encoder.ids(t), end_id], kind).tobytes() for t in texts.to_pylist()]
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // encoder.width
            ends = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(n), pa.array(ids, pa.binary()), pa.array(np.full(len(n), part)), pa.array(ends - n)], ["doc_id", "n", "ids", "part", "before"])
            before = int(ends[-1])

    only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n long, ids binary, part long, before long").write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def placed(tokens: DataFrame) -> DataFrame:
    """Pass two: encode()'s rows as doc_id, n, ids, at: where the document starts among all tokens."""
    starts = running_starts(tokens.groupBy("part").agg(F.sum("n").alias("total")), "part", "total")
    few = tokens.select("part").distinct().limit(SENT + 1).count() <= SENT
    return tokens.join(F.broadcast(starts) if few else starts, "part").select("doc_id", "n", "ids", (F.col("first") + F.col("before")).alias("at"))


def numbers(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4")


def pieces(tokens: DataFrame, size: int = SIZE) -> DataFrame:
    """PIECE of every piece of encode()'s documents in sequences of size tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, ids, at in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                data = memoryview(numbers(ids, n).tobytes())
                for begin in [at, *range(at - at % size + size, at + n, size)]:
                    end = min(at + n, begin - begin % size + size)
                    rows.append((doc_id, begin - at, end - begin, zlib.crc32(data[4 * (begin - at) : 4 * (end - at)]), n, begin // size, begin % size))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7, [c.split()[0] for c in PIECE.split(", ")])

    return placed(tokens).mapInArrow(run, PIECE)


def sequences(tokens: DataFrame, size: int = SIZE, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens, ids (array, padded) of every sequence that pieces() has pieces of."""
    folder = fresh_dir(tokens.sparkSession, "sequences")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, end = [], 0, 0  # tokens from first to end that aren't sent yet

        def sent(upto: int) -> Iterator[pa.RecordBatch]:
            nonlocal held, first
            data = np.concatenate([np.zeros(0, "<u4"), *held])
            cuts = np.array([first, *range(first - first % size + size, upto, size), upto], np.int64)
            if upto > first:
                flat = pa.ListArray.from_arrays(pa.array((cuts - first).astype(np.int32)), pa.array(data[: upto - first].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(cuts[:-1] // size), pa.array(cuts[:-1] % size), pa.array(np.diff(cuts)), flat], ["sequence_id", "offset", "length", "ids"])
            held, first = [data[upto - first :]], upto

        for batch in batches:
            for n, ids, at in zip(*[batch.column(k).to_pylist() for k in range(1, 4)], strict=True):
                if at != end:
                    yield from sent(end)
                    held, first = [], at
                held.append(numbers(ids, n))
                end = at + n
            yield from sent(max(first, end - end % size))
        yield from sent(end)

    placed(tokens).mapInArrow(run, "sequence_id long, offset long, length long, ids array<int>").write.parquet(folder)
    found = tokens.sparkSession.read.parquet(folder)
    bounds = found.filter(F.col("length") < size).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("runs"))
    joined = bounds.select("sequence_id", F.flatten("runs.ids").alias("ids")).withColumn("n_tokens", F.size("ids").cast("long"))
    whole = found.filter(F.col("length") == size).select("sequence_id", "ids", F.col("length").alias("n_tokens"))
    power = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    short = F.when(power, 0).otherwise(F.lit(size) - F.col("n_tokens")).cast("int")
    return whole.unionByName(joined).select("sequence_id", "n_tokens", F.concat("ids", F.array_repeat(F.lit(pad_id), short)).alias("ids"))
