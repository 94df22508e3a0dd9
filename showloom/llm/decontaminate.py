"""Benchmark decontamination by size-partitioned MinHash containment search, verified by exact shingle containment.

An item's shingles are the distinct runs of SHINGLE words (words ``[^\x20\x09-\x0D]+`` in lower case). An item of fewer
words is one shingle of its own length, looked up among the documents' runs of that length. A shingle's hash is a mix of its words' numbers. The sketch of an item of n shingles is its bottom-k
MinHash, the k least hashes, with k = n - ceil(threshold * n) + 1: who holds the threshold's share of the item lacks at
most n - ceil(threshold * n) of its shingles, hence holds one of any k. So the search misses nothing, whatever a
document's length (its recall is 1, which tests measure against brute force).

Items are put into partitions by n, each a power of two wide, and each partition is searched with sketches of its own: a
document's sketch for a partition is what it has up to the greatest hash in the partition's item sketches, which for
long items is a fifth of its shingles, and for the shortest ones nearly all. Partitions of items that need more shingles
than a document has are left out. Candidates are then verified word by word: the share of the item's distinct shingles
that the document holds, counted without hashes, has to reach the threshold.

The benchmark is the side of bounded size: it is read in blocks of MOST bytes of text, whose number is known from one
aggregate and to which rows are dealt by id and text, equal ones as one with their number; one block at a time is on the driver, and each is a pass over the documents. Documents are read once a block,
never shuffled and never compared with each other.

Defined results: null or empty texts hold nothing, items without words are held by nothing; items with a null id are left out; a share of just the
threshold counts; rows repeated in either table give repeated results; very long texts are searched whole; without
documents or items there are no pairs, and clean() keeps every row; other columns, whatever their names, are kept by
clean() and not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showloom.llm.common import cut, python_rows, words_of

SHINGLE, THRESHOLD = 5, 0.8
#: UTF-8 bytes of benchmark text in a block: about ten times as much in a worker.
MOST = 8 << 20
PAIRS = "doc_id long, item_id long, containment double"


def words(text: str | None) -> list[bytes]:
    return words_of(text.lower() if text else text)


def hashed(runs: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of runs (uint32)."""
    out = np.full(len(runs), 0x9E3779B97F4A7C15, np.uint64)
    for column in runs.T:
        out = (out ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


def partition_of(size: int) -> int:
    return int(math.log2(size))


@dataclass
class Partition:
    """Sketches of items of like sizes: sorted hashes, where each one's owners start among owners, the least size."""

    hashes: np.ndarray
    starts: np.ndarray
    owners: np.ndarray
    least: int


class Items:
    """Sketches of benchmark items by size partition, and their shingles for verification."""

    def __init__(self, items: list[tuple], threshold: float = THRESHOLD, n: int = SHINGLE):
        self.threshold, self.n = threshold, n
        self.vocabulary: dict[bytes, int] = {}
        self.short: dict[int, dict[bytes, list[int]]] = defaultdict(dict)  # by number of words
        self.ids: list[int] = []
        self.times: list[int] = []  # rows of each item
        self.runs: list[np.ndarray] = []  # of each item: its distinct shingles
        #: hashes that search() has looked up
        self.looked = 0
        sketches: dict[int, list[np.ndarray]] = defaultdict(list)
        owners: dict[int, list[int]] = defaultdict(list)
        for i, text, *rows in items:  # and perhaps how many rows there are of it
            times = rows[0] if rows else 1
            if i is None or not (w := words(text)):
                continue
            if len(w) < n:
                self.short[len(w)].setdefault(b" ".join(w), []).extend([i] * times)
                continue
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary) + 1)
            runs = np.unique(self.numbered(w), axis=0)
            sketches[p := partition_of(len(runs))].append(np.sort(np.unique(hashed(runs)))[: len(runs) - self.needed(len(runs)) + 1])
            owners[p].append(len(self.ids))
            self.ids.append(i)
            self.times.append(times)
            self.runs.append(runs)
        self.partitions = []
        for p, of in sorted(sketches.items()):
            every = np.concatenate(of)
            order = np.argsort(every, kind="stable")
            hashes, starts = np.unique(every[order], return_index=True)
            self.partitions.append(Partition(hashes, np.append(starts, len(every)), np.repeat(owners[p], [len(x) for x in of])[order], min(len(self.runs[k]) for k in owners[p])))

    def needed(self, size: int) -> int:
        """Shingles of an item of this size that reach the threshold."""
        return math.ceil(self.threshold * size - 1e-9)

    def numbered(self, w: list[bytes]) -> np.ndarray:
        """The runs of n words that the vocabulary covers, as numbers of words."""
        ids = np.fromiter(map(self.vocabulary.get, w, [0] * len(w)), np.uint32, len(w))
        runs = np.lib.stride_tricks.sliding_window_view(ids, self.n)
        return runs[runs.all(axis=1)]

    def candidates(self, runs: np.ndarray, hashes: np.ndarray) -> set[int]:
        """Items of whose sketch a document with these shingles has a hash (hashes ascend, none twice)."""
        found: set[int] = set()
        for p in self.partitions:
            if len(runs) < self.needed(p.least):
                continue
            own = hashes[: np.searchsorted(hashes, p.hashes[-1], side="right")]
            self.looked += len(own)
            at = np.searchsorted(p.hashes, own)
            for k in at[p.hashes[at] == own]:
                found.update(p.owners[p.starts[k] : p.starts[k + 1]].tolist())
        return found

    def search(self, text: str | None) -> list[tuple[int, float]]:
        """(item, containment) of each item that the text holds at the threshold."""
        w = words(text)
        out = [(i, 1.0) for m, known in self.short.items() for run in {b" ".join(w[k : k + m]) for k in range(len(w) - m + 1)} for i in known.get(run, ())]
        if len(w) < self.n:
            return sorted(out)
        runs = self.numbered(w)
        if not len(runs) or not (found := self.candidates(runs, np.unique(hashed(runs)))):
            return sorted(out)
        held = set(map(bytes, np.ascontiguousarray(runs).view(f"V{4 * self.n}").ravel()))
        for k in found:
            own = np.ascontiguousarray(self.runs[k]).view(f"V{4 * self.n}").ravel()
            if (n := sum(map(held.__contains__, map(bytes, own)))) >= self.needed(len(own)):
                out += [(self.ids[k], n / len(own))] * self.times[k]
        return sorted(out)


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str, int]]]:
    """The benchmark (item_id, text and how many rows are alike) in blocks of about MOST bytes, one by one. Their number
    is known before anything is collected."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).filter("item_id is not null and text is not null")
    rows = cut(rows.groupBy("item_id", "text").agg(F.count("*").alias("times")))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / MOST))
    deal = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield [tuple(r) for r in (rows if n == 1 else rows.filter(deal == k)).collect()]


def find_pairs(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, containment: every document and item with the threshold's share of the item's shingles."""

    def one(items: Items) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = sent.value
            for _, (ids, texts) in python_rows(batches, "doc_id", "text"):
                found = [(d, i, c) for d, t in zip(ids, texts, strict=True) for i, c in held.search(t)]
                d, i, c = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(c, pa.float64())], ["doc_id", "item_id", "containment"])

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PAIRS)

    return reduce(DataFrame.unionByName, [one(Items(block, threshold)) for block in blocks(benchmark)])


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that hold no benchmark item, all their columns."""
    for k, block in enumerate(blocks(benchmark)):
        docs = cut(docs) if k else docs  # so that a task holds one block
        sent = docs.sparkSession.sparkContext.broadcast(Items(block, threshold))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for part, (texts,) in python_rows(batches, "text"):
                yield part.filter(pa.array([not sent.value.search(t) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
