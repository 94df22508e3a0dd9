"""A quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Statistics are computed where texts are read; labels, language, source and id are no inputs. Training takes labelled
rows outside the held-out third (crc32 of the id as text, mod 3, is 1), at most SAMPLE of them, those whose ids hash
least; this bound is the only limit, and it holds for what the driver collects. Trees are flattened into arrays and
all rows of a batch walk them at once.

Defined results: null and empty texts, and texts of white space, have statistics of zero and so a score; very long texts
are read whole; without usable labels every score is one half; a score of just one half predicts 1; ids whose labels
differ, and null labels or ids, aren't learnt from; a null id isn't held out; rows that repeat an id are all scored, and
the least of their statistics is learnt from; repeated rows give repeated results, empty tables none; of the table,
doc_id and text alone are read, whatever other columns are named, and keep_good() returns them as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showloom.llm.boosting import Trees, train
from showloom.llm.common import TO_BLANK, only, python_rows, small_batches

SAMPLE = 20_000
SCORES = "doc_id long, held_out boolean, score double, predicted int"
#: Bytes of UTF-8 by kind.
KIND = np.zeros(256, np.int64)
for _kind, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".,;:?'\"()-", b"!", b"#$%&*", b"|<>=_/\\{}[]~^`+@", bytes(range(128, 256)))):
    KIND[list(_bytes)] = _kind + 1
KINDS = 11
STOP = re.compile(rb"[.!?]")
#: Numbers that statistics() gives.
NAMES = 25


def statistics(text: str | None) -> list[float]:
    """NAMES numbers of a text: its size, shares of kinds of bytes, word and line shapes and repetition."""
    data = (text or "").encode()
    if not data.strip():
        return [0.0] * NAMES
    kinds = np.bincount(KIND[np.frombuffer(data, np.uint8)], minlength=KINDS) / len(data)
    words = data.translate(TO_BLANK).split()
    n = len(words)
    if not n:
        return [0.0] * NAMES
    sizes = np.fromiter(map(len, words), np.int64, n)
    distinct = set(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    pairs = sum(map(bytes.__eq__, words, words[1:]))
    counts = np.unique(sizes, return_counts=True)[1]
    lead = np.frombuffer(b"".join([w[:1] for w in words]), np.uint8)
    letters = KIND[lead]
    out = [np.log1p(len(data)), np.log1p(n), *kinds[1:], sizes.mean(), sizes.std(), sizes.max(), len(distinct) / n, len(distinct) / np.sqrt(n), pairs / n]
    out += [len(lines) and len(set(lines)) / len(lines), n / len(lines), len(STOP.findall(data)) / n, counts.max() / n, (letters == 1).mean(), (letters == 2).mean(), ((letters != 1) & (letters != 2) & (letters != 10)).mean()]
    return [float(v) for v in out]


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text, mod 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees for labels.quality from the texts of at most sample labelled rows."""
    small_batches(docs.sparkSession)
    known = labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other")).filter("label = other")
    # No more than sample rows of two numbers: fit for every task.
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (texts,) in python_rows(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    rows = only(docs, "doc_id", "text").join(chosen, "doc_id").select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, x array<double>")
    found = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x")).orderBy("doc_id").collect()  # one row an id: sample rows at most
    return train(np.array([r["x"] for r in found], float).reshape(-1, NAMES), np.array([r["label"] for r in found], float))


def scores(docs: DataFrame, model: Trees) -> DataFrame:
    """SCORES of every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (texts,) in python_rows(batches, "text"):
            score = model.score(np.array([statistics(t) for t in texts], float).reshape(-1, NAMES))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, SCORES)


def keep_good(docs: DataFrame, model: Trees) -> DataFrame:
    """The rows of docs that the model predicts good, all their columns."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (texts,) in python_rows(batches, "text"):
            score = model.score(np.array([statistics(t) for t in texts], float).reshape(-1, NAMES))
            yield part.filter(pa.array(score >= 0.5))

    return docs.mapInArrow(run, docs.schema)
