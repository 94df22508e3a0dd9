"""SimHash near-duplicates through Gray-order hierarchical indexes.

Fingerprints: A-Z in lower case, words ``[^\x20\x09-\x0D]+``, shingles of SHINGLE words, repeats included (fewer words:
the whole sequence; none: fingerprint zero, linked like any other). A bit is 1 if over half of the shingles' XXH64
(seed 42) have it. Fingerprints link at MOST or fewer differing bits; a component is what links reach.

1. Texts become fingerprints where they are read; equal fingerprints become one class with its least doc_id. From here
   on only classes move, so a group of exact copies counts once, however large.
2. The index's first level is by whole bit runs: with the 64 bits in m runs, two fingerprints within MOST bits agree in
   m - MOST runs at least, so each class goes to a bucket for each choice of m - MOST runs, and no link is missed,
   whatever m is. m is the least that makes random buckets of BUCKET classes at most. Classes of buckets above CAP are
   dealt again by choices of RUNS runs; what is still above CAP then goes to chunks by hash, of which each pair is
   searched by itself. So a hot bucket becomes many searches of bounded size that find all its links.
3. Buckets, each in Gray order, are ranges of what a task reads. All its links are found by one Gray-order index over
   some thousands of rows: leaves are runs of LEAF fingerprints, nodes runs of FAN children; a node keeps the bits that
   all below it share, less those its parent keeps, and the range of its buckets. Differences from the shared bits add
   up on the way down, and a node where they exceed MOST, or that has nothing of the asked bucket behind the asking row,
   is dropped with all below it; in a leaf that is reached what is left is compared. Leaves are pairs: two fingerprints
   share half of the bits that the bucket leaves open, so a leaf's pattern alone keeps nearly all that isn't near from
   being compared (on the 9,296 different fingerprints of sf0.1, whose buckets hold 2.4 on average: 10,584 comparisons,
   32,706 with the patterns off, which is each bucket by itself). There is no
   other search, at any size. A search returns a spanning forest of its links, not its pairs.
4. Components of the forests' edges by large and small stars; the least doc_id of a component names it.

Defined results: a null text is an empty one; very long texts are read whole; a bit set in just half of the hashes is 0;
rows that repeat a doc_id, with the same or another text, are each fingerprinted, and link; a row with a null doc_id
gets its fingerprint, links nothing, and has no component; an empty table gives no rows; other columns, whatever their
names, aren't read, and keep_one() returns them as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showloom.llm.common import cut, python_rows, small_batches, words_of
from showloom.llm.components import components

SHINGLE, SEED, MOST = 4, 42, 4
BUCKET, CAP, LEAF, FAN = 256, 1 << 14, 2, 4
#: Runs of the second dealing; rows of one index, at least; queries that descend together; rows of a shuffle partition.
RUNS, ROWS, QUERIES, PARTITION = 8, 1 << 15, 1024, 1 << 22
EDGES = "a long, b long"


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words).lower()
    if len(words) <= n:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[n - 1 :].tolist(), strict=False)], np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, fp (64 bits as a long) of every row of docs (doc_id, text), and more columns of longs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (texts,) in python_rows(batches, "text"):
            found = pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), found, *part.columns[2:]], ["doc_id", "fp", *part.schema.names[2:]])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more)
    return rows.mapInArrow(run, ", ".join(["doc_id long", "fp long", *[f"{name} long" for name in rows.columns[2:]]]))


def gray_rank(fp: Column) -> Column:
    """The place of fp in the Gray order of 64-bit numbers, as a long of the same bits."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def bucket_keys(fp: Column, runs: int) -> Column:
    """array<long>: for each choice of runs - MOST of the runs, a number of the choice and of the bits in it."""
    edges = [64 * i // runs for i in range(runs + 1)]
    part = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
    keys = []
    for number, chosen in enumerate(combinations(range(runs), runs - MOST)):
        bits = sum(edges[i + 1] - edges[i] for i in chosen)
        value = reduce(lambda x, i: F.shiftleft(x, edges[i + 1] - edges[i]).bitwiseOR(part[i]), chosen[1:], part[chosen[0]])
        keys.append(value.bitwiseOR(F.lit(number << bits)))
    return F.array(*keys)


def runs_for(classes: int) -> int:
    """The least number of runs at which random buckets hold BUCKET classes at most; 8 runs make 32-bit buckets."""
    return next((m for m in range(MOST + 1, RUNS) if classes <= BUCKET << 64 * (m - MOST) // m), RUNS)


class Forest:
    """Union-find with vectorised joining of many pairs."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.label[a], self.label[b]
        apart = x != y
        if not apart.any():
            return
        codes = np.unique(np.minimum(x, y)[apart] * len(self.label) + np.maximum(x, y)[apart])
        parent: dict[int, int] = {}

        def find(k: int) -> int:
            while (up := parent.get(k, k)) != k:
                parent[k] = k = parent.get(up, up)
            return k

        for code in codes.tolist():
            p, q = sorted(map(find, divmod(code, len(self.label))))
            if p != q:
                parent[q] = p
        change = np.arange(len(self.label))
        for k in parent:
            change[k] = find(k)
        self.label = change[self.label]


class GrayIndex:
    """An index of fingerprints (uint64) in buckets (ascending numbers), each bucket in Gray order."""

    def __init__(self, fps: np.ndarray, buckets: np.ndarray):
        self.fps, self.buckets = fps, buckets
        self.tested = self.compared = 0  # patterns of leaves and nodes, and fingerprints
        starts = np.arange(0, len(fps), LEAF)
        ends = np.append(starts[1:], len(fps)) - 1
        common, any_bit, low, high = np.bitwise_and.reduceat(fps, starts), np.bitwise_or.reduceat(fps, starts), buckets[starts], buckets[ends]
        levels = [(common, ~(common ^ any_bit), low, high)]
        while len(common) > FAN:
            at = np.arange(0, len(common), FAN)
            ends = np.append(at[1:], len(common)) - 1
            common, any_bit, low, high = np.bitwise_and.reduceat(common, at), np.bitwise_or.reduceat(any_bit, at), low[at], high[ends]
            levels.append((common, ~(common ^ any_bit), low, high))
        #: from the top: patterns, the shared bits that the parent doesn't share, first and last bucket
        self.levels = []
        for depth in range(len(levels) - 1, -1, -1):
            pattern, shared, low, high = levels[depth]
            above = levels[depth + 1][1][np.arange(len(pattern)) // FAN] if depth + 1 < len(levels) else np.uint64(0)
            self.levels.append((pattern, shared & ~above, low, high))

    def links(self, queries: np.ndarray, asked: np.ndarray, after: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of queries and of fingerprints behind a place (after) in their asked bucket within MOST bits of each
        other, in parts."""
        for start in range(0, len(queries), QUERIES):
            block, bucket, behind = (x[start : start + QUERIES] for x in (queries, asked, after))
            q, node = (x.ravel() for x in np.indices((len(block), len(self.levels[0][0]))))
            differ, size = np.zeros(len(q), np.uint8), LEAF * FAN ** (len(self.levels) - 1)
            for depth, (pattern, shared, low, high) in enumerate(self.levels):
                if depth:
                    q, differ, size = np.repeat(q, FAN), np.repeat(differ, FAN), size // FAN
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    real = node < len(pattern)
                    q, node, differ = q[real], node[real], differ[real]
                own = bucket[q]
                near = (low[node] <= own) & (own <= high[node]) & ((node + 1) * size - 1 > behind[q])
                q, node, differ = q[near], node[near], differ[near]
                self.tested += len(q)
                differ = differ + np.bitwise_count((block[q] ^ pattern[node]) & shared[node])
                near = differ <= MOST
                q, node, differ = q[near], node[near], differ[near]
            q, place = np.repeat(q, LEAF), (node[:, None] * LEAF + np.arange(LEAF)).ravel()
            left = (place < len(self.fps)) & (place > behind[q])
            q, place = q[left], place[left]
            left = self.buckets[place] == bucket[q]
            q, place = q[left], place[left]
            self.compared += len(q)
            near = np.bitwise_count(block[q] ^ self.fps[place]) <= MOST
            yield q[near] + start, place[near]


def search(fps: np.ndarray, reps: np.ndarray, groups: np.ndarray, across: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the links of each group, by representatives. Rows come by group, side and Gray rank; in a group
    that is across, links are those between its sides 0 and 1, else all."""
    buckets = 2 * groups + side
    asking = np.flatnonzero(~across | (side == 1))
    forest = Forest(len(fps))
    # A link of a group that isn't across is found by the first of its two rows.
    behind = np.where(across, -1, np.arange(len(fps)))
    for a, b in GrayIndex(fps, buckets).links(fps[asking], np.where(across, buckets - 1, buckets)[asking], behind[asking]):
        forest.join(asking[a], b)
    child = forest.label != np.arange(len(fps))
    return reps[child], reps[forest.label[child]]


def keyed(classes: DataFrame, runs: int) -> DataFrame:
    """key, fp, rep: each class in all of its buckets. Keys of different numbers of runs differ."""
    return classes.select("fp", "rep", F.explode(bucket_keys(F.col("fp"), runs)).alias("key")).select(F.col("key").bitwiseOR(F.lit(runs << 56)).alias("key"), "fp", "rep")


def hot_keys(rows: DataFrame) -> DataFrame:
    """key, n: buckets above CAP, and the chunks that each is dealt to."""
    return cut(rows.groupBy("key").count().filter(F.col("count") > CAP).select("key", F.ceil(F.col("count") / CAP).cast("long").alias("n")))


def grouped(classes: DataFrame) -> DataFrame:
    """key, low, high, side, fp, rep: the rows of each group that is searched by itself."""
    plain = [F.lit(0).cast("long").alias(x) for x in ("low", "high", "side")]
    rows = keyed(classes, runs_for(classes.count()))
    hot = hot_keys(rows)
    if hot.isEmpty():
        return rows.select("key", *plain, "fp", "rep")
    out = rows.join(hot, "key", "left_anti").select("key", *plain, "fp", "rep")
    rows = keyed(cut(rows.join(hot, "key", "left_semi").select("fp", "rep").distinct()), RUNS)
    hot = hot_keys(rows)
    if hot.isEmpty():
        return out.unionByName(rows.select("key", *plain, "fp", "rep"))
    n = F.coalesce("n", F.lit(1).cast("long"))
    dealt = rows.join(hot, "key", "left").select("key", "fp", "rep", n.alias("n"), F.pmod(F.xxhash64("fp"), n).alias("own"))
    dealt = dealt.select("key", "fp", "rep", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return out.unionByName(dealt.select("key", low.alias("low"), high.alias("high"), (F.col("own") > low).cast("long").alias("side"), "fp", "rep"))


def find_edges(classes: DataFrame) -> DataFrame:
    """a, b of classes (fp, rep): edges that join the representatives of all fingerprints within MOST bits."""
    rows, group = cut(grouped(classes)), ["key", "low", "high"]
    n = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / PARTITION))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def edges(rows: np.ndarray) -> pa.RecordBatch:
            number = np.cumsum(np.append(False, (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)))
            found = search(rows[4].view(np.uint64), rows[5], number, rows[1] != rows[2], rows[3])
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b"])

        for batch in batches:  # a group is of one or two chunks of about CAP rows, so what is held over is small
            held.append(np.stack([np.asarray(batch.column(i)) for i in range(6)]))
            if sum(x.shape[1] for x in held) >= ROWS:
                rows = np.concatenate(held, axis=1)
                last = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0))
                cut_at = int(last[-1]) + 1 if len(last) else 0
                held = [rows[:, cut_at:]]
                if cut_at:
                    yield edges(np.ascontiguousarray(rows[:, :cut_at]))
        if sum(x.shape[1] for x in held):
            yield edges(np.ascontiguousarray(np.concatenate(held, axis=1)))

    # By unsigned rank: the sign bit is flipped.
    rank = gray_rank(F.col("fp")).bitwiseXOR(F.lit(-(1 << 63)))
    return rows.repartition(n, *group).sortWithinPartitions(*group, "side", rank).mapInArrow(run, EDGES)


def with_components(prints: DataFrame) -> DataFrame:
    """component_id with every row of prints (doc_id, fp), which is written already."""
    classes = cut(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = cut(components(find_edges(classes)))
    named = cut(classes.join(roots, classes["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id")))
    return prints.join(named, "fp", "left")


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id of every row of docs (doc_id, text)."""
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return with_components(cut(fingerprints(docs))).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component.alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component of docs, the row with its least doc_id; all rows without an id. Of rows of that id, only those
    whose text is in the component count, and of these the text that hashes least stays (any of rows alike in both)."""
    text_hash = F.xxhash64("text")
    prints = with_components(cut(fingerprints(docs, text_hash.alias("text_hash"))))
    kept = prints.filter("doc_id = component_id").groupBy("doc_id").agg(F.min("text_hash").alias("text_hash"))
    own = "k" * (1 + max(map(len, docs.columns)))  # a name that docs doesn't have
    kept = kept.select(F.struct("doc_id", "text_hash").alias(own))
    # Joined by id alone (the hashes are no key as they are compared here), so that rows of an id are together already.
    same = (F.col("doc_id") == F.col(own)["doc_id"]) & (text_hash.bitwiseXOR(F.col(own)["text_hash"]) == 0)
    with_id = docs.join(kept, same, "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return with_id.unionByName(docs.filter("doc_id is null"))
