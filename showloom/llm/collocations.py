"""Frequent phrases of up to five words and how tightly their parts go together, mined by pivots.

Words are counted first. What a task then has to know of a word is its count; a table of BUCKETS counts, each the sum over
the frequent words that fall into it, is a bound of that and the same size for any corpus. The pivot of a phrase is its
rarest word by that table (the leftmost of several), which depends on nothing but the phrase.

A text is rewritten for each of its words as pivot: the fragment around it, cut at pieces' ends, at words that no frequent
phrase can hold and at rarer words, four words away at most. Equal fragments of a slice of texts become one with their
number. The NUMBERED most frequent words have numbers of two bytes; other words go along as they are. Fragments are routed
by their pivot's bucket, buckets of few occurrences several to a route. There only phrases that own the pivot are counted,
shorter ones first, and a longer one only where the phrase inside it is frequent. So every phrase is counted in one place, once.

A bucket of over HOT occurrences has a route of its own and is dealt to several groups by the fragments' words; their
counts are sums in part, so all of them go on and are added up.

Defined results: a null or empty text has no words; a null lang is ``und``; repeated rows count each; a table without
rows, or without a phrase that is frequent, gives none; of other columns, whatever their names, nothing is read. Very long
texts are taken whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from showloom.llm.common import cut, offsets, text_slices

MIN_COUNT, LONGEST, PERCENT, TOP = 100, 5, 100, 2000
#: Counts in the table that is broadcast (8 bytes each), and numbered words (of LONG bytes at most).
BUCKETS, NUMBERED, LONG = 1 << 20, 60_000, 64
#: Occurrences of a bucket in one group, of a route on average, and fragments that are mined at once.
HOT, ROUTE, MINED = 1 << 19, 1 << 18, 1 << 18
#: Groups of a language's phrases from which the best are taken first; languages whose sizes are broadcast at most (past
#: that they are joined).
SALTS, LANGS = 64, 10_000
BLANK, CUT = 32, 10
#: bytes.translate: A-Z to lower case, white space to BLANK, what ends a piece to CUT.
FOLD = bytes(b + 32 if 65 <= b <= 90 else BLANK if b in b" \t" else CUT if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
FRAGMENTS = "lang string, route int, salt int, codes binary, rare binary, sizes binary, lefts binary, counts binary"


class Words:
    """The words of texts, as bytes after FOLD: codes of distinct words, and the piece that each word is in."""

    def __init__(self, data: np.ndarray, begins: np.ndarray):
        """begins: where texts begin."""
        solid = (data != BLANK) & (data != CUT)
        first = np.zeros(len(data) + 1, bool)
        first[begins] = True
        start = solid.copy()
        start[1:] &= ~solid[:-1] | first[1:-1]
        at = np.flatnonzero(start)
        self.n, packed = len(at), data[solid]
        ends = np.append(np.cumsum(solid)[at] - 1, len(packed)).astype(np.int32)
        self.piece = np.cumsum((data == CUT) | first[:-1], dtype=np.int32)[at]
        found = pa.Array.from_buffers(pa.binary(), self.n, [None, pa.py_buffer(ends), pa.py_buffer(packed)]).dictionary_encode()
        self.codes, self.distinct = found.indices.to_numpy().astype(np.int64), found.dictionary


@dataclass
class Known:
    """What tasks know of words: counts of buckets, and the most frequent words with their languages, by number from 1."""

    table: np.ndarray
    words: list[tuple[str, bytes]]
    hot: int
    route: int
    numbers: dict[str, dict[bytes, int]] = field(default_factory=dict)

    def number(self, lang: str, words: list[bytes]) -> np.ndarray:
        """Numbers of a language's words, 0 of others."""
        if not self.numbers:
            self.numbers = defaultdict(dict)
            for k, (own, w) in enumerate(self.words):
                self.numbers[own][w] = k + 1
        own = self.numbers.get(lang, {})
        return np.fromiter((own.get(w, 0) for w in words), np.uint16, len(words))

    def routes(self) -> int:
        return max(1, -(-int(self.table.sum()) // self.route))


def by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
    """The words of slices of the batches (lang, text), a language at a time."""
    for part, texts in text_slices(batches, "text"):
        found = part.column(0).dictionary_encode()
        for k, lang in enumerate(found.dictionary.to_pylist()):
            own = texts.filter(pa.array(found.indices.to_numpy() == k)) if len(found.dictionary) > 1 else texts
            at = offsets(own)
            raw = bytes(own.buffers()[2][int(at[0]) : int(at[-1])]) if own.buffers()[2] else b""
            yield lang, Words(np.frombuffer(raw.translate(FOLD), np.uint8), at[:-1] - at[0])


def word_counts(texts: DataFrame, min_count: int) -> DataFrame:
    """lang, word, f of the frequent words of texts (lang, text); the empty word stands for all words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in by_lang(batches):
            n = np.append(np.bincount(words.codes, minlength=len(words.distinct)), words.n)
            every = pa.concat_arrays([words.distinct.cast(pa.string()), pa.array([""])])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), every, pa.array(n)], ["lang", "word", "n"])

    counted = texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    return counted.filter((F.col("f") >= min_count) | (F.col("word") == ""))


def known_of(words: DataFrame) -> Known:
    """Of frequent words (lang, word, f): BUCKETS numbers and NUMBERED words, however many there are."""
    bucket = F.pmod(F.xxhash64(F.concat_ws(" ", "lang", "word")), F.lit(BUCKETS)).cast("int")
    rows = words.groupBy(bucket.alias("bucket")).agg(F.sum("f").alias("f")).toArrow()
    table = np.zeros(BUCKETS, np.int64)
    table[rows.column("bucket").to_numpy()] = rows.column("f").to_numpy()
    best = words.filter(F.octet_length("word") <= LONG).orderBy(F.desc("f"), "lang", "word").limit(NUMBERED).select("lang", "word").collect()
    return Known(table, [(r["lang"], r["word"].encode()) for r in best], HOT, ROUTE)


def blocks(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """data cut at these places (of elements), as binary values."""
    at = (cuts * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))])


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each of the sizes, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def combined(codes: np.ndarray, first: np.ndarray, sizes: np.ndarray, left: np.ndarray, widest: int) -> tuple[np.ndarray, np.ndarray]:
    """Of fragments (their words' codes from first on): one of each kind, and how many there are of it."""
    with np.errstate(over="ignore"):
        key = (left * 16 + sizes).astype(np.uint64)
        for k in range(widest):
            key = key * np.uint64(0x9E3779B97F4A7C15) + np.where(k < sizes, codes[np.minimum(first + k, len(codes) - 1)] + 1, 0).astype(np.uint64)
            key ^= key >> np.uint64(29)
    _, at, kind, number = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    same = (sizes == sizes[at][kind]) & (left == left[at][kind])
    for k in range(widest):
        same &= (k >= sizes) | (codes[np.minimum(first + k, len(codes) - 1)] == codes[np.minimum(first[at][kind] + k, len(codes) - 1)])
    if not same.all():  # two kinds with one key: none are put together
        return np.arange(len(first)), np.ones(len(first), np.int64)
    return at, number


def fragments_of(lang: str, words: Words, known: Known, min_count: int, longest: int) -> pa.RecordBatch | None:
    """The fragments of a slice's words, a row for each route and salt."""
    prefix, table, distinct = lang.encode() + b" ", known.table, words.distinct.to_pylist()
    hashes = np.array([xxhash.xxh64_intdigest(prefix + w, 42) for w in distinct], np.uint64)
    buckets = hashes.view(np.int64) % len(table)
    counts = table[buckets][words.codes] if words.n else np.zeros(0, np.int64)
    frequent, n, far = counts >= min_count, words.n, longest - 1
    joined = np.zeros(n + 1, bool)  # word i goes on from word i - 1
    joined[1:n] = (words.piece[1:] == words.piece[:-1]) & frequent[1:] & frequent[:-1]
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    on_left, on_right, at = frequent.copy(), frequent.copy(), np.arange(n)
    for k in range(1, far + 1):
        there = np.maximum(at - k, 0)
        on_left &= (at >= k) & joined[there + 1] & (counts[there] > counts)
        there = np.minimum(at + k, n - 1)
        on_right &= (at + k < n) & joined[there] & (counts[there] >= counts)
        left += on_left
        right += on_right
    pivots = np.flatnonzero(left + right)
    if not len(pivots):
        return None
    first, sizes, left = pivots - left[pivots], (left + right)[pivots] + 1, left[pivots]
    kept, number = combined(words.codes, first, sizes, left, 2 * far + 1)
    pivots, first, sizes, left = pivots[kept], first[kept], sizes[kept], left[kept]
    bucket, routes = buckets[words.codes[pivots]], known.routes()
    groups = np.where(table[bucket] > known.hot, -(-table[bucket] // known.hot), 1)
    route = np.where(groups > 1, routes + bucket, bucket % routes)
    sums = np.append(np.uint64(0), np.cumsum(hashes[words.codes], dtype=np.uint64))
    salt = ((sums[first + sizes] - sums[first]) >> np.uint64(33)).astype(np.int64) % groups
    order = np.lexsort((salt, route))
    route, salt, first, sizes = route[order], salt[order], first[order], sizes[order]
    starts = np.flatnonzero(np.append(True, (route[1:] != route[:-1]) | (salt[1:] != salt[:-1])))
    cuts = np.append(starts, len(order))
    own = words.codes[spread(first, sizes)]
    codes = known.number(lang, distinct)[own]
    word_cuts = np.append(0, np.cumsum(sizes))[cuts]
    lacking = np.append(0, np.cumsum(codes == 0))[word_cuts]
    rare = pc.binary_join_element_wise(words.distinct.take(pa.array(own[codes == 0])), pa.scalar(b"\n"), pa.scalar(b""))
    ends = offsets(rare) if len(rare) else np.zeros(1, np.int64)
    chars = np.frombuffer(rare.buffers()[2], np.uint8) if len(rare) else np.zeros(0, np.uint8)
    columns = [pa.array([lang] * len(starts), pa.string()), pa.array(route[starts].astype(np.int32)), pa.array(salt[starts].astype(np.int32))]
    columns += [blocks(codes.astype("<u2"), word_cuts), blocks(chars, ends[lacking]), blocks(sizes.astype(np.uint8), cuts), blocks(left[order].astype(np.uint8), cuts), blocks(number[order].astype("<u4"), cuts)]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FRAGMENTS.split(", ")])


def mine(rows: list[tuple], known: Known, min_count: int, longest: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Phrases and their counts, for each length, of rows of FRAGMENTS; what is rarer than min_count goes if its route is
    all here."""
    joined = lambda k, kind: np.frombuffer(b"".join(r[k] for r in rows), kind).astype(np.int64)
    codes, sizes, left, number = joined(3, "<u2"), joined(5, np.uint8), joined(6, np.uint8), joined(7, "<u4")
    rare = pa.array(b"".join(r[4] for r in rows).split(b"\n")[:-1], pa.binary()).dictionary_encode()
    codes[codes == 0] = len(known.words) + 1 + rare.indices.to_numpy().astype(np.int64)
    names = pa.concat_arrays([pa.array([b"", *[w for _, w in known.words]], pa.binary()), rare.dictionary])
    end = np.cumsum(sizes)
    start = end - sizes  # of each fragment
    pivot, routes = start + left, known.routes()
    least = np.repeat([min_count if r[1] < routes else 0 for r in rows], [len(r[5]) for r in rows])
    every = np.arange(len(start))
    of = np.concatenate([every[pivot > start], every[pivot + 1 < end]])  # fragment of each window of two words
    first = np.concatenate([pivot[pivot > start] - 1, pivot[pivot + 1 < end]])
    key = codes[first] * len(names) + codes[first + 1]
    for size in range(2, longest + 1):
        if not len(of):
            return
        _, at, phrase = np.unique(key, return_index=True, return_inverse=True)
        total = np.bincount(phrase, number[of], len(at)).astype(np.int64)
        frequent = total >= least[of[at]]
        if frequent.any():
            begin = first[at[frequent]]
            yield pc.binary_join_element_wise(*[names.take(pa.array(codes[begin + k])) for k in range(size)], pa.scalar(b" ")), total[frequent]
        held = frequent[phrase]
        of, first, phrase = of[held], first[held], phrase[held]
        on = first + size < end[of]
        back = (first + size - 1 == pivot[of]) & (first > start[of])
        key = phrase * len(names) * 2
        key = np.concatenate([key[on] + 2 * codes[first[on] + size], key[back] + 2 * codes[first[back] - 1] + 1])
        of, first = np.concatenate([of[on], of[back]]), np.concatenate([first[on], first[back] - 1])


def phrases(texts: DataFrame, words: DataFrame, min_count: int, longest: int) -> DataFrame:
    """lang, phrase, f of the phrases of 2 to longest words that are frequent in texts (lang, text)."""
    sent, most = texts.sparkSession.sparkContext.broadcast(known_of(words)), MINED

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, found in by_lang(batches):
            if rows := fragments_of(lang, found, sent.value, min_count, longest):
                yield rows

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                for found, n in mine(held, sent.value, min_count, longest):
                    yield pa.RecordBatch.from_arrays([pa.array([held[0][0]] * len(n), pa.string()), found.cast(pa.string()), pa.array(n)], ["lang", "phrase", "n"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if last and (row[0] != last[0] or size >= most and row[:3] != last):
                    yield from done()
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[5]), row[:3]
        yield from done()

    routed = texts.mapInArrow(rewrite, FRAGMENTS).repartition("lang", "route", "salt").sortWithinPartitions("lang", "route", "salt")
    mined = routed.mapInArrow(local, "lang string, phrase string, n long")
    return mined.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count)


def scored(frequent: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases among frequent (lang, phrase, f) that no longer one explains."""
    found = frequent.filter(F.instr("phrase", " ") > 0).withColumn("w", F.split("phrase", " ")).withColumnRenamed("f", "a")
    join = lambda first, n: F.array_join(F.slice("w", first, n), " ")
    cuts = found.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("first"), join(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    of = lambda part, name: frequent.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"]).join(sizes, "lang")
    score = F.expr("CAST(CAST(1000 AS DECIMAL(38, 0)) * a * n DIV (CAST(l AS DECIMAL(38, 0)) * r) AS BIGINT)")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inside = found.filter(F.size("w") > 2).select("lang", "a", F.explode(F.array(join(F.lit(1), F.size("w") - 1), join(F.lit(2), F.size("w") - 1))).alias("phrase"))
    longer = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(longer, ["lang", "phrase"], "left").filter(f"longer is null or 100 * longer < {percent} * a")
    return left.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, percent: int = PERCENT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first top phrases by score, of docs (lang, text)."""
    texts = docs.select(F.coalesce(docs["lang"], F.lit("und")).alias("lang"), docs["text"])
    counted = cut(word_counts(texts, min_count))
    words, sizes = counted.filter("word <> ''"), counted.filter("word = ''").select("lang", F.col("f").alias("n"))
    few = sizes.limit(LANGS + 1).count() <= LANGS
    single = words.select("lang", F.col("word").alias("phrase"), "f")
    rows = scored(single.unionByName(cut(phrases(texts, words, min_count, longest))), F.broadcast(sizes) if few else sizes, percent)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", place("lang", "salt")).filter(F.col("rank") <= top)
    return first.withColumn("rank", place("lang").cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
