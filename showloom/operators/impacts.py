"""Impacts: what each term adds to a document's score, in blocks with their greatest value, for batches of queries.

A posting's impact is all of its share in a score that doesn't depend on the query (for a cosine its weight over the
document's norm, for BM25 its idf times its saturated count, summed over fields), so cosine, BM25 and vector search
differ in nothing but where impacts come from. Documents are dealt to shards of bounded size by a hash. Of a term and a
shard, postings are sorted by impact and cut into blocks, the first one short; a block has its greatest and least impact.

A batch sends its queries' terms to the shards' tasks. Of a query, a document's score is at most what a block's greatest
impact and the other terms' greatest ones add up to; blocks for which that is less than what k documents surely have are
skipped, some of them before they are shuffled. Within a shard, terms are added in order of what they can add at most, and
once the rest can't bring a new document among the k best, only documents that still can be there look up the rest. What
leaves a shard is its k best for each query.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Documents of a shard on average; postings of a first block and of the ones after it.
SHARD, FIRST, BLOCK = 16_384, 16, 512
#: Rows (query, term) that are sent to tasks at once; queries of more rows go in rounds.
SENT = 1_000_000
EPSILON = 1e-9


@dataclass
class Impacts:
    """blocks(term, shard, block, top, low, n, docs, xs), terms(term, top, sure, later): sure has impacts that at least 1, 2,
    ... FIRST documents reach, later one that BLOCK reach."""

    blocks: DataFrame
    terms: DataFrame

    @staticmethod
    def build(postings: DataFrame, shards: int | None = None, docs: int | None = None, once: bool = True, ranged: bool = False) -> Impacts:
        """Of postings (term, doc_id, x), x > 0. A document comes at most once with a term, or without once its x are added
        up. docs: how many documents there are, where that is known. ranged: postings are in ranges of terms already, so
        nothing is shuffled."""
        if not shards:
            docs = docs or postings.agg(F.approx_count_distinct("doc_id")).first()[0]
            shards = max(int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(docs / SHARD))
        rows = postings.select(F.col("term").cast("string").alias("term"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "x")
        rows = rows if ranged else rows.repartitionByRange("term", "shard")
        rows = rows if once else rows.groupBy("term", "shard", "doc_id").agg(F.sum("x").alias("x"))  # within the ranges
        kind = dict(rows.dtypes)["doc_id"]
        first, block = FIRST, BLOCK
        cut = lambda batches: blocks_of(batches, first, block)
        blocks = rows.sortWithinPartitions("term", "shard", F.desc("x")).mapInArrow(cut, f"term string, shard int, block int, top double, low double, n int, docs array<{kind}>, xs array<double>")
        return Impacts(blocks, Impacts.bounds(blocks))

    @staticmethod
    def bounds(blocks: DataFrame) -> DataFrame:
        sure = F.array(*[F.max(F.when(F.col("block") == 0, F.get("xs", F.lit(i)))) for i in range(FIRST)])
        return blocks.groupBy("term").agg(F.max("top").alias("top"), sure.alias("sure"), F.max(F.when(F.col("n") >= BLOCK, F.col("low"))).alias("later"))

    def save(self, folder: str) -> None:
        """Parquet, ranged and sorted by term, so that a search's scan prunes to its terms."""
        self.blocks.write.mode("overwrite").parquet(f"{folder}/blocks")
        saved = self.blocks.sparkSession.read.parquet(f"{folder}/blocks")
        Impacts.bounds(saved).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/bounds")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Impacts:
        return Impacts(spark.read.parquet(f"{folder}/blocks"), spark.read.parquet(f"{folder}/bounds"))

    def one(self, weights: dict[str, float]) -> DataFrame:
        """doc_id, score: sums for the terms of one query, of all documents that have one of them."""
        rows = self.blocks.filter(F.col("term").isin([*weights])).join(F.broadcast(self.blocks.sparkSession.createDataFrame([(t, float(w)) for t, w in weights.items()], "term string, w double")), "term")
        each = rows.select("w", F.explode(F.arrays_zip("docs", "xs")).alias("p"))
        return each.groupBy(F.col("p.docs").alias("doc_id")).agg(F.sum(F.col("w") * F.col("p.xs")).alias("score"))

    def bounded(self, weights: DataFrame, k: int) -> DataFrame:
        """weights (query_id, term, w) and theta, what k documents of the query surely have, and need, the least impact of
        this term with which a document can have as much."""
        of_query = Window.partitionBy("query_id")
        sure = F.get("sure", F.lit(k - 1)) if k <= FIRST else F.col("later") if k <= BLOCK else F.lit(0.0)
        rows = weights.join(self.terms, "term").withColumn("theta", F.max(F.col("w") * F.coalesce(sure, F.lit(0.0))).over(of_query))
        others = F.sum(F.col("w") * F.col("top")).over(of_query) - F.col("w") * F.col("top")
        return rows.select("query_id", "term", "w", "theta", ((F.col("theta") * (1 - EPSILON) - others) / F.col("w")).alias("need"))

    def best(self, weights: DataFrame, k: int) -> DataFrame:
        """query_id, doc_id, score, rank: the k best sums of w times impact for each query of weights (query_id, term, w;
        w > 0, a term at most once a query); ties go to the smaller id, equal are sums that agree in 12 places."""
        found = self.searched(weights, k)
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "doc_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def searched(self, weights: DataFrame, k: int, counts: bool = False) -> DataFrame:
        """query_id, doc_id, score of each shard's k best; or with counts query_id, read, held: how many of the postings of
        its terms a query added or looked up in a shard, and how many there are in the blocks sent there."""
        rows = self.bounded(weights.withColumn("term", F.col("term").cast("string")), k).checkpoint()
        rounds = max(1, math.ceil(rows.count() / SENT))
        deal = F.pmod(F.xxhash64("query_id"), F.lit(rounds))
        return reduce(DataFrame.unionByName, [self.round(rows.filter(deal == i) if rounds > 1 else rows, k, counts) for i in range(rounds)])

    def round(self, rows: DataFrame, k: int, counts: bool) -> DataFrame:
        spark = rows.sparkSession
        sent = spark.sparkContext.broadcast(Queries(rows.select("query_id", "term", "w", "theta").toArrow()))
        needs = F.broadcast(rows.groupBy("term").agg(F.min("need").alias("need")))
        blocks = self.blocks.join(needs, "term").filter("top >= need").select("shard", "term", "top", "docs", "xs")
        dealt = blocks.repartition("shard").sortWithinPartitions("shard", "term", F.desc("top"))
        kinds = dict(rows.dtypes)
        schema = f"query_id {kinds['query_id']}, " + ("read long, held long" if counts else f"doc_id {dict(self.blocks.dtypes)['docs'][6:-1]}, score double")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries, held, last = sent.value, defaultdict(list), None
            for batch in batches:
                docs, xs = batch.column(3), batch.column(4)
                for i, (shard, term, top) in enumerate(zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True)):
                    if shard != last and held:
                        yield queries.search(Shard(held), k, counts)
                        held = defaultdict(list)
                    held[term].append((top, docs[i].values.to_numpy(zero_copy_only=False), xs[i].values.to_numpy()))
                    last = shard
            if held:
                yield queries.search(Shard(held), k, counts)

        return dealt.mapInArrow(run, schema)


def blocks_of(batches: Iterator[pa.RecordBatch], first: int, size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (term, shard, doc_id, x) that are sorted by term, shard and falling x. Where a batch ends so does a
    block, and the next one counts as a first one again."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        terms, shards, docs, xs = batch.columns
        codes, shard, x = terms.dictionary_encode().indices.to_numpy(), shards.to_numpy(), xs.to_numpy()
        new = np.append(True, (codes[1:] != codes[:-1]) | (shard[1:] != shard[:-1]))
        at = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))  # place in the term's list
        starts = np.flatnonzero(new | (at >= first) & ((at - first) % size == 0))
        ends = np.append(starts[1:], n)
        number = np.where(at[starts] < first, 0, 1 + (at[starts] - first) // size)
        cuts = pa.array(np.append(starts, n).astype(np.int32))
        columns = [terms.take(pa.array(starts)), pa.array(shard[starts]), pa.array(number.astype(np.int32)), pa.array(x[starts]), pa.array(x[ends - 1]), pa.array((ends - starts).astype(np.int32))]
        columns += [pa.ListArray.from_arrays(cuts, docs), pa.ListArray.from_arrays(cuts, xs)]
        yield pa.RecordBatch.from_arrays(columns, ["term", "shard", "block", "top", "low", "n", "docs", "xs"])


class Shard:
    """A shard's blocks of a batch's terms: of each term its documents (as places among all of them) and impacts, the
    greatest first, and where its blocks start."""

    def __init__(self, blocks: dict[str, list[tuple[float, np.ndarray, np.ndarray]]]):
        self.docs, places = np.unique(np.concatenate([d for own in blocks.values() for _, d, _ in own]), return_inverse=True)
        self.terms, at = {}, 0
        for term, own in blocks.items():
            n = sum(len(d) for _, d, _ in own)
            starts = np.cumsum([0, *[len(d) for _, d, _ in own]])
            self.terms[term] = (places[at : at + n], np.concatenate([x for _, _, x in own]), np.array([-top for top, _, _ in own]), starts)
            at += n
        self.by_place: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def look_up(self, term: str, places: np.ndarray) -> np.ndarray:
        """The term's impacts for documents, 0 for those that don't have it."""
        if term not in self.by_place:
            own, xs, _, _ = self.terms[term]
            order = np.argsort(own)
            self.by_place[term] = own[order], xs[order]
        own, xs = self.by_place[term]
        at = np.minimum(np.searchsorted(own, places), len(own) - 1)
        return np.where(own[at] == places, xs[at], 0.0)


class Queries:
    """The queries of a round: of each its terms, weights, and what k documents surely have."""

    def __init__(self, rows: pa.Table):
        self.kind, self.held = rows.schema.field("query_id").type, {}
        for query, term, w, theta in zip(*[rows.column(c).to_pylist() for c in ("query_id", "term", "w", "theta")], strict=True):
            self.held.setdefault(query, (theta, []))[1].append((term, w))

    def search(self, shard: Shard, k: int, counts: bool) -> pa.RecordBatch:
        found: list[tuple] = []
        for query, (theta, terms) in self.held.items():
            own = sorted(((w * -shard.terms[t][2][0], w, t) for t, w in terms if t in shard.terms), reverse=True)
            if not own:
                continue
            read, scores = self.scores(shard, own, theta, k)
            if counts:
                found.append((query, read, sum(len(shard.terms[t][0]) for _, _, t in own)))
                continue
            places = np.flatnonzero(scores)
            if len(places) > 4 * k:
                least = np.partition(scores[places], -k)[-k]
                places = places[scores[places] >= least * (1 - EPSILON)]
            # Added up again in one order of terms: the one above differs by shard, and so would the last digits of
            # documents that are equal, which decides between them where rounding is near.
            sums = np.zeros(len(places))
            for _, w, term in sorted(own, key=lambda o: o[2]):
                sums += w * shard.look_up(term, places)
            best = sorted(zip((-np.round(sums, 12)).tolist(), shard.docs[places].tolist(), sums.tolist(), strict=True))[:k]
            found += [(query, d, s) for _, d, s in best]
        if counts:
            names, kinds = ["query_id", "read", "held"], [self.kind, pa.int64(), pa.int64()]
        else:
            names, kinds = ["query_id", "doc_id", "score"], [self.kind, pa.from_numpy_dtype(shard.docs.dtype) if shard.docs.dtype != object else pa.string(), pa.float64()]
        columns = zip(*found, strict=True) if found else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    def scores(self, shard: Shard, terms: list[tuple[float, float, str]], theta: float, k: int) -> tuple[int, np.ndarray]:
        """How many postings were added or looked up, and the scores of the documents that can be among the k best (0 for
        others). terms: what each can add at most, its weight and itself, by the first."""
        total = rest = sum(most for most, _, _ in terms)
        scores, read = np.zeros(len(shard.docs)), 0
        for n, (most, w, term) in enumerate(terms):
            if rest < theta * (1 - EPSILON):
                break
            own, xs, tops, starts = shard.terms[term]
            need = (theta * (1 - EPSILON) - (total - most)) / w
            upto = starts[np.searchsorted(tops, -need, side="right")]  # blocks from there on can't reach theta
            scores[own[:upto]] += w * xs[:upto]
            read, rest = read + int(upto), rest - most
            if len(scores) > k:
                theta = max(theta, float(np.partition(scores, -k)[-k]))
        else:
            n, rest = len(terms), 0.0
        places = np.flatnonzero((scores > 0) & (scores + rest >= theta * (1 - EPSILON)))
        for _, w, term in terms[n:]:
            own, xs, _, _ = shard.terms[term]
            if len(own) <= len(places):  # adding the list is less work than looking documents up
                scores[own] += w * xs
            else:
                scores[places] += w * shard.look_up(term, places)
            read += min(len(own), len(places))
        out = np.zeros(len(scores))
        out[places] = scores[places]
        return read, out
