"""A store of sparse tf-idf vectors: vocabulary, idf, rows and documents as Parquet, and the search over them."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from showloom.functions.text import counted, empty_as_null, let, tokenize_for_vectors
from showloom.operators.impacts import Impacts
from showloom.operators.index import spread
from showloom.operators.numbering import numbered
from showloom.operators.search import query_terms

FLOOR = 1e-12


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def length(values: Column) -> Column:
    size = F.sqrt(total(F.transform(values, lambda x: x * x)))
    return F.when(size == 0, FLOOR).otherwise(size)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with the same key, that which is last in the order column; without that column."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*")


@dataclass
class Vectors:
    """vocab(term, term_id), idf(term_id, idf), rows(doc_id, url, title, ids, values), docs(doc_id, url, title); saved
    ones have the rows inverted too, by term id, as values over lengths."""

    vocab: DataFrame
    idf: DataFrame
    rows: DataFrame
    docs: DataFrame
    inverted: Impacts | None = None

    @staticmethod
    def build(docs: DataFrame, text: str, key: str = "doc_id", url: str | None = None, title: str | None = None) -> Vectors:
        """Vectors of tf times ln((1 + n) / (1 + df)); term ids are places in the sorted vocabulary."""
        named = lambda c: (F.col(c) if c else F.lit("")).cast("string")
        held = docs.select(F.col(key).alias("doc_id"), named(url).alias("url"), named(title).alias("title"), F.col(text).alias("text"))
        tokens = spread(held.select("doc_id", "text"), "doc_id").select("doc_id", tokenize_for_vectors(F.col("text")).alias("tokens")).filter(F.size("tokens") > 0)
        if docs.groupBy(key).count().filter("count > 1").isEmpty():  # counted within rows, which shuffles nothing
            counts = tokens.select("doc_id", F.explode(counted(F.col("tokens"))).alias("x")).select("doc_id", "x.*")
        else:
            counts = tokens.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
        counts = counts.checkpoint()
        n = F.broadcast(held.agg(F.count("*").alias("n")))  # one row
        terms = numbered(counts.groupBy("term").agg(F.count("*").alias("df")), "term_id", "term").crossJoin(n).select("term", "term_id", F.ln((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))
        value = F.struct("term_id", (F.col("tf") * F.col("idf")).alias("v"))
        rows = counts.join(terms, "term").select("doc_id", value.alias("x")).groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
        rows = held.drop("text").join(rows, "doc_id", "left").select("doc_id", "url", "title", F.coalesce("x.term_id", F.array().cast("array<long>")).alias("ids"), F.coalesce("x.v", F.array().cast("array<double>")).alias("values"))
        return Vectors(terms.select("term", "term_id"), terms.select("term_id", "idf"), rows, held.drop("text"))

    def save(self, folder: str, batches: bool = True) -> None:
        """Parquet; vocabulary and idf are sorted, so that a query's scan prunes to its terms. Without batches the rows
        aren't inverted (they can be later): a single query scans them."""
        self.vocab.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/vocab")
        self.idf.repartitionByRange("term_id").sortWithinPartitions("term_id").write.mode("overwrite").parquet(f"{folder}/idf")
        self.rows.write.mode("overwrite").parquet(f"{folder}/rows")
        self.docs.write.mode("overwrite").parquet(f"{folder}/docs")
        if batches:
            Vectors.add_impacts(self.rows.sparkSession, folder)

    @staticmethod
    def add_impacts(spark: SparkSession, folder: str) -> None:
        """Adds the inverted rows to the store in folder."""
        Vectors.load(spark, folder).impacts().save(f"{folder}/impacts")

    def impacts(self) -> Impacts:
        """The rows inverted: of a term id and document, the value over the vector's length."""
        if self.inverted:
            return self.inverted
        # The length once a row, not once for each of its values.
        shares = let(length(F.col("values")), lambda size: F.transform(F.arrays_zip("ids", "values"), lambda p: F.struct(p["ids"].alias("term"), (p["values"] / size).alias("x"))))
        return Impacts.build(self.rows.select("doc_id", F.explode(shares).alias("p")).select("p.term", "doc_id", "p.x").filter("x > 0"))

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Vectors:
        """The store in folder; FileNotFoundError names the parts that are missing."""
        found, missing = {}, []
        for name in ("vocab", "idf", "rows", "docs"):
            try:
                found[name] = spark.read.parquet(f"{folder}/{name}")
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                missing.append(name)
        if missing:
            raise FileNotFoundError(f"{folder} has no {', '.join(missing)}")
        try:
            inverted = Impacts.load(spark, f"{folder}/impacts")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            inverted = None
        return Vectors(**found, inverted=inverted)

    def documents(self) -> DataFrame:
        """doc_id, url, title of every vector: of the documents, else what came with the vector."""
        own = self.rows.select("doc_id", F.col("url").alias("_url"), F.col("title").alias("_title"))
        either = lambda a: F.coalesce(empty_as_null(F.col(a)), F.col(f"_{a}"), F.lit("")).alias(a)
        return own.join(self.docs.select("doc_id", "url", "title"), "doc_id", "left").select("doc_id", either("url"), either("title"))

    def weights(self, counts: dict[str, int]) -> DataFrame:
        """term_id, w of a query's known terms: a few rows."""
        known = self.vocab.filter(F.col("term").isin([*counts])).join(query_terms(self.vocab, counts), "term")
        ids = [r["term_id"] for r in known.select("term_id").collect()]
        return known.join(self.idf.filter(F.col("term_id").isin(ids)), "term_id").select("term_id", (F.col("qtf") * F.col("idf")).alias("w"))

    def scanned(self, weights: dict[int, float]) -> DataFrame:
        """doc_id, score: sums for the terms of one query, by a pass over the rows."""
        table = F.create_map(*[F.lit(x) for p in weights.items() for x in p])
        own = F.filter(F.arrays_zip("ids", "values"), lambda p: p["ids"].isin([*weights]))
        rows = self.rows.select("doc_id", "values", own.alias("own")).filter(F.size("own") > 0)
        size = length(F.col("values"))
        return rows.select("doc_id", F.aggregate(F.transform("own", lambda p: F.element_at(table, p["ids"]) * (p["values"] / size)), F.lit(0.0), lambda a, x: a + x).alias("score"))

    def search(self, query: str, k: int = 10) -> DataFrame:
        """doc_id, url, title, score: the k best by cosine; nothing without a known term.

        Only postings of the query's terms are read; a store that isn't inverted is scanned once. Documents without any of them have a score of zero: the first by id
        follow where there are fewer than k others.
        """
        spark = self.rows.sparkSession
        tokens = spark.range(1).select(tokenize_for_vectors(F.lit(query or "")).alias("t")).first()["t"]
        found = self.weights(Counter(tokens)).collect() if tokens else []
        if not found:
            return self.documents().limit(0).withColumn("score", F.lit(0.0))
        size = sum(r["w"] ** 2 for r in found) ** 0.5 or FLOOR
        order = [F.desc(F.round("score", 12)), F.col("doc_id")]
        weights = {r["term_id"]: r["w"] / size for r in found}
        scores = self.inverted.one({str(t): w for t, w in weights.items()}) if self.inverted else self.scanned(weights)
        best = scores.filter("score > 0").orderBy(*order).limit(k)
        hits = spark.createDataFrame(best.collect(), best.schema)  # k rows
        if (n := hits.count()) < k:
            rest = self.rows.select("doc_id").join(F.broadcast(hits), "doc_id", "left_anti").orderBy("doc_id").limit(k - n)
            hits = hits.unionByName(rest.withColumn("score", F.lit(0.0)))
        return self.documents().join(F.broadcast(hits), "doc_id").orderBy(*order).select("doc_id", "url", "title", "score")

    def search_many(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """query_id, doc_id, rank, score of many queries (query_id, text); only documents that share a term."""
        terms = queries.select("query_id", F.explode(tokenize_for_vectors(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        weighted = terms.join(self.vocab, "term").join(self.idf, "term_id").select("query_id", "term_id", (F.col("qtf") * F.col("idf")).alias("w")).filter("w > 0")
        sizes = weighted.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("q"))
        unit = weighted.join(sizes, "query_id").select("query_id", "term_id", (F.col("w") / F.col("q")).alias("w"))
        return self.impacts().best(unit.withColumnRenamed("term_id", "term"), k).select("query_id", "doc_id", "rank", "score")
