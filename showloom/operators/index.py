"""Fielded, weighted inverted index as DataFrames: postings, term statistics, norms, four idf modes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from showloom.functions.text import let, tokenize
from showloom.operators.impacts import Impacts

#: Weights of a show's fields.
WEIGHTS = {"show_title": 2.1, "genres": 1.4, "description": 1.0, "cast": 0.9, "status": 0.5, "network": 0.5, "country": 0.5, "episodes": 1.0, "characters": 1.0, "keywords": 1.0}
MODES = ("classic", "smooth", "prob", "invdf")
#: Norms that are broadcast at most (16 bytes each); past that they are joined.
SENT = 2_000_000


def idf(mode: str, n: Column, df: Column) -> Column:
    if mode == "classic":
        return F.ln(n / df)
    if mode == "smooth":
        return F.ln((n + 1) / (df + 1)) + 1
    if mode == "prob":
        return F.ln((n - df + 0.5) / (df + 0.5))
    if mode == "invdf":
        return 1 / (df + 1)
    raise ValueError(f"idf mode {mode!r} is none of {MODES}")


def tf_weight(tf: Column, sublinear: bool = True) -> Column:
    return (1 + F.ln(tf)) if sublinear else tf.cast("double")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows, dealt by key where fewer tasks read them than the session has cores, as work within rows has no more."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() >= cores:
        return rows
    return rows.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def weighed(weights: dict, fields: list[str] | None, by: str | None) -> list[tuple[str, Column]]:
    """Fields that are indexed, each with its weight.

    Weights are by field, or with by, the name of a column of document types, by type and then field. A field that is
    listed in fields and has no weight has 1; without fields those of the weights are indexed. One that weighs nothing
    or less for all documents is left out.
    """
    if by is None:
        return [(f, F.lit(float(weights.get(f, 1.0)))) for f in fields or weights if weights.get(f, 1.0) > 0]
    names = fields or [*dict.fromkeys(f for own in weights.values() for f in own)]

    def weight(name: str) -> Column:
        own = {kind: float(w[name]) for kind, w in weights.items() if name in w}
        table = F.create_map(*[F.lit(x) for p in own.items() for x in p]) if own else None
        return F.coalesce(F.element_at(table, F.col(by)), F.lit(1.0)) if own else F.lit(1.0)

    return [(f, weight(f)) for f in names]


def shares(docs: DataFrame, weights: dict, key: str = "doc_id", fields: list[str] | None = None, by: str | None = None) -> DataFrame:
    """doc_id, term, tf: for each row of docs, term and field the weighted count, without a shuffle. A row's tokens are
    sorted, and a term's count is the length of its run. Weights are as weighed() says."""
    chosen = weighed(weights, fields, by)

    def tagged(number: int, name: str, weight: Column) -> Column:  # a token, and two characters that say its field
        found = F.transform(tokenize(F.col(name)), lambda t: F.concat(t, F.lit("\x01" + chr(65 + number))))
        return F.when(weight > 0, found).otherwise(F.array().cast("array<string>"))

    def runs(tokens: Column) -> Column:
        new = lambda i: (i == 0) | (F.get(tokens, i) != F.get(tokens, F.greatest(i - 1, F.lit(0))))
        starts = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), new)
        lengths = let(starts, lambda s: F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.struct(a.alias("at"), (F.coalesce(b, F.size(tokens)) - a).alias("n"))))
        return F.transform(lengths, lambda r: F.struct(F.get(tokens, r["at"]).alias("token"), r["n"].alias("n")))

    every = F.sort_array(F.flatten(F.array(*[tagged(i, f, w) for i, (f, w) in enumerate(chosen)])))
    rows = docs.select(F.col(key).alias("doc_id"), every.alias("tokens"), F.array(*[w for _, w in chosen]).alias("weights")).filter(F.size("tokens") > 0)
    each = rows.select("doc_id", "weights", F.explode(let(F.col("tokens"), runs)).alias("r"))
    weight = F.get("weights", F.ascii(F.right("r.token", F.lit(1))) - 65)
    term = F.substr("r.token", F.lit(1), F.char_length("r.token") - 2)
    return each.select("doc_id", term.alias("term"), F.greatest(F.lit(1).cast("long"), F.rint(F.col("r.n") * weight).cast("long")).alias("tf"))


def postings(docs: DataFrame, weights: dict, key: str = "doc_id", fields: list[str] | None = None, by: str | None = None) -> DataFrame:
    """doc_id, term, tf: over fields the sum of tf times weight, rounded half to even, 1 at least. Rows of one id are one
    document (of rows that differ in type the greatest weight of a field counts). Weights are as weighed() says."""
    chosen = weighed(weights, fields, by)

    def tagged(number: int, name: str, weight: Column) -> Column:
        found = F.transform(tokenize(F.col(name)), lambda t: F.struct(F.lit(number).alias("field"), t.alias("term")))
        return F.when(weight > 0, found).otherwise(F.array().cast("array<struct<field: int, term: string>>"))

    pairs = F.flatten(F.array(*[tagged(i, f, w) for i, (f, w) in enumerate(chosen)]))
    held = [w.alias(f"w{i}") for i, (_, w) in enumerate(chosen)] if by else []
    rows = docs.select(F.col(key).alias("doc_id"), *held, F.explode(pairs).alias("p")).select("doc_id", *[f"w{i}" for i in range(len(held))], "p.term", "p.field")
    # All fields of a term are counted together, so that postings are shuffled once.
    counts = rows.groupBy("doc_id", "term").agg(*[F.count(F.when(F.col("field") == i, 1)).alias(f"n{i}") for i in range(len(chosen))], *[F.max(f"w{i}").alias(f"w{i}") for i in range(len(held))])
    weight = lambda i: F.col(f"w{i}") if held else chosen[i][1]
    each = [F.when(F.col(f"n{i}") > 0, F.greatest(F.lit(1).cast("long"), F.rint(F.col(f"n{i}") * weight(i)).cast("long"))).otherwise(0) for i in range(len(chosen))]
    return counts.select("doc_id", "term", reduce(lambda x, y: x + y, each).alias("tf"))


def by_mode(sums: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """doc_id, norm, idf_mode of the sums of squares (doc_id, and a column for each mode)."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("idf_mode"), F.sqrt(F.greatest(F.col(m), F.lit(1e-12))).alias("norm")) for m in modes]))
    return sums.select("doc_id", each.alias("x")).select("doc_id", "x.norm", "x.idf_mode")


@dataclass
class Index:
    """postings(doc_id, term, tf), terms(term, df, n), titles(doc_id, url, title)."""

    postings: DataFrame
    terms: DataFrame
    titles: DataFrame
    sublinear: bool = True
    parts: Callable[[], DataFrame] | None = None  # doc_id, term, tf that add up to postings
    documents: DataFrame | None = None  # doc_id of rows with a token, where that is known without postings

    @staticmethod
    def build(docs: DataFrame, weights: dict, key: str = "doc_id", title: str | None = None, url: str | None = None, sublinear: bool = True, fields: list[str] | None = None, by: str | None = None) -> Index:
        """An index of documents of one kind, or with by (a column) of several, each with weights of its own."""
        found = postings(docs, weights, key, fields, by)
        text = lambda c: (F.col(c) if c else F.lit(None)).cast("string")
        held = reduce(lambda a, b: a | b, [(w > 0) & F.rlike(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit("[a-z0-9]")) for f, w in weighed(weights, fields, by)], F.lit(False))
        documents = docs.filter(held).select(F.col(key).alias("doc_id"))
        out = Index.of(found, docs.select(F.col(key).alias("doc_id"), text(url).alias("url"), text(title).alias("title")), sublinear)
        out.documents = documents
        out.parts = lambda: shares(spread(docs, key), weights, key, fields, by) if docs.groupBy(key).count().filter("count > 1").isEmpty() else found
        return out

    @staticmethod
    def of(found: DataFrame, titles: DataFrame, sublinear: bool = True) -> Index:
        n = found.agg(F.countDistinct("doc_id").alias("n"))  # one row
        return Index(found, found.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)), titles, sublinear)

    def ids(self) -> DataFrame:
        """doc_id of the documents that have tokens, each once; read from the documents where they are known."""
        return (self.postings if self.documents is None else self.documents).select("doc_id").distinct()

    def idf(self, mode: str) -> DataFrame:
        return self.terms.select("term", "df", idf(mode, F.col("n"), F.col("df")).alias("idf"))

    def norms(self, mode: str) -> DataFrame:
        w = tf_weight(F.col("tf"), self.sublinear) * F.col("idf")
        return self.postings.join(self.idf(mode), "term").groupBy("doc_id").agg(F.sqrt(F.greatest(F.sum(w * w), F.lit(1e-12))).alias("norm"))

    def persist(self) -> Index:
        """This index, its postings and terms kept (memory, then disk) for many searches; unpersist() both when done."""
        self.postings.persist(StorageLevel.MEMORY_AND_DISK)
        self.terms.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def all_norms(self, modes: tuple[str, ...]) -> DataFrame:
        """doc_id, norm, idf_mode for several modes, in one pass over the postings."""
        w = lambda m: tf_weight(F.col("tf"), self.sublinear) * idf(m, F.col("n"), F.col("df"))
        return by_mode(self.postings.join(self.terms, "term").groupBy("doc_id").agg(*[F.sum(w(m) * w(m)).alias(m) for m in modes]), modes)

    def impacts(self, mode: str) -> Impacts:
        """Impacts of the cosine with an idf mode, for batches of queries: weights over norms."""
        x = F.abs(tf_weight(F.col("tf"), self.sublinear) * F.col("idf") / F.col("norm"))
        return Impacts.build(self.postings.join(self.idf(mode), "term").join(self.norms(mode), "doc_id").select("term", "doc_id", x.alias("x")).filter("x > 0"))

    def save(self, folder: str, modes: tuple[str, ...] = MODES, batches: tuple[str, ...] = ("smooth",)) -> None:
        """Parquet: postings ranged and sorted by term, so a query's scan prunes to its terms; norms by idf mode; impacts of
        the modes in which batches are searched.

        Postings are written first, each with its term's df, and what follows is computed from the files without a join but
        that of norms, which are sent to all tasks where they are few. Norms and impacts can be added later too.
        """
        spark = self.postings.sparkSession
        # Written before they are ranged, as ranges are found by reading twice. They are by term, so adding up and counting
        # by term shuffle nothing.
        (self.parts() if self.parts else self.postings).write.mode("overwrite").parquet(f"{folder}/_parts")
        rows = spark.read.parquet(f"{folder}/_parts").repartitionByRange("term")
        ranged = rows.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf")).select("doc_id", "term", "tf").withColumn("df", F.count("*").over(Window.partitionBy("term")))
        ranged.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{folder}/postings")
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_parts")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        held = spark.read.parquet(f"{folder}/postings")
        n = self.ids().agg(F.count("doc_id")).first()[0]
        held.groupBy("term").agg(F.first("df").alias("df")).select("term", "df", F.lit(n).cast("long").alias("n")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/terms")
        self.titles.write.mode("overwrite").parquet(f"{folder}/titles")
        if modes:
            Index.add_norms(spark, folder, modes, self.sublinear)
        for mode in batches:
            Index.add_impacts(spark, folder, mode, self.sublinear)

    @staticmethod
    def stored_weight(spark: SparkSession, folder: str, sublinear: bool) -> tuple[int, Callable[[str], Column]]:
        """The number of documents of a saved index, and by mode the weight of its postings' rows."""
        first = spark.read.parquet(f"{folder}/terms").select("n").first()
        n = first["n"] if first else 0
        return n, lambda m: tf_weight(F.col("tf"), sublinear) * idf(m, F.lit(n), F.col("df"))

    @staticmethod
    def add_norms(spark: SparkSession, folder: str, modes: tuple[str, ...], sublinear: bool = True) -> None:
        """Adds norms of idf modes that the saved index in folder doesn't have yet."""
        _, weight = Index.stored_weight(spark, folder, sublinear)
        held = spark.read.parquet(f"{folder}/postings")
        by_mode(held.groupBy("doc_id").agg(*[F.sum(weight(m) * weight(m)).alias(m) for m in modes]), modes).write.mode("append").partitionBy("idf_mode").parquet(f"{folder}/norms")

    @staticmethod
    def add_impacts(spark: SparkSession, folder: str, mode: str, sublinear: bool = True) -> None:
        """Adds impacts of an idf mode, for batches, to the saved index in folder, which has its norms."""
        n, weight = Index.stored_weight(spark, folder, sublinear)
        norms = spark.read.parquet(f"{folder}/norms").filter(F.col("idf_mode") == mode).select("doc_id", "norm")
        rows = spark.read.parquet(f"{folder}/postings").join(F.broadcast(norms) if n <= SENT else norms, "doc_id")
        Impacts.build(rows.select("term", "doc_id", F.abs(weight(mode) / F.col("norm")).alias("x")).filter("x > 0"), docs=n, ranged=n <= SENT).save(f"{folder}/impacts-{mode}")

    @staticmethod
    def load(spark: SparkSession, folder: str, sublinear: bool = True) -> Saved:
        read = lambda name: spark.read.parquet(f"{folder}/{name}")
        try:
            stored = read("norms")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            stored = None  # of no mode yet
        return Saved(read("postings").drop("df"), read("terms"), read("titles"), sublinear, stored=stored, folder=folder)


@dataclass
class Saved(Index):
    """An index whose norms were stored by mode."""

    stored: DataFrame | None = None
    folder: str = ""

    def impacts(self, mode: str) -> Impacts:
        """The stored impacts; those of a mode that has none are computed."""
        try:
            return Impacts.load(self.postings.sparkSession, f"{self.folder}/impacts-{mode}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return super().impacts(mode)

    def norms(self, mode: str) -> DataFrame:
        if self.stored is None:
            return super().norms(mode)
        return self.stored.filter(F.col("idf_mode") == mode).select("doc_id", "norm")
