"""Ranked retrieval: weighted cosine, vectors, multi-field BM25, and the filter mini-language."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import islice

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from showloom.functions.text import analyze, let, norm_query, snippet, tokenize
from showloom.operators import grammar
from showloom.operators.impacts import Impacts
from showloom.operators.index import Index, spread, tf_weight

BOOST, K1, B = 1.3, 1.2, 0.75
#: Most terms that a fuzzy word stands for in a field.
EXPANSIONS = 50
#: Fields that free text is searched in.
FIELDS = ["show_name", "alt_title", "native_title", "description", "wiki_description", "cast_all", "wiki_categories", "keywords", "content_all"]


def query_terms(df: DataFrame, counts: dict[str, int]) -> DataFrame:
    """term, qtf of a query: a few rows."""
    return F.broadcast(df.sparkSession.createDataFrame(sorted(counts.items()), "term string, qtf long"))


def cosine(index: Index, query: str, mode: str = "smooth", k: int = 20) -> DataFrame:
    """doc_id, url, title, score: the k best by cosine, times BOOST where the title holds the query's tokens in a row."""
    tokens = re.findall("[a-z0-9]+", (query or "").lower())
    if not tokens:
        return index.titles.limit(0).withColumn("score", F.lit(0.0))
    counts = Counter(tokens)
    # The filter reaches the postings' scan; both query sides are a few rows.
    known = index.idf(mode).filter(F.col("term").isin([*counts])).join(query_terms(index.terms, counts), "term")
    known = known.select("term", "idf", (tf_weight(F.col("qtf"), index.sublinear) * F.col("idf")).alias("wq"))
    norm = F.broadcast(known.agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("q")))
    hits = index.postings.filter(F.col("term").isin([*counts])).join(F.broadcast(known.filter("wq <> 0")), "term")
    dots = hits.groupBy("doc_id").agg(F.sum(tf_weight(F.col("tf"), index.sublinear) * F.col("idf") * F.col("wq")).alias("dot"))
    phrase = F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(" ".join(tokens)))
    scored = dots.join(index.norms(mode), "doc_id").join(index.titles, "doc_id").crossJoin(norm)
    score = F.col("dot") / (F.col("norm") * F.when(F.col("q") == 0, 1.0).otherwise(F.col("q"))) * F.when(phrase, BOOST).otherwise(1.0)
    return scored.select("doc_id", "url", "title", score.alias("score")).orderBy(F.desc(F.round("score", 12)), "doc_id").limit(k)


def cosine_many(index: Index, queries: DataFrame, mode: str = "smooth", k: int = 20) -> DataFrame:
    """query_id, doc_id, score, rank of many queries (query_id, text), without boosts, by the index's impacts."""
    weights = cosine_weights(index, queries, mode)
    norms = weights.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("q"))
    unit = weights.join(norms, "query_id").select("query_id", "term", (F.col("w") / F.col("q")).alias("w"))
    return index.impacts(mode).best(unit, k)


def cosine_weights(index: Index, queries: DataFrame, mode: str) -> DataFrame:
    """query_id, term, w of the known terms of queries (query_id, text); signs go, as a posting's is the same."""
    terms = queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    w = F.abs(tf_weight(F.col("qtf"), index.sublinear) * F.col("idf"))
    return terms.join(index.idf(mode), "term").select("query_id", "term", w.alias("w")).filter("w > 0")


@dataclass
class Parsed:
    """A command of the mini-language: free text and filters."""

    text: str = ""
    filters: list[tuple[str, str | int]] = field(default_factory=list)

    def predicate(self) -> Column:
        """All filters over columns country, genres_exact (array) and start_year."""
        out = F.lit(True)
        for kind, value in self.filters:
            if kind == "country":
                out &= F.lower("country") == value
            elif kind == "genre":
                out &= F.array_contains("genres_exact", value)
            elif kind == "from":
                out &= F.col("start_year").between(value, 9999)
            else:
                out &= F.col("start_year").between(0, value)
        return F.coalesce(out, F.lit(False))


def parse(command: str) -> Parsed:
    """country:x, genre:x (also with a quoted value), year>=n, year<=n; numbers that aren't drop out; the rest is text."""
    out, free = Parsed(), []
    for token in re.findall(r'(?:country|genre):"[^"]*"|\S+', command or ""):
        kind, _, value = token.partition(":")
        if kind in ("country", "genre") and ":" in token:
            out.filters.append((kind, value.strip('"').lower()))
        elif token.startswith(("year>=", "year<=")):
            if re.fullmatch(r"[+-]?\d+", token[6:]):
                out.filters.append(("from" if token[4] == ">" else "to", int(token[6:])))
        else:
            free.append(token)
    out.text = " ".join(free)
    return out


def placed(terms: Column) -> Column:
    """array<term, tf, positions> of a text's terms: places are sorted by term, and a term's are a run of them."""

    def runs(all: Column) -> Column:
        new = lambda i: (i == 0) | (F.get(all, i)["term"] != F.get(all, F.greatest(i - 1, F.lit(0)))["term"])
        starts = F.filter(F.sequence(F.lit(0), F.size(all) - 1), new)
        lengths = let(starts, lambda s: F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.struct(a.alias("at"), (F.coalesce(b, F.size(all)) - a).alias("n"))))
        return F.transform(lengths, lambda r: F.struct(F.get(all, r["at"])["term"].alias("term"), r["n"].cast("long").alias("tf"), F.slice(all, r["at"] + 1, r["n"])["place"].alias("positions")))

    return let(F.sort_array(F.transform(terms, lambda t, i: F.struct(t.alias("term"), i.alias("place")))), runs)


@dataclass
class FieldIndex:
    """postings(field, term, doc_id, dl, tf, positions), stats(field, docs, total), df(field, term, df) of analyzed fields."""

    postings: DataFrame
    stats: DataFrame
    df: DataFrame
    folder: str = ""
    parts: Callable[[], DataFrame] | None = None  # the postings, made without a shuffle where no id is repeated

    @staticmethod
    def build(docs: DataFrame, fields: list[str], key: str = "doc_id") -> FieldIndex:
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), analyze(F.col(f)).alias("terms")) for f in fields]))
        split = lambda docs: docs.select(F.col(key).alias("doc_id"), each.alias("x")).select("doc_id", "x.field", "x.terms", F.size("x.terms").cast("long").alias("dl")).filter("dl > 0")
        rows = split(docs)
        found = rows.select("field", "doc_id", "dl", F.posexplode("terms").alias("place", "term")).groupBy("field", "term", "doc_id", "dl").agg(F.count("*").alias("tf"), F.collect_list("place").alias("positions"))
        out = FieldIndex(found, rows.groupBy("field").agg(F.count("*").alias("docs"), F.sum("dl").alias("total")), found.groupBy("field", "term").agg(F.count("*").alias("df")))
        own = lambda: split(spread(docs.select(*dict.fromkeys([key, *fields])), key)).select("field", "doc_id", "dl", F.explode(placed(F.col("terms"))).alias("p")).select("field", "p.term", "doc_id", "dl", "p.tf", "p.positions")
        out.parts = lambda: own() if docs.groupBy(key).count().filter("count > 1").isEmpty() else found
        return out

    def save(self, folder: str, batches: bool = True) -> None:
        """Parquet: postings by field, ranged and sorted by term, so a query's scan prunes to its terms; and impacts, which
        batches are searched by and nothing else (they can be added later)."""
        # Written before they are ranged, as ranges are found by reading twice.
        spark = self.postings.sparkSession
        (self.parts() if self.parts else self.postings).write.mode("overwrite").parquet(f"{folder}/_parts")
        # Counted by the ranges' own columns, which shuffles nothing.
        ranged = spark.read.parquet(f"{folder}/_parts").repartitionByRange("field", "term").withColumn("df", F.count("*").over(Window.partitionBy("field", "term")))
        ranged.sortWithinPartitions("field", "term", "doc_id").write.mode("overwrite").partitionBy("field").parquet(f"{folder}/postings")
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_parts")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        saved = spark.read.parquet(f"{folder}/postings")
        saved.groupBy("field", "term").agg(F.first("df").alias("df")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/df")
        self.stats.write.mode("overwrite").parquet(f"{folder}/stats")
        if batches:
            FieldIndex.add_impacts(spark, folder)

    @staticmethod
    def add_impacts(spark: SparkSession, folder: str) -> None:
        """Adds impacts to the saved index in folder."""
        saved, stats = spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/stats")
        Impacts.build(saved.join(F.broadcast(stats), "field").select("term", "doc_id", (idf_of() * saturated()).alias("x")), once=False).save(f"{folder}/impacts")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> FieldIndex:
        postings, stats, df = [spark.read.parquet(f"{folder}/{name}") for name in ("postings", "stats", "df")]
        return FieldIndex(postings.drop("df"), stats, df, folder)

    def computed(self) -> Impacts:
        """Impacts of BM25: of a term and document, idf times saturated count, summed over fields."""
        rows = self.postings.join(self.df, ["field", "term"]).join(F.broadcast(self.stats), "field")
        return Impacts.build(rows.select("term", "doc_id", (idf_of() * saturated()).alias("x")), once=False)

    def impacts(self) -> Impacts:
        """The stored impacts of BM25; of an index that has none they are computed."""
        if not self.folder:
            return self.computed()
        try:
            return Impacts.load(self.postings.sparkSession, f"{self.folder}/impacts")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.computed()


def analyzed(spark: SparkSession, node: grammar.Group) -> grammar.Group | None:
    """node with words and phrases as the index has them; what holds no word drops out, None if nothing is left."""
    texts = [*dict.fromkeys(x.text for x in node.leaves() if x.kind in ("word", "phrase"))]
    found = spark.range(1).select(F.array(*[analyze(F.lit(t)) for t in texts]).alias("t")).first()["t"] if texts else []
    words = dict(zip(texts, found, strict=True))

    def leaf(x: grammar.Leaf) -> grammar.Leaf | grammar.Group | None:
        if x.kind not in ("word", "phrase"):
            return x
        own = words[x.text]
        if x.kind == "phrase" and len(own) > 1:
            if x.edits and len({*own}) < len(own):
                raise ValueError("a phrase with gaps can't have a word twice")
            return replace(x, text=" ".join(own))
        each = [(False, replace(x, kind="word", text=w)) for w in own]
        return (each[0][1] if len(each) == 1 else grammar.Group(each)) if each else None

    def group(g: grammar.Group) -> grammar.Group | None:
        kept = [(must, y) for must, x in g.clauses if (y := group(x) if isinstance(x, grammar.Group) else leaf(x)) is not None]
        return grammar.Group(kept) if kept else None

    return group(node)


def saturated() -> Column:
    """A word's count in a field, saturated and by the field's length."""
    return F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / (F.col("total") / F.col("docs"))))


def idf_of(stats: str = "docs", df: str = "df") -> Column:
    return F.ln(1 + (F.col(stats) - F.col(df) + 0.5) / (F.col(df) + 0.5))


def similar_terms(index: FieldIndex, number: int, leaf: grammar.Leaf) -> list[tuple[int, str, str, int, float]]:
    """leaf's number, field, term, df, weight: in each field the EXPANSIONS terms most like a fuzzy word, with the
    greatest df among them. The dictionary is scanned, not the postings, and what comes back is bounded."""
    word, most = leaf.text, leaf.edits
    near = [F.levenshtein("term", F.lit(word))] + [F.levenshtein("term", F.lit(v)) + 1 for v in grammar.swapped(word, 1)]
    near += [F.when(F.col("term").isin(twice), 2)] if most > 1 and (twice := grammar.swapped(word, 2)) else []
    edits = F.least(*near) if len(near) > 1 else near[0]
    length = F.char_length("term")
    rows = index.df.filter(length.between(len(word) - most, len(word) + most)).select("field", "term", "df", edits.alias("edits")).filter(F.col("edits") <= most)
    likeness = 1 - F.col("edits") / F.least(F.char_length("term"), F.lit(len(word)))
    best = Window.partitionBy("field").orderBy(F.desc("likeness"), "term")
    rows = rows.withColumn("likeness", likeness).filter("likeness > 0").withColumn("k", F.row_number().over(best)).filter(F.col("k") <= EXPANSIONS).collect()
    df = {f: max(r["df"] for r in rows if r["field"] == f) for f in {r["field"] for r in rows}}
    return [(number, r["field"], r["term"], df[r["field"]], r["likeness"] * leaf.boost) for r in rows]


def moved_back(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def with_gaps(places: list[Column], most: int) -> Column:
    """How often words, by their places in a field, are found as a phrase whose words are moved by most places in all: the
    sum of 1 / (1 + moves) over its windows.

    Places count from where the phrase would begin. A window is the last place of a word before that word's next one
    would be behind one of the others, and the first place of each other word from there on (of words at one place, those
    before it in the phrase are behind it already); its moves are what lies between its first and last place.
    """
    at = [moved_back(p, k) for k, p in enumerate(places)]

    def windows(w: int) -> Column:
        def share(x: Column) -> Column:
            first = [F.array_min(F.filter(p, lambda y: (y > x))) if v < w else F.array_min(F.filter(p, lambda y: (y >= x))) for v, p in enumerate(at) if v != w]

            def value(others: Column) -> Column:
                whole = ~F.exists(others, lambda y: y.isNull())
                nearest = F.array_min(others)
                tied = F.exists(F.slice(others, 1, w), lambda y: y == nearest) if w else F.lit(False)  # with a word before it
                last = ~F.exists(at[w], lambda y: (y > x) & ((y < nearest) | (y == nearest) & ~tied))
                moves = F.array_max(others) - x
                return F.when(whole & last & (moves <= most), 1 / (1 + moves)).otherwise(0.0)

            return let(F.array(*first), value)

        return F.coalesce(F.aggregate(F.transform(at[w], share), F.lit(0.0), lambda s, y: s + y), F.lit(0.0))

    return reduce(lambda a, b: a + b, [windows(w) for w in range(len(at))])


def leaf_scores(index: FieldIndex, leaves: list[grammar.Leaf]) -> DataFrame:
    """leaf, field, doc_id, score of the leaves, by their place in the list; a wildcard scores its boost for each term."""
    spark, stats = index.postings.sparkSession, F.broadcast(index.stats)
    numbered, parts = list(enumerate(leaves)), []
    words = [(i, x.text, x.boost) for i, x in numbered if x.kind == "word"]
    if words:
        each = F.broadcast(spark.createDataFrame(words, "leaf int, term string, weight double"))
        terms = [*{t for _, t, _ in words}]
        weights = F.broadcast(index.df.filter(F.col("term").isin(terms)).join(each, "term"))
        hits = index.postings.filter(F.col("term").isin(terms)).join(weights, ["field", "term"]).join(stats, "field")
        parts.append(hits.select("leaf", "field", "doc_id", (F.col("weight") * idf_of() * saturated()).alias("score")))
    similar = [r for i, x in numbered if x.kind == "fuzzy" for r in similar_terms(index, i, x)]
    if similar:
        weights = F.broadcast(spark.createDataFrame(similar, "leaf int, field string, term string, df long, weight double"))
        hits = index.postings.filter(F.col("term").isin([*{r[2] for r in similar}])).join(weights, ["field", "term"]).join(stats, "field")
        parts.append(hits.select("leaf", "field", "doc_id", (F.col("weight") * idf_of() * saturated()).alias("score")))
    for i, x in numbered:
        if x.kind == "wildcard":
            start, pattern = grammar.wildcard(x.text)
            fits = F.col("term").startswith(start) & (F.col("term").rlike(pattern) if pattern else F.lit(True))
            # The dictionary is matched, and its few rows go to the postings.
            known = index.df.filter(fits).select("field", "term")
            parts.append(index.postings.filter(F.col("term").startswith(start)).join(known, ["field", "term"], "left_semi").select(F.lit(i).alias("leaf"), "field", "doc_id", F.lit(x.boost).alias("score")))
        elif x.kind == "phrase":
            own = x.text.split(" ")
            times = F.broadcast(spark.createDataFrame([*Counter(own).items()], "term string, times long"))
            weight = F.broadcast(index.df.filter(F.col("term").isin(own)).join(times, "term").join(stats, "field").groupBy("field").agg(F.sum(F.col("times") * idf_of()).alias("weight")))
            # Of each document: its places of each word, then places of the first word that all others follow.
            places = {w: F.max(F.when(F.col("term") == w, F.col("positions"))) for w in dict.fromkeys(own)}
            rows = index.postings.filter(F.col("term").isin(own)).groupBy("field", "doc_id", "dl").agg(*[c.alias(f"p{k}") for k, c in enumerate(places.values())])
            at = {w: F.col(f"p{k}") for k, w in enumerate(places)}
            starts = reduce(F.array_intersect, [moved_back(at[w], k) for k, w in enumerate(own)])
            hits = rows.withColumn("tf", with_gaps([at[w] for w in own], x.edits) if x.edits else F.size(starts)).filter("tf > 0").join(weight, "field").join(stats, "field")
            parts.append(hits.select(F.lit(i).alias("leaf"), "field", "doc_id", (F.lit(x.boost) * F.col("weight") * saturated()).alias("score")))
    return reduce(DataFrame.unionByName, parts) if parts else index.postings.limit(0).select(F.lit(0).alias("leaf"), "field", "doc_id", F.lit(0.0).alias("score"))


def matched(node: grammar.Group | grammar.Leaf, places: Iterator[int]) -> Column:
    """Whether a field of a document matches node; s0, s1, ... are the scores of all leaves in order, null where one
    doesn't match."""
    if isinstance(node, grammar.Leaf):
        return F.col(f"s{next(places)}").isNotNull()
    each = [(must, matched(x, places)) for must, x in node.clauses]
    musts = [c for must, c in each if must]
    return reduce(lambda a, b: a & b, musts) if musts else reduce(lambda a, b: a | b, [c for _, c in each])


def total(node: grammar.Group | grammar.Leaf, places: Iterator[int]) -> Column:
    """The score of node where it matches: that of a group that doesn't match isn't counted."""
    if isinstance(node, grammar.Leaf):
        return F.coalesce(f"s{next(places)}", F.lit(0.0))
    out = F.lit(0.0)
    for _, x in node.clauses:
        first = next(places)
        size = len([*x.leaves()]) if isinstance(x, grammar.Group) else 1
        own = [first, *islice(places, size - 1)]
        out = out + F.when(matched(x, iter(own)), total(x, iter(own))).otherwise(0.0)
    return out


def bm25(index: FieldIndex, docs: DataFrame, command: str, k: int = 5, boosts: dict[str, float] | None = None) -> DataFrame:
    """doc_id, score: k best of docs (doc_id and filter columns) for a command of filters and free text.

    Text is read by the grammar, against each field by itself: a document matches where one of its fields matches the
    whole tree, and scores the sum over such fields. Filters don't score. Without text every document scores 1.
    """
    parsed = parse(command)
    held = docs.filter(parsed.predicate()).select("doc_id")
    spark = docs.sparkSession
    text = spark.range(1).select(norm_query(F.lit(parsed.text)).alias("t")).first()["t"]
    if not text:
        return held.select("doc_id", F.lit(1.0).alias("score")).orderBy("doc_id").limit(k)
    tree = analyzed(spark, grammar.parse(text))
    leaves = [*tree.leaves()] if tree else []
    scores = leaf_scores(index, leaves)
    if tree and (tree.has_must() or any(x.kind == "wildcard" for x in leaves)):
        # A wildcard counts once, however many terms fit.
        each = [(F.max if x.kind == "wildcard" else F.sum)(F.when(F.col("leaf") == i, F.col("score"))).alias(f"s{i}") for i, x in enumerate(leaves)]
        scores = scores.groupBy("field", "doc_id").agg(*each).filter(matched(tree, iter(range(len(leaves))))).select("field", "doc_id", total(tree, iter(range(len(leaves)))).alias("score"))
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in boosts.items() for x in p]), F.col("field")), F.lit(1.0)) if boosts else F.lit(1.0)
    scores = scores.groupBy("doc_id").agg(F.sum(F.col("score") * weight).alias("score"))
    scores = scores.join(held, "doc_id", "left_semi") if parsed.filters else scores
    return scores.orderBy(F.desc(F.round("score", 12)), "doc_id").limit(k)


def bm25_many(index: FieldIndex, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, doc_id, rank, score of many queries (query_id, text), as bm25() scores plain words: no filters, no grammar."""
    words = queries.select("query_id", F.explode(analyze(norm_query(F.col("text")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").cast("double").alias("w"))
    return index.impacts().best(words, k).select("query_id", "doc_id", "rank", "score")


def hits(found: DataFrame, docs: DataFrame, *columns: str, description: str | None = None, key: str = "doc_id") -> DataFrame:
    """found (the best by doc_id and score: a few rows) with columns of docs, and the description cut to a snippet, best first."""
    kept = [F.col(c) for c in columns] + ([snippet(F.col(description)).alias("snippet")] if description else [])
    rows = docs.select(F.col(key).alias("doc_id"), *[c for c in kept])
    return rows.join(F.broadcast(found.select("doc_id", "score")), "doc_id").orderBy(F.desc(F.round("score", 12)), "doc_id")


def dense(rows: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """vec_id, score: cosine of a dense vector with each row's (vec_id, embedding)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    own = F.transform("embedding", lambda x: x.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(total(F.transform(own, lambda x: x * x)))
    length = math.sqrt(sum(float(x) ** 2 for x in query)) or 1e-12
    score = total(F.zip_with(own, q, lambda a, b: a * b)) / (F.when(size == 0, 1e-12).otherwise(size) * length)
    return rows.select("vec_id", score.alias("score")).orderBy(F.desc(F.round("score", 9)), "vec_id").limit(k)
