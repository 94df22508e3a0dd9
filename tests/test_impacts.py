"""Batches of queries by impacts against brute force, and how much they read."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from showloom.operators import impacts, search
from showloom.operators.impacts import Impacts
from showloom.operators.index import Index
from showloom.operators.vectors import Vectors


def best_by_hand(postings, queries, k):
    of = collections.defaultdict(list)
    for term, doc, x in postings:
        of[term].append((doc, x))
    out = set()
    for query, terms in queries.items():
        scores = collections.Counter()
        for term, w in terms.items():
            for doc, x in of[term]:
                scores[doc] += w * x
        ranked = sorted((-round(s, 12), d) for d, s in scores.items())[:k]
        out |= {(query, d, i + 1, round(-s, 9)) for i, (s, d) in enumerate(ranked)}
    return out


def zipf(n, terms, seed):
    """Postings whose terms are from in nearly all documents to in few, with some very high impacts."""
    random.seed(seed)
    out = []
    for t in range(terms):
        for d in random.sample(range(n), max(1, n // (t + 1))):
            out.append((f"t{t}", d, round(random.random() * (1 + t) + (50 if random.random() < 0.003 else 0), 3) + 0.001))
    return out


@pytest.mark.parametrize("shards, first, block, k", [(1, 16, 512, 10), (3, 4, 20, 3), (5, 2, 5, 1), (2, 16, 64, 40), (4, 1, 1, 2)])
def test_batches_equal_brute_force(spark, tmp_path, monkeypatch, shards, first, block, k):
    monkeypatch.setattr(impacts, "FIRST", first)
    monkeypatch.setattr(impacts, "BLOCK", block)
    postings = zipf(600, 60, shards) + [("tie", d, 0.5) for d in range(90)] + [("one", 7, 1.0)]
    queries = {q: {f"t{random.choice([*range(12), *range(60)])}": random.choice([1, 2, 0.25]) for _ in range(random.randrange(1, 9))} for q in range(25)} | {90: {"tie": 1.0}, 91: {"one": 3.0, "t0": 0.01}, 92: {"unknown": 1.0}, 93: {"tie": 1.0, "t0": 0.001, "unknown": 9.0}}
    index = Impacts.build(spark.createDataFrame(postings, "term string, doc_id long, x double"), shards)
    index.save(str(tmp_path))
    index = Impacts.load(spark, str(tmp_path))
    weights = spark.createDataFrame([(q, t, float(w)) for q, own in queries.items() for t, w in own.items()], "query_id long, term string, w double")
    got = {(r["query_id"], r["doc_id"], r["rank"], round(r["score"], 9)) for r in index.best(weights, k).collect()}
    assert got == best_by_hand(postings, queries, k)
    one = {r["doc_id"]: round(r["score"], 9) for r in index.one(queries[3]).collect()}
    want = {d: s for _, d, _, s in best_by_hand(postings, {3: queries[3]}, 10**6)}
    assert one == pytest.approx(want)


def test_rounds_and_other_keys(spark, monkeypatch):
    monkeypatch.setattr(impacts, "SENT", 5)
    postings = [(t, f"d{d}", x) for t, d, x in zipf(80, 10, 1)]
    queries = {f"q{q}": {f"t{q % 10}": 1.0, "t1": 0.5} for q in range(9)}
    index = Impacts.build(spark.createDataFrame(postings, "term string, doc_id string, x double"), 2)
    weights = spark.createDataFrame([(q, t, w) for q, own in queries.items() for t, w in own.items()], "query_id string, term string, w double")
    got = {(r["query_id"], r["doc_id"], r["rank"], round(r["score"], 9)) for r in index.best(weights, 4).collect()}
    assert got == best_by_hand(postings, queries, 4)
    assert index.best(weights.limit(0), 4).count() == 0
    empty = Impacts.build(spark.createDataFrame([], "term string, doc_id string, x double"))
    assert empty.best(weights, 4).count() == 0


def test_blocks_are_skipped(spark):
    """A rare word with a high impact decides; of the common ones little is read."""
    postings = zipf(20_000, 3, 5) + [("rare", d, 400.0 + d) for d in range(0, 20_000, 400)]
    index = Impacts.build(spark.createDataFrame(postings, "term string, doc_id long, x double"), 4)
    weights = spark.createDataFrame([(1, "rare", 1.0), (1, "t0", 0.5), (1, "t1", 0.5)], "query_id long, term string, w double")
    read, held = index.searched(weights, 5, counts=True).agg(F.sum("read"), F.sum("held")).first()
    assert 0 < read < 0.1 * held
    alone = spark.createDataFrame([(2, "t0", 1.0)], "query_id long, term string, w double")
    read, held = index.searched(alone, 5, counts=True).agg(F.sum("read"), F.sum("held")).first()
    assert 0 < read <= held < 0.1 * 20_000  # before anything is shuffled
    assert {(r["doc_id"], round(r["score"], 9)) for r in index.best(weights, 5).collect()} == {(d, s) for _, d, _, s in best_by_hand(postings, {1: {"rare": 1.0, "t0": 0.5, "t1": 0.5}}, 5)}


def test_bm25_batches_equal_single_queries(spark, tmp_path):
    random.seed(2)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(d, " ".join(random.choices(words, [1 / (i + 1) for i in range(40)], k=random.randrange(30))), random.choice(words)) for d in range(200)], "doc_id long, text string, source string")
    built = search.FieldIndex.build(docs, ["text", "source"])
    built.save(str(tmp_path))
    queries = [(q, " ".join(random.choices(words, k=q % 5 + 1))) for q in range(6)] + [(8, ""), (9, None)]
    for index in (built, search.FieldIndex.load(spark, str(tmp_path))):
        got = search.bm25_many(index, spark.createDataFrame(queries, "query_id long, text string"), 4).collect()
        for q, text in queries[:6]:
            want = [(r["doc_id"], pytest.approx(r["score"])) for r in search.bm25(index, docs, text, 4).collect()]
            assert [(r["doc_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want
        assert {r["query_id"] for r in got} == set(range(6))


def test_saved_index_equals_the_one_built(spark, tmp_path):
    """Counting within rows, and adding up where an id has several rows, give what grouping by document gives."""
    random.seed(9)
    texts = [" ".join(random.choices(["a", "b", "c9", "dd", "é"], k=random.randrange(25))) for _ in range(60)] + ["", None]
    for ids in (range(62), [i // 2 for i in range(62)]):
        docs = spark.createDataFrame([(i, t, random.choice(["a dd", "x", None])) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, source string")
        built = Index.build(docs, {"text": 0.5, "source": 2.1, "lang": 0.0})
        folder = str(tmp_path / str(len({*ids})))
        built.save(folder)
        saved = Index.load(spark, folder)
        rows = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
        assert rows(saved.postings, "doc_id", "term", "tf") == rows(built.postings, "doc_id", "term", "tf")
        assert rows(saved.terms, "term", "df", "n") == rows(built.terms, "term", "df", "n")
        assert rows(saved.norms("prob"), "doc_id", F.round("norm", 9)) == rows(built.norms("prob"), "doc_id", F.round("norm", 9))
        queries = spark.createDataFrame([(1, "a é dd"), (2, "c9 c9 b")], "query_id long, text string")
        of = lambda index, mode: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in search.cosine_many(index, queries, mode, 5).collect())
        assert of(saved, "smooth") == of(built, "smooth") and of(saved, "classic") == of(built, "classic")


def test_vector_search_fills_up_with_zero_scores(spark, tmp_path):
    docs = spark.createDataFrame([(d, text) for d, text in enumerate(["apple pie", "apple apple", "pear", "", "plum tart", None])], "doc_id long, text string")
    Vectors.build(docs, "text").save(str(tmp_path))
    store = Vectors.load(spark, str(tmp_path))
    got = [(r["doc_id"], r["score"]) for r in store.search("apple", 4).collect()]
    idf = {"apple": math.log(7 / 3), "pie": math.log(7 / 2)}
    assert got == [(1, pytest.approx(1.0)), (0, pytest.approx(idf["apple"] / math.hypot(*idf.values()))), (2, 0.0), (3, 0.0)]
    assert store.search("nothing known").count() == 0


def test_equal_documents_of_several_shards_have_equal_sums(spark):
    """In each shard another term weighs most, so terms are added in other orders there."""
    import itertools
    import random

    rng = random.Random(1)
    while True:  # three numbers whose sums round to two values at the twelfth place
        xs = [rng.random() for _ in range(3)]
        if len({round(a + b + c, 12) for a, b, c in itertools.permutations(xs)}) > 1:
            break
    terms = "abc"
    rows = [(t, d, x) for d in range(40) for t, x in zip(terms, xs, strict=True)]
    shard = {r["d"]: r["s"] for r in spark.range(2000).selectExpr("id as d", "pmod(xxhash64(id), 6) as s").collect()}
    order = dict(enumerate(itertools.permutations(terms)))  # of shards: which term has the greatest impact, and the next
    big = [(t, d, 5.0 - order[shard[d]].index(t)) for d in range(1000, 1100) for t in terms[:1] + terms[1:] if d % 3 == "abc".index(t)]
    queries = spark.createDataFrame([(1, t, 1.0) for t in terms], "query_id int, term string, w double")
    found = Impacts.build(spark.createDataFrame(rows + big, "term string, doc_id long, x double"), shards=6).best(queries, 140)
    assert len({r["score"] for r in found.filter("doc_id < 1000").collect()}) == 1
