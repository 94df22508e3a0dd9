"""Parts of saved indexes that a search doesn't read aren't built for it, and can be added later."""

import os

from pyspark.sql import functions as F

from showloom.operators.index import Index
from showloom.operators.search import FieldIndex
from showloom.operators.vectors import Vectors
from showloom.plans import catalogue

DOCS = [(1, "a b a c"), (2, "b c"), (3, ""), (4, None), (5, "a d d é")]


def docs(spark, rows=DOCS):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_single_searches_build_no_impacts(spark, sf, monkeypatch):
    monkeypatch.setattr(catalogue, "_SAVED", {})
    for name in ("search_bm25_multifield", "search_vector_tfidf", "search_cosine_classic"):
        catalogue.QUERIES[name](spark, sf)
    assert catalogue._SAVED
    for folder in catalogue._SAVED.values():
        assert not [n for n in os.listdir(folder.removeprefix("file:").replace("//", "/")) if n.startswith("impacts")]


def test_documents_of_an_index_need_no_postings(spark):
    index = Index.build(docs(spark, [*DOCS, (6, "K"), (7, "-"), (1, "b")]), {"text": 1.0})
    assert sorted(r[0] for r in index.ids().collect()) == sorted(r[0] for r in index.postings.select("doc_id").distinct().collect()) == [1, 2, 5, 6]


def test_field_index_counts_within_rows_as_grouping_does(spark, tmp_path):
    for i, rows in enumerate((DOCS, [*DOCS, (1, "x y z a")])):
        built = FieldIndex.build(docs(spark, rows), ["text"])
        built.save(str(tmp_path / str(i)), batches=False)
        read = lambda x: sorted((r["field"], r["term"], r["doc_id"], r["dl"], r["tf"], sorted(r["positions"])) for r in x.postings.collect())
        held = FieldIndex.load(spark, str(tmp_path / str(i)))
        assert read(held) == read(built) and held.impacts().blocks.count() > 0


def test_vectors_are_scanned_or_inverted_with_the_same_result(spark, tmp_path):
    Vectors.build(docs(spark, [(i, "alpha beta " * (i % 3) + "gamma " * (i % 2) + f"w{i}") for i in range(40)]), "text").save(str(tmp_path), batches=False)
    scanned = Vectors.load(spark, str(tmp_path))
    Vectors.add_impacts(spark, str(tmp_path))
    inverted = Vectors.load(spark, str(tmp_path))
    assert scanned.inverted is None and inverted.inverted is not None
    found = [x.search("alpha gamma", 15).select("doc_id", F.round("score", 9).alias("s")).collect() for x in (scanned, inverted)]
    assert found[0] == found[1] and len(found[0]) == 15
