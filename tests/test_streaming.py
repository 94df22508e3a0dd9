"""Ingestion by chunks with a manifest, and rows that no earlier run has had."""

from pyspark.sql import functions as F

from showloom.operators.index import Index
from showloom.streaming.ingest import ingest_chunks, ingest_new, read_manifest


def files(spark, folder, rows):
    spark.createDataFrame(rows, "id long, name string").coalesce(1).write.mode("append").parquet(folder)


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    source, out, manifest, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "manifest", "checkpoint"))
    run = lambda: ingest_chunks(spark, source, "id long, name string", out, manifest, checkpoint, transform=lambda df: df.filter("id > 0"))
    state = lambda: (sorted(r["id"] for r in spark.read.parquet(out).collect()), sorted(r["rows"] for r in read_manifest(spark, manifest).collect()))
    files(spark, source, [(1, "a"), (2, "b"), (-1, "c")])
    files(spark, source, [(-5, "none of these stays")])
    run()
    assert state() == ([1, 2], [0, 2])
    files(spark, source, [(3, "d")])
    run()
    assert state() == ([1, 2, 3], [0, 1, 2])
    # The last batch's end wasn't noted, so it is run again.
    last = max((tmp_path / "checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert state() == ([1, 2, 3], [0, 1, 2])
    names = {r["chunk_file"] for r in read_manifest(spark, manifest).collect()}
    assert names == {p.name for p in (tmp_path / "in").glob("part-*")}
    assert all(r["processed_at"] for r in read_manifest(spark, manifest).collect())


def test_keys_of_earlier_runs_are_known(spark, tmp_path):
    source, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    run = lambda: ingest_new(spark, source, "id long, name string", out, checkpoint, ["name"], transform=lambda df: df.filter("name <> ''"))
    files(spark, source, [(1, "ann"), (1, "ann"), (2, ""), (3, None), (4, "bo")])
    assert run() == 5
    files(spark, source, [(9, "ann"), (8, "cy"), (7, "bo")])
    assert run() == 3 and run() == 0
    assert sorted((r["name"], r["id"]) for r in spark.read.parquet(out).collect()) == [("ann", 1), ("bo", 4), ("cy", 8)]


def test_weights_by_type_in_a_saved_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "show", "a a a b", "b"), (2, "film", "a a a b", "b"), (3, None, "a", None), (4, "other", "c c", "c")], "doc_id long, kind string, text string, name string")
    weights = {"show": {"text": 0.5, "name": 4.0}, "film": {"text": 0.0}}
    built = Index.build(docs, weights, fields=["text", "name"], by="kind")
    want = {(1, "a", 2), (1, "b", 5), (2, "b", 1), (3, "a", 1), (4, "c", 3)}
    assert {tuple(r) for r in built.postings.select("doc_id", "term", "tf").collect()} == want
    built.save(str(tmp_path))
    assert {tuple(r) for r in Index.load(spark, str(tmp_path)).postings.select("doc_id", "term", F.col("tf")).collect()} == want
