"""The pipeline against a brute-force version, stage by stage, and over odd tables."""

import hashlib
import shutil

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from showloom.llm import quality_model
from showloom.llm.queries import ORACLES
from tests.llm.test_groups import fingerprint_by_hand, links_by_hand, roots_by_hand
from tests.llm.test_texts import held_by


def test_run_equals_brute_force(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    texts = dict(db.execute("SELECT doc_id, text FROM documents").fetchall())
    rules = db.execute(f"SELECT doc_id FROM ({ORACLES['op3_quality_rules']}) WHERE kept").fetchall()
    kept = sorted(i for (i,) in rules)
    labels = dict(db.execute(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    docs = spark.createDataFrame([(i, texts[i]) for i in kept], "doc_id long, text string")
    model = quality_model.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = [i for i in kept if model.score(np.array([quality_model.statistics(texts[i])]))[0] >= 0.5]
    assert len(good) > 0.9 * sum(labels.get(i, 1) for i in kept)
    prints = {i: fingerprint_by_hand(texts[i]) for i in good}
    fps = np.unique(np.array([*prints.values()], np.uint64))
    roots, at = roots_by_hand(links_by_hand(fps), range(len(fps))), {int(f): k for k, f in enumerate(fps)}
    least = {}
    for i in good:
        least.setdefault(roots[at[prints[i]]], i)  # good ascends
    items = [t for (t,) in db.execute(f"SELECT text FROM '{sf}/benchmark.parquet'").fetchall()]
    left = [i for i in least.values() if not any(held_by(texts[i], t) >= 0.8 for t in items)]
    assert 0 < len(left) < len(least) < len(good) <= len(kept) < len(texts)
    piece = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {(i, len(ids := piece.encode(texts[i])), sha(",".join(map(str, ids))), sha(piece.decode(ids))) for i in left}
    got = [tuple(r) for r in corpus_pipeline.run(spark, sf).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.fixture
def odd(spark, sf, tmp_path):
    """A folder whose documents hold nulls, repeats, an extra column and a very long text."""
    clean = spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars > 900").limit(30).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x") for r in clean]
    rows += [rows[0], rows[0], (None, rows[1][1], None, None, None, None), (9001, None, "en", "s", 0, "x"), (9002, "", "en", "s", 0, "x"), (9003, " ".join(r[1] for r in rows) * 3, "en", "s", 1, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `_row` string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        shutil.copy(f"{sf}/{name}.parquet", tmp_path / f"{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_over_odd_tables(spark, odd, empty):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    docs = docs.limit(0) if empty else docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, odd)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert len(rows) <= docs.count() and (empty or rows), name
        assert set(map(tuple, rows)) <= set(map(tuple, docs.collect())), name
    once = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, odd).collect() if r["doc_id"] is not None]
    assert len(once) == len(set(once))
    assert corpus_pipeline.pieces(spark, docs, odd).count() == docs.count()


def test_stages_are_five():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "simhash_dedup", "decontamination", "sentencepiece"]
