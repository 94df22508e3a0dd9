"""A corpus pipeline of five stages over documents, each one operator of the llm subpackage applied whole."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from showloom.llm import decontaminate, piece_codec, quality_model, quality_rules, simhash
from showloom.llm.common import delete, fresh_dir
from showloom.llm.queries import PIECE_BPE


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on those of docs with labels, predicts good."""
    return quality_model.keep_good(docs, quality_model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id."""
    return simhash.keep_one(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of what is left, and what they decode to, as digests by document."""
    return piece_codec.round_trip(docs, public_tokenizers.path(PIECE_BPE))


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("simhash_dedup", near_duplicates), ("decontamination", benchmark_free), ("sentencepiece", pieces)]

#: Trained trees and tokenizer ids aren't SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written in the shared folder and read again for the next one, after
    which the one before it is deleted."""
    docs, folder, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh_dir(spark, "pipeline"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
