"""Incremental ingestion: each new file once, by a checkpointed stream that stops when all are taken."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from showloom.sources.tables import PAGE, SCHEMAS, read_tsv, wiki_shows, write_tsv


class Counter(StreamingQueryListener):
    """Rows of each run of a stream: a query itself remembers its last batches only."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = defaultdict(int)
        self.ended: dict[str, Event] = defaultdict(Event)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows[str(event.progress.runId)] += event.progress.numInputRows

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.runId)].set()

    def total(self, run: str) -> int:
        """Once all events of a run that has ended are here, which come a little later."""
        if not self.ended[run].wait(60):
            raise TimeoutError(f"no word of the end of run {run}")
        return self.rows[run]


def ingest(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, kind: str = "parquet", transform: Callable[[DataFrame], DataFrame] = lambda df: df, **options: str) -> int:
    """Appends transform of the files in source that weren't taken before to Parquet in out; returns how many rows."""
    rows = transform(spark.readStream.format(kind).schema(schema).options(**options).load(source))
    counter = Counter()
    spark.streams.addListener(counter)
    try:
        query = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        query.awaitTermination()
        return counter.total(str(query.runId))
    finally:
        spark.streams.removeListener(counter)


def ingest_chunks(spark: SparkSession, source: str, schema: str, out: str, manifest: str, checkpoint: str, kind: str = "parquet", transform: Callable[[DataFrame], DataFrame] = lambda df: df, **options: str) -> None:
    """Appends transform of the files in source that weren't taken before to Parquet in out, and to the manifest a line
    for each of them: chunk_file, rows (of the transform, 0 too) and processed_at.

    A batch writes folders of its own number, so one that is run again after a failure adds nothing. transform keeps a
    column chunk, the name of the file that a row is from.
    """

    def batch(rows: DataFrame, number: int) -> None:
        own = f"{out}/batch={number}"
        transform(rows).write.mode("overwrite").parquet(own)
        counts = rows.sparkSession.read.parquet(own).groupBy("chunk").agg(F.count("*").alias("rows"))
        lines = rows.select("chunk").distinct().join(counts, "chunk", "left")
        lines = lines.select(F.col("chunk").alias("chunk_file"), F.coalesce("rows", F.lit(0)).alias("rows"), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("processed_at"))
        write_tsv(lines, f"{manifest}/batch={number}")

    read = spark.readStream.format(kind).schema(schema).options(**options).load(source).withColumn("chunk", F.col("_metadata.file_name"))
    read.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_manifest(spark: SparkSession, manifest: str) -> DataFrame:
    """chunk_file, rows, processed_at of all batches."""
    return read_tsv(spark, f"{manifest}/batch=*", SCHEMAS["chunks"]).withColumn("rows", F.col("rows").cast("long"))


def ingest_new(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, keys: list[str], kind: str = "parquet", transform: Callable[[DataFrame], DataFrame] = lambda df: df, **options: str) -> int:
    """Appends those rows of transform of new files whose keys no earlier run, nor an earlier row of this one, has had;
    returns how many rows were read. The keys seen are kept as the stream's state, in its checkpoint: one row a key."""
    return ingest(spark, source, schema, out, checkpoint, kind, lambda df: transform(df).dropDuplicates(keys), **options)


def ingest_dump(spark: SparkSession, source: str, out: str, checkpoint: str, keywords: list[str] | None = None) -> int:
    """Television pages of the dump chunks in source that weren't taken before."""
    pages = lambda df: wiki_shows(df.select(F.col("id").alias("page_id"), "title", F.col("revision.text._VALUE").alias("raw_text")), keywords)
    return ingest(spark, source, PAGE, out, checkpoint, kind="xml", transform=pages, rowTag="page")
