"""What several operators share: cutting lineage, the shared folder, word splitting."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space of the word definition ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"
#: For bytes.translate: each of SPACES to a blank.
TO_BLANK = bytes.maketrans(SPACES.encode(), b" " * len(SPACES))
#: Rows of an Arrow batch that are turned into Python objects at once; bytes of text that are worked on at once.
SLICE, SLICE_BYTES = 256, 7 << 19
#: Most rows of an Arrow batch where texts are sent to Python.
BATCH = 1200


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, without lineage. A lost executor doesn't lose it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


#: Numbers in a block of running_starts().
BLOCK_OF_TOTALS = 1024


def running_starts(totals: DataFrame, number: str, total: str, block: int | None = None) -> DataFrame:
    """number, first: the sum of total over all rows with a smaller number, for totals with each number once. In two
    steps, over blocks of numbers and within each, so that no window has more than a block or a row a block."""
    rows = totals.select(F.col(number), F.col(total).alias("t"), F.floor(F.col(number) / (block or BLOCK_OF_TOTALS)).alias("b"))
    before = lambda w: F.coalesce(F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = rows.groupBy("b").agg(F.sum("t").alias("t")).select("b", before(Window.orderBy("b")).alias("ahead"))
    return rows.withColumn("inside", before(Window.partitionBy("b").orderBy(number))).join(ahead, "b").select(number, (F.col("ahead") + F.col("inside")).alias("first"))


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's URI, and the folder's path there. A bare path is a local one."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def put_file(folder: str, name: str, write: Callable[[pa.NativeFile], None]) -> None:
    """Writes a file whole or not at all: each attempt writes a file of its own, the last step renames it."""
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    own = f"{path}/_tmp-{uuid.uuid4().hex}"
    with fs.open_output_stream(own, compression=None) as out:
        write(out)
    fs.move(own, f"{path}/{name}")


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\x20\x09-\x0D]+`` of a text, in UTF-8; a lone surrogate can't occur in Spark's strings."""
    return (text or "").encode().translate(TO_BLANK).split()


def python_rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[pa.RecordBatch, list[list]]]:
    """Slices of the batches, each with the named columns as Python lists, so that few objects live at once."""
    for batch in batches:
        at = [batch.schema.get_field_index(n) for n in names]
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            yield part, [part.column(i).to_pylist() for i in at]


def offsets(texts: pa.Array) -> np.ndarray:
    """Where each text starts in the bytes of a string array, and where the last one ends."""
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def text_slices(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[pa.RecordBatch, pa.StringArray]]:
    """Slices of the batches whose texts have about SLICE_BYTES (a longer text is alone), with the texts, null as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(name))
        texts = pc.fill_null(texts, "") if texts.null_count else texts
        ends = offsets(texts)
        start = 0
        while start < len(texts):
            end = max(start + 1, int(np.searchsorted(ends, ends[start] + SLICE_BYTES)))
            yield batch.slice(start, end - start), texts.slice(start, end - start)
            start = end


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of this session's Arrow batches to BATCH, as rows are whole texts here."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns of df, found by exact name."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def blanked(text: Column) -> Column:
    """text with each of SPACES as a blank. Plain replacements scan bytes, which translate() doesn't."""
    for c in SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def occurrences(text: Column, char: str) -> Column:
    """How often an ASCII character is in text."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(char), F.lit("")))



def held(value: Column) -> Column:
    """value, in a column through which no filter is pushed: pushed down, a filter would have the expressions below
    written out for each of their uses, and evaluated as often."""
    return F.when(F.monotonically_increasing_id() >= 0, value)
