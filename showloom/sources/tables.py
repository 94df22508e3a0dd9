"""Files of the show catalog: tab-separated tables, encyclopedia dumps, keyword lists; and their writers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from showloom.functions.text import limited
from showloom.functions.urls import store_path
from showloom.functions.wiki import categories, category_matches, description, has_television_infobox, infobox, is_redirect, plain_text
from showloom.functions.dates import start_year
from showloom.functions.html import tables_together, together
from showloom.functions.text import norm_title
from showloom.operators.catalog import INFO, RENAMED
from showloom.operators.vectors import last_wins


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def strings(*names: str) -> str:
    return ", ".join(f"`{n}` string" for n in names)


#: Columns of each table, all text on disk.
SCHEMAS = {
    "shows": strings(*"url keywords title date_start date_start_iso date_end date_end_iso status network country runtime_minutes episode_count genres description season_count".split()),
    "actors": strings("actor_name", "actor_url"),
    "credits": strings("show_url", "actor_name", "role"),
    "seasons": strings("show_url", "season_number", "episode_count"),
    "episodes": strings(*"show_url season_number episode_number_in_season episode_number_overall episode_title airdate airdate_iso episode_url".split()),
    "url_mapping": strings("url", "path"),
    "extracted_mapping": strings("url", "path", "status"),
    "chunks": strings("chunk_file", "rows", "processed_at"),
}
#: What a path may start with and mean the same.
LEADING = r"^(\./|/)+"
#: Rows of a URL map that are broadcast at most.
SENT = 200_000
PAGE = "id long, title string, revision struct<text: struct<_VALUE: string>>"


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated table with a header, doubled quotes and line breaks in quoted fields; empty fields are null."""
    return spark.read.schema(schema).options(header=True, sep="\t", quote='"', escape='"', multiLine=True, lineSep="\n").csv(path)


def write_tsv(df: DataFrame, path: str, rows_a_file: int = 2000, mode: str = "overwrite") -> int:
    """Text columns cut to 4000 characters, null as empty, at most so many rows a file; replaces what was there, or with
    mode "append" adds to it. Returns how many rows were written, counted on the way."""
    seen = Observation()
    text = df.select(*[limited(F.col(f"`{c}`")).alias(c) for c in df.columns]).observe(seen, F.count(F.lit(1)).alias("n"))
    text.write.mode(mode).options(header=True, sep="\t", quote='"', escape='"', emptyValue="", lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, maxRecordsPerFile=rows_a_file).csv(path)
    return seen.get["n"]


def store_pages(pages: DataFrame, store: str, mapping: str) -> int:
    """Adds pages (url, html) to the store, Parquet of path, html and when they were stored, and their URLs to the URL
    map (url, path)."""
    rows = pages.select("url", store_path(F.col("url")).alias("path"), "html")
    rows.select("path", "html", F.current_timestamp().alias("stored_at")).write.mode("append").parquet(store)
    return write_tsv(rows.select("url", "path"), mapping, mode="append")


def stored_pages(spark: SparkSession, store: str, mapping: str) -> DataFrame:
    """url, path, html of the URL map; a page that isn't stored has null, one that was stored again what came last (of
    one run the greatest)."""
    urls = read_tsv(spark, mapping, SCHEMAS["url_mapping"]).distinct()
    pages = spark.read.parquet(store).groupBy("path").agg(F.max_by("html", F.struct("stored_at", "html")).alias("html"))
    return urls.join(pages, "path", "left").select("url", "path", "html")


def write_files(pages: DataFrame, folder: str, order: str | None = None) -> None:
    """Each page (path, html) as a file of its own below folder, which tasks can write to; null html writes none.

    Of pages with one path the last in the order column is written (without one, the greatest html). A page whose path is a
    folder of another page's isn't written, as no file can be there; a path with a ".." segment would leave the folder and
    is an error. Files appear whole, by a rename, so a task may run twice.
    """
    rows = pages.filter("html is not null").select(F.regexp_replace("path", LEADING, "").alias("path"), "html", (F.col(order) if order else F.col("html")).alias("place"))
    names = F.split("path", "/")
    above = F.transform(names, lambda _, k: F.array_join(F.slice(names, 1, k), "/"))  # "" and each folder
    folders = rows.select(F.explode(above).alias("path"))
    rows = last_wins(rows, "path", "place").select("path", "html").join(folders.distinct(), "path", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder) if ":/" in folder else (pafs.LocalFileSystem(), folder)
        made: set[str] = set()
        for batch in batches:
            for path, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ".." in path.split("/"):
                    raise ValueError(f"{path} is outside the folder")
                at = f"{root}/{path}"
                if (parent := at.rsplit("/", 1)[0]) not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                own = f"{parent}/._{uuid.uuid4().hex}"
                with fs.open_output_stream(own, compression=None) as out:
                    out.write(html.encode())
                fs.move(own, at)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()  # one number: the files are there


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length of the files of a glob, by name; their content isn't read."""
    return spark.read.format("binaryFile").load(path).select("path", "length").orderBy("path")


def write_tables(pages: DataFrame, folder: str) -> None:
    """The five tables of show pages (url, html) as tab-separated text; the parsed pages are written once before them, with
    what goes by URL. Tables are written side by side, so that cores aren't idle while the driver renames one's many files."""
    together(pages).write.mode("overwrite").parquet(f"{folder}/_parsed")
    made = tables_together(pages.sparkSession.read.parquet(f"{folder}/_parsed"))

    def write(name: str) -> None:
        names = [c.strip().split(" ")[0].strip("`") for c in SCHEMAS[name].split(",")]
        write_tsv(made[name].select(*names), f"{folder}/{name}")

    with ThreadPoolExecutor(len(made)) as pool:
        list(pool.map(write, made))
    delete(pages.sparkSession, f"{folder}/_parsed")


def read_pages(spark: SparkSession, mapping: DataFrame, folder: str) -> DataFrame:
    """url, path, html of a URL map (url, path): each path's file below folder, decoded as UTF-8; null where there is none.

    A file is found by its whole path below the folder, so files of one name don't meet. Rows of the map stay as they are.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri().getPath().rstrip("/") + "/"

    def key(uri: Column) -> Column:
        """A file's path below the folder; it comes as a URI: percent-encoded, with a plus sign as itself."""
        decoded = F.url_decode(F.replace(F.regexp_replace(uri, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
        return F.when(F.startswith(decoded, F.lit(root)), F.substr(decoded, F.lit(len(root) + 1)))

    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("html"), key(F.col("_metadata.file_path")).alias("key"))
    rows = mapping.select("url", "path", F.regexp_replace("path", LEADING, "").alias("key"))
    if rows.limit(SENT + 1).count() > SENT:
        return rows.join(files, "key", "left").select("url", "path", "html")
    # A map that is small goes to where files are read, so pages aren't shuffled; what isn't there is found by names alone.
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(key(F.col("_metadata.file_path")).alias("key"))
    lacking = rows.join(names, "key", "left_anti").withColumn("html", F.lit(None).cast("string"))
    return files.join(F.broadcast(rows), "key").select("url", "path", "html").unionByName(lacking.select("url", "path", "html"))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """page_id, title, raw_text, chunk (its file) of an XML dump (also .bz2, also a glob), by an explicit schema."""
    rows = spark.read.format("xml").option("rowTag", "page").schema(PAGE).load(path)
    return rows.select(F.col("id").alias("page_id"), "title", F.col("revision.text._VALUE").alias("raw_text"), F.col("_metadata.file_name").alias("chunk"))


def wiki_shows(pages: DataFrame, keywords: list[str] | None = None, kept: list[str] | None = None) -> DataFrame:
    """Rows of pages (page_id, title, raw_text) about television, with the columns kept of pages: cheap filters first,
    then infobox and text."""
    raw = F.col("raw_text")
    rows = pages.filter(~is_redirect(raw)).filter(has_television_infobox(raw)).withColumn("categories", categories(raw)).filter(category_matches(F.col("categories"), keywords or []))
    rows = rows.withColumn("info", infobox(raw)).withColumn("plain", plain_text(raw))
    fields = [F.coalesce(F.element_at("info", F.lit(RENAMED.get(c, c))), F.lit("")).alias(c) for c in INFO]
    return rows.select("page_id", F.coalesce("title", F.lit("")).alias("title"), norm_title(F.col("title")).alias("norm_title"), start_year(F.col("info")).alias("page_start_year"), *fields, description(F.col("plain")).alias("description"), F.coalesce("categories", F.lit("")).alias("categories"), *(kept or []))


def read_keywords(spark: SparkSession, path: str) -> list[str]:
    """Lines that aren't blank or comments; a list of filter words, so small. Without the file, none: no filter."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    rows = lines.select(F.trim("value").alias("k")).filter("k <> '' and not startswith(k, '#')")
    return [r["k"] for r in rows.collect()]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, url, title; rows whose id isn't a number are dropped, of repeated ids the last stays, by file and place.

    A file with line breaks in fields is read by one task, so that numbers of rows ascend within it.
    """
    place = F.struct("_metadata.file_path", F.monotonically_increasing_id()).alias("place")
    rows = read_tsv(spark, path, strings("doc_id", "url", "title")).select(F.col("doc_id").try_cast("long").alias("doc_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("title", F.lit("")).alias("title"), place)
    return last_wins(rows.filter("doc_id is not null"), "doc_id", "place")
