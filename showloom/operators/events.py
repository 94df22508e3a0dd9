"""Log events: JSON lines, and a crawl's counters from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event string, url string, links_found long, response_time_s double, total_pages long, error string, retry_count long, reason string, message string, status string, details string"


def event(kind: str, **fields: Column) -> Column:
    """A JSON line of an event."""
    return F.to_json(F.struct(F.lit(kind).alias("event"), *[v.alias(k) for k, v in fields.items()]))


def write_log(events: DataFrame, path: str) -> None:
    """The rows as JSON lines; null fields are left out. Replaces what was there."""
    events.select(F.to_json(F.struct(*events.columns)).alias("value")).write.mode("overwrite").text(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """The events of log lines, whose JSON starts at the first brace; other lines are dropped."""
    rows = lines.select(F.from_json(F.regexp_extract(column, r"(\{.*\})\s*$", 1), SCHEMA).alias("e"))
    return rows.select("e.*").filter("event is not null")


def crawl_stats(events: DataFrame, seconds: float | None = None) -> DataFrame:
    """pages, links, errors, elapsed seconds (the given ones, else the sum of the events' response times), pages a second."""
    is_page = F.col("event") == "page_crawled"
    count = lambda p: F.sum(F.when(p, 1).otherwise(0)).cast("long")
    spent = F.lit(seconds) if seconds is not None else F.sum(F.when(is_page, F.col("response_time_s")))
    found = events.agg(count(is_page).alias("pages"), F.coalesce(F.sum(F.when(is_page, F.col("links_found"))), F.lit(0).cast("long")).alias("links"), count(F.col("event") == "crawl_error").alias("errors"), spent.cast("double").alias("s"))
    return found.select("pages", "links", "errors", F.coalesce("s", F.lit(0.0)).alias("elapsed"), F.when(F.col("s") > 0, F.col("pages") / F.col("s")).otherwise(0.0).alias("rate"))
