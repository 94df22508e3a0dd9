"""A crawl over a store of fetched pages: the link graph, and breadth-first levels over it."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showloom.functions.urls import is_skipped, links, resolve, store_path
from showloom.operators.robots import host_of, judged


def fetch(urls: DataFrame, get: Callable[[str], tuple[int, str, str]], delay: float = 0.0, lanes: int = 1) -> DataFrame:
    """url, html of urls (url): what get(url) gives, if its status is 2xx and its type text/html, else null.

    get returns status, content type and text, and may raise OSError; it runs in the tasks, and keeps its own timeout. With
    a delay, all URLs of a host (of each of its lanes) go to one task, in order, which waits so many seconds between two.
    """

    def page(url: str) -> str | None:
        try:
            status, kind, text = get(url)
        except OSError:
            return None
        return text if 200 <= status < 300 and "text/html" in kind.lower() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for url, lane in zip(*[c.to_pylist() for c in batch.columns], strict=True):  # a page at a time, as pages may be large
                if delay and lane == last:
                    time.sleep(delay)
                last = lane
                yield pa.RecordBatch.from_arrays([pa.array([url], pa.string()), pa.array([None if url is None else page(url)], pa.string())], ["url", "html"])

    rows = urls.select("url", F.concat_ws(" ", host_of(F.col("url")), F.pmod(F.xxhash64("url"), F.lit(lanes))).alias("lane"))
    dealt = rows.repartition("lane").sortWithinPartitions("lane", "url") if delay else rows
    return dealt.mapInArrow(run, "url string, html string")


def link_graph(pages: DataFrame, root: str, allowed: Column | None = None) -> DataFrame:
    """src, dst: distinct links of pages (url, html) to the root's own site that robots rules (on dst) allow."""
    rows = pages.select(F.col("url").alias("src"), F.explode(links(F.col("html"))).alias("link")).filter(~is_skipped(F.col("link")))
    rows = rows.select("src", resolve(F.col("link"), root).alias("dst")).filter(F.startswith("dst", F.lit(root)))
    return (rows.filter(allowed) if allowed is not None else rows).distinct()


def breadth_first(graph: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """url, level of all that seeds (url) reach; a level is the frontier's links less the levels before it, and is written."""
    frontier, level = seeds.select("url").distinct().withColumn("level", F.lit(0)).checkpoint(), 0
    visited = frontier
    while depth is None or level < depth:
        level += 1
        found = graph.join(frontier.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct()
        frontier = found.join(visited, "url", "left_anti").withColumn("level", F.lit(level)).checkpoint()
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)  # of written levels; none is written again
    return visited


def crawl(pages: DataFrame, seeds: DataFrame, root: str, depth: int | None = None, allowed: Column | None = None) -> DataFrame:
    """url, level, fetched (the store has content for it), n_links of a crawl; a page without content is visited once."""
    graph = link_graph(pages.filter("html is not null and html <> ''"), root, allowed).checkpoint()
    reached = breadth_first(graph, seeds, depth)
    counts = graph.groupBy(F.col("src").alias("url")).agg(F.count("*").alias("n_links"))
    stored = pages.select("url", (F.coalesce("html", F.lit("")) != "").alias("fetched")).groupBy("url").agg(F.max("fetched").alias("fetched"))
    rows = reached.join(stored, "url", "left").join(counts, "url", "left")
    return rows.select("url", "level", F.coalesce("fetched", F.lit(False)).alias("fetched"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def exists(df: DataFrame, path: str) -> bool:
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(at)


def fetch_all(seeds: DataFrame, get: Callable[[str], tuple[int, str, str]], folder: str, root: str, robots: DataFrame | None = None, depth: int | None = None, delay: float = 0.0, lanes: int = 1) -> DataFrame:
    """A crawl that fetches, level by level: url, level, html (null where nothing came) of all that it visited.

    A level fetches what the links of the level before lead to, on the root's own site, as far as robots (a rule_table())
    allow and no level has visited yet, failed fetches included. It is written in folder as pages (Parquet) and as a part
    of the URL map (url, path) of the pages that came; so a crawl that was stopped goes on from its last whole level, and
    fetches nothing again but what the level it was in had fetched. Seeds are fetched whatever robots say.
    """
    spark, level, levels = seeds.sparkSession, 0, []

    def written(n: int) -> str:
        return f"{folder}/pages/level={n}"

    while depth is None or level <= depth:
        if not exists(seeds, f"{written(level)}/_SUCCESS"):
            if level:
                visited = spark.read.parquet(*levels).select("url")
                pages = spark.read.parquet(levels[-1]).filter("html is not null")
                found = link_graph(pages, root).select(F.col("dst").alias("url")).distinct()
                found = judged(found, robots).filter("allowed").select("url") if robots is not None else found
                frontier = found.join(visited, "url", "left_anti")
            else:
                frontier = seeds.select("url").filter("url is not null").distinct()
            fetch(frontier, get, delay, lanes).write.mode("overwrite").parquet(written(level))
        stored = spark.read.parquet(written(level))
        if not exists(seeds, f"{folder}/map/level={level}/_SUCCESS"):
            kept = stored.filter("html is not null").select("url", store_path(F.col("url")).alias("path"))
            kept.write.mode("overwrite").options(header=True, sep="\t", lineSep="\n").csv(f"{folder}/map/level={level}")
        levels.append(written(level))
        if stored.isEmpty():
            break
        level += 1
    return spark.read.option("basePath", f"{folder}/pages").parquet(*levels).select("url", "level", "html")
