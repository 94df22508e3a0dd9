"""Connected components of a graph of long ids, as DataFrames: each node gets the least id it can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showloom.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of edges (a, b), root the least node of its component.

    Large-star and small-star steps by turns until nothing moves: each turn links every node's neighbours to the least
    of them, so paths shorten by half or more and a turn's edges are no more than twice the edges there were. Least
    neighbours are pre-aggregated and written before they are joined, so Spark can split a node with many edges. Only
    two numbers a turn come to the driver.
    """

    def pairs(rows: DataFrame) -> DataFrame:
        return rows.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def with_least(rows: DataFrame) -> DataFrame:
        """rows (u, v) and m, the least of u and all of its v. The right side is a written table of one row a node."""
        return rows.join(cut(rows.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))), "u")

    now = cut(pairs(edges))
    before = None
    while True:
        up = now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        down = now.select(F.col("a").alias("u"), F.col("b").alias("v"))
        # Large star: each node links its larger neighbours to the least it knows.
        large = cut(pairs(with_least(up.unionByName(down)).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))))
        # Small star: each node links itself and its smaller neighbours to the least of these.
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        known = with_least(down)
        now = cut(pairs(known.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")))
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            break
        before = state
    inner = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return inner.unionByName(inner.select(F.col("root").alias("node"), "root").distinct())
