"""Dominance counting: how many points have an x that is no larger and a y that is strictly larger.

Equal points are one cell with their number and the sum of their weights, so a point that a third of all rows share is one
row from the first shuffle on. Each cell gets two unique ranks: r in the order of x, larger y first, and q in the order
of y, largest first, then larger x first. A cell is above another exactly if both its ranks are smaller, so ties need no
further care, and a node of the recursion has the same number of cells as every other one, however rows are spread over x.

CDQ divide and conquer goes over the bits of r from the top. At a level the cells of a node meet in one shuffle, in the
order of q; each cell of its right half adds the sum of the left-half cells before it. While there are fewer nodes than
tasks a node is cut into chunks of q, of as many cells each, and a chunk starts from the sums of the chunks before it: those
sums, one row a node and chunk, go through the same shuffle as the first row of the chunk. Once a node's cells are few
(LEAF bits at most), one shuffle brings them to one task, which goes through the levels below by itself.

Nothing is collected and no table is broadcast but one row a partition (where its ranks start). The recursion has
shuffles in number as the logarithm of the cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from showloom.llm.common import fresh_dir

#: Bits of the number of cells that one task goes through by itself: at least, where cells are few, and at most.
LEAF = (12, 18)
CELL = "x long, y long, r long, q long, n long, w long, n_above long, w_above long"


def ranked(cells: DataFrame, name: str, parts: int, *order) -> DataFrame:
    """cells with name: 0, 1, 2 ... in the order, which has no ties. Sorted in ranges and written; a range's ranks start
    at the number of rows in the ranges before it."""
    spark, folder = cells.sparkSession, fresh_dir(cells.sparkSession, "ranks")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    cells.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), place.alias("place")).write.parquet(folder)
    rows = spark.read.parquet(folder)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("part").agg(F.count("*").alias("rows")).select("part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    return rows.join(F.broadcast(starts), "part").withColumn(name, F.col("start") + F.col("place")).drop("part", "place", "start")


def split(cells: DataFrame, base: DataFrame, depth: int, bits: int, chunk_bits: int) -> DataFrame:
    """One level of the recursion: cells of right halves with what their left halves add. base: the cells as they were."""
    node, left = F.shiftright("r", bits - depth), F.shiftright("r", bits - depth - 1).bitwiseAND(1) == 0
    keys = [node.alias("node"), F.shiftright("q", bits - chunk_bits).alias("chunk")]
    rows = cells.select(*keys, left.alias("left"), "*")
    if chunk_bits:
        sums = base.filter(left).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
        chunks = base.select(*keys).distinct().join(sums, ["node", "chunk"], "left")
        earlier = Window.partitionBy("node").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        first = chunks.select("node", "chunk", F.lit(True).alias("left"), F.lit(-1).cast("long").alias("q"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("n", "w")])
        rows = rows.unionByName(first, allowMissingColumns=True)
    before = Window.partitionBy("node", "chunk").orderBy("q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = {f"{c}_above": F.col(f"{c}_above") + F.when(F.col("left"), 0).otherwise(F.sum(F.when(F.col("left"), F.col(c)).otherwise(0)).over(before)) for c in ("n", "w")}
    return rows.withColumns(added).filter("q >= 0").drop("node", "chunk", "left")


def within(r: np.ndarray, q: np.ndarray, values: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """For cells that share all but the lowest bits of r: of each of the values, the sum over the cells above."""
    order = np.argsort(q)
    r, values = r[order], [v[order] for v in values]
    sums = [np.zeros(len(r), np.int64) for _ in values]
    for b in range(bits):
        merged = np.argsort(r >> (b + 1), kind="stable")  # by node, in the order of q
        node, left = r[merged] >> (b + 1), (r[merged] >> b) & 1 == 0
        start = np.searchsorted(node, node)
        for v, s in zip(values, sums, strict=True):
            total = np.append(0, np.cumsum(np.where(left, v[merged], 0)))
            s[merged] += np.where(left, 0, total[:-1] - total[start])
    back = np.empty(len(r), np.int64)
    back[order] = np.arange(len(r))
    return [s[back] for s in sums]


def above(points: DataFrame, parts: int | None = None) -> DataFrame:
    """x, y, n_above, w_above of each distinct point of points (x, y, weight: long, no nulls): the rows that are above
    it, and the sum of their weights."""
    spark = points.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cells = points.groupBy("x", "y").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    base = ranked(ranked(cells, "r", parts, F.col("x"), F.col("y").desc()), "q", parts, F.col("y").desc(), F.col("x").desc())
    bits = max(1, (base.count() - 1).bit_length())
    wide = min(bits, (4 * parts - 1).bit_length())  # so many bits of q make chunks for all tasks
    leaf = min(bits, LEAF[1], max(LEAF[0], bits - wide))
    rows = base.withColumns({"n_above": F.lit(0).cast("long"), "w_above": F.lit(0).cast("long")})
    for depth in range(bits - leaf):
        rows = split(rows, base, depth, bits, wide if depth < wide else 0)

    def finish(group: pa.Table) -> pa.Table:
        r, q, *values = [group.column(c).to_numpy() for c in ("r", "q", "n", "w")]
        for name, sums in zip(("n_above", "w_above"), within(r, q, values, leaf), strict=True):
            group = group.set_column(group.schema.get_field_index(name), name, pa.array(group.column(name).to_numpy() + sums))
        return group.drop_columns(["leaf"]).select([c.split()[0] for c in CELL.split(", ")])

    whole = rows.withColumn("leaf", F.shiftright("r", leaf)).groupBy("leaf").applyInArrow(finish, CELL)
    return whole.select("x", "y", "n_above", "w_above")


def count_above(table: DataFrame, key: str, x: str, y: str, weight: str) -> DataFrame:
    """key, x, y, n_above, w_above of every row of table (x, y and weight are whole numbers; other columns aren't read).

    n_above counts the rows whose x is smaller or equal and whose y is strictly larger, w_above sums their weights (a null
    weight is 0). Rows with a null x or y are above none, and their own counts are null; the least and greatest rows have
    0. Equal points have equal counts; repeated rows all count and are all returned; a null key is kept; an empty table
    gives no rows.
    """
    names = dict(zip("kxy", (key, x, y), strict=True))
    rows = table.select(F.col(f"`{key}`").alias("k"), F.col(f"`{x}`").cast("long").alias("x"), F.col(f"`{y}`").cast("long").alias("y"), F.coalesce(F.col(f"`{weight}`").cast("long"), F.lit(0)).alias("weight"))
    placed = rows.filter("x is not null and y is not null")
    counted = placed.drop("weight").join(above(placed.drop("k")), ["x", "y"])
    none = F.lit(None).cast("long")
    rest = rows.filter("x is null or y is null").select("x", "y", "k", none.alias("n_above"), none.alias("w_above"))
    return counted.select("k", "x", "y", "n_above", "w_above").unionByName(rest).withColumnsRenamed(names)
