"""Dense numbers in a stated order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows and name: 0, 1, 2 ... in the order of the columns, which should have no ties.

    Rows are sorted into ranges and written; a range's numbers start at the count of the rows before it, so each window
    is over one range, or over one row a range.
    """
    spread = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint()
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = spread.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return spread.withColumn("_place", place).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")
