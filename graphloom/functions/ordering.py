"""Row numbers over a whole table, without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..scratch import cut

#: Up to this many rows one task numbers them at once.
ONE_TASK = 100_000
#: Bytes, as Spark takes them from the files' sizes, that a partition of together() holds: of edges in Parquet a million rows or so.
TOGETHER = 4 << 20
#: Partitions beyond which a size is taken for a join's guess, the product of its sides.
MOST = 10_000


def numbered(df: DataFrame, order: list[Column], name: str, many: bool | None = None) -> DataFrame:
    """df with a column `name`: 0, 1, 2 ... in the given order, whose ties the caller must have broken.

    Large tables are split into ranges and sorted in parallel; only the ranges' sizes go to the driver.
    many says whether the table is large, where the caller knows; else its rows are counted.
    """
    if many is None:
        many = df.count() > ONE_TASK
    if not many:
        return df.withColumn(name, F.row_number().over(W.orderBy(*order)).cast("long") - 1)
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    before, offsets = 0, []
    for r in ranged.groupBy(part.alias("part")).count().orderBy("part").collect():
        offsets.append((r["part"], before))
        before += r["count"]
    sizes = df.sparkSession.createDataFrame(offsets, "__part long, __before long")
    placed = ranged.withColumn("__part", part).join(F.broadcast(sizes), "__part")
    return placed.withColumn(name, F.col("__before") + F.col("__at") - F.shiftleft(F.col("__part"), 33)).drop("__at", "__part", "__before")


def together(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows, dealt out by key ahead of an aggregate of strings or structs over it. Spark sums those up by sorting, and would
    sort all rows of a scan's task first, whose number follows the file's split and not the shuffle's partitions. Partitions
    grow with the rows' size, as far as Spark knows it without joins. For keys that few rows share, where summing up
    before the shuffle saves nothing."""
    spark, by = rows.sparkSession, [F.col(c) for c in key]
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if TOGETHER < size < MOST * TOGETHER:
        return rows.repartition(max(-(-size // TOGETHER), int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)
    return rows.repartition(*by)
