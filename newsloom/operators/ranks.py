"""Positions in a sorted order, computed without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import cut_lineage

PART = 33  # monotonically_increasing_id() has the number of the partition above this bit


def with_positions(
    df: DataFrame, order: list[Column], *, keys: tuple[str, ...] = (), pos: str = "pos", total: str | None = None, partitions: int | None = None
) -> DataFrame:
    """Adds the position (from 0) of each row among those with equal ``keys``, sorted by ``order``.

    Rows are dealt out by ranges of (keys, order) and numbered inside their partition; the rows
    of a key before a partition are a running sum over the (key, partition) counts, of which
    there are no more than keys plus partitions. ``df`` is read twice (once for the ranges), so
    it should be a table. ``keys`` must not be null. ``total`` names a column for the rows of a key.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(k) for k in keys] + order
    dealt = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id())
    placed = cut_lineage(dealt, "positions").withColumn("_part", F.shiftright("_place", PART))
    counts = placed.groupBy(*keys, "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    columns = [*keys, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")]
    starts = counts.select(*columns, *([F.sum("_n").over(own).alias(total)] if total else []))
    joined = placed.join(starts if keys else F.broadcast(starts), [*keys, "_part"])
    out = joined.withColumn(pos, F.col("_before") + F.col("_place") - F.col("_first"))
    return out.select(*df.columns, pos, *([total] if total else []))
