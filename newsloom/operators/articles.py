"""Row operators of a collection run: windows of time, limits, keep-first, unified schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom import constants as C
from newsloom.functions.text import article_id, text_or_empty


def fresh_only(df: DataFrame, ts: str, now: Column, hours: int = C.FRESH_HOURS) -> DataFrame:
    """Rows of the last ``hours``; undated rows pass and are stamped ``now``."""
    cutoff = now - F.make_interval(hours=F.lit(hours))
    return df.filter(F.col(ts).isNull() | (F.col(ts) >= cutoff)).withColumn(ts, F.coalesce(ts, now))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first ``k`` rows of every group.

    Spark keeps only ``k`` rows per group in every task before it shuffles (a partial
    window-group limit), so one huge group costs no more than ``k`` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def first_values(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The rows of every group that hold one of its first ``k`` values in order, however many rows hold one.

    For rows that are still to be added up by value: tasks drop the others before they shuffle or aggregate.
    """
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def keep_first(df: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first in order; all empty or missing keys count as one."""
    df = df.withColumn("_key", text_or_empty(F.col(key)))
    return first_rows(df, ["_key"], order, 1).drop("_key")


def limit_then_whitelist(
    df: DataFrame, group: str, order: Sequence[Column | str], source: str,
    limit: int = C.CATEGORY_LIMIT, allowed: Sequence[str] = C.API_SOURCE_WHITELIST,
) -> DataFrame:
    """First ``limit`` rows per category, then the allowed sources, in this order."""
    return first_rows(df, [group], order, limit).filter(F.col(source).isin(list(allowed)))


def unify(df: DataFrame) -> DataFrame:
    """Raw rows with a title in the common article schema."""
    return df.filter(text_or_empty(F.col("title")) != "").select(
        article_id(F.col("url"), F.col("title")).alias("id"),
        "title",
        F.col("description").alias("summary"),
        "url", "published_at", "source", "tickers",
        *[c for c in ("feed_rank", "pos") if c in df.columns],
    )


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """Feeds one after another; ``feed_rank`` and ``pos`` keep the order as data."""
    ranked = [f.withColumn("feed_rank", F.lit(i)) for i, f in enumerate(feeds)]
    result = ranked[0]
    for feed in ranked[1:]:
        result = result.unionByName(feed)
    return result


def scan_order(df: DataFrame, *order: str) -> DataFrame:
    """Add ``id``: an increasing number along ``order``, without a single-task sort.

    Rows are range-partitioned and sorted; numbers grow with the partition and inside it,
    so their order is the scan order even though they are not consecutive.
    """
    return (
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("id", F.monotonically_increasing_id())
    )
