"""Keyed table of finished scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.operators.buckets import BucketTable

# A cache is a bucketed table of batches: a batch writes its own entries only, reads take the newest of each
# key, and merging drops the older ones. ``cached_at`` is the time at which an entry was stored.


def _table(spark: SparkSession, path: str, schema: str) -> BucketTable:
    return BucketTable(spark, path, "key", f"{schema}, cached_at timestamp", skip_damaged=True)


def newest(entries: DataFrame) -> DataFrame:
    """The entry of the latest batch for each key."""
    columns = [F.col(c) for c in entries.columns if c != "key"]
    return entries.groupBy("key").agg(F.max_by(F.struct(*columns), "batch").alias("e")).select("key", "e.*").select(*entries.columns)


def current_cache(spark: SparkSession, path: str, schema: str, keys: DataFrame | None = None) -> DataFrame:
    """Entries with ``cached_at``; of ``keys`` alone, which reads their buckets only, or all.

    Entries in damaged files are as good as absent.
    """
    entries = _table(spark, path, schema).read(None if keys is None else keys.select("key").distinct())
    if keys is not None:
        entries = entries.join(keys.select("key").distinct(), "key", "left_semi")
    return newest(entries).drop("batch")


def usable(cache: DataFrame) -> DataFrame:
    """Entries that may be served: everything but stored fallbacks."""
    return cache.filter(~F.coalesce("from_fallback", F.lit(False)))


def lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with their cached columns, null where there is no usable entry."""
    return requests.join(usable(cache).withColumn("from_cache", F.lit(True)), "key", "left").withColumn(
        "from_cache", F.coalesce("from_cache", F.lit(False))
    )


def one_per_key(entries: DataFrame) -> DataFrame:
    """One usable entry for each key, always the same one: the last in the order of its content."""
    last = Window.partitionBy("key").orderBy(F.desc(F.to_json(F.struct("*"))))
    return usable(entries).withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cache after a run: fallbacks purged, fresh successes replace older entries, one entry per key."""
    good = one_per_key(fresh.select(cache.columns))
    return usable(cache).join(good.select("key"), "key", "left_anti").unionByName(good)


def store(spark: SparkSession, path: str, schema: str, fresh: DataFrame, version: int | None = None, at: Column | None = None) -> None:
    """Add the usable fresh entries as a batch; what it writes does not depend on what is stored already.

    With a given ``version`` (a stream's batch number) a repeated call changes nothing. Now and then, one of many calls
    merges earlier batches.
    """
    table = _table(spark, path, schema)
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    good = one_per_key(fresh.select(*names)).withColumn("cached_at", F.current_timestamp() if at is None else at)
    table.append(good, version)
    table.merge(newest)
