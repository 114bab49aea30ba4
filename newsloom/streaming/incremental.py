"""Streams: incremental collection and upkeep of the script cache."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from newsloom import constants as C
from newsloom.functions.text import keyword_match, text_or_empty
from newsloom.operators import cache
from newsloom.operators.articles import fresh_only


def article_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """Landed parquet articles as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def new_articles(stream: DataFrame, now: Column, keywords: Sequence[str] = C.MACRO_KEYWORDS, hours: int = C.FRESH_HOURS) -> DataFrame:
    """Fresh matching articles, one row per address.

    Freshness is counted from ``now``, undated rows are stamped with it. The state, one key per
    address, is cleared by the time an article landed here, not by the date it bears, so no row
    is late however the files are cut into batches. Which of several equal addresses
    survives is open, unlike in the batch job, which keeps the first.
    """
    fresh = fresh_only(stream, "published_at", now, hours)
    return (
        fresh.filter(keyword_match(F.col("title"), F.col("summary"), keywords))
        .withColumn("url", text_or_empty(F.col("url")))
        .withColumn("landed_at", F.current_timestamp())
        .withWatermark("landed_at", f"{hours} hours")
        .dropDuplicatesWithinWatermark(["url"])
    )


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIRST = "url string, title string, summary string, source string, published_at timestamp, feed_rank int, pos long, landed_at timestamp"


class _HoldFirst(StatefulProcessor):
    """Holds the earliest (feed_rank, pos) of an address until its window is over."""

    def __init__(self, hours: int):
        self.length = hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", FIRST)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        best = frame.sort_values(["feed_rank", "pos"], kind="stable").iloc[0]
        new = [None if x is pd.NaT or x is None else x for x in best.tolist()]
        if self.held.exists():
            old = self.held.get()
            if (old[5], old[6]) <= (new[5], new[6]):
                new = None
        else:
            begun = int(frame["landed_at"].min().timestamp() * 1000)
            self.handle.registerTimer(begun + self.length)
        if new is not None:
            self.held.update(tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else x.item() if hasattr(x, "item") else x for x in new))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        row = self.held.get()
        self.held.clear()
        yield pd.DataFrame([list(row)], columns=[c.split()[0] for c in FIRST.split(", ")])

    def close(self) -> None:
        pass


def first_articles(stream: DataFrame, now: Column, keywords: Sequence[str] = C.MACRO_KEYWORDS, hours: int = C.FRESH_HOURS, late: str = "0 seconds") -> DataFrame:
    """Fresh matching articles, of equal addresses the one that the batch job keeps: the first by (feed_rank, pos).

    ``stream``: url, title, summary, source, published_at, feed_rank, pos, landed_at. An address is held from the first
    landing for ``hours`` of landing time and given out when that is over, so the result does not depend
    on how the files were cut into batches. All empty or missing addresses count as one.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    fresh = fresh_only(stream, "published_at", now, hours).filter(keyword_match(F.col("title"), F.col("summary"), keywords))
    names = [c.split()[0] for c in FIRST.split(", ")]
    keyed = fresh.withColumn("url", text_or_empty(F.col("url"))).select(*names).withWatermark("landed_at", late)
    return keyed.groupBy("url").transformWithStateInPandas(
        statefulProcessor=_HoldFirst(hours), outputStructType=FIRST, outputMode="Append", timeMode="EventTime"
    )


def keep_cache(scripts: DataFrame, path: str, schema: str, checkpoint: str) -> DataStreamWriter:
    """Store finished scripts of a stream by key; fallbacks are purged, replays change nothing."""

    def write(batch: DataFrame, number: int) -> None:
        cache.store(batch.sparkSession, path, schema, batch, version=number)

    return scripts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
