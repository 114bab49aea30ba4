"""A keyed table that grows by segments and is read by the buckets of the keys asked for.

A segment is an immutable folder ``seg-<first>-<last>-<bits>`` with the rows of the batches first to last, in
2**bits buckets by the hash of the key; one bucket has about ``rows_per_bucket`` rows. An append writes a
segment of its own rows only. Merging takes runs of ``fan`` segments of like size, so a row is rewritten
once per power of ``fan`` of the table's growth, and few segments are left to read.

A segment counts once its _SUCCESS file is there, and those inside the range of a larger one do not, so
readers always see whole batches; a batch that runs again finds its segment there, or writes it anew if
it was not complete.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import cut_lineage

LISTED = 10_000  # more buckets than this are not named one by one: all are read


@dataclass(frozen=True)
class Segment:
    first: int
    last: int
    bits: int

    @property
    def name(self) -> str:
        return f"seg-{self.first}-{self.last}-{self.bits}"

    def inside(self, other: Segment) -> bool:
        return self != other and other.first <= self.first and self.last <= other.last


class BucketTable:
    """Rows of ``schema`` by ``key``; reads add ``batch``, the number of the append that wrote a row."""

    def __init__(
        self, spark: SparkSession, path: str, key: str, schema: str, rows_per_bucket: int = 1_000_000, fan: int = 8, skip_damaged: bool = False
    ):
        """``skip_damaged``: rows of files that cannot be read are missing, not an error."""
        self.spark, self.path, self.key, self.schema, self.rows_per_bucket, self.fan = spark, path, key, schema, rows_per_bucket, fan
        self.skip_damaged = str(skip_damaged).lower()

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _complete(self) -> list[Segment]:
        path, files = self._files()
        if not files.exists(path):
            return []
        found = [re.fullmatch(r"seg-(\d+)-(\d+)-(\d+)", s.getPath().getName()) for s in files.listStatus(path)]
        done = [Segment(*map(int, m.groups())) for m in found if m]
        return [s for s in done if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{s.name}/_SUCCESS"))]

    def segments(self) -> list[Segment]:
        """Those to read, by their batches."""
        done = self._complete()
        return sorted((s for s in done if not any(s.inside(o) for o in done)), key=lambda s: s.first)

    def _write(self, rows: DataFrame, first: int, last: int) -> Segment:
        n = rows.count()
        bits = max(0, math.ceil(math.log2(max(1, n) / self.rows_per_bucket)))
        segment = Segment(first, last, bits)
        bucket = F.pmod(F.xxhash64(self.key), F.lit(1 << bits))
        tasks = min(1 << bits, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = rows.withColumn("bucket", bucket).repartition(tasks, "bucket").sortWithinPartitions("bucket", self.key)
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{segment.name}")
        return segment

    def _rows(self, segment: Segment) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, batch long, bucket long").option("ignoreCorruptFiles", self.skip_damaged).parquet(
            f"{self.path}/{segment.name}"
        )

    def append(self, rows: DataFrame, batch: int | None = None) -> int:
        """Write ``rows`` as a batch of its own; the number of the batch. One that is complete is left as it is."""
        now = self.segments()
        batch = (now[-1].last + 1 if now else 0) if batch is None else batch
        if any(s.first <= batch <= s.last for s in now):
            return batch
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        self._write(cut_lineage(rows.select(*names).withColumn("batch", F.lit(batch).cast("long")), "delta"), batch, batch)
        return batch

    def read(self, keys: DataFrame | None = None, upto: int | None = None) -> DataFrame:
        """All rows, or those in the buckets of ``keys`` (a column named like the key)."""
        out = self.spark.createDataFrame([], f"{self.schema}, batch long")
        touched: dict[int, list[int] | None] = {}
        for s in self.segments():
            if upto is not None and s.first > upto:
                continue
            rows = self._rows(s)
            if keys is not None and s.bits:
                if s.bits not in touched:
                    buckets = keys.select(F.pmod(F.xxhash64(self.key), F.lit(1 << s.bits)).alias("b")).distinct().limit(LISTED + 1).collect()
                    touched[s.bits] = [r["b"] for r in buckets] if len(buckets) <= LISTED else None
                if touched[s.bits] is not None:
                    rows = rows.filter(F.col("bucket").isin(touched[s.bits]))
            out = out.unionByName(rows.drop("bucket"))
        return out if upto is None else out.filter(F.col("batch") <= upto)

    def merge(self, keep=None) -> bool:
        """Merge the oldest run of ``fan`` neighbours of like size; whether there was one.

        ``keep`` may drop rows of the merged part that no reader needs. What a merge replaces is
        removed by the next one, so readers that began before it can finish.
        """
        self._remove_replaced()
        now = self.segments()
        sizes = [round(math.log(s.last - s.first + 1, self.fan)) for s in now]
        for at in range(len(now) - self.fan + 1):
            if len(set(sizes[at : at + self.fan])) == 1:
                part = now[at : at + self.fan]
                rows = self._rows(part[0])
                for s in part[1:]:
                    rows = rows.unionByName(self._rows(s))
                rows = rows.drop("bucket")
                self._write(cut_lineage(keep(rows) if keep else rows, "merged"), part[0].first, part[-1].last)
                return True
        return False

    def _remove_replaced(self) -> None:
        _, files = self._files()
        done = self._complete()
        for s in done:
            if any(s.inside(o) for o in done):
                files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{s.name}"), True)
