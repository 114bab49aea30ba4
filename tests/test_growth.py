"""Cache deltas, numbered lists and the stream that keeps the first, whatever the cut into files."""

import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from newsloom.operators import cache as K
from newsloom.operators.articles import keep_first
from newsloom.session import scratch_path
from newsloom.sources import landed as L
from newsloom.streaming import incremental

CACHE = "key string, from_fallback boolean, value string"


def written(path):
    return {f"{d}/{f}" for d, _, files in os.walk(path.removeprefix("file:")) for f in files if f.endswith(".parquet")}


def test_a_batch_writes_its_own_entries_only(spark):
    path = scratch_path(spark, "cache")
    rows = lambda n, v: spark.range(n).select(F.col("id").cast("string").alias("key"), F.lit(False).alias("from_fallback"), F.lit(v).alias("value"))
    K.store(spark, path, CACHE, rows(5000, "old"), version=0)
    sizes = []
    for version in (1, 2, 3):
        before = written(path)
        K.store(spark, path, CACHE, rows(10, f"new{version}"), version=version)
        sizes.append(sum(os.path.getsize(f) for f in written(path) - before))
    large = sum(os.path.getsize(f) for f in written(path)) - sum(sizes)
    assert max(sizes) < large / 5 and max(sizes) < 1.5 * min(sizes)
    state = written(path)
    K.store(spark, path, CACHE, rows(10, "other"), version=2)  # a replay
    assert written(path) == state
    asked = spark.createDataFrame([("3",), ("4999",), ("none",)], "key string")
    assert {r.key: r.value for r in K.current_cache(spark, path, CACHE, asked).collect()} == {"3": "new3", "4999": "old"}
    assert K.current_cache(spark, path, CACHE).count() == 5000


def test_merged_caches_keep_the_newest_and_its_time(spark):
    path = scratch_path(spark, "cache")
    for version in range(17):
        at = F.lit(dt.datetime(2024, 1, 1) + dt.timedelta(days=version))
        K.store(spark, path, CACHE, spark.createDataFrame([("a", False, str(version)), (f"k{version}", None, "x"), ("f", True, "y")], CACHE), version, at)
    rows = {r.key: (r.value, r.cached_at) for r in K.current_cache(spark, path, CACHE).collect()}
    assert rows["a"] == ("16", dt.datetime(2024, 1, 17)) and len(rows) == 18 and "f" not in rows
    assert rows["k3"] == ("x", dt.datetime(2024, 1, 4))
    names = {d for d in os.listdir(path.removeprefix("file:")) if d.startswith("seg-")}
    assert "seg-0-7-0" in names and "seg-0-0-0" not in names  # old versions go


def test_damaged_entries_are_misses(spark):
    path = scratch_path(spark, "cache")
    K.store(spark, path, CACHE, spark.createDataFrame([("a", False, "1")], CACHE), version=0)
    K.store(spark, path, CACHE, spark.createDataFrame([("b", False, "1")], CACHE), version=1)
    for f in written(path):
        if "seg-0-0" in f:
            os.chmod(f, 0o644)
            with open(f, "wb") as out:
                out.write(b"damaged, but not short" * 20)
            crc = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
            os.remove(crc) if os.path.exists(crc) else None
    found = K.lookup(spark.createDataFrame([("a",), ("b",)], "key string"), K.current_cache(spark, path, CACHE)).collect()
    assert {r.key: r.from_cache for r in found} == {"a": False, "b": True}


def test_lists_are_numbered_over_files_and_writes(spark):
    path = scratch_path(spark, "list")
    spark.range(50).orderBy("id").repartitionByRange(4, "id").sortWithinPartitions("id").selectExpr("concat('a', id) as value").write.text(path)
    L.append_urls(spark.range(40).selectExpr("concat('b', id) as url", "id as pos").repartition(3), path)
    rows = L.numbered_lines(spark, path).orderBy("line").collect()
    assert [r.value for r in rows] == [f"a{i}" for i in range(50)] + [f"b{i}" for i in range(40)]
    assert [r.line for r in rows] == list(range(90))
    plan = L.numbered_lines(spark, path)._jdf.queryExecution().executedPlan().toString()
    # Only the counts of the partitions come together, never the lines.
    assert plan.count("SinglePartition") == len(re.findall(r"SinglePartition[^\n]*\n\W*HashAggregate\(keys=\[_part", plan)) == 1


LANDED = "url string, title string, summary string, source string, published_at timestamp, feed_rank int, pos long, landed_at timestamp"
NOW = dt.datetime(2024, 1, 2)


@pytest.mark.parametrize("cuts", [[9], [2, 5, 9], [1, 2, 3, 4, 5, 6, 7, 8, 9]])
def test_stream_keeps_the_first_of_equal_addresses(spark, tmp_path, cuts):
    landed, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    addresses = ["u1", "u2", "u1", None, "u3", "u2", "u1", "", "u4"]
    places = [(1, 4), (0, 9), (0, 7), (1, 1), (0, 2), (0, 3), (0, 8), (0, 5), (1, 0)]
    rows = [
        (u, "oil" if u != "u4" else "cats", f"n{i}", "s", None if i % 2 else NOW, *places[i], NOW + dt.timedelta(minutes=i))
        for i, u in enumerate(addresses)
    ]
    end = [("end", "oil", "", "s", None, 0, 0, NOW + dt.timedelta(hours=48))]
    start = 0
    for cut in cuts:
        spark.createDataFrame(rows[start:cut], LANDED).coalesce(1).write.mode("append").parquet(landed)
        start = cut
    spark.createDataFrame(end, LANDED).coalesce(1).write.mode("append").parquet(landed)
    stream = incremental.article_stream(spark, landed, LANDED, files_per_batch=1)
    incremental.first_articles(stream, F.lit(NOW)).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.url, r.summary, r.feed_rank, r.pos) for r in spark.read.schema(LANDED).parquet(out).collect())
    batch = keep_first(spark.createDataFrame(rows, LANDED).filter("title = 'oil'"), "url", ["feed_rank", "pos"]).collect()
    assert got == sorted((r.url or "", r.summary, r.feed_rank, r.pos) for r in batch)


def test_unreadable_scripts_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"issue_id": "1"}\nnot json\n[{"issue_id": "2"}, {"issue_id": "3"}]\n[broken\n\n')
    (tmp_path / "b.json").write_text('[{"issue_id": "4"},\n {"issue_id": "5"}]')
    (tmp_path / "c.json").write_text('[{"issue_id": "6"},\n {"issue')
    assert sorted(r.issue_id for r in L.read_scripts(spark, str(tmp_path)).collect()) == ["1", "2", "3", "4", "5"]
    assert sorted(r.unread for r in L.unread_scripts(spark, str(tmp_path)).collect()) == sorted(["not json", "[broken", '[{"issue_id": "6"},\n {"issue'])
