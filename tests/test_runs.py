"""Runs with a kept index against one scan over all rows; bucketed tables."""

import random

from pyspark.sql import functions as F

from newsloom.operators.buckets import BucketTable
from newsloom.operators.dedup import duplicate_texts, duplicate_titles
from newsloom.operators.pairs import candidate_pairs, cheapest_share, first_entries, prefix_index
from newsloom.operators.run_index import text_index, title_index
from newsloom.session import scratch_path


def texts(seed, n):
    rng = random.Random(seed)
    base = [" ".join(rng.choices([f"word{i}" for i in range(300)], k=rng.randrange(4, 14))) for _ in range(n // 3)]
    out = []
    for _ in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = f"word{rng.randrange(300)}"
        out.append(" ".join(words))
    return out + ["", " "]


def pairs_of(df):
    return sorted((r.id, r.leader) for r in df.collect())


def test_runs_of_texts_equal_one_scan(spark):
    rows = list(enumerate(texts(1, 150)))
    index = text_index(spark, scratch_path(spark, "index"), rows_per_bucket=40)
    got = []
    for run, (a, b) in enumerate([(0, 60), (60, 61), (61, len(rows))]):
        df = spark.createDataFrame(rows[a:b], "id long, text string").repartition(2)
        found = pairs_of(index.add(df, run))
        if run == 1:
            assert pairs_of(index.add(df, run)) == found  # a run added again changes nothing
        got += found
    everything = spark.createDataFrame(rows, "id long, text string")
    assert sorted(got) == pairs_of(duplicate_texts(everything)) and len(got) > 20


def test_runs_of_titles_equal_one_scan(spark):
    rows = list(enumerate(t[:40] for t in texts(2, 60)))
    index = title_index(spark, scratch_path(spark, "index"))
    got = []
    for run in (0, 1):
        df = spark.createDataFrame(rows[run * 30 : (run + 1) * 30 + 2 * run], "id long, text string")
        got += pairs_of(index.add(df, run))
    everything = spark.createDataFrame(rows, "id long, title string")
    assert sorted(got) == pairs_of(duplicate_titles(everything)) and got


def test_reads_do_not_grow_with_the_table(spark):
    """Few keys read few buckets, after one batch and after many; appends write their own rows alone."""
    table = BucketTable(spark, scratch_path(spark, "table"), "key", "key string, v long", rows_per_bucket=100, fan=3)
    keys = spark.createDataFrame([(f"0-{i}",) for i in range(3)], "key string")
    read, written = [], []
    for batch in range(9):
        table.append(spark.range(1000).select(F.format_string(f"{batch}-%d", "id").alias("key"), F.col("id").alias("v")))
        own = f"{table.path}/{table.segments()[-1].name}"
        written.append(spark.read.parquet(own).count())
        while table.merge():
            pass
        found = table.read(keys)
        assert {r.key for r in found.join(keys, "key").collect()} == {"0-0", "0-1", "0-2"}
        read.append(found.count())
    assert set(written) == {1000} and len(table.segments()) == 1
    assert table.read().count() == 9000 and read[-1] < 2 * read[0] < 1200
    assert table.read(upto=3).count() == 4000


def test_batches_written_again(spark):
    table = BucketTable(spark, scratch_path(spark, "table"), "key", "key string, v long", fan=2)
    rows = spark.createDataFrame([("a", 1)], "key string, v long")
    for batch in (0, 0, 1, 1):
        table.append(rows, batch)
    assert table.read().count() == 2
    assert table.merge()
    table.append(rows, 0)  # already merged: left as it is
    assert sorted((r.key, r.batch) for r in table.read().collect()) == [("a", 0), ("a", 1)]
    table.merge()  # removes what the first merge replaced
    assert [s.name for s in table._complete()] == [s.name for s in table.segments()]


def test_candidates_that_share_several_entries(spark):
    """Whatever is asked to be shared, no similar pair is lost, and candidates become fewer."""
    sets = [sorted(set(t.split())) for t in texts(3, 150) if t.split()] + [["a"], ["a", "b"], ["a", "b", "c"], ["a", "b", "d"]]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<string>").withColumn("batch", F.lit(0))
    true = {
        (i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
        if len(set(sets[i]) & set(sets[j])) >= 0.6 * len(set(sets[i]) | set(sets[j])) - 1e-9
    }
    longest = prefix_index(df, 0.6, share=6)
    counts = []
    for share in (1, 3, 6):
        index = first_entries(longest, 0.6, share)
        found = {(r.a, r.b) for r in candidate_pairs(index, index, 0.6, share).collect()}
        assert true <= found
        counts.append(len(found))
    assert len(true) > 30 and counts[0] >= counts[1] >= counts[2]
    assert 1 <= cheapest_share(longest, 0.6, 6, sample=20) <= 6
