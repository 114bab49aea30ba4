"""Near-duplicate removal over many collection runs, each compared with all that were kept before.

Kept rows are held in two bucketed tables: an inverted index of their prefix entries by token, and their
contents by id. A run reads the index buckets of its own prefix tokens and the contents of the
candidates found there, then scans itself, and appends what it keeps. What it costs depends on its
tokens and candidates, not on how many runs there were. A large run would find most of what was kept, so it reads the contents whole, and what
no run has looked up yet is not indexed yet. Both meet tile by tile (``meets``), and the result is that of one scan over
all rows in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import constants as C
from newsloom.functions.text import text_or_empty, tokens
from newsloom.operators.buckets import BucketTable
from newsloom.operators.dedup import title_bound, title_rows
from newsloom.operators.leaders import collapse_copies, follow
from newsloom.operators.meets import Rule, Sets, Titles, scan_tiles, similar_between
from newsloom.operators.pairs import frequent_tokens, prefix_index
from newsloom.session import cut_lineage

LARGE = 8  # a run with a row for so many kept ones reads them all


class RunIndex:
    """What earlier runs have kept. Use :func:`text_index` or :func:`title_index`.

    ``prepare`` turns (id, batch, text) into rows with ``tokens``, ``same`` names the column by which rows are equal,
    ``rule`` says which rows are similar, and ``length`` how many tokens it compares of a row. Tokens are ordered by their
    frequency in the first run; any order that does not change is right.
    """

    def __init__(
        self, spark: SparkSession, path: str, threshold: float, prepare: Callable[[DataFrame], DataFrame], same: str,
        rule: Rule, length: Column, content: str, rows_per_bucket: int = 1_000_000, contents_per_bucket: int = 16_384,
    ):
        self.spark, self.path, self.threshold, self.prepare, self.same, self.rule, self.length = spark, path, threshold, prepare, same, rule, length
        self.entries = BucketTable(spark, f"{path}/entries", "token", "id long, token string, at int, size int", rows_per_bucket)
        self.rows = BucketTable(spark, f"{path}/rows", "id", f"id long, {content}", contents_per_bucket)

    def _order(self, first: DataFrame | None = None) -> DataFrame:
        """Token counts of the first rows that were indexed, kept beside the index."""
        if first is not None:
            frequent_tokens(first).write.mode("overwrite").parquet(f"{self.path}/order")
        return self.spark.read.schema("token string, count long").parquet(f"{self.path}/order")

    def _index(self, upto: int) -> None:
        """Index what the runs up to ``upto`` have kept, as far as that is still to be done."""
        done = self.entries.segments()
        kept = self.rows.read(upto=upto).filter(F.col("batch") > (done[-1].last if done else -1))
        for batch in sorted(r["batch"] for r in kept.select("batch").distinct().collect()):
            rows = kept.filter(F.col("batch") == batch)
            order = self._order() if done else self._order(rows)
            self.entries.append(prefix_index(rows, self.threshold, order), batch)
            done = self.entries.segments()

    def _leaders(self, rows: DataFrame, n: int, run: int) -> tuple[DataFrame, int]:
        """The kept rows of earlier runs that the run has to meet, and about how many they are."""
        kept = self.rows.read(upto=run - 1)
        many = kept.count()
        if many <= LARGE * n:
            return kept.withColumn("batch", F.lit(0)), many
        self._index(run - 1)
        tokens_here = cut_lineage(prefix_index(rows, self.threshold, self._order()).select("token").distinct(), "run-tokens")
        known = self.entries.read(tokens_here, upto=run - 1).join(tokens_here, "token", "left_semi")
        ids = cut_lineage(known.select("id").distinct(), "run-candidates")
        leaders = cut_lineage(self.rows.read(ids, upto=run - 1).join(ids, "id", "left_semi").withColumn("batch", F.lit(0)), "run-leaders")
        return leaders, leaders.count()

    def add(self, items: DataFrame, run: int) -> DataFrame:
        """Rows of the run to drop: (id, leader), leader the earliest kept row that they resemble.

        ``items``: id, text. Ids must be larger than those of earlier runs, ``run`` larger than
        their numbers; a run that is added again gives the same result and adds nothing.
        """
        rows = cut_lineage(self.prepare(items.select(F.col("id").cast("long").alias("id"), F.lit(0).alias("batch"), "text")), "run")
        copies = cut_lineage(collapse_copies(rows, "batch", self.same), "run-copies")
        rows = cut_lineage(rows.join(copies, "id", "left_anti"), "run-rows")
        n, size = rows.agg(F.count("*"), F.avg(self.length)).first()
        leaders, many = self._leaders(rows, n, run)
        met = similar_between(leaders, rows, self.rule, (many, n), size or 0)
        old = cut_lineage(met.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader")), "run-old")
        dropped = cut_lineage(old.unionByName(scan_tiles(rows.join(old, "id", "left_anti"), self.rule, self.length)), "run-dropped")
        self.rows.append(rows.join(dropped, "id", "left_anti"), run)
        return follow(copies, dropped)

    def tidy(self) -> None:
        """Merge segments where many of one size have come together."""
        for table in (self.rows, self.entries):
            while table.merge():
                pass


def text_index(spark: SparkSession, path: str, threshold: float = C.DUPLICATE_JACCARD, **sizes: int) -> RunIndex:
    """Runs of texts, by token Jaccard of at least ``threshold``; texts without tokens take no part."""

    def prepare(items: DataFrame) -> DataFrame:
        sets = items.select("id", "batch", F.array_sort(tokens(F.col("text"))).alias("tokens")).filter(F.size("tokens") > 0)
        return sets.withColumn("same", F.sha2(F.array_join("tokens", "\0"), 256))

    return RunIndex(spark, path, threshold, prepare, "same", Sets(threshold), F.size("tokens"), "tokens array<string>, same string", **sizes)


def title_index(spark: SparkSession, path: str, ratio: float = C.TITLE_RATIO, **sizes: int) -> RunIndex:
    """Runs of titles, by a matching-blocks ratio above ``ratio``; empty titles take no part."""

    def prepare(items: DataFrame) -> DataFrame:
        return title_rows(items.filter(text_or_empty(F.col("text")) != "").select("id", "batch", F.lower("text").alias("title")))

    content = "title string, length int, tokens array<string>, buckets array<int>"
    return RunIndex(spark, path, title_bound(ratio), prepare, "title", Titles(ratio), F.length("title"), content, **sizes)
