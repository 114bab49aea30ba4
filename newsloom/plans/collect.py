"""Collection run: two feeds to one list of distinct, unified articles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import constants as C
from newsloom.functions.text import keyword_match
from newsloom.operators.articles import fresh_only, keep_first, limit_then_whitelist, scan_order, unify, union_feeds
from newsloom.operators.dedup import duplicate_titles
from newsloom.session import cut_lineage

RAW = ["title", "description", "url", "published_at", "source", "tickers", "pos"]


def feed_articles(entries: DataFrame, now: Column, keywords: Sequence[str] = C.MACRO_KEYWORDS) -> DataFrame:
    """Feed entries of the last day that match a keyword, first of each address, short summary."""
    recent = fresh_only(entries, "published_at", now)
    matching = recent.filter(keyword_match(F.col("title"), F.col("description"), keywords))
    return keep_first(matching, "url", ["pos"]).withColumn(
        "description", F.substring("description", 1, C.DESCRIPTION_CHARS)
    ).select(RAW)


def api_articles(rows: DataFrame, allowed: Sequence[str] = C.API_SOURCE_WHITELIST) -> DataFrame:
    """First rows per category from allowed sources."""
    return limit_then_whitelist(rows, "category", ["pos"], "source", allowed=allowed).select(RAW)


def merge_feeds(feed: DataFrame, api: DataFrame, **limits: int) -> DataFrame:
    """Both feeds in order without near-duplicate titles, in the unified schema.

    The rows are one collection run; runs are not compared with each other.
    """
    rows = unify(union_feeds(feed.select(RAW), api.select(RAW))).withColumnRenamed("id", "article_id")
    ordered = cut_lineage(scan_order(rows, "feed_rank", "pos"), "run")
    dropped = duplicate_titles(ordered.select("id", "title"), **limits)
    return (
        ordered.join(dropped, "id", "left_anti").withColumnRenamed("id", "scan_id")
        .withColumnRenamed("article_id", "id")
        .select("scan_id", "id", "title", "summary", "url", "published_at", "source", "tickers")
    )
