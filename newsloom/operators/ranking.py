"""Engagement ranking and collection of new addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import constants as C
from newsloom.functions import scores as S
from newsloom.functions.text import post_slug, text_or_empty
from newsloom.operators.articles import first_rows

METRICS = (
    "struct<followers:bigint,likes:bigint,comments:bigint,engagement_rate:double,"
    "subscribers:bigint,views:bigint,view_ratio:double,title:string>"
)


def _metrics(**known: Column) -> Column:
    fields = {
        "followers": "bigint", "likes": "bigint", "comments": "bigint", "engagement_rate": "double",
        "subscribers": "bigint", "views": "bigint", "view_ratio": "double", "title": "string",
    }
    return F.struct(*[known.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields.items()])


def rank_posts(posts: DataFrame, top_n: int = C.TOP_POSTS, newest: int | None = C.MAX_POSTS) -> DataFrame:
    """Best posts per account by engagement, by raw reactions without followers.

    ``posts``: account, followers, pos (feed order), shortcode, likes, comments. Only the
    ``newest`` first rows of an account take part.
    """
    likes, comments, followers = F.col("likes"), F.col("comments"), F.col("followers")
    if newest is not None:
        posts = first_rows(posts, ["account"], ["pos"], newest)
    scored = posts.withColumn("rank_key", S.engagement_rank_key(likes, comments, followers))
    best = first_rows(scored, ["account"], [F.desc("rank_key"), F.col("pos")], top_n)
    rate = S.engagement(likes, comments, followers)
    return best.select(
        F.concat(F.lit(C.POST_URL_PREFIX), "shortcode", F.lit(C.POST_URL_SUFFIX)).alias("url"),
        F.lit("instagram").alias("platform"), "account",
        _metrics(followers=followers, likes=F.coalesce(likes, F.lit(0)), comments=F.coalesce(comments, F.lit(0)),
                 engagement_rate=F.round(rate, 5)).alias("metrics"),
        S.engagement_reason(likes, comments, followers).alias("reason"),
        "rank_key", "pos",
    )


def rank_videos(videos: DataFrame, top_n: int = C.TOP_POSTS, newest: int | None = C.MAX_POSTS) -> DataFrame:
    """Best videos per channel by views per subscriber, by raw views without subscribers.

    ``videos``: account, subscribers, pos, url, title, view_count.
    """
    views, subs = F.col("view_count"), F.col("subscribers")
    if newest is not None:
        videos = first_rows(videos, ["account"], ["pos"], newest)
    scored = videos.withColumn("rank_key", S.view_rank_key(views, subs))
    best = first_rows(scored, ["account"], [F.desc("rank_key"), F.col("pos")], top_n)
    return best.select(
        "url", F.lit("youtube").alias("platform"), "account",
        _metrics(subscribers=subs, views=F.coalesce(views, F.lit(0)), view_ratio=F.round(S.view_ratio(views, subs), 3),
                 title=text_or_empty(F.col("title"))).alias("metrics"),
        S.view_reason(views, subs).alias("reason"),
        "rank_key", "pos",
    )


def new_urls(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Addresses not known yet, once each, with the position of their first mention."""
    return (
        candidates.groupBy("url").agg(F.min("pos").alias("pos"))
        .join(known.select("url").distinct(), "url", "left_anti")
    )


def not_collected(urls: DataFrame, collected: DataFrame) -> DataFrame:
    """Addresses whose folder name is not among the collected ones."""
    return urls.withColumn("slug", post_slug(F.col("url"))).join(
        collected.select("slug").distinct(), "slug", "left_anti"
    )
