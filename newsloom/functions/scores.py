"""Numeric scores: picture hits, engagement, view ratio."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom import constants as C
from newsloom.functions.text import let, text_or_empty


def hit_score(tags: Column, width: Column, height: Column, downloads: Column, query: Column) -> Column:
    """Fitness of a picture: bad tags and odd shapes cost, query words and downloads add."""
    wide = F.when(F.coalesce(width, F.lit(0)) == 0, F.lit(1)).otherwise(width)
    high = F.when(F.coalesce(height, F.lit(0)) == 0, F.lit(1)).otherwise(height)
    aspect = wide / F.greatest(high, F.lit(1))

    def word_points(low: Column) -> Column:
        bad = sum((F.contains(low, F.lit(t)).cast("int") for t in C.BAD_TAGS), F.lit(0))
        words = F.filter(
            F.regexp_extract_all(F.lower(text_or_empty(query)), F.lit(r"\S+"), F.lit(0)),
            lambda w: (F.length(w) >= C.MIN_QUERY_WORD) & F.contains(low, w),
        )
        return bad * C.BAD_TAG_POINTS + F.size(words) * C.WORD_POINTS

    odd = F.when((aspect > C.MAX_ASPECT) | (aspect < C.MIN_ASPECT), C.BAD_ASPECT_POINTS).otherwise(0.0)
    popular = F.least(
        F.coalesce(downloads, F.lit(0)) / C.DOWNLOADS_PER_POINT, F.lit(C.MAX_DOWNLOAD_POINTS)
    )
    return let(F.lower(text_or_empty(tags)), word_points) + odd + popular


def engagement(likes: Column, comments: Column, followers: Column) -> Column:
    """(likes + comments) / followers, 0.0 without followers."""
    return F.when(followers > 0, _sum(likes, comments) / followers).otherwise(F.lit(0.0))


def view_ratio(views: Column, subscribers: Column) -> Column:
    """views / subscribers, 0.0 without subscribers."""
    return F.when(subscribers > 0, _zero(views) / subscribers).otherwise(F.lit(0.0))


def engagement_rank_key(likes: Column, comments: Column, followers: Column) -> Column:
    return F.when(followers > 0, engagement(likes, comments, followers)).otherwise(
        _sum(likes, comments).cast("double")
    )


def view_rank_key(views: Column, subscribers: Column) -> Column:
    return F.when(subscribers > 0, view_ratio(views, subscribers)).otherwise(_zero(views).cast("double"))


def engagement_reason(likes: Column, comments: Column, followers: Column) -> Column:
    rate = engagement(likes, comments, followers) * 100
    return F.concat(
        F.lit("engagement "), F.call_function("format_number", rate, F.lit("0.00")), F.lit("% (좋아요 "),
        F.format_number(_zero(likes), 0), F.lit(" + 댓글 "), F.format_number(_zero(comments), 0),
        F.lit(" / 팔로워 "), F.format_number(followers, 0), F.lit(")"),
    )


def view_reason(views: Column, subscribers: Column) -> Column:
    count = F.format_number(_zero(views), 0)
    return F.when(
        subscribers > 0,
        F.concat(
            F.lit("조회수/구독자 "), F.call_function("format_number", view_ratio(views, subscribers), F.lit("0.00")),
            F.lit("x (조회 "), count, F.lit(" / 구독 "), F.format_number(subscribers, 0), F.lit(")"),
        ),
    ).otherwise(F.concat(F.lit("조회수 "), count, F.lit(" (구독자 미확인)")))


def _zero(col: Column) -> Column:
    return F.coalesce(col, F.lit(0))


def _sum(likes: Column, comments: Column) -> Column:
    return _zero(likes) + _zero(comments)
