"""Discovery of strong posts and videos from listed accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.ranking import new_urls, rank_posts, rank_videos

CANDIDATE = ["url", "platform", "account", "metrics", "reason"]


def discover(accounts: DataFrame, posts: DataFrame, videos: DataFrame, known: DataFrame, profiles: DataFrame | None = None
             ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, new addresses, failed accounts).

    ``accounts``: platform (ig or yt), account. An account without a landed listing has failed;
    it does not disturb the others. ``profiles`` (account) are landed even if they have no posts.
    """
    at = F.col("at") if "at" in accounts.columns else F.lit(0)
    listed = accounts.groupBy("platform", "account").agg(F.min(at).alias("at"))
    ig = listed.filter("platform = 'ig'").select("account")
    yt = listed.filter("platform = 'yt'").select("account")
    best = rank_posts(posts.join(ig, "account", "left_semi")).withColumn("listed_as", F.lit("ig")).unionByName(
        rank_videos(videos.join(yt, "account", "left_semi")).withColumn("listed_as", F.lit("yt"))
    )
    # addresses keep the order of the account list, then that of the ranking
    order = listed.select(F.col("platform").alias("listed_as"), "account", "at")
    best = best.join(order, ["listed_as", "account"]).withColumn("pos", F.struct("at", (-F.col("rank_key")).alias("rank"), "pos"))
    landed = posts.select("account") if profiles is None else posts.select("account").union(profiles.select("account"))
    missing = ig.join(landed.distinct(), "account", "left_anti").select(
        F.concat(F.lit("ig:"), "account").alias("account")
    ).unionByName(
        yt.join(videos.select("account").distinct(), "account", "left_anti")
        .select(F.concat(F.lit("yt:"), "account").alias("account"))
    )
    return best.select(CANDIDATE), new_urls(best, known), missing.withColumn("error", F.lit("no landed listing"))
