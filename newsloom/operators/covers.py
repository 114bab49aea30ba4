"""Choice of the cover phrase and the best picture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import constants as C
from newsloom.functions.scores import hit_score
from newsloom.functions.text import cover_phrase, detect_topic, lookup, text_or_empty


def topic_cover(topic: Column) -> Column:
    """Fixed phrase of a macro topic, null for other topics."""
    return lookup(topic, C.TOPIC_COVERS)


def resolve_cover(stored_topic: Column, hook: Column, line: Column, keyword: Column) -> Column:
    """Cover phrase: stored topic, else topic found in the texts, else dictionary."""
    issue = F.concat(F.replace(text_or_empty(hook), F.lit("\n"), F.lit(" ")), F.lit(" "), text_or_empty(line))
    topic = F.when(text_or_empty(stored_topic) != "", stored_topic).otherwise(detect_topic(issue))
    return F.coalesce(topic_cover(topic), cover_phrase(F.concat(issue, F.lit(" "), text_or_empty(keyword))))


def merge_pools(*pools: DataFrame) -> DataFrame:
    """One row per picture id: values of the last pool, place of the first. No id, no row.

    The place is (pool, pos) of the first sighting.
    """
    ranked = [p.withColumn("pool", F.lit(i)) for i, p in enumerate(pools)]
    rows = ranked[0]
    for pool in ranked[1:]:
        rows = rows.unionByName(pool)
    keys = [c for c in ("query",) if c in rows.columns]
    values = [c for c in rows.columns if c not in ("id", "pool", "pos", *keys)]
    merged = (
        rows.filter("id IS NOT NULL").groupBy(*keys, "id")
        .agg(F.max_by(F.struct(*values), F.struct("pool", "pos")).alias("hit"),
             F.min(F.struct("pool", "pos")).alias("place"))
    )
    return merged.select(*keys, "id", "hit.*", "place")


def best_hits(hits: DataFrame) -> DataFrame:
    """Best picture per ``query``, with its address if the hits have one; none if even the best one is unfit."""
    scored = hits.withColumn(
        "score", hit_score(F.col("tags"), F.col("width"), F.col("height"), F.col("downloads"), F.col("query"))
    )
    order = F.struct("score", (-F.col("place.pool")).alias("pool"), (-F.col("place.pos")).alias("pos"))
    address = ["largeImageURL"] if "largeImageURL" in hits.columns else []
    return (
        scored.groupBy("query").agg(F.max_by(F.struct("id", "score", *address), order).alias("best"))
        .select("query", "best.*").filter(F.col("score") > C.REJECT_SCORE)
    )
