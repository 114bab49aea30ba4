"""Best cover picture of every script."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom import constants as C
from newsloom.operators.covers import best_hits, merge_pools, resolve_cover


PHRASES = sorted({p for _, p in C.COVER_PHRASES} | {p for _, p in C.TOPIC_COVERS} | {C.DEFAULT_COVER})


def script_covers(scripts: DataFrame, *pools: DataFrame) -> DataFrame:
    """(issue_id, query, id, score[, largeImageURL]); id is null where no picture is fit.

    Pictures are chosen once per phrase; there are only as many phrases as the fixed tables hold.
    """
    asked = scripts.select(
        "issue_id",
        resolve_cover(F.col("topic"), F.col("hook_title"), F.col("one_line"), F.col("image_keyword")).alias("query"),
    )
    return asked.join(F.broadcast(best_hits(merge_pools(*pools)).filter(F.col("query").isin(PHRASES))), "query", "left")
