"""Price series: recent trend per ticker and scaling to 0-100."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import constants as C
from newsloom.operators.articles import first_rows


def recent_trend(prices: DataFrame, last: int = C.TREND_DAYS) -> DataFrame:
    """Change in percent over the last observations: (ticker, n_days, pct).

    Fewer than two observations give 0.0.
    """
    recent = first_rows(prices, ["ticker"], [F.desc("date")], last)
    change = (F.try_divide(F.col("end") - F.col("start"), F.col("start"))) * 100
    return (
        recent.groupBy("ticker")
        .agg(F.count("*").alias("n_days"), F.min_by("close", "date").alias("start"), F.max_by("close", "date").alias("end"))
        .select("ticker", "n_days", F.when(F.col("n_days") < 2, F.lit(0.0)).otherwise(change).alias("pct"))
    )


def trend_agrees(expected: Column, n_days: Column, pct: Column) -> Column:
    """True if the change does not contradict the expected direction (or is unknown)."""
    fits = F.when(expected == "up", pct >= -C.TREND_TOLERANCE).when(expected == "down", pct <= C.TREND_TOLERANCE)
    return F.when(F.coalesce(n_days, F.lit(0)) < 2, F.lit(True)).otherwise(F.coalesce(fits, F.lit(False)))


def scale_series(prices: DataFrame) -> DataFrame:
    """Close scaled to 0-100 per ticker, null for a flat series.

    The extremes are combined per task and joined back, so one long series is never sorted
    or held in a single task.
    """
    ends = prices.groupBy("ticker").agg(F.min("close").alias("low"), F.max("close").alias("high"))
    return prices.join(ends, "ticker").select(
        "ticker", "date", "close",
        (F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")) * 100).alias("scaled"),
    )
