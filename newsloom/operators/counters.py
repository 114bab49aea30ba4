"""Row counts of a run, taken while the rows pass by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` with a row counter that is filled by the next action on it."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def stage_counts(**stages: DataFrame) -> DataFrame:
    """One row per stage: (stage, rows)."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("stage"), "rows") for n, df in stages.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def condition_counts(df: DataFrame, **stages: Column) -> DataFrame:
    """One row per stage: (stage, rows), all of them counted in one pass over ``df``."""
    counted = df.agg(*[F.count_if(c).alias(n) for n, c in stages.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("stage"), F.col(n).alias("rows")) for n in stages])
    return counted.select(F.explode(pairs).alias("p")).select("p.*")
