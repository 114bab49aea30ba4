"""Checks and statistics on articles: confirmation, outliers, relevance, samples, sources, text, splits, scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import text_or_empty
from newsloom.operators.articles import first_rows

BUCKETS = 4096


def confirmed_issues(df: DataFrame, issue: str, source: str, least: int = 3) -> DataFrame:
    """Issues that enough different sources report: (issue, n_sources)."""
    counts = df.groupBy(issue).agg(F.count_distinct(source).alias("n_sources"))
    return counts.filter(F.col("n_sources") >= least)


def numeric_outlier(text: Column, percent: float = 100, value: float = 10_000) -> Column:
    """True if a percentage or a plain number in the text is beyond its bound."""
    numbers = F.regexp_extract_all(text_or_empty(text), F.lit(r"([0-9]+(?:\.[0-9]+)?)(%?)"), F.lit(1))
    units = F.regexp_extract_all(text_or_empty(text), F.lit(r"([0-9]+(?:\.[0-9]+)?)(%?)"), F.lit(2))
    pairs = F.arrays_zip(numbers.alias("n"), units.alias("u"))
    return F.exists(pairs, lambda p: p["n"].cast("double") > F.when(p["u"] == "%", percent).otherwise(value))


def relevant(text: Column, words: Sequence[str], least: int = 2) -> Column:
    """True if at least ``least`` different words of the topic occur in the text."""
    found = [F.contains(F.lower(text_or_empty(text)), F.lit(w)).cast("int") for w in words]
    return sum(found[1:], found[0]) >= least


def balanced_sample(df: DataFrame, source: str, order: str) -> DataFrame:
    """At most ceil(rows / sources) rows of every source, the first in order."""
    n, sources = df.agg(F.count("*"), F.count_distinct(source)).first()
    return first_rows(df, [source], [order], -(-n // max(1, sources)))


def source_of_url(url: Column, names: Sequence[tuple[str, str]]) -> Column:
    """Name of the outlet whose domain ends the URL's host, else the host without ``www.``."""
    host = F.regexp_replace(F.lower(F.regexp_extract(text_or_empty(url), r"://([^/?#:]*)", 1)), r"^www\.", "")
    known = F.coalesce(*[F.when((host == d) | F.endswith(host, F.lit("." + d)), F.lit(n)) for d, n in names])
    return F.coalesce(known, host)


def html_text(html: Column) -> Column:
    """Visible text of a page, blanks collapsed."""
    plain = F.regexp_replace(text_or_empty(html), r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", " ")
    plain = F.regexp_replace(plain, r"<[^>]*>", " ")
    return F.regexp_replace(F.regexp_replace(plain, r"[ \t\r\n]+", " "), "^ | $", "")


def merged_class(rating: Column) -> Column:
    """Five ratings as three classes."""
    return F.when(rating <= 2, "negative").when(rating == 3, "neutral").when(rating >= 4, "positive")


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.1) -> DataFrame:
    """Adds ``held_out`` for exactly ceil(share x rows) rows of every class, chosen by a hash of the key.

    Rows are ranked inside small buckets of the hash only; whole buckets are counted.
    """
    digest = F.sha2(F.col(key).cast("string"), 256)
    rows = df.withColumn("_digest", digest).withColumn("_bucket", F.conv(F.substring("_digest", 1, 3), 16, 10).cast("int"))
    counts = rows.groupBy(label, "_bucket").agg(F.count("*").alias("_n"))  # classes x BUCKETS rows at most
    before = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumns({
        "_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_total": F.sum("_n").over(Window.partitionBy(label)),
    }).drop("_n")
    ranked = rows.join(F.broadcast(placed), [label, "_bucket"]).withColumn(
        "_rank", F.col("_before") + F.row_number().over(Window.partitionBy(label, "_bucket").orderBy("_digest"))
    )
    out = ranked.withColumn("held_out", F.col("_rank") <= F.ceil(F.col("_total") * share))
    return out.select(*df.columns, "held_out")


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1 of a 0/1 prediction."""
    y, p = F.col(label), F.col(predicted)
    counts = df.agg(*[F.count_if((y == a) & (p == b)).alias(n) for n, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))])
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    f1 = F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return counts.select("*", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def dominant_signal(df: DataFrame, group: str, signal: str) -> DataFrame:
    """Most frequent signal of every group, the first by name on a tie: (group, signal, n)."""
    counts = df.filter(F.col(signal).isNotNull()).groupBy(group, signal).agg(F.count("*").alias("n"))
    return first_rows(counts, [group], [F.desc("n"), F.col(signal)], 1)
