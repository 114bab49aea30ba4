"""Operators on clustered articles: quality, labels, keywords, material, sources.

Rows need ``cluster_id`` and ``pos`` (article order). A cluster may hold any share of all
rows, so nothing collects a whole cluster: lists are cut to their first few rows before
they are gathered, everything else is a combining aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import constants as C
from newsloom.functions.text import BLANKS, keyword_terms, outlet_of, short_label, strip, text_or_empty
from newsloom.operators.articles import first_rows

NOISE = -1


def drop_noise(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce("cluster_id", F.lit(NOISE)) >= 0)


def noise_rows(df: DataFrame) -> DataFrame:
    """The rows without a cluster; they never take part in a join on its number, whose hottest key they would be."""
    return df.filter(F.coalesce("cluster_id", F.lit(NOISE)) < 0)


def cluster_quality(df: DataFrame) -> DataFrame:
    """Rows and distinct sources per cluster; kept with two of each."""
    return (
        drop_noise(df).groupBy("cluster_id")
        .agg(F.count("*").alias("n_articles"), F.count_distinct("source").alias("n_sources"))
        .withColumn("kept", (F.col("n_articles") >= 2) & (F.col("n_sources") >= 2))
    )


def reject_weak_clusters(df: DataFrame) -> DataFrame:
    """Turn clusters of one article or one source into noise."""
    good = cluster_quality(df).filter("kept").select("cluster_id", F.lit(True).alias("_good"))
    kept = drop_noise(df).join(good, "cluster_id", "left").withColumn(
        "cluster_id", F.when(F.col("_good"), F.col("cluster_id")).otherwise(F.lit(NOISE))
    )
    return kept.select(*df.columns).unionByName(noise_rows(df).withColumn("cluster_id", F.lit(NOISE)))


def noise_report(df: DataFrame) -> DataFrame:
    """One row: clusters, noise rows and noise share in percent."""
    noise = F.coalesce("cluster_id", F.lit(NOISE)) < 0
    return df.agg(
        F.count_distinct(F.when(~noise, F.col("cluster_id"))).alias("n_clusters"),
        F.count_if(noise).alias("n_noise"),
        (F.try_divide(F.count_if(noise), F.count("*")) * 100).alias("noise_pct"),
    )


def _short_titled(df: DataFrame, limit: int = 20) -> DataFrame:
    """Clusters whose titles, joined by blanks and stripped, have under ``limit`` characters."""
    title = text_or_empty(F.col("title"))
    filled = strip(title) != ""
    ends = df.groupBy("cluster_id").agg(
        F.min(F.when(filled, F.col("pos"))).alias("first"), F.max(F.when(filled, F.col("pos"))).alias("last")
    )
    lead = F.length(title) - F.length(F.ltrim(title, F.lit(BLANKS)))
    trail = F.length(title) - F.length(F.rtrim(title, F.lit(BLANKS)))
    chars = (
        F.length(title) + 1
        - F.when(F.col("pos") == F.col("first"), lead).otherwise(0)
        - F.when(F.col("pos") == F.col("last"), trail).otherwise(0)
    )
    inside = F.col("pos").between(F.col("first"), F.col("last"))
    return (
        df.join(ends, "cluster_id").groupBy("cluster_id")
        .agg((F.coalesce(F.sum(F.when(inside, chars)), F.lit(0)) - 1).alias("n"))
        .select("cluster_id", (F.col("n") < limit).alias("use_body"))
    )


def cluster_keywords(df: DataFrame, top_n: int = 5, body_chars: int = C.DESCRIPTION_CHARS) -> DataFrame:
    """Most frequent words per cluster: (cluster_id, word, n, place); ties by first use."""
    rows = drop_noise(df)
    title = text_or_empty(F.col("title"))
    body = F.substring(text_or_empty(F.col("summary")), 1, body_chars) if "summary" in df.columns else title
    words = (
        rows.join(_short_titled(rows), "cluster_id")
        .select("cluster_id", "pos", F.posexplode(keyword_terms(F.when(F.col("use_body"), body).otherwise(title)))
                .alias("at", "word"))
        .filter(~F.col("word").isin(C.COMMON_WORDS))
        .groupBy("cluster_id", "word")
        .agg(F.count("*").alias("n"), F.min(F.struct("pos", "at")).alias("first"))
    )
    ranked = first_rows(words, ["cluster_id"], [F.desc("n"), F.col("first")], top_n)
    return ranked.select("cluster_id", "word", "n", "first")


def cluster_labels(df: DataFrame) -> DataFrame:
    """Label per cluster: longest title (first on a tie), keywords if it is too short."""
    rows = drop_noise(df)
    longest = rows.groupBy("cluster_id").agg(
        F.max_by(text_or_empty(F.col("title")), F.struct(F.length(text_or_empty(F.col("title"))), -F.col("pos")))
        .alias("title")
    )
    tiny = longest.filter(F.length(strip(F.col("title"))) < 5).select("cluster_id")
    words = (
        cluster_keywords(rows.join(tiny, "cluster_id", "left_semi"), top_n=3)
        .groupBy("cluster_id")
        .agg(F.array_join(F.sort_array(F.collect_list(F.struct(-F.col("n"), "first", "word"))).word, " ").alias("words"))
    )
    title = F.when(
        F.length(strip(F.col("title"))) < 5,
        F.coalesce("words", F.concat(F.lit("이슈 "), F.col("cluster_id").cast("string"))),
    ).otherwise(F.col("title"))
    return longest.join(words, "cluster_id", "left").select("cluster_id", short_label(title).alias("cluster_label"))


def attach_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Bring the cluster label to every row; rows without one are noise."""
    bare = df.drop("cluster_label")
    named = drop_noise(bare).join(labels, "cluster_id", "left")
    named = named.withColumn("cluster_label", F.coalesce("cluster_label", F.lit(C.NOISE_LABEL)))
    return named.unionByName(noise_rows(bare).withColumn("cluster_label", F.lit(C.NOISE_LABEL)))


def cluster_terms(df: DataFrame, terms: Column) -> DataFrame:
    """Term counts of all titles of a cluster: (id, term, tf).

    Equal to counting in the joined titles of the cluster, without building that string.
    """
    return (
        drop_noise(df).select(F.col("cluster_id").alias("id"), F.explode(terms).alias("term"))
        .groupBy("id", "term").agg(F.count("*").alias("tf"))
    )


def cluster_sources(df: DataFrame, limit: int = C.MAX_SOURCES) -> DataFrame:
    """First sources and first known outlets of a cluster, both in source-name order."""
    names = (
        drop_noise(df).filter(text_or_empty(F.col("source")) != "").select("cluster_id", "source").distinct()
    )
    first = (
        first_rows(names, ["cluster_id"], ["source"], limit)
        .groupBy("cluster_id").agg(F.array_sort(F.collect_list("source")).alias("sources"))
    )
    known = (
        names.withColumn("outlet", outlet_of(F.col("source"))).filter("outlet IS NOT NULL")
        .groupBy("cluster_id", "outlet").agg(F.min("source").alias("source"))
    )
    outlets = (
        first_rows(known, ["cluster_id"], ["source"], limit)
        .groupBy("cluster_id")
        .agg(F.sort_array(F.collect_list(F.struct("source", "outlet"))).outlet.alias("outlets"))
    )
    return first.join(outlets, "cluster_id", "left").withColumn(
        "outlets", F.coalesce("outlets", F.array([F.lit(s) for s in C.DEFAULT_SOURCES]))
    )


def issue_groups(df: DataFrame, k: int = C.MATERIAL_ARTICLES) -> DataFrame:
    """One row per cluster in order of first appearance, with its first ``k`` articles."""
    rows = drop_noise(df).withColumn("summary", F.substring("summary", 1, C.MATERIAL_SUMMARY_CHARS))  # all that is used of it
    groups = rows.groupBy("cluster_id").agg(
        F.min("pos").alias("first_pos"),
        F.count("*").alias("n_articles"),
        F.min_by(text_or_empty(F.col("cluster_label")), "pos").alias("cluster_label"),
    )
    heads = (
        first_rows(rows, ["cluster_id"], ["pos"], k)
        .groupBy("cluster_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "title", "summary", "source"))).alias("articles"))
    )
    return groups.join(heads, "cluster_id")


def material_text(label: Column, articles: Column) -> Column:
    """Text of an issue: label, then its first articles numbered with source and short summary."""

    def line(a: Column, i: Column) -> Column:
        return F.concat(
            (i + 1).cast("string"), F.lit(". ("), text_or_empty(a["source"]), F.lit(") "),
            text_or_empty(a["title"]), F.lit("\n   "),
            F.substring(text_or_empty(a["summary"]), 1, C.MATERIAL_SUMMARY_CHARS),
        )

    head = F.array(
        F.concat(F.lit(C.MATERIAL_LABEL_LINE), text_or_empty(label)), F.lit(""), F.lit(C.MATERIAL_LIST_LINE)
    )
    lines = F.transform(F.slice(articles, 1, C.MATERIAL_ARTICLES), line)
    return F.array_join(F.concat(head, lines), "\n")
