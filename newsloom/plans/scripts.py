"""From clusters and generated drafts to checked scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import constants as C
from newsloom import schemas
from newsloom.functions.records import clean_sources, cover_texts, validate_record
from newsloom.functions.text import content_key, text_or_empty
from newsloom.operators import cache as K
from newsloom.operators.clusters import cluster_sources, issue_groups, material_text
from newsloom.operators.factcheck import correct_sectors, fact_check
from newsloom.session import cut_lineage

DRAFT_COLUMNS = [part.split()[0] for part in schemas.DRAFT.split(", ")]
SLIDE_COLUMNS = [part.split()[0] for part in schemas.SLIDES.split(", ")]
GENERIC_ID = "generic"


def fallback_drafts(spark: SparkSession) -> DataFrame:
    """Hand-written drafts by issue id and the generic one."""
    rows = [(GENERIC_ID, *[C.GENERIC_SCRIPT[c] for c in DRAFT_COLUMNS])]
    rows += [(issue, *[draft[c] for c in DRAFT_COLUMNS]) for issue, draft in C.CURATED_SCRIPTS.items()]
    return spark.createDataFrame(rows, f"fallback_id string, {schemas.DRAFT}")


def build_scripts(drafts: DataFrame) -> DataFrame:
    """Check and repair drafts; adds ``viable`` and ``validation_issues``."""
    checked = cover_texts(validate_record(drafts))
    return checked.withColumns({
        "sources": clean_sources(F.col("sources")),
        "image_keyword": F.when(text_or_empty(F.col("image_keyword")) != "", F.col("image_keyword"))
        .otherwise(F.lit(C.DEFAULT_COVER)),
        "validation_issues": F.concat("issues", "cover_issues"),
    }).drop("issues", "cover_issues")


def pick_fallback(clusters: DataFrame) -> DataFrame:
    """Fallback draft of every cluster: the curated one, else the generic one with its sources.

    ``clusters``: issue_id, first_sources, outlets (see ``cluster_sources``).
    """
    spark = clusters.sparkSession
    curated = list(C.CURATED_SCRIPTS)
    known = F.col("issue_id").isin(curated)
    named = ~known & (F.size(F.coalesce("first_sources", F.array())) > 0)
    picked = clusters.withColumn(
        "fallback_id", F.when(known, F.col("issue_id")).otherwise(F.lit(GENERIC_ID))
    ).join(F.broadcast(fallback_drafts(spark)), "fallback_id")  # one row per hand-written draft
    return picked.withColumns({
        "sources": F.when(named, F.col("first_sources")).otherwise(F.col("sources")),
        "slide2_source": F.when(
            named, F.concat(F.lit(C.SOURCE_PREFIX), F.array_join("outlets", C.SOURCE_JOIN))
        ).otherwise(F.col("slide2_source")),
    })


def requests(clustered: DataFrame) -> DataFrame:
    """One request per cluster: issue_id, label, key of its material, sources for a fallback."""
    groups = issue_groups(clustered)
    sources = cluster_sources(clustered).withColumnRenamed("sources", "first_sources")
    key = content_key(F.lit(C.CACHE_MODEL), F.lit(C.CACHE_VERSION),
                      material_text(F.col("cluster_label"), F.col("articles")))
    return groups.join(sources, "cluster_id", "left").select(
        F.col("cluster_id").cast("string").alias("issue_id"), "cluster_label", key.alias("key"),
        "first_sources", "outlets",
    )


def finish_scripts(scripts: DataFrame, trends: DataFrame | None) -> DataFrame:
    """Fact check against the rules, then corrected sectors or a disclaimer."""
    text = F.concat(
        text_or_empty(F.col("cluster_label")), F.lit(" "),
        F.replace("hook_title", F.lit("\n"), F.lit(" ")), F.lit(" "), F.col("one_line"),
    )
    gain, lose = F.col("slide3_sectors.name"), F.col("slide4_sectors.name")
    checked = fact_check(scripts, text, gain, lose, trends)
    status = F.col("fact_check.status")

    def corrected(right: str, old: str) -> Column:
        wanted = F.col(f"fact_check.{right}")
        change = (status == "failed") & (F.size(F.coalesce(wanted, F.array())) > 0)
        return F.when(change, correct_sectors(wanted, F.col(old))).otherwise(F.col(old))

    return checked.withColumns({
        "slide3_sectors": corrected("correct_pos", "slide3_sectors"),
        "slide4_sectors": corrected("correct_neg", "slide4_sectors"),
        "extra_disclaimer": F.when(status == "warning", F.lit(C.MARKET_DISCLAIMER)).otherwise(""),
    })


def parse_drafts(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Generated texts (issue_id, answer) as typed drafts, and the answers that are no JSON object.

    An empty answer is an empty object, so the issue gets the fallback later on.
    """
    text = F.when(F.trim(F.coalesce("answer", F.lit(""))) == "", "{}").otherwise(F.col("answer"))
    corrupt = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unread"}
    parsed = answers.withColumn("d", F.from_json(text, schemas.DRAFT + ", _unread string", corrupt))
    good = parsed.filter("d._unread is null").select("issue_id", "d.*").drop("_unread")
    return good, parsed.filter("d._unread is not null").select("issue_id", "answer")


def generate_scripts(clustered: DataFrame, drafts: DataFrame, cache: DataFrame,
                     trends: DataFrame | None = None) -> DataFrame:
    """One checked script per cluster: cached, generated or fallback.

    ``drafts`` holds the generated records by ``issue_id``; ``cache`` finished scripts by
    ``key``. The rows with ``from_cache`` and ``from_fallback`` false are what
    ``cache.upsert`` stores.
    """
    asked = cut_lineage(requests(clustered), "requests")
    open_requests = asked.join(K.usable(cache).select("key"), "key", "left_anti")
    hits = asked.select("key").join(K.usable(cache), "key").withColumn("from_cache", F.lit(True))

    generated = cut_lineage(build_scripts(open_requests.join(drafts, "issue_id", "left")), "generated")
    good = generated.filter("viable").withColumn("from_fallback", F.lit(False))
    poor = generated.filter(~F.col("viable")).select(*open_requests.columns)
    fallback = build_scripts(pick_fallback(poor)).withColumn("from_fallback", F.lit(True))

    columns = ["key", "issue_id", "cluster_label", *DRAFT_COLUMNS, "from_fallback", "validation_issues"]
    fresh = finish_scripts(good.select(columns).unionByName(fallback.select(columns)), trends)
    fresh = fresh.select(
        "key", "issue_id", "hook_title", "one_line", "sources", "image_keyword",
        F.struct(*SLIDE_COLUMNS).alias("inner"), "from_fallback", "validation_issues", "fact_check",
        "extra_disclaimer", F.lit(False).alias("from_cache"),
    )
    return fresh.unionByName(hits.select(fresh.columns))


def prepare_scripts(scripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Second check before use: (prepared scripts, rejected ids with the reason)."""
    flat = scripts.filter("inner IS NOT NULL").select(
        *[c for c in scripts.columns if c != "inner"], *[F.col(f"inner.{c}").alias(c) for c in SLIDE_COLUMNS]
    )
    checked = cut_lineage(validate_record(flat), "validated")  # both results come from it
    prepared = cover_texts(checked.filter("viable")).withColumn("inner", F.struct(*SLIDE_COLUMNS))
    rejected = (
        scripts.filter("inner IS NULL").select("issue_id", F.lit("no slides").alias("reason"))
        .unionByName(checked.filter("NOT viable").select("issue_id", F.lit("not viable").alias("reason")))
    )
    return prepared.select(scripts.columns), rejected


def first_scripts(scripts: DataFrame, order: str, items: str, n: int = 2, n_items: int = 3) -> DataFrame:
    """The first ``n`` scripts in order, each with the first ``n_items`` of its list ``items``.

    Every task hands on ``n`` rows at most.
    """
    return scripts.orderBy(order).limit(n).withColumn(items, F.slice(items, 1, n_items))
