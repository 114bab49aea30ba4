"""Cleaning and packing of a document table in five stages.

Every stage takes all documents that its predecessor kept. Its result is written to the shared
folder and read again as the next one's input.

Every stage but the last returns all columns that it got, whatever they are named, and no rows for an
empty table. Null and empty texts have no language, so the first stage drops them; rows without
an id pass all stages on their own. Repeated rows are judged alike by the first two stages, count as one
document for repeated lines, and are reduced to one row by the fourth.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm import jaccard, language, line_dedup, packing, toxicity
from newsloom.llm.registry import held_out, read
from newsloom.session import cut_lineage


def _teachers(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out(F.col("doc_id")))


def _set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with other names for the columns that a result has names for, and the columns to get them back."""
    mark = "_" * (1 + max(map(len, docs.columns)))
    aside = {n: n + mark for n in names if n in docs.columns}
    return docs.withColumnsRenamed(aside), [F.col(aside.get(c, c)).alias(c) for c in docs.columns]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language: null texts and those without letters."""
    profiles = language.learn(_teachers(docs))
    plain, back = _set_aside(docs, "lang_pred", "score")
    judged = language.predict(plain, profiles, keep=plain.columns)
    return judged.filter(F.col("lang_pred") != language.UNKNOWN).select(*back)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that the lexicon learned from the labels predicts to be toxic."""
    model = toxicity.learn(_teachers(docs), read(spark, sf_dir, "labels"))
    plain, back = _set_aside(docs, "score", "predicted")
    return toxicity.score(plain, model, keep=plain.columns).filter("predicted = 0").select(*back)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes later copies of runs of lines out of the texts; drops texts of which nothing is left."""
    plain, back = _set_aside(docs, "removed")
    cut = line_dedup.dedup_lines(plain).filter("removed is null or text <> ''")
    n_chars = F.when(F.col("removed").isNull(), F.col("n_chars")).otherwise(F.length("text")).alias("n_chars")
    return cut.select(*[n_chars if c == "n_chars" else b for c, b in zip(docs.columns, back, strict=True)])


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every component; rows without an id stay.

    Different texts that share an id are documents of their own; rows with equal id and text are one.
    """
    known = docs.filter("doc_id is not null").select(
        F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("n"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("copy")
    )
    rows = cut_lineage(known, "rows")
    linked = jaccard.jaccard_components(rows.select("n", "row.text"), id_col="n").select(F.col("doc_id").alias("n"), "component_id")
    named = rows.select("n", "row.doc_id", "copy").join(linked, "n")
    first = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "copy", "n")).alias("first"))
    # Texts without shingles link with nothing, so their equal rows are still there.
    first = first.groupBy("first.doc_id", "first.copy").agg(F.min("first.n").alias("n"))
    kept = rows.join(first.select("n"), "n", "left_semi").select("row.*")
    return kept.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the kept documents' pieces in training sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), remember=60_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_group),
    ("best_fit_packing", pack),
]
ORACLE_SQL = None  # models and packing cannot be written in SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
