"""Named queries over the given tables, each with an optional SQL twin for checking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import spread_small, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def sql_list(values) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_any(text: str, phrases) -> str:
    """SQL twin of ``contains_any``."""
    return "(" + " OR ".join(f"contains({text}, {sql_text(p)})" for p in phrases) + ")"


def sql_first(text: str, table_, default: str | None) -> str:
    """SQL twin of ``first_match``."""
    cases = " ".join(f"WHEN contains({text}, {sql_text(k)}) THEN {sql_text(v)}" for k, v in table_)
    return f"CASE {cases} ELSE {'NULL' if default is None else sql_text(default)} END"


# The given documents seen as articles: the first line is the title, the text the summary.
ARTICLES = (
    "articles AS (SELECT doc_id AS pos, split_part(text, chr(10), 1) AS title, text AS summary,"
    " source, lang, n_chars FROM documents)"
)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread_small(table(spark, sf_dir, "documents"), "doc_id")
    return documents.select(
        F.col("doc_id").alias("pos"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("summary"),
        "source", "lang", "n_chars",
    )


# Articles with a cluster number, -1 for noise, derived from the text length.
CLUSTERED = ARTICLES + (
    ", clustered AS (SELECT *, CAST(n_chars % 97 - 1 AS INTEGER) AS cluster_id,"
    " lang || ' ' || CAST(n_chars % 97 AS VARCHAR) AS cluster_label FROM articles)"
)


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("n_chars") % 97
    return articles(spark, sf_dir).withColumns({
        "cluster_id": (number - 1).cast("int"),
        "cluster_label": F.concat("lang", F.lit(" "), number.cast("string")),
    })
