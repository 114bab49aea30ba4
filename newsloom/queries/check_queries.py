"""Queries on checks, splits, scores and generated text."""

from pyspark.sql import functions as F

from newsloom.operators import checks
from newsloom.plans.scripts import parse_drafts
from newsloom.queries.registry import ARTICLES, articles, query, sql_list
from newsloom.session import table

TOPIC_WORDS = ["and", "the ", "und ", "les ", "para"]
# Fixed values of the query: outlets by domain.
OUTLETS = [("tionsh.example.net", "Tionsh"), ("example.org", "Example Org"), ("ththe.example.com", "Ththe")]
OUTLET_SQL = " ".join(f"WHEN host = '{d}' OR ends_with(host, '.{d}') THEN '{n}'" for d, n in OUTLETS)


@query("confirmed_issues", f"""
WITH {ARTICLES} SELECT title, count(DISTINCT source) AS n_sources FROM articles GROUP BY title HAVING count(DISTINCT source) >= 3""")
def confirmed_issues(spark, sf_dir):
    return checks.confirmed_issues(articles(spark, sf_dir), "title", "source")


@query("numeric_outliers", r"""
WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?%?')) AS x FROM documents),
b AS (SELECT DISTINCT doc_id FROM n WHERE CASE WHEN ends_with(x, '%') THEN CAST(rtrim(x, '%') AS DOUBLE) > 100 ELSE CAST(x AS DOUBLE) > 10000 END)
SELECT doc_id FROM b""")
def numeric_outliers(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(checks.numeric_outlier(F.col("text"))).select("doc_id")


@query("relevant_articles", f"""
SELECT doc_id FROM documents WHERE len(list_filter({sql_list(TOPIC_WORDS)}, lambda w: contains(lower(text), w))) >= 2""")
def relevant_articles(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(checks.relevant(F.col("text"), TOPIC_WORDS)).select("doc_id")


@query("balanced_sample", """
WITH q AS (SELECT CAST(ceil(count(*) / count(DISTINCT lang)) AS BIGINT) AS quota FROM documents)
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents), q WHERE rn <= quota""")
def balanced_sample(spark, sf_dir):
    return checks.balanced_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query("url_sources", rf"""
WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\.', '') AS host FROM pages)
SELECT page_id, CASE {OUTLET_SQL} ELSE host END AS source FROM h""")
def url_sources(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", checks.source_of_url(F.col("url"), OUTLETS).alias("source"))


@query("page_texts", r"""
WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<(script|style)\b[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'), '^ | $', '', 'g') AS text FROM pages)
SELECT page_id, sha256(text) AS text_hash, length(text) AS n_chars FROM t WHERE length(text) >= 100""")
def page_texts(spark, sf_dir):
    text = table(spark, sf_dir, "pages").select("page_id", checks.html_text(F.col("html")).alias("text")).filter(F.length("text") >= 100)
    return text.select("page_id", F.sha2("text", 256).alias("text_hash"), F.length("text").cast("bigint").alias("n_chars"))


@query("stratified_split", """
WITH r AS (SELECT doc_id, CASE WHEN doc_id % 5 + 1 <= 2 THEN 'negative' WHEN doc_id % 5 + 1 = 3 THEN 'neutral' ELSE 'positive' END AS class FROM labels)
SELECT doc_id, class, row_number() OVER (PARTITION BY class ORDER BY sha256(CAST(doc_id AS VARCHAR))) <= ceil(0.1 * count(*) OVER (PARTITION BY class)) AS held_out FROM r""")
def stratified_split(spark, sf_dir):
    rated = table(spark, sf_dir, "labels").select("doc_id", checks.merged_class(F.col("doc_id") % 5 + 1).alias("class"))
    return checks.stratified_split(rated, "class", "doc_id")


@query("prediction_scores", """
WITH p AS (SELECT toxic, CAST(contains(lower(text), 'idiot') OR contains(lower(text), 'stupid') AS INTEGER) AS p FROM labels JOIN documents USING (doc_id)),
c AS (SELECT count(*) FILTER (toxic = 1 AND p = 1) AS tp, count(*) FILTER (toxic = 0 AND p = 1) AS fp,
  count(*) FILTER (toxic = 1 AND p = 0) AS fn, count(*) FILTER (toxic = 0 AND p = 0) AS tn FROM p)
SELECT tp, fp, fn, tn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM c""")
def prediction_scores(spark, sf_dir):
    text = F.lower("text")
    rule = F.contains(text, F.lit("idiot")) | F.contains(text, F.lit("stupid"))
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("toxic", rule.cast("int").alias("p"))
    return checks.confusion(rows, "toxic", "p")


@query("dominant_signal", """
WITH c AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL)
SELECT source, lang, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS rn FROM c) WHERE rn = 1""")
def dominant_signal(spark, sf_dir):
    return checks.dominant_signal(table(spark, sf_dir, "documents"), "source", "lang")


@query("parsed_drafts", """
SELECT CAST(doc_id AS VARCHAR) AS issue_id, CASE WHEN doc_id % 4 < 2 THEN text END AS hook_title,
  CASE WHEN doc_id % 4 < 2 THEN source END AS outlet, doc_id % 4 = 2 AS unread FROM documents""")
def parsed_drafts(spark, sf_dir):
    """Generated texts: whole objects, objects cut off in the middle, and empty answers."""
    doc = table(spark, sf_dir, "documents")
    whole = F.to_json(F.struct(F.col("text").alias("hook_title"), F.array("source").alias("sources"), F.lit(1).alias("extra")))
    answer = F.when(F.col("doc_id") % 4 < 2, whole).when(F.col("doc_id") % 4 == 2, F.expr("substring(text, 1, 20)"))
    drafts, unread = parse_drafts(doc.select(F.col("doc_id").cast("string").alias("issue_id"), answer.alias("answer")))
    good = drafts.select("issue_id", "hook_title", F.try_element_at("sources", F.lit(1)).alias("outlet"), F.lit(False).alias("unread"))
    bad = unread.select("issue_id", F.lit(None).cast("string").alias("hook_title"), F.lit(None).cast("string").alias("outlet"), F.lit(True).alias("unread"))
    return good.unionByName(bad)
