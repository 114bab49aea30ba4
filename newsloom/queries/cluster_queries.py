"""Queries for aggregates on clustered articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import constants as C
from newsloom.functions.text import keyword_match
from newsloom.operators import clusters as K
from newsloom.operators.articles import first_rows, keep_first, union_feeds
from newsloom.operators.counters import condition_counts, stage_counts
from newsloom.plans import scripts
from newsloom.queries.registry import (
    ARTICLES, CLUSTERED, articles, clustered, query, sql_any, sql_first, sql_list,
)
from newsloom.session import table

CHATS = (
    "chats AS (SELECT conv_id AS cluster_id, turn AS pos, 'talk ' || conv_id AS cluster_label,"
    " split_part(text, chr(10), 1) AS title, text AS summary, role AS source FROM conversations)"
)


def chats(spark, sf_dir):
    """Conversations as clusters: every turn is an article."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("cluster_id"), F.col("turn").alias("pos"),
        F.concat(F.lit("talk "), F.col("conv_id").cast("string")).alias("cluster_label"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("summary"),
        F.col("role").alias("source"),
    )


@query("issue_groups", f"""
WITH {CHATS} SELECT cluster_id, min(pos) AS first_pos, count(*) AS n_articles, arg_min(cluster_label, pos) AS cluster_label,
  string_agg(title, '|' ORDER BY pos) FILTER (pos < 5) AS head FROM chats GROUP BY cluster_id""")
def issue_groups(spark, sf_dir):
    return K.issue_groups(chats(spark, sf_dir)).select(
        "cluster_id", "first_pos", "n_articles", "cluster_label", F.array_join("articles.title", "|").alias("head")
    )


@query("material_text", f"""
WITH {CHATS} SELECT cluster_id, '{C.MATERIAL_LABEL_LINE}' || arg_min(cluster_label, pos) || chr(10) || chr(10) ||
  '{C.MATERIAL_LIST_LINE}' || chr(10) || string_agg((pos + 1) || '. (' || source || ') ' || title || chr(10) || '   ' ||
  substring(summary, 1, 400), chr(10) ORDER BY pos) FILTER (pos < 5) AS material FROM chats GROUP BY cluster_id""")
def material_text(spark, sf_dir):
    return K.issue_groups(chats(spark, sf_dir)).select(
        "cluster_id", K.material_text(F.col("cluster_label"), F.col("articles")).alias("material")
    )


@query("cluster_quality", f"""
WITH {CLUSTERED} SELECT cluster_id, count(*) AS n_articles, count(DISTINCT source) AS n_sources,
  CAST(count(*) >= 2 AND count(DISTINCT source) >= 2 AS BIGINT) AS kept FROM clustered WHERE cluster_id >= 0 GROUP BY 1""")
def cluster_quality(spark, sf_dir):
    return K.cluster_quality(clustered(spark, sf_dir)).withColumn("kept", F.col("kept").cast("bigint"))


@query("reject_weak_clusters", f"""
WITH {CLUSTERED}, fine AS (SELECT *, cluster_id * 100 + (pos // 50) % 100 AS c FROM clustered),
good AS (SELECT c FROM fine WHERE cluster_id >= 0 GROUP BY c HAVING count(*) >= 2 AND count(DISTINCT source) >= 2)
SELECT pos, CASE WHEN cluster_id >= 0 AND c IN (SELECT c FROM good) THEN c ELSE -1 END AS cluster_id FROM fine""")
def reject_weak_clusters(spark, sf_dir):
    finer = F.col("cluster_id") * 100 + F.floor(F.col("pos") / 50) % 100
    df = clustered(spark, sf_dir).withColumn("cluster_id", F.when(F.col("cluster_id") >= 0, finer).otherwise(-1))
    return K.reject_weak_clusters(df).select("pos", "cluster_id")


@query("noise_report", f"""
WITH {CLUSTERED} SELECT count(DISTINCT CASE WHEN cluster_id >= 0 THEN cluster_id END) AS n_clusters,
  count(*) FILTER (cluster_id < 0) AS n_noise, 100.0 * (count(*) FILTER (cluster_id < 0))::DOUBLE / count(*) AS noise_pct
FROM clustered""")
def noise_report(spark, sf_dir):
    return K.noise_report(clustered(spark, sf_dir))


# Words: runs of word characters, then pure Latin words of 3+ letters or Hangul runs of 2+.
WORDS_SQL = (
    "flatten(list_transform(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'), lambda w:"
    " CASE WHEN regexp_full_match(w, '[a-z]{{3,}}') THEN [w] ELSE regexp_extract_all(w, '[가-힣]{{2,}}') END))"
)


def keywords_sql(source: str, top: int, with_cte: str) -> str:
    return f"""
WITH {with_cte}, usable AS (SELECT * FROM {source} WHERE cluster_id >= 0),
joined AS (SELECT cluster_id, length(trim(string_agg(title, ' ' ORDER BY pos), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) < 20
  AS use_body FROM usable GROUP BY 1),
texts AS (SELECT cluster_id, pos, {WORDS_SQL.format("CASE WHEN use_body THEN substring(summary, 1, 500) ELSE title END")} AS words
  FROM usable JOIN joined USING (cluster_id)),
w AS (SELECT cluster_id, pos, unnest(words) AS word, generate_subscripts(words, 1) AS nth FROM texts),
c AS (SELECT cluster_id, word, count(*) AS n, min(pos * 1000000 + nth) AS first FROM w
  WHERE word NOT IN (SELECT unnest({sql_list(C.COMMON_WORDS)})) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, first) AS place FROM c)
SELECT cluster_id, word, n, place FROM r WHERE place <= {top}"""


def placed(keywords):
    from pyspark.sql.window import Window
    order = Window.partitionBy("cluster_id").orderBy(F.desc("n"), "first")
    return keywords.withColumn("place", F.row_number().over(order)).select("cluster_id", "word", "n", "place")


@query("cluster_keywords", keywords_sql("clustered", 5, CLUSTERED))
def cluster_keywords(spark, sf_dir):
    return placed(K.cluster_keywords(clustered(spark, sf_dir)))


BLANK_TITLES = CHATS + (
    ", sparse AS (SELECT * REPLACE (CASE WHEN (cluster_id + pos) % 3 = 0 THEN substring(title, 1, 9)"
    " ELSE ' ' END AS title) FROM chats)"
)


def sparse(spark, sf_dir):
    """Conversations with mostly blank titles, so that bodies must serve."""
    title = F.when((F.col("cluster_id") + F.col("pos")) % 3 == 0, F.substring("title", 1, 9)).otherwise(" ")
    return chats(spark, sf_dir).withColumn("title", title)


@query("cluster_keywords_from_bodies", keywords_sql("sparse", 5, BLANK_TITLES))
def cluster_keywords_from_bodies(spark, sf_dir):
    return placed(K.cluster_keywords(sparse(spark, sf_dir)))


@query("cluster_labels", f"""
WITH {CLUSTERED} SELECT cluster_id, CASE WHEN length(title) > 50 THEN substring(title, 1, 50) || '...' ELSE title END AS cluster_label
FROM (SELECT cluster_id, title, row_number() OVER (PARTITION BY cluster_id ORDER BY length(title) DESC, pos) AS rn
  FROM clustered WHERE cluster_id >= 0) WHERE rn = 1""")
def cluster_labels(spark, sf_dir):
    return K.cluster_labels(clustered(spark, sf_dir)).select("cluster_id", "cluster_label")


@query("attach_labels", f"""
WITH {CLUSTERED} SELECT pos, coalesce(l.cluster_label, '{C.NOISE_LABEL}') AS cluster_label FROM clustered c LEFT JOIN
  (SELECT cluster_id, min(cluster_label) AS cluster_label FROM clustered WHERE cluster_id >= 0 GROUP BY 1) l
  USING (cluster_id)""")
def attach_labels(spark, sf_dir):
    df = clustered(spark, sf_dir)
    labels = K.drop_noise(df).groupBy("cluster_id").agg(F.min("cluster_label").alias("cluster_label"))
    return K.attach_labels(df, labels).select("pos", "cluster_label")


@query("cluster_title_terms", f"""
WITH {CLUSTERED}, t AS (SELECT cluster_id AS id, unnest(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term
  FROM clustered WHERE cluster_id >= 0) SELECT id, term, count(*) AS tf FROM t GROUP BY 1, 2""")
def cluster_title_terms(spark, sf_dir):
    from newsloom.operators.vectors import word_grams
    return K.cluster_terms(clustered(spark, sf_dir), word_grams(F.col("title"), []))


@query("cluster_sources", f"""
WITH {CLUSTERED}, named AS (SELECT cluster_id, CASE WHEN pos % 4 = 0 THEN source WHEN pos % 4 = 1 THEN 'Reuters ' || source
  WHEN pos % 4 = 2 THEN 'CNBC ' || source ELSE 'Soft ' || source END AS source FROM clustered WHERE cluster_id >= 0),
d AS (SELECT DISTINCT cluster_id, source, {sql_first('lower(source)', C.OUTLETS, None)} AS outlet FROM named),
s AS (SELECT cluster_id, array_to_string(list_sort(list(source))[1:3], '|') AS sources FROM d GROUP BY 1),
o AS (SELECT cluster_id, outlet, min(source) AS first FROM d WHERE outlet IS NOT NULL GROUP BY 1, 2),
p AS (SELECT cluster_id, array_to_string(list(outlet ORDER BY first)[1:3], '|') AS outlets FROM o GROUP BY 1)
SELECT cluster_id, sources, coalesce(outlets, 'Reuters') AS outlets FROM s LEFT JOIN p USING (cluster_id)""")
def cluster_sources(spark, sf_dir):
    part = F.col("pos") % 4
    df = clustered(spark, sf_dir).withColumn(
        "source",
        F.when(part == 0, F.col("source")).when(part == 1, F.concat(F.lit("Reuters "), "source"))
        .when(part == 2, F.concat(F.lit("CNBC "), "source")).otherwise(F.concat(F.lit("Soft "), "source")),
    )
    return K.cluster_sources(df).select(
        "cluster_id", F.array_join("sources", "|").alias("sources"), F.array_join("outlets", "|").alias("outlets")
    )


KEYWORD_SQL = sql_any("lower(title || ' ' || summary)", [k.lower() for k in C.MACRO_KEYWORDS])


@query("run_counters", f"""
WITH {ARTICLES}, m AS (SELECT * FROM articles WHERE {KEYWORD_SQL})
SELECT 'collected' AS stage, count(*) AS rows FROM articles UNION ALL SELECT 'matching', count(*) FROM m
UNION ALL SELECT 'distinct_titles', count(DISTINCT lower(title)) FROM m""")
def run_counters(spark, sf_dir):
    rows = articles(spark, sf_dir).withColumn("matches", keyword_match(F.col("title"), F.col("summary")))
    titles = rows.filter("matches").select(F.lower("title")).distinct()
    return condition_counts(rows, collected=F.lit(True), matching=F.col("matches")).unionByName(stage_counts(distinct_titles=titles))


@query("first_articles_per_cluster", f"""
WITH {CHATS} SELECT cluster_id, pos, title FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY pos) AS rn FROM chats) WHERE rn <= 5""")
def first_articles_per_cluster(spark, sf_dir):
    return first_rows(chats(spark, sf_dir), ["cluster_id"], ["pos"], 5).select("cluster_id", "pos", "title")


@query("keep_first_by_url", f"""
WITH {ARTICLES}, m AS (SELECT pos, source, CASE WHEN pos % 9 = 0 THEN '' WHEN pos % 10 = 0 THEN NULL
  ELSE lower(title) END AS url FROM articles WHERE {KEYWORD_SQL})
SELECT pos, source FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(url, '') ORDER BY pos) AS rn FROM m) WHERE rn = 1""")
def keep_first_by_url(spark, sf_dir):
    pos = F.col("pos")
    rows = articles(spark, sf_dir).filter(keyword_match(F.col("title"), F.col("summary"))).withColumn(
        "url", F.when(pos % 9 == 0, "").when(pos % 10 != 0, F.lower("title"))
    )
    return keep_first(rows, "url", ["pos"]).select("pos", "source")


@query("union_two_feeds", """
SELECT 0 AS feed_rank, page_id AS pos, url FROM pages UNION ALL SELECT 1, doc_id, source FROM documents""")
def union_two_feeds(spark, sf_dir):
    first = table(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), "url")
    second = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("source").alias("url"))
    return union_feeds(first, second)


@query("first_scripts", f"""
WITH {CHATS}, g AS (SELECT cluster_id, min(cluster_label) AS label, list_sort(list(DISTINCT source)) AS sources FROM chats GROUP BY 1)
SELECT cluster_id, label, array_to_string(sources[1:3], '|') AS items FROM g ORDER BY cluster_id LIMIT 2""")
def first_scripts(spark, sf_dir):
    groups = chats(spark, sf_dir).groupBy("cluster_id").agg(
        F.min("cluster_label").alias("label"), F.sort_array(F.collect_set("source")).alias("sources")
    )
    return scripts.first_scripts(groups, "cluster_id", "sources").select("cluster_id", "label", F.array_join("sources", "|").alias("items"))
