"""Queries for the text expressions, filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import constants as C
from newsloom.functions import text as X
from newsloom.functions.records import clean_sources, find_banned, reason_owners, wrong_owner
from newsloom.operators import articles as A
from newsloom.queries.registry import (
    ARTICLES, CLUSTERED, articles, clustered, query, sql_any, sql_first, sql_list, sql_text,
)
from newsloom.session import table

EVENT_NOW = "2024-01-30 12:00:00"
TOKENS_SQL = "list_distinct(regexp_extract_all(lower({0}), '" + C.TOKEN_PATTERN + "'))"


def topic_sql(low: str) -> str:
    parts = []
    for topic, words in C.TOPIC_WORDS:
        test = sql_any(low, words)
        if topic == C.AI_TOPIC:
            test = f"({test} OR regexp_matches({low}, '(^|[^\\p{{L}}\\p{{N}}_])ai([^\\p{{L}}\\p{{N}}_]|$)'))"
        parts.append(f"WHEN {test} THEN {sql_text(topic)}")
    return "CASE " + " ".join(parts) + " ELSE NULL END"


@query("freshness_window", f"""
SELECT event_id, coalesce(strftime(published, '%Y-%m-%d %H:%M:%S'), '{EVENT_NOW}') AS published_at
FROM (SELECT event_id, CASE WHEN event_type <> 'error' THEN ts END AS published FROM events)
WHERE published IS NULL OR published >= TIMESTAMP '{EVENT_NOW}' - INTERVAL 24 HOUR""")
def freshness_window(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") != "error", F.col("ts").cast("timestamp")).alias("published_at"),
    )
    recent = A.fresh_only(events, "published_at", F.lit(EVENT_NOW).cast("timestamp"))
    return recent.withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))


@query("keyword_filter", f"""
WITH {ARTICLES} SELECT pos, source FROM articles
WHERE {sql_any("lower(title || ' ' || summary)", [k.lower() for k in C.MACRO_KEYWORDS])}""")
def keyword_filter(spark, sf_dir):
    return articles(spark, sf_dir).filter(X.keyword_match(F.col("title"), F.col("summary"))).select("pos", "source")


WHITELIST = ["src1", "src3", "src5", "src8"]


@query("limit_then_whitelist", f"""
WITH {ARTICLES} SELECT lang, pos, source FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY pos) AS rn FROM articles)
WHERE rn <= 100 AND source IN ('src1', 'src3', 'src5', 'src8')""")
def limit_then_whitelist(spark, sf_dir):
    return A.limit_then_whitelist(
        articles(spark, sf_dir), "lang", ["pos"], "source", allowed=WHITELIST
    ).select("lang", "pos", "source")


FEED_URL = "CASE page_id % 4 WHEN 0 THEN 'https://feeds.reuters.com/' WHEN 1 THEN 'https://rss.nytimes.com/' " \
           "WHEN 2 THEN 'https://feeds.bloomberg.com/' ELSE '' END || url"


@query("feed_source_label", f"""
SELECT page_id, {sql_first('feed', C.FEED_SOURCES, C.UNKNOWN_SOURCE)} AS source
FROM (SELECT page_id, {FEED_URL} AS feed FROM pages)""")
def feed_source_label(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr(FEED_URL).alias("feed"))
    return pages.select("page_id", X.feed_source(F.col("feed")).alias("source"))


@query("unified_articles", f"""
WITH {ARTICLES} SELECT sha256(source || chr(31) || title) AS id, title, substring(summary, 1, 500) AS summary,
  source AS url, 0 AS n_tickers, pos FROM articles WHERE title <> ''""")
def unified_articles(spark, sf_dir):
    raw = articles(spark, sf_dir).select(
        "title", F.substring("summary", 1, C.DESCRIPTION_CHARS).alias("description"),
        F.col("source").alias("url"), F.lit(None).cast("timestamp").alias("published_at"), "source",
        F.array().cast("array<string>").alias("tickers"), "pos",
    )
    return A.unify(raw).select("id", "title", "summary", "url", F.size("tickers").alias("n_tickers"), "pos")


@query("truncated_texts", f"""
WITH {ARTICLES} SELECT pos, length(substring(summary, 1, 500)) AS n500, length(substring(summary, 1, 600)) AS n600,
  substring(summary, 1, 400) AS s400,
  CASE WHEN length(title) > 50 THEN substring(title, 1, 50) || '...' ELSE title END AS label FROM articles""")
def truncated_texts(spark, sf_dir):
    return articles(spark, sf_dir).select(
        "pos",
        F.length(F.substring("summary", 1, C.DESCRIPTION_CHARS)).cast("bigint").alias("n500"),
        F.length(F.substring("summary", 1, C.BODY_CHARS)).cast("bigint").alias("n600"),
        F.substring("summary", 1, C.MATERIAL_SUMMARY_CHARS).alias("s400"),
        X.short_label(F.col("title")).alias("label"),
    )


@query("drop_empty_titles", f"""
WITH {ARTICLES} SELECT source, count(*) AS n FROM
  (SELECT source, CASE WHEN pos % 7 = 0 THEN '' WHEN pos % 11 = 0 THEN NULL ELSE title END AS title FROM articles)
WHERE coalesce(title, '') <> '' GROUP BY source""")
def drop_empty_titles(spark, sf_dir):
    df = articles(spark, sf_dir).withColumn(
        "title",
        F.when(F.col("pos") % 7 == 0, "").when(F.col("pos") % 11 == 0, None).otherwise(F.col("title")),
    )
    return df.filter(X.text_or_empty(F.col("title")) != "").groupBy("source").agg(F.count("*").alias("n"))


@query("body_column_choice", f"""
WITH {ARTICLES} SELECT pos, sha256(repeat(coalesce(title, '') || ' ', 10) || substring(coalesce(summary, ''), 1, 600))
  AS text_hash FROM articles""")
def body_column_choice(spark, sf_dir):
    from newsloom.operators.vectors import weighted_documents
    docs = weighted_documents(articles(spark, sf_dir), "pos")
    return docs.select(F.col("id").alias("pos"), F.sha2(X.weighted_text(F.col("title"), F.col("body")), 256).alias("text_hash"))


@query("drop_noise", f"""
WITH {CLUSTERED} SELECT pos, cluster_id FROM (
  SELECT pos, CASE WHEN pos % 13 = 0 THEN NULL ELSE cluster_id END AS cluster_id FROM clustered)
WHERE coalesce(cluster_id, -1) >= 0""")
def drop_noise(spark, sf_dir):
    from newsloom.operators.clusters import drop_noise as op
    df = clustered(spark, sf_dir).withColumn("cluster_id", F.when(F.col("pos") % 13 != 0, F.col("cluster_id")))
    return op(df).select("pos", "cluster_id")


# Korean rule words do not occur in the given prose, so a phrase is appended by document number.
PHRASES = C.BANNED_PHRASES + [w for _, words in C.REASON_SIGNATURES for w in words] + ["일반 문장", "변동성 확대"]
NOTE_SQL = f"summary || ' ' || list_extract({sql_list(PHRASES)}, CAST(pos % {len(PHRASES)} AS INTEGER) + 1)"


def noted(spark, sf_dir):
    phrase = F.element_at(F.array([F.lit(p) for p in PHRASES]), (F.col("pos") % len(PHRASES)).cast("int") + 1)
    return articles(spark, sf_dir).withColumn("note", F.concat("summary", F.lit(" "), phrase))


@query("banned_phrases", f"""
WITH {ARTICLES} SELECT pos, array_to_string(list_filter({sql_list(C.BANNED_PHRASES)},
  lambda p: contains({NOTE_SQL}, p)), '|') AS banned FROM articles""")
def banned_phrases(spark, sf_dir):
    return noted(spark, sf_dir).select("pos", F.array_join(find_banned(F.col("note")), "|").alias("banned"))


SECTOR_NAMES = C.SECTORS + ["NVDA", "테슬라", " 보험 "]
SECTOR_SQL = f"list_extract({sql_list(SECTOR_NAMES)}, CAST(pos % {len(SECTOR_NAMES)} AS INTEGER) + 1)"


@query("sector_membership", f"""
WITH {ARTICLES} SELECT pos, trim({SECTOR_SQL}) AS sector FROM articles
WHERE trim({SECTOR_SQL}) IN (SELECT unnest({sql_list(C.SECTORS)}))""")
def sector_membership(spark, sf_dir):
    name = F.element_at(F.array([F.lit(s) for s in SECTOR_NAMES]), (F.col("pos") % len(SECTOR_NAMES)).cast("int") + 1)
    return articles(spark, sf_dir).select("pos", X.strip(name).alias("sector")).filter(F.col("sector").isin(C.SECTORS))


OWNERS_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN {sql_any('note', words)} THEN {sql_text(s)} END" for s, words in C.REASON_SIGNATURES
) + "], lambda o: o IS NOT NULL)"


@query("reason_owner", f"""
WITH {ARTICLES}, noted AS (SELECT pos, {NOTE_SQL} AS note, trim({SECTOR_SQL}) AS sector FROM articles),
owned AS (SELECT *, {OWNERS_SQL} AS owners FROM noted)
SELECT pos, array_to_string(owners, '|') AS owners,
  CASE WHEN len(owners) > 0 AND NOT list_contains(owners, sector) THEN owners[1] END AS better FROM owned""")
def reason_owner(spark, sf_dir):
    name = F.element_at(F.array([F.lit(s) for s in SECTOR_NAMES]), (F.col("pos") % len(SECTOR_NAMES)).cast("int") + 1)
    return noted(spark, sf_dir).select(
        "pos",
        F.array_join(reason_owners(F.col("note")), "|").alias("owners"),
        wrong_owner(X.strip(name), F.col("note")).alias("better"),
    )


@query("hangul_cover_default", f"""
WITH {ARTICLES}, c AS (SELECT pos, CASE WHEN pos % 3 = 0 THEN title || ' 금리' ELSE title END AS hook,
  CASE WHEN pos % 5 = 0 THEN '요약 ' || title ELSE title END AS line FROM articles)
SELECT pos, CASE WHEN regexp_matches(hook, '[가-힣]') THEN hook ELSE {sql_text(C.DEFAULT_HOOK)} END AS hook_title,
  CASE WHEN regexp_matches(line, '[가-힣]') THEN line ELSE {sql_text(C.DEFAULT_ONE_LINE)} END AS one_line,
  CAST(NOT regexp_matches(hook, '[가-힣]') AS BIGINT) + CAST(NOT regexp_matches(line, '[가-힣]') AS BIGINT) AS n_issues
FROM c""")
def hangul_cover_default(spark, sf_dir):
    from newsloom.functions.records import cover_texts
    title, pos = F.col("title"), F.col("pos")
    df = articles(spark, sf_dir).select(
        "pos",
        F.when(pos % 3 == 0, F.concat(title, F.lit(" 금리"))).otherwise(title).alias("hook_title"),
        F.when(pos % 5 == 0, F.concat(F.lit("요약 "), title)).otherwise(title).alias("one_line"),
    )
    return cover_texts(df).select(
        "pos", "hook_title", "one_line", F.size("cover_issues").cast("bigint").alias("n_issues")
    )


OUTLET_NAMES = ["Reuters: " , "CNBC - ", "via Bloomberg ", "blog ", "WSJ/", "The FT, ", "NYT ", "MarketWatch: "]
SOURCES_SQL = "[" + ", ".join(
    f"list_extract({sql_list(OUTLET_NAMES)}, CAST((pos + {k * k}) % {len(OUTLET_NAMES)} AS INTEGER) + 1) || "
    + ("source" if k else "title") for k in range(5)
) + "]"


@query("clean_source_list", f"""
WITH {ARTICLES}, s AS (SELECT pos, {SOURCES_SQL} AS sources FROM articles),
f AS (SELECT pos, list_filter(list_transform(sources, lambda t: {sql_first('lower(t)', C.OUTLETS, None)}),
  lambda o: o IS NOT NULL) AS found FROM s),
d AS (SELECT pos, list_filter(found, lambda o, i: list_position(found, o) = i)[1:3] AS names FROM f)
SELECT pos, CASE WHEN len(names) = 0 THEN 'Reuters' ELSE array_to_string(names, '|') END AS outlets FROM d""")
def clean_source_list(spark, sf_dir):
    names = F.array([F.lit(o) for o in OUTLET_NAMES])
    sources = F.array([
        F.concat(F.element_at(names, ((F.col("pos") + k * k) % len(OUTLET_NAMES)).cast("int") + 1),
                 F.col("source" if k else "title"))
        for k in range(5)
    ])
    return articles(spark, sf_dir).select("pos", F.array_join(clean_sources(sources), "|").alias("outlets"))


@query("topic_detection", f"""
WITH {ARTICLES} SELECT pos, {topic_sql('low')} AS topic FROM (SELECT pos, lower(summary) AS low FROM articles)""")
def topic_detection(spark, sf_dir):
    return articles(spark, sf_dir).select("pos", X.detect_topic(F.col("summary")).alias("topic"))


@query("cover_dictionary", f"""
WITH {ARTICLES} SELECT pos, {sql_first('lower(summary)', C.COVER_PHRASES, C.DEFAULT_COVER)} AS phrase FROM articles""")
def cover_dictionary(spark, sf_dir):
    return articles(spark, sf_dir).select("pos", X.cover_phrase(F.col("summary")).alias("phrase"))


@query("url_platform", f"""
SELECT platform, count(*) AS n FROM (SELECT {sql_first('post_url', [("instagram.com", "instagram"),
  ("youtube.com", "youtube"), ("youtu.be", "youtube")], "unsupported")} AS platform FROM
  (SELECT CASE page_id % 4 WHEN 0 THEN 'https://www.instagram.com/p/' || page_id
   WHEN 1 THEN 'https://youtu.be/' || page_id WHEN 2 THEN 'https://www.youtube.com/shorts/' || page_id
   ELSE url END AS post_url FROM pages)) GROUP BY platform""")
def url_platform(spark, sf_dir):
    return (
        post_urls(spark, sf_dir).groupBy(X.platform_of(F.col("post_url")).alias("platform"))
        .agg(F.count("*").alias("n"))
    )


def post_urls(spark, sf_dir):
    page = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(page % 4 == 0, F.concat(F.lit("https://www.instagram.com/p/"), page.cast("string")))
        .when(page % 4 == 1, F.concat(F.lit("https://youtu.be/"), page.cast("string")))
        .when(page % 4 == 2, F.concat(F.lit("https://www.youtube.com/shorts/"), page.cast("string")))
        .otherwise(F.col("url")).alias("post_url"),
    )


@query("post_slug", r"""
WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://www.instagram.com/p/' || page_id
   WHEN 1 THEN 'https://youtu.be/' || page_id WHEN 2 THEN 'https://www.youtube.com/shorts/' || page_id
   ELSE url END AS u FROM pages),
q AS (SELECT page_id, u, regexp_extract(u,
  '(?:instagram\.com/(?:p|reel)/|youtube\.com/(?:shorts/|watch\?v=)|youtu\.be/)([\w-]+)', 1) AS post_id FROM p)
SELECT page_id, CASE WHEN contains(u, 'instagram.com') THEN 'ig_' ELSE 'yt_' END ||
  CASE WHEN post_id <> '' THEN post_id ELSE right(regexp_replace(u, '[^\p{L}\p{N}_]+', '_', 'g'), 30) END AS slug FROM q""")
def post_slug(spark, sf_dir):
    return post_urls(spark, sf_dir).select("page_id", X.post_slug(F.col("post_url")).alias("slug"))


@query("token_sets", f"""
WITH {ARTICLES} SELECT pos, CAST(len({TOKENS_SQL.format('summary')}) AS BIGINT) AS n_tokens,
  array_to_string(list_sort({TOKENS_SQL.format('title')}), ' ') AS title_tokens FROM articles""")
def token_sets(spark, sf_dir):
    return articles(spark, sf_dir).select(
        "pos",
        F.size(X.tokens(F.col("summary"))).cast("bigint").alias("n_tokens"),
        F.array_join(F.array_sort(X.tokens(F.col("title"))), " ").alias("title_tokens"),
    )


JACCARD_SQL = (
    "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({0}, {1})) AS DOUBLE)"
    " / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) END"
)


@query("token_jaccard", f"""
WITH t AS (SELECT c.conv_id, c.turn, {TOKENS_SQL.format('c.text')} AS a, {TOKENS_SQL.format('n.text')} AS b
  FROM conversations c JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1)
SELECT conv_id, turn, {JACCARD_SQL.format('a', 'b')} AS similarity,
  CAST({JACCARD_SQL.format('a', 'b')} >= 0.6 AS BIGINT) AS duplicate FROM t""")
def token_jaccard(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.tokens(F.col("text")).alias("a"))
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    score = X.token_jaccard(F.col("a"), F.col("b"))
    return turns.join(following, ["conv_id", "turn"]).select(
        "conv_id", "turn", score.alias("similarity"), (score >= C.DUPLICATE_JACCARD).cast("bigint").alias("duplicate")
    )


@query("cache_keys", f"""
WITH {ARTICLES} SELECT pos, substring(sha256('{C.CACHE_MODEL}' || chr(31) || '{C.CACHE_VERSION}' || chr(31) || summary), 1, 32)
  AS cache_key FROM articles""")
def cache_keys(spark, sf_dir):
    return articles(spark, sf_dir).select(
        "pos", X.content_key(F.lit(C.CACHE_MODEL), F.lit(C.CACHE_VERSION), F.col("summary")).alias("cache_key")
    )


@query("number_mentions", f"""
WITH {ARTICLES}, m AS (SELECT pos, unnest(regexp_extract_all(summary, '({C.NUMBER_PATTERN})', 1)) AS mention FROM articles)
SELECT pos, rtrim(mention, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS mention, count(*) AS n
FROM m GROUP BY ALL""")
def number_mentions(spark, sf_dir):
    return (
        articles(spark, sf_dir)
        .select("pos", F.explode(X.number_mentions(F.col("summary"))).alias("mention"))
        .groupBy("pos", "mention").agg(F.count("*").alias("n"))
    )


@query("basic_string_functions", f"""
WITH {ARTICLES} SELECT pos, lower(source) AS low, trim(replace(substring(summary, 1, 30), chr(10), ' ')) AS flat,
  concat_ws(' ', lang, source) AS joined, CAST(contains(lower(summary), 'oil') AS BIGINT) AS has_oil FROM articles""")
def basic_string_functions(spark, sf_dir):
    head = F.replace(F.substring("summary", 1, 30), F.lit("\n"), F.lit(" "))
    return articles(spark, sf_dir).select(
        "pos", F.lower("source").alias("low"), F.trim(head).alias("flat"),
        F.array_join(F.array("lang", "source"), " ").alias("joined"),
        F.contains(F.lower("summary"), F.lit("oil")).cast("bigint").alias("has_oil"),
    )


@query("whole_word_ai", f"""
WITH {ARTICLES} SELECT pos FROM articles
WHERE regexp_matches(lower(summary), '(^|[^\\p{{L}}\\p{{N}}_])ai([^\\p{{L}}\\p{{N}}_]|$)')""")
def whole_word_ai(spark, sf_dir):
    return articles(spark, sf_dir).filter(X.has_word(F.lower("summary"), C.AI_WORD)).select("pos")


@query("epoch_to_iso", """
SELECT event_id, strftime(to_timestamp(CAST(floor(epoch(ts)) AS BIGINT)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS iso
FROM events""")
def epoch_to_iso(spark, sf_dir):
    seconds = F.floor(F.col("ts").cast("timestamp").cast("double"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss").alias("iso")
    )


@query("weighted_text", f"""
WITH {ARTICLES} SELECT pos, CAST(length(repeat(title || ' ', 10) || substring(summary, 1, 600)) AS BIGINT) AS n,
  sha256(repeat(title || ' ', 10) || substring(summary, 1, 600)) AS h FROM articles""")
def weighted_text(spark, sf_dir):
    text = X.weighted_text(F.col("title"), F.col("summary"))
    return articles(spark, sf_dir).select("pos", F.length(text).cast("bigint").alias("n"), F.sha2(text, 256).alias("h"))
