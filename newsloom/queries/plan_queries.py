"""Queries for whole jobs: script generation, cache, discovery, covers, collection, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import constants as C
from newsloom import schemas
from newsloom.functions.text import content_key
from newsloom.operators import cache as K
from newsloom.plans import collect, covers, discovery, scripts as S
from newsloom.queries.cluster_queries import CHATS, KEYWORD_SQL, chats
from newsloom.queries.rank_queries import (
    POSTS, VIDEOS, hits, posts, score_sql, TAGS, videos,
)
from newsloom.queries.record_queries import (
    CHECKED, PAIR, PAIRS_SQL, VALIDATED, _pairs_text, checked_sql, corrected_sql, drafts, trends,
)
from newsloom.queries.registry import ARTICLES, articles, query, sql_first, sql_list, sql_text
from newsloom.queries.text_queries import topic_sql
from newsloom.session import scratch_path, table
from newsloom.sources import landed as L
from newsloom.streaming import incremental


def _pairs_sql(pairs):
    return "[" + ", ".join(f"{{'name': {sql_text(n)}, 'reason': {sql_text(r)}}}" for n, r in pairs) + f"]::{PAIR}[]"


CURATED, GENERIC = C.CURATED_SCRIPTS["6"], C.GENERIC_SCRIPT


def _either(field, sql=sql_text):
    return f"CASE WHEN issue_id = '6' THEN {sql(CURATED[field])} ELSE {sql(GENERIC[field])} END"


GENERATED = f"""{VALIDATED}, {CHATS}, {CHECKED},
requests AS (SELECT CAST(cluster_id AS VARCHAR) AS issue_id, cluster_id, arg_min(cluster_label, pos) AS label FROM chats GROUP BY cluster_id),
cached AS (SELECT issue_id, label FROM requests WHERE cluster_id % 5 = 0 AND cluster_id % 10 <> 0),
open AS (SELECT * FROM requests WHERE issue_id NOT IN (SELECT issue_id FROM cached)),
good AS (SELECT o.issue_id, label, hook_title, one_line, fixed3.kept AS gain_list, fixed4.kept AS lose_list, 'CNBC' AS sources, false AS from_fallback
  FROM open o JOIN validated v ON v.issue_id = o.issue_id AND v.pos % 4 <> 3 WHERE viable),
fallback AS (SELECT issue_id, label, {_either('hook_title')} AS hook_title, {_either('one_line')} AS one_line,
  {_either('slide3_sectors', _pairs_sql)} AS gain_list, {_either('slide4_sectors', _pairs_sql)} AS lose_list, 'Reuters' AS sources, true AS from_fallback
  FROM open WHERE issue_id NOT IN (SELECT issue_id FROM good)),
chosen AS (SELECT * REPLACE (CASE WHEN regexp_matches(hook_title, '[가-힣]') THEN hook_title ELSE {sql_text(C.DEFAULT_HOOK)} END AS hook_title,
  CASE WHEN regexp_matches(one_line, '[가-힣]') THEN one_line ELSE {sql_text(C.DEFAULT_ONE_LINE)} END AS one_line)
  FROM (SELECT * FROM good UNION ALL SELECT * FROM fallback)),
macro AS (SELECT *, label || ' ' || replace(hook_title, chr(10), ' ') || ' ' || one_line AS macro,
  list_transform(gain_list, lambda s: s.name) AS gain_names, list_transform(lose_list, lambda s: s.name) AS lose_names FROM chosen),
{checked_sql('macro', 'macro', 'gain_names', 'lose_names')}"""


def _cached_scripts(requests):
    """Finished scripts for every fifth cluster, every second of them a stored fallback."""
    number = F.col("issue_id").cast("int")
    empty = requests.sparkSession.createDataFrame([], schemas.SCRIPT)
    fields = {f.name: F.lit(None).cast(f.dataType) for f in empty.schema}
    fields.update(
        issue_id=F.col("issue_id"), hook_title=F.concat(F.lit("cached "), "cluster_label"), one_line=F.lit(""),
        from_fallback=number % 10 == 0, from_cache=F.lit(False), extra_disclaimer=F.lit(""),
    )
    return requests.filter(number % 5 == 0).select("key", *[c.alias(n) for n, c in fields.items()])


@query("script_generation", f"""
WITH {GENERATED} SELECT issue_id, hook_title, one_line, sources, from_fallback::BIGINT AS from_fallback, 0::BIGINT AS from_cache, status,
  {PAIRS_SQL.format(corrected_sql('correct_pos', 'gain_list'))} AS gain, {PAIRS_SQL.format(corrected_sql('correct_neg', 'lose_list'))} AS lose,
  CASE WHEN status = 'warning' THEN {sql_text(C.MARKET_DISCLAIMER)} ELSE '' END AS disclaimer FROM checked
UNION ALL SELECT issue_id, 'cached ' || label, '', '', 0, 1, NULL, '', '', '' FROM cached""")
def script_generation(spark, sf_dir):
    clusters = chats(spark, sf_dir)
    generated = drafts(spark, sf_dir).filter("pos % 4 <> 3").drop("pos")
    done = S.generate_scripts(clusters, generated, _cached_scripts(S.requests(clusters)), trends(spark, sf_dir))
    return done.select(
        "issue_id", "hook_title", "one_line", F.coalesce(F.array_join("sources", "|"), F.lit("")).alias("sources"),
        F.col("from_fallback").cast("bigint").alias("from_fallback"), F.col("from_cache").cast("bigint").alias("from_cache"),
        F.col("fact_check.status").alias("status"),
        F.coalesce(_pairs_text(F.col("inner.slide3_sectors")), F.lit("")).alias("gain"),
        F.coalesce(_pairs_text(F.col("inner.slide4_sectors")), F.lit("")).alias("lose"),
        F.col("extra_disclaimer").alias("disclaimer"),
    )


@query("fallback_choice", f"""
WITH {CHATS}, r AS (SELECT CAST(cluster_id AS VARCHAR) AS issue_id, array_to_string(list_sort(list(DISTINCT source))[1:3], '|') AS names FROM chats GROUP BY 1)
SELECT issue_id, {_either('hook_title')} AS hook_title, CASE WHEN issue_id = '6' THEN 'Reuters' ELSE names END AS sources,
  {sql_text(C.SOURCE_PREFIX + 'Reuters')} AS slide2_source FROM r""")
def fallback_choice(spark, sf_dir):
    return S.pick_fallback(S.requests(chats(spark, sf_dir))).select(
        "issue_id", "hook_title", F.array_join("sources", "|").alias("sources"), "slide2_source"
    )


def _keyed(spark, sf_dir):
    return articles(spark, sf_dir).select(
        "pos", content_key(F.lit("m"), F.lit("v"), F.concat("summary", F.col("pos").cast("string"))).alias("key")
    )


@query("cache_lookup", f"""
WITH {ARTICLES} SELECT pos, CAST(pos % 3 = 0 AND pos % 6 <> 0 AS BIGINT) AS from_cache, CASE WHEN pos % 3 = 0 AND pos % 6 <> 0 THEN pos END AS value FROM articles""")
def cache_lookup(spark, sf_dir):
    asked = _keyed(spark, sf_dir)
    stored = asked.filter("pos % 3 = 0").select("key", (F.col("pos") % 6 == 0).alias("from_fallback"), F.col("pos").alias("value"))
    found = K.lookup(asked, stored)
    return found.select("pos", F.col("from_cache").cast("bigint").alias("from_cache"), "value")


@query("cache_upsert", f"""
WITH {ARTICLES} SELECT pos, CASE WHEN pos % 4 = 0 AND pos % 8 <> 0 THEN 'new' ELSE 'old' END AS value FROM articles
WHERE (pos % 4 = 0 AND pos % 8 <> 0) OR (pos % 3 = 0 AND pos % 6 <> 0)""")
def cache_upsert(spark, sf_dir):
    keyed = _keyed(spark, sf_dir)
    path, schema = scratch_path(spark, "cache"), "key string, pos bigint, from_fallback boolean, value string"

    def part(n, value):
        rows = keyed.filter(F.col("pos") % n == 0).select(
            "key", "pos", (F.col("pos") % (2 * n) == 0).alias("from_fallback"), F.lit(value).alias("value")
        )
        return rows.unionByName(rows)  # a key twice in one run is one entry

    K.store(spark, path, schema, part(3, "old"))
    K.store(spark, path, schema, part(4, "new"))
    return K.current_cache(spark, path, schema).select("pos", "value")


DISCOVERED = f"""{POSTS}, {VIDEOS},
newest_p AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY pos) AS age FROM posts WHERE account NOT LIKE '%77'),
kp AS (SELECT *, CASE WHEN followers > 0 THEN (coalesce(likes, 0) + comments)::DOUBLE / followers ELSE (coalesce(likes, 0) + comments)::DOUBLE END AS rank_key FROM newest_p WHERE age <= 50),
bp AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY rank_key DESC, pos) AS rn FROM kp),
newest_v AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY pos) AS age FROM videos),
kv AS (SELECT *, CASE WHEN subscribers > 0 THEN view_count::DOUBLE / subscribers ELSE view_count::DOUBLE END AS rank_key FROM newest_v WHERE age <= 50),
bv AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY rank_key DESC, pos) AS rn FROM kv),
candidates AS (SELECT 'https://www.instagram.com/p/' || pos || '/' AS url, 'instagram' AS platform, account FROM bp WHERE rn <= 5
  UNION ALL SELECT '{C.VIDEO_URL_PREFIX}' || pos, 'youtube', CAST(account AS VARCHAR) FROM bv WHERE rn <= 5)"""


def _discovered(spark, sf_dir, accounts=None):
    lines = table(spark, sf_dir, "customer").select(F.concat(F.lit("ig:@"), "c_name").alias("value")).unionByName(
        table(spark, sf_dir, "supplier").select(F.concat(F.lit("yt:"), F.col("s_suppkey").cast("string")).alias("value"))
    )
    path = scratch_path(spark, "accounts")
    lines.write.text(path)
    accounts = L.read_accounts(spark, path)[0] if accounts is None else accounts
    shown = videos(spark, sf_dir).withColumn("account", F.col("account").cast("string"))
    known = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(
        F.concat(F.lit("https://www.instagram.com/p/"), F.col("o_orderkey").cast("string"), F.lit("/")).alias("url")
    )
    listed = posts(spark, sf_dir).filter("account NOT LIKE '%77'")  # these accounts have failed
    return discovery.discover(accounts, listed, shown, known)


@query("discovery", f"""
WITH {DISCOVERED}, known AS (SELECT 'https://www.instagram.com/p/' || o_orderkey || '/' AS url FROM orders WHERE o_orderkey % 3 = 0)
SELECT url, platform, account, CAST(url NOT IN (SELECT url FROM known) AS BIGINT) AS is_new FROM candidates""")
def discover(spark, sf_dir):
    candidates, fresh, _ = _discovered(spark, sf_dir)
    return candidates.join(fresh.select("url", F.lit(1).alias("is_new")), "url", "left").select(
        "url", "platform", "account", F.coalesce("is_new", F.lit(0)).cast("bigint").alias("is_new")
    )


@query("appended_urls", f"""
WITH {DISCOVERED}, ordered AS (SELECT 'https://www.instagram.com/p/' || bp.pos || '/' AS url, 0 AS kind, account, -rank_key AS k, pos FROM bp WHERE rn <= 5
  UNION ALL SELECT '{C.VIDEO_URL_PREFIX}' || pos, 1, lpad(CAST(account AS VARCHAR), 12, '0'), -rank_key, pos FROM bv WHERE rn <= 5),
firsts AS (SELECT url, min([kind::VARCHAR, account]) AS a, arg_min(k, [kind::VARCHAR, account]) AS k, arg_min(pos, [kind::VARCHAR, account]) AS pos FROM ordered
  WHERE url NOT IN (SELECT 'https://www.instagram.com/p/' || o_orderkey || '/' FROM orders WHERE o_orderkey % 3 = 0) GROUP BY url)
SELECT url, row_number() OVER (ORDER BY a, k, pos) AS place FROM firsts""")
def appended_urls(spark, sf_dir):
    """The list of addresses as it is after a run, with the line numbers of its file."""
    lines = table(spark, sf_dir, "customer").select(F.col("c_name").alias("k"), F.concat(F.lit("ig:@"), "c_name").alias("value")).unionByName(
        table(spark, sf_dir, "supplier").select(F.format_string("z%012d", "s_suppkey").alias("k"), F.concat(F.lit("yt:"), F.col("s_suppkey").cast("string")).alias("value"))
    )
    accounts, urls = scratch_path(spark, "accounts"), scratch_path(spark, "urls")
    lines.orderBy("k").select("value").write.text(accounts)
    fresh = _discovered(spark, sf_dir, L.read_accounts(spark, accounts)[0])[1]
    L.append_urls(fresh, urls)
    return L.numbered_lines(spark, urls).select(F.col("value").alias("url"), (F.col("line") + 1).alias("place"))


@query("discovery_failures", """
SELECT 'ig:' || c_name AS account, 'no landed listing' AS error FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) OR c_name LIKE '%77'
UNION ALL SELECT 'yt:' || s_suppkey, 'no landed listing' FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)""")
def discovery_failures(spark, sf_dir):
    return _discovered(spark, sf_dir)[2]


PHRASES = [p for _, p in C.COVER_PHRASES] + [p for _, p in C.TOPIC_COVERS] + [C.DEFAULT_COVER]
PHRASE_SQL = f"list_extract({sql_list(PHRASES)}, CAST(p_partkey % {len(PHRASES)} AS INTEGER) + 1)"


@query("script_covers", f"""
WITH {ARTICLES}, asked AS (SELECT CAST(pos AS VARCHAR) AS issue_id, CASE {" ".join(f"WHEN topic = '{t}' THEN '{p}'" for t, p in C.TOPIC_COVERS)}
  ELSE {sql_first("lower(title || ' ' || source || ' ' || summary)", C.COVER_PHRASES, C.DEFAULT_COVER)} END AS query
  FROM (SELECT *, {topic_sql("lower(title || ' ' || source)")} AS topic FROM articles)),
hits AS (SELECT p_partkey AS pos, p_partkey AS id, {TAGS} || ' ' || split_part({PHRASE_SQL}, ' ', 1) AS tags, p_size * 40 AS width,
  (p_partkey % 60) * 40 AS height, CAST(p_retailprice * 60 AS BIGINT) AS downloads, {PHRASE_SQL} AS query FROM part),
s AS (SELECT query, id, {score_sql('query')} AS score, pos FROM hits),
best AS (SELECT query, id, score, 'https://pictures.example/' || pos AS address FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, pos) AS rn FROM s) WHERE rn = 1 AND score > -50)
SELECT issue_id, query, id, round(score, 6) AS score, address FROM asked LEFT JOIN best USING (query)""")
def script_covers(spark, sf_dir):
    asked = articles(spark, sf_dir).select(
        F.col("pos").cast("string").alias("issue_id"), F.lit(None).cast("string").alias("topic"),
        F.col("title").alias("hook_title"), F.col("source").alias("one_line"), F.col("summary").alias("image_keyword"),
    )
    phrase = F.element_at(F.array([F.lit(p) for p in PHRASES]), (F.col("pos") % len(PHRASES)).cast("int") + 1)
    address = F.concat(F.lit("https://pictures.example/"), F.col("pos").cast("string"))
    found = hits(spark, sf_dir).withColumns({"query": phrase, "id": F.col("pos"), "largeImageURL": address}).withColumn(
        "tags", F.concat("tags", F.lit(" "), F.split_part("query", F.lit(" "), F.lit(1)))
    )
    chosen = covers.script_covers(asked, found.filter("pos % 2 = 0"), found)
    return chosen.select("issue_id", "query", "id", F.round("score", 6).alias("score"), F.col("largeImageURL").alias("address"))


NOW = "2024-01-02 12:00:00"


def _raw(spark, sf_dir):
    """Documents as raw entries, one a minute; every eleventh is undated."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("pos") * 60)
    return articles(spark, sf_dir).select(
        "pos", "title", F.col("summary").alias("description"), F.lower("title").alias("url"),
        F.when(F.col("pos") % 11 != 0, at).alias("published_at"), "source", F.col("lang").alias("category"),
        F.array().cast("array<string>").alias("tickers"),
    )


def _files(rows):
    """Files to land, at least three: as many as the tasks of the scan, so none grows with the table."""
    return max(3, rows.rdd.getNumPartitions())


FEED_SQL = f"""
fresh AS (SELECT * FROM (SELECT *, CASE WHEN pos % 11 <> 0 THEN TIMESTAMP '2024-01-01' + to_seconds(pos * 60) END AS published FROM articles)
  WHERE published IS NULL OR published >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR),
feed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY pos) AS rn FROM fresh WHERE {KEYWORD_SQL}) WHERE rn = 1)"""


@query("feed_collection", f"""
WITH {ARTICLES}, {FEED_SQL} SELECT pos, source, CAST(least(length(summary), 500) AS BIGINT) AS n_chars FROM feed""")
def feed_collection(spark, sf_dir):
    rows = collect.feed_articles(_raw(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    return rows.select("pos", "source", F.length("description").cast("bigint").alias("n_chars"))


@query("collect_and_merge")
def collect_and_merge(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    feed = collect.feed_articles(raw.filter("pos % 2 = 0"), F.lit(NOW).cast("timestamp"))
    api = collect.api_articles(raw.filter("pos % 2 = 1"), [f"src{i}" for i in range(10)])
    return collect.merge_feeds(feed, api).select("id", "title", "url", "source")


@query("incremental_collection", f"""
WITH {ARTICLES} SELECT DISTINCT lower(title) AS url FROM articles WHERE {KEYWORD_SQL}
  AND (pos % 11 = 0 OR TIMESTAMP '2024-01-01' + to_seconds(pos * 60) >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR)""")
def incremental_collection(spark, sf_dir):
    """Several batches, undated rows in each of them."""
    landed, out, state = (scratch_path(spark, n) for n in ("landed", "stream", "state"))
    rows = _raw(spark, sf_dir).withColumnRenamed("description", "summary")
    files = _files(rows)
    rows.repartition(files, "pos").write.parquet(landed)
    stream = incremental.article_stream(
        spark, landed, "title string, summary string, url string, published_at timestamp, source string", files_per_batch=-(-files // 3)
    )
    (
        incremental.new_articles(stream, F.lit(NOW).cast("timestamp")).select("url").writeStream.format("parquet")
        .option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.schema("url string").parquet(out)


@query("stream_keeps_first", f"""
WITH {ARTICLES}, fresh AS (SELECT *, lower(title) AS url, row_number() OVER (PARTITION BY lower(title) ORDER BY pos % 2, pos) AS n FROM articles WHERE {KEYWORD_SQL}
  AND (pos % 11 = 0 OR TIMESTAMP '2024-01-01' + to_seconds(pos * 60) >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR))
SELECT url, CAST(pos % 2 AS INTEGER) AS feed_rank, pos FROM fresh WHERE n = 1""")
def stream_keeps_first(spark, sf_dir):
    """Files of rows in no order; of equal addresses the stream gives the one that the batch job keeps."""
    landed, out, state = (scratch_path(spark, n) for n in ("landed", "stream", "state"))
    at = F.lit(NOW).cast("timestamp")
    rows = _raw(spark, sf_dir).select(
        "url", "title", F.col("description").alias("summary"), "source", "published_at",
        (F.col("pos") % 2).cast("int").alias("feed_rank"), "pos", at.alias("landed_at"),
    )
    files = _files(rows)
    rows.repartition(files, F.xxhash64("pos")).write.parquet(landed)
    end = rows.limit(1).withColumns({"landed_at": at + F.expr("interval 48 hours"), "published_at": at, "title": F.lit(C.MACRO_KEYWORDS[0]), "url": F.lit("\0end")})
    end.write.mode("append").parquet(landed)  # time goes on, which ends the windows
    stream = incremental.article_stream(spark, landed, incremental.FIRST, files_per_batch=-(-(files + 1) // 2))
    (
        incremental.first_articles(stream, at).select("url", "feed_rank", "pos").writeStream.format("parquet")
        .option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.schema("url string, feed_rank int, pos bigint").parquet(out)


@query("cache_upkeep_stream", f"""
WITH {ARTICLES} SELECT pos, 'script' AS value FROM articles WHERE pos % 3 <> 0""")
def cache_upkeep_stream(spark, sf_dir):
    landed, path, state = (scratch_path(spark, n) for n in ("scripts", "cache", "state"))
    schema = "key string, pos bigint, from_fallback boolean, value string"
    scripts = _keyed(spark, sf_dir).select(
        "key", "pos", (F.col("pos") % 3 == 0).alias("from_fallback"), F.lit("script").alias("value")
    )
    beside = scripts.filter("pos % 3 = 1").withColumns({"from_fallback": F.lit(True), "value": F.lit("fallback")})
    scripts.unionByName(beside).write.parquet(landed)  # a fallback does not displace a success with its key
    stream = incremental.article_stream(spark, landed, schema)
    incremental.keep_cache(stream, path, schema, state).trigger(availableNow=True).start().awaitTermination()
    return K.current_cache(spark, path, schema).select("pos", "value")
