"""Queries that land the given tables as files and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import constants as C
from newsloom import schemas
from newsloom.queries.registry import ARTICLES, articles, query
from newsloom.session import scratch_path, table
from newsloom.sources import landed as L


@query("jsonl_round_trip", f"""
WITH {ARTICLES} SELECT CAST(pos AS VARCHAR) AS id, title, sha256(summary) AS summary_hash, source, CAST(NULL AS VARCHAR) AS url
FROM articles""")
def jsonl_round_trip(spark, sf_dir):
    path = scratch_path(spark, "articles")
    rows = articles(spark, sf_dir).select(
        F.col("pos").cast("string").alias("id"), "title", "summary", F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("timestamp").alias("published_at"), "source", F.array().cast("array<string>").alias("tickers"),
    )
    L.write_jsonl(rows, path)
    return L.read_jsonl(spark, path).select("id", "title", F.sha2("summary", 256).alias("summary_hash"), "source", "url")


@query("script_round_trip", """
SELECT CAST(conv_id AS VARCHAR) AS issue_id, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY 1""")
def script_round_trip(spark, sf_dir):
    path = scratch_path(spark, "scripts")
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("issue_id"), F.col("text").alias("hook_title"), F.lit("").alias("one_line")
    )
    L.write_scripts(rows, path)
    back = L.read_scripts(spark, path)
    return L.select_script(back, None).groupBy("issue_id").agg(F.count("hook_title").alias("n"))


@query("script_by_issue", "SELECT CAST(conv_id AS VARCHAR) AS issue_id, text AS hook_title FROM conversations WHERE CAST(conv_id AS VARCHAR) = '6'")
def script_by_issue(spark, sf_dir):
    path = scratch_path(spark, "scripts")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("issue_id"), F.col("text").alias("hook_title"))
    rows.select(F.to_json(F.array(F.struct("*"))).alias("value")).write.text(path)  # an array on each line
    return L.select_script(L.read_scripts(spark, path), 6).select("issue_id", "hook_title")


@query("feed_scan", """
SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN 'body ' || page_id ELSE 'sum ' || page_id END AS description,
  CASE WHEN page_id % 7 <> 0 AND page_id % 11 <> 0 THEN strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id * 61), '%Y-%m-%d %H:%M:%S') END AS published_at,
  CASE WHEN page_id % 7 <> 0 AND page_id % 11 = 0 THEN 'soon' END AS unread_date
FROM pages""")
def feed_scan(spark, sf_dir):
    path = scratch_path(spark, "feed")
    page = F.col("page_id")
    at = F.timestamp_seconds(F.lit(1704067200) + page * 61)

    def tag(name, value):
        return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))

    number = page.cast("string")
    address = F.replace("url", F.lit("&"), F.lit("&amp;"))
    item = F.concat(
        F.lit("<item>"), tag("title", number),
        F.when(page % 3 == 0, F.concat(F.lit('<link rel="alternate" href="'), address, F.lit('"/>'))).otherwise(tag("link", address)),
        F.when(page % 5 != 0, tag("summary", F.concat(F.lit("sum "), number))).otherwise(""),
        tag("description", F.concat(F.lit("body "), number)),
        F.when(page % 7 == 0, "")
        .when(page % 11 == 0, tag("pubDate", F.lit("soon")))
        .when(page % 4 == 0, tag("pubDate", F.date_format(at, "E, dd MMM yyyy HH:mm:ss 'GMT'")))
        .when(page % 4 == 2, tag("pubDate", F.date_format(at - F.expr("interval 5 hours"), "E, dd MMM yyyy HH:mm:ss 'EST'")))
        .otherwise(F.concat(  # an unreadable date does not hide a good one
            tag("pubDate", F.lit("yesterday")), tag("updated", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        )),
        F.lit("</item>"),
    )
    # one feed document per 200 pages: head, items, foot
    feed = F.floor(page / 200).alias("feed")
    pages = table(spark, sf_dir, "pages")
    items = pages.select(feed, page.alias("at"), item.alias("value"))
    frame = pages.select(feed).distinct().select("feed", F.explode(F.array(
        F.struct(F.lit(-1).cast("bigint").alias("at"), F.lit("<rss><channel>").alias("value")),
        F.struct(F.lit(2**62).cast("bigint").alias("at"), F.lit("</channel></rss>").alias("value")),
    )).alias("line")).select("feed", "line.*")
    (
        items.unionByName(frame).repartition("feed").sortWithinPartitions("feed", "at")
        .select("feed", "value").write.partitionBy("feed").text(path)
    )
    return L.read_feed(spark, path).select(
        F.col("title").cast("bigint").alias("page_id"), "url", "description",
        F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), "unread_date",
    )


@query("news_api_scan", """
SELECT event_id AS n, event_type AS category, 'headline ' || event_id AS title, strftime(CASE WHEN event_id % 9 <> 0 THEN
  date_trunc('second', ts) ELSE TIMESTAMP '1970-01-01' END, '%Y-%m-%d %H:%M:%S') AS published_at FROM events""")
def news_api_scan(spark, sf_dir):
    path = scratch_path(spark, "api")
    event = F.col("event_id")
    article = F.struct(
        F.concat(F.lit("headline "), event.cast("string")).alias("headline"),
        event.cast("string").alias("url"), F.lit("Reuters").alias("source"),
        F.when(event % 9 != 0, F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("datetime"),
    )
    (
        table(spark, sf_dir, "events")
        .select(F.col("event_type").alias("category"), F.to_json(F.array(article)).alias("value"))
        .write.partitionBy("category").text(path)
    )
    return L.read_news_api(spark, path).select(
        F.col("url").cast("bigint").alias("n"), "category", "title",
        F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"),
    )


def _account_lines(spark, sf_dir):
    key, name = F.col("c_custkey"), F.col("c_name")
    line = (
        F.when(key % 6 == 0, F.concat(F.lit("# "), name)).when(key % 6 == 1, F.lit("  "))
        .when(key % 6 == 2, F.concat(F.lit("ig:@"), name))
        .when(key % 6 == 3, F.concat(F.lit("yt:https://www.youtube.com/"), name))
        .when(key % 6 == 4, name).otherwise(F.concat(F.lit("  ig: "), name, F.lit("  ")))
    )
    path = scratch_path(spark, "accounts")
    table(spark, sf_dir, "customer").select(line.alias("value")).write.text(path)
    return path


@query("account_list", """
SELECT CASE WHEN c_custkey % 6 = 3 THEN 'yt' WHEN c_custkey % 6 = 4 THEN 'malformed' ELSE 'ig' END AS platform,
  CASE WHEN c_custkey % 6 = 3 THEN 'https://www.youtube.com/' ELSE '' END || c_name AS account FROM customer WHERE c_custkey % 6 > 1""")
def account_list(spark, sf_dir):
    accounts, malformed = L.read_accounts(spark, _account_lines(spark, sf_dir))
    return accounts.drop("at").unionByName(
        malformed.select(F.lit("malformed").alias("platform"), F.col("line").alias("account"))
    )


@query("url_list", "SELECT url FROM pages WHERE page_id % 3 > 0")
def url_list(spark, sf_dir):
    path = scratch_path(spark, "urls")
    page = F.col("page_id")
    pages = table(spark, sf_dir, "pages").filter(page % 3 > 0).select("url")
    notes = table(spark, sf_dir, "pages").filter(page % 3 == 0).select(
        F.when(page % 2 == 0, F.concat(F.lit("# "), "url")).otherwise("").alias("url")
    )
    pages.unionByName(notes).write.text(path)
    return L.read_urls(spark, path)


def _pattern_file(spark, sf_dir):
    """Parts as patterns: objects with a list, bare lists and broken lines, one per line."""
    key = F.col("p_partkey")
    one = F.struct(
        key.cast("string").alias("id"), F.when(key % 3 == 0, "hook").otherwise("layout").alias("type"),
        F.col("p_name").alias("token"), F.col("p_brand").alias("description"),
        F.when(key % 2 == 0, F.array("p_type")).alias("examples"),
    )
    line = (
        F.when(key % 10 == 9, F.lit('{"patterns": ['))
        .when(key % 2 == 0, F.to_json(F.struct(F.array(one).alias("patterns")))).otherwise(F.to_json(F.array(one)))
    )
    path = scratch_path(spark, "patterns")
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    return path


@query("pattern_scan", """
SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'hook' ELSE 'layout' END AS type, p_name AS token,
  CASE WHEN p_partkey % 2 = 0 THEN p_type END AS example FROM part WHERE p_partkey % 10 <> 9""")
def pattern_scan(spark, sf_dir):
    return L.read_patterns(spark, _pattern_file(spark, sf_dir), multi_line=False).select(
        F.col("id").cast("bigint").alias("id"), "type", "token",
        F.try_element_at("examples", F.lit(1)).alias("example"),
    )


@query("hook_snippet", f"""
WITH h AS (SELECT p_partkey, '- ' || p_name || ': ' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN ' (예: "' || p_type || '")'
  ELSE '' END AS line FROM part WHERE p_partkey % 10 <> 9 AND p_partkey % 3 = 0 ORDER BY p_partkey LIMIT 6)
SELECT '{C.HOOK_HEADER}' || chr(10) || string_agg(line, chr(10) ORDER BY p_partkey) AS snippet FROM h""")
def hook_snippet(spark, sf_dir):
    patterns = L.read_patterns(spark, _pattern_file(spark, sf_dir), multi_line=False)
    return L.hook_snippet(patterns.withColumn("number", F.col("id").cast("bigint")), order=("number",))


CHANNEL_SQL = f"""videos AS (SELECT l_orderkey AS account, o_custkey AS subscribers,
  CASE WHEN l_linenumber % 3 = 1 THEN 'https://youtu.be/' || l_partkey WHEN l_linenumber <> 6 THEN '{C.VIDEO_URL_PREFIX}' || l_partkey END AS url,
  CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS views
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def channel_files(spark, sf_dir):
    """Orders as channels: lines sit in one tab per return flag, with null nodes between.

    Every third order has its tabs three levels further down.
    """
    line = F.col("l_linenumber")
    node = F.struct(
        F.when(line != 6, F.col("l_partkey").cast("string")).alias("id"),
        F.when(line % 3 == 1, F.concat(F.lit("https://youtu.be/"), F.col("l_partkey").cast("string"))).alias("url"),
        F.when(line % 2 == 0, F.rint("l_quantity").cast("bigint")).alias("view_count"),
    )
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.collect_list(node).alias("entries"))
    tabs = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("title"), "entries")).alias("tabs"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    path = scratch_path(spark, "channels")
    (
        tabs.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.to_json(F.struct(
            F.col("l_orderkey").cast("string").alias("channel"), F.col("o_custkey").alias("channel_follower_count"),
            F.concat(F.array(F.lit(None)), F.col("tabs")).alias("entries"),
        )).alias("value"), "l_orderkey")
        .select(F.when(F.col("l_orderkey") % 3 == 0, F.regexp_replace("value", '"entries":\\[null,', (
            '"entries":[null,{"id":"t1","entries":[{"id":"t2","entries":[null,{"id":"t3","entries":['
        )).alias("value")).otherwise(F.col("value")).alias("value"), "l_orderkey")
        .select(F.when(F.col("l_orderkey") % 3 == 0, F.concat("value", F.lit("]}]}]}"))).otherwise(F.col("value")).alias("value"))
        .write.text(path)
    )
    return path


@query("channel_scan", f"""
WITH {CHANNEL_SQL} SELECT account, subscribers, url, views, count(*) AS n FROM videos WHERE url IS NOT NULL GROUP BY ALL""")
def channel_scan(spark, sf_dir):
    videos = L.read_channels(spark, channel_files(spark, sf_dir))
    return videos.groupBy(
        F.col("account").cast("bigint").alias("account"), "subscribers", "url", F.col("view_count").alias("views")
    ).agg(F.count("*").alias("n"))


@query("picture_scan", """
SELECT p_brand AS query, CAST(p_partkey % 2 AS INTEGER) AS pool, p_partkey AS id, p_name AS tags, p_size AS width FROM part""")
def picture_scan(spark, sf_dir):
    path = scratch_path(spark, "hits")
    hit = F.struct(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("tags"), F.col("p_size").alias("imageWidth"),
        F.col("p_size").alias("imageHeight"), F.lit("u").alias("largeImageURL"),
    )
    table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("query"), (F.col("p_partkey") % 2).alias("pool"), F.to_json(F.array(hit)).alias("value")
    ).repartition("query").write.partitionBy("query", "pool").text(path)
    return L.read_hits(spark, path).select("query", "pool", "id", "tags", "width")


@query("candidate_sink", """
SELECT '2024-01-01T00:00:00' AS generated_at, (SELECT count(*) FROM pages) AS count, url FROM pages""")
def candidate_sink(spark, sf_dir):
    path = scratch_path(spark, "discovered")
    rows = table(spark, sf_dir, "pages").select(
        "url", F.lit("youtube").alias("platform"), F.col("page_id").cast("string").alias("account"),
        F.struct(F.col("page_id").alias("views")).alias("metrics"), F.lit("r").alias("reason"),
    )
    L.save_candidates(rows, path, "2024-01-01T00:00:00")
    saved = spark.read.schema(schemas.CANDIDATE).json(f"{path}/candidates")
    envelope = spark.read.schema("generated_at string, count bigint").json(f"{path}/envelope").first()
    return saved.select(F.lit(envelope["generated_at"]).alias("generated_at"), F.lit(envelope["count"]).alias("count"), "url")


@query("failure_log", """
SELECT '2024-01-01T00:00:00' AS at, 'ig:' || c_name AS account, 'timeout ' || c_custkey AS error FROM customer WHERE c_acctbal <= 0""")
def failure_log(spark, sf_dir):
    path = scratch_path(spark, "failed")
    failed = table(spark, sf_dir, "customer").filter("c_acctbal <= 0").select(
        F.concat(F.lit("ig:"), "c_name").alias("account"),
        F.concat(F.lit("timeout "), F.col("c_custkey").cast("string")).alias("error"), "c_custkey",
    )
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    L.append_failures(failed.filter("c_custkey % 2 = 0"), path, at)
    L.append_failures(failed.filter("c_custkey % 2 = 1"), path, at)
    return spark.read.schema("at string, account string, error string").option("sep", "\t").csv(path)
