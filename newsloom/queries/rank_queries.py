"""Queries for ranking, trend, pictures and address lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import constants as C
from newsloom.operators import covers, ranking, trend
from newsloom.operators.articles import first_values
from newsloom.functions.scores import hit_score
from newsloom.queries.registry import ARTICLES, articles, query, sql_first, sql_list, sql_text
from newsloom.queries.text_queries import post_urls, topic_sql
from newsloom.session import table

# Customers as accounts (balance = followers), their orders as posts.
POSTS = """posts AS (SELECT c_name AS account, CAST(floor(c_acctbal) AS BIGINT) AS followers, o_orderkey AS pos,
  CASE WHEN o_orderkey % 17 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS likes,
  o_orderkey % 1000 AS comments FROM orders JOIN customer ON o_custkey = c_custkey)"""


def posts(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_name").alias("account"), F.floor("c_acctbal").cast("bigint").alias("followers"),
        F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("shortcode"),
        F.when(F.col("o_orderkey") % 17 != 0, F.floor("o_totalprice").cast("bigint")).alias("likes"),
        (F.col("o_orderkey") % 1000).alias("comments"),
    )


@query("rank_posts", f"""
WITH {POSTS}, newest AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY pos) AS age FROM posts),
s AS (SELECT *, coalesce(likes, 0) + comments AS total FROM newest WHERE age <= 50),
k AS (SELECT *, CASE WHEN followers > 0 THEN total::DOUBLE / followers ELSE total::DOUBLE END AS rank_key FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY rank_key DESC, pos) AS rn FROM k)
SELECT 'https://www.instagram.com/p/' || pos || '/' AS url, account, rank_key, coalesce(likes, 0) AS likes, comments,
  CASE WHEN followers > 0 THEN rank_key ELSE 0.0 END AS rate FROM r WHERE rn <= 5""")
def rank_posts(spark, sf_dir):
    best = ranking.rank_posts(posts(spark, sf_dir))
    m = F.col("metrics")
    return best.select(
        "url", "account", "rank_key", m["likes"].alias("likes"), m["comments"].alias("comments"),
        F.when(m["followers"] > 0, F.col("rank_key")).otherwise(0.0).alias("rate"),
    )


@query("post_reasons", f"""
WITH {POSTS} SELECT account, pos, 'engagement ' || format('{{:.2f}}', CASE WHEN followers > 0 THEN
  ((coalesce(likes, 0) + comments)::DOUBLE / followers) * 100 ELSE 0.0 END) || '% (좋아요 ' || format('{{:,}}', coalesce(likes, 0)) ||
  ' + 댓글 ' || format('{{:,}}', comments) || ' / 팔로워 ' || format('{{:,}}', followers) || ')' AS reason FROM posts""")
def post_reasons(spark, sf_dir):
    from newsloom.functions.scores import engagement_reason
    reason = engagement_reason(F.col("likes"), F.col("comments"), F.col("followers"))
    return posts(spark, sf_dir).select("account", "pos", reason.alias("reason"))


# Suppliers as channels, their shipped lines as videos.
VIDEOS = """videos AS (SELECT l_suppkey AS account, CASE WHEN l_suppkey % 10 = 0 THEN 0 ELSE l_suppkey * 37 END AS subscribers,
  l_orderkey * 1000 + l_linenumber * 100 + (l_partkey % 100) AS pos, max(CAST(l_extendedprice AS BIGINT)) AS view_count
  FROM lineitem GROUP BY ALL)"""


def videos(spark, sf_dir, newest=None):
    """Of every channel all videos, or the ``newest`` first ones; the others leave before lines are added up."""
    key = F.col("l_suppkey")
    lines = table(spark, sf_dir, "lineitem").select(
        key.alias("account"), F.when(key % 10 == 0, 0).otherwise(key * 37).cast("bigint").alias("subscribers"),
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_partkey") % 100).alias("pos"),
        F.rint("l_extendedprice").cast("bigint").alias("view_count"),
    )
    if newest is not None:
        lines = first_values(lines, ["account"], ["pos"], newest)
    return (
        lines.groupBy("account", "subscribers", "pos").agg(F.max("view_count").alias("view_count"))
        .withColumns({"url": F.concat(F.lit(C.VIDEO_URL_PREFIX), F.col("pos").cast("string")), "title": F.lit("")})
    )


@query("rank_videos", f"""
WITH {VIDEOS}, newest AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY pos) AS age FROM videos),
k AS (SELECT *, CASE WHEN subscribers > 0 THEN view_count::DOUBLE / subscribers ELSE view_count::DOUBLE END AS rank_key
  FROM newest WHERE age <= 50),
r AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY rank_key DESC, pos) AS rn FROM k)
SELECT account, '{C.VIDEO_URL_PREFIX}' || pos AS url, view_count AS views, rank_key FROM r WHERE rn <= 5""")
def rank_videos(spark, sf_dir):
    return ranking.rank_videos(videos(spark, sf_dir, C.MAX_POSTS)).select(
        "account", "url", F.col("metrics.views").alias("views"), "rank_key"
    )


@query("newest_posts", f"""
WITH {POSTS} SELECT account, pos FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY pos DESC) AS rn FROM posts)
WHERE rn <= 50""")
def newest_posts(spark, sf_dir):
    from newsloom.operators.articles import first_rows
    return first_rows(posts(spark, sf_dir), ["account"], [F.desc("pos")], C.MAX_POSTS).select("account", "pos")


PRICES = """prices AS (SELECT event_type AS ticker, CAST(ts AS DATE) AS date, arg_max(value, event_id) AS close
  FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"""


def prices(spark, sf_dir):
    """Daily last value per event type as a price series."""
    return (
        table(spark, sf_dir, "events").filter("value IS NOT NULL")
        .groupBy(F.col("event_type").alias("ticker"), F.to_date("ts").alias("date"))
        .agg(F.max_by("value", "event_id").alias("close"))
    )


@query("price_history", f"""
WITH {PRICES} SELECT ticker, strftime(date, '%Y-%m-%d') AS date, close FROM prices WHERE date >= DATE '2024-01-10'""")
def price_history(spark, sf_dir):
    from newsloom.sources.landed import read_prices
    from newsloom.session import scratch_path
    path = scratch_path(spark, "prices")
    prices(spark, sf_dir).write.parquet(path)
    return read_prices(spark, path, since="2024-01-10").withColumn("date", F.col("date").cast("string"))


TREND_SQL = """
recent AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM prices),
trend AS (SELECT ticker, count(*) AS n_days, (arg_max(close, date) - arg_min(close, date)) / arg_min(close, date) * 100 AS pct
  FROM recent WHERE rn <= 5 GROUP BY 1)"""


@query("price_trend", f"""
WITH {PRICES}, {TREND_SQL} SELECT ticker, n_days, round(pct, 6) AS pct, CAST(pct >= -0.5 AS BIGINT) AS up_ok, CAST(pct <= 0.5 AS BIGINT) AS down_ok
FROM trend""")
def price_trend(spark, sf_dir):
    t = trend.recent_trend(prices(spark, sf_dir))
    ok = {d: trend.trend_agrees(F.lit(d), F.col("n_days"), F.col("pct")).cast("bigint") for d in ("up", "down")}
    return t.select(
        "ticker", "n_days", F.round("pct", 6).alias("pct"), ok["up"].alias("up_ok"), ok["down"].alias("down_ok")
    )


@query("scaled_series", f"""
WITH {PRICES} SELECT ticker, strftime(date, '%Y-%m-%d') AS date, round((close - min(close) OVER w) /
  nullif(max(close) OVER w - min(close) OVER w, 0) * 100, 6) AS scaled FROM prices WINDOW w AS (PARTITION BY ticker)""")
def scaled_series(spark, sf_dir):
    return trend.scale_series(prices(spark, sf_dir)).select(
        "ticker", F.col("date").cast("string").alias("date"), F.round("scaled", 6).alias("scaled")
    )


# Parts as picture hits.
PICTURE_QUERY = "red widget small planet wall"
TAGS = "p_name || CASE p_partkey % 7 WHEN 0 THEN ' planet' WHEN 1 THEN ' map, logo' ELSE '' END || ', ' || lower(p_type)"
HITS = f"""hits AS (SELECT p_partkey AS pos, CASE WHEN p_partkey % 29 <> 0 THEN p_partkey // 2 END AS id, {TAGS} AS tags,
  p_size * 40 AS width, (p_partkey % 60) * 40 AS height, CAST(p_retailprice * 60 AS BIGINT) AS downloads, p_brand AS query FROM part)"""


def hits(spark, sf_dir):
    key = F.col("p_partkey")
    extra = F.when(key % 7 == 0, " planet").when(key % 7 == 1, " map, logo").otherwise("")
    return table(spark, sf_dir, "part").select(
        key.alias("pos"), F.when(key % 29 != 0, F.floor(key / 2)).cast("bigint").alias("id"),
        F.concat("p_name", extra, F.lit(", "), F.lower("p_type")).alias("tags"),
        (F.col("p_size") * 40).alias("width"), ((key % 60) * 40).cast("int").alias("height"),
        F.rint(F.col("p_retailprice") * 60).cast("bigint").alias("downloads"),
        F.col("p_brand").alias("query"),
    )


def score_sql(q: str) -> str:
    bad = " + ".join(f"CAST(contains(lower(tags), {sql_text(t)}) AS INTEGER)" for t in C.BAD_TAGS)
    return f"""(-100.0 * ({bad})
  + CASE WHEN (CASE WHEN width = 0 THEN 1 ELSE width END)::DOUBLE / greatest(height, 1) > 2.2
      OR (CASE WHEN width = 0 THEN 1 ELSE width END)::DOUBLE / greatest(height, 1) < 0.4 THEN -50.0 ELSE 0.0 END
  + 20.0 * len(list_filter(string_split_regex(lower({q}), '\\s+'), lambda w: length(w) >= 4 AND contains(lower(tags), w)))
  + least(coalesce(downloads, 0) / 10000.0, 10.0))::DOUBLE"""


@query("picture_scores", f"""
WITH {HITS} SELECT pos, round({score_sql("'" + PICTURE_QUERY + "'")}, 6) AS score FROM hits""")
def picture_scores(spark, sf_dir):
    score = hit_score(F.col("tags"), F.col("width"), F.col("height"), F.col("downloads"), F.lit(PICTURE_QUERY))
    return hits(spark, sf_dir).select("pos", F.round(score, 6).alias("score"))


POOLS = HITS + """, pools AS (SELECT *, 0 AS pool FROM hits WHERE pos % 3 <> 0 UNION ALL SELECT *, 1 FROM hits WHERE pos % 5 <> 0),
ranked AS (SELECT *, pool * 1000000000 + pos AS place FROM pools WHERE id IS NOT NULL),
merged AS (SELECT query, id, arg_max(tags, place) AS tags, arg_max(width, place) AS width, arg_max(height, place) AS height,
  arg_max(downloads, place) AS downloads, min(place) AS place FROM ranked GROUP BY query, id)"""


def pools(spark, sf_dir):
    rows = hits(spark, sf_dir)
    return covers.merge_pools(rows.filter("pos % 3 <> 0"), rows.filter("pos % 5 <> 0"))


@query("picture_pools", f"""
WITH {POOLS} SELECT query, id, tags, downloads, place FROM merged""")
def picture_pools(spark, sf_dir):
    place = F.col("place.pool") * 1000000000 + F.col("place.pos")
    return pools(spark, sf_dir).select("query", "id", "tags", "downloads", place.alias("place"))


@query("best_picture", f"""
WITH {POOLS}, s AS (SELECT query, id, place, {score_sql("query || ' ring widget bolt'")} AS score FROM merged),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, place) AS rn FROM s)
SELECT query, id, round(score, 6) AS score FROM r WHERE rn = 1 AND score > -50""")
def best_picture(spark, sf_dir):
    named = pools(spark, sf_dir).withColumn("query", F.concat("query", F.lit(" ring widget bolt")))
    return covers.best_hits(named).select(
        F.replace("query", F.lit(" ring widget bolt"), F.lit("")).alias("query"), "id", F.round("score", 6).alias("score")
    )


TOPICS = [t for t, *_ in C.MACRO_RULES] + ["", "기타"]


@query("cover_phrase_choice", f"""
WITH {ARTICLES}, s AS (SELECT pos, title, CASE WHEN pos % 3 = 0 THEN list_extract({sql_list(TOPICS)}, CAST(pos % {len(TOPICS)} AS INTEGER) + 1) END AS stored,
  replace(title, chr(10), ' ') || ' ' || summary AS issue FROM articles),
t AS (SELECT *, CASE WHEN coalesce(stored, '') <> '' THEN stored ELSE {topic_sql('lower(issue)')} END AS topic FROM s)
SELECT pos, coalesce(CASE {" ".join(f"WHEN topic = '{t}' THEN '{p}'" for t, p in C.TOPIC_COVERS)} END,
  {sql_first("lower(issue || ' ' || title)", C.COVER_PHRASES, C.DEFAULT_COVER)}) AS phrase FROM t""")
def cover_phrase_choice(spark, sf_dir):
    topic = F.element_at(F.array([F.lit(t) for t in TOPICS]), (F.col("pos") % len(TOPICS)).cast("int") + 1)
    return articles(spark, sf_dir).select(
        "pos",
        covers.resolve_cover(F.when(F.col("pos") % 3 == 0, topic), F.col("title"), F.col("summary"), F.col("title"))
        .alias("phrase"),
    )


@query("new_urls", """
WITH given AS (SELECT page_id AS pos, split_part(url, '?', 1) AS url FROM pages UNION ALL
  SELECT 1000000000 + page_id, split_part(url, '#', 1) FROM pages),
known AS (SELECT split_part(url, '?', 1) AS url FROM pages WHERE page_id % 3 = 0)
SELECT url, min(pos) AS pos FROM given WHERE url NOT IN (SELECT url FROM known) GROUP BY url""")
def new_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    given = pages.select(F.col("page_id").alias("pos"), F.split_part("url", F.lit("?"), F.lit(1)).alias("url")).unionByName(
        pages.select((F.col("page_id") + 1000000000).alias("pos"), F.split_part("url", F.lit("#"), F.lit(1)).alias("url"))
    )
    known = pages.filter("page_id % 3 = 0").select(F.split_part("url", F.lit("?"), F.lit(1)).alias("url"))
    return ranking.new_urls(given, known)


@query("not_collected_yet", r"""
WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://www.instagram.com/p/' || page_id
   WHEN 1 THEN 'https://youtu.be/' || page_id WHEN 2 THEN 'https://www.youtube.com/shorts/' || page_id
   ELSE url END AS u FROM pages),
s AS (SELECT page_id, CASE WHEN contains(u, 'instagram.com') THEN 'ig_' ELSE 'yt_' END || CASE WHEN regexp_extract(u,
  '(?:instagram\.com/(?:p|reel)/|youtube\.com/(?:shorts/|watch\?v=)|youtu\.be/)([\w-]+)', 1) <> '' THEN regexp_extract(u,
  '(?:instagram\.com/(?:p|reel)/|youtube\.com/(?:shorts/|watch\?v=)|youtu\.be/)([\w-]+)', 1)
  ELSE right(regexp_replace(u, '[^\p{L}\p{N}_]+', '_', 'g'), 30) END AS slug FROM p)
SELECT page_id, slug FROM s WHERE slug NOT IN (SELECT slug FROM s WHERE page_id % 5 = 0)""")
def not_collected_yet(spark, sf_dir):
    from newsloom.functions.text import post_slug
    urls = post_urls(spark, sf_dir).withColumnRenamed("post_url", "url")
    done = urls.filter("page_id % 5 = 0").select(post_slug(F.col("url")).alias("slug"))
    return ranking.not_collected(urls, done).select("page_id", "slug")
