"""Row operators, clusters, ranking, trends, pictures."""

import datetime as dt

from pyspark.sql import functions as F

from newsloom import constants as C
from newsloom.functions.scores import hit_score
from newsloom.operators import articles as A, clusters as K, covers, ranking, trend
from newsloom.operators.counters import observed

NOW = dt.datetime(2024, 1, 2, 12)


def test_freshness_keeps_equality_and_undated(spark):
    rows = [(1, NOW - dt.timedelta(hours=24)), (2, NOW - dt.timedelta(hours=24, seconds=1)), (3, None), (4, NOW)]
    df = spark.createDataFrame(rows, "id int, published_at timestamp")
    got = {r["id"]: r["published_at"] for r in A.fresh_only(df, "published_at", F.lit(NOW)).collect()}
    assert got.keys() == {1, 3, 4} and got[3] == NOW


def test_limit_comes_before_whitelist(spark):
    df = spark.createDataFrame([("g", i, "Blog" if i < 3 else "Reuters") for i in range(6)], "c string, pos int, source string")
    assert [r["pos"] for r in A.limit_then_whitelist(df, "c", ["pos"], "source", limit=4).collect()] == [3]


def test_keep_first_counts_empty_addresses_as_one(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "u"), (4, "u")], "pos int, url string")
    assert sorted(r["pos"] for r in A.keep_first(df, "url", ["pos"]).collect()) == [1, 3]


def test_top_rows_are_limited_before_the_shuffle(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    plan = A.first_rows(df, ["g"], ["id"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") != plan.rindex("WindowGroupLimit")


def test_scan_order_follows_rank_and_position(spark):
    a = spark.range(50).select(F.col("id").alias("pos"))
    got = A.scan_order(A.union_feeds(a, a), "feed_rank", "pos").orderBy("id").collect()
    assert [(r["feed_rank"], r["pos"]) for r in got] == [(f, p) for f in (0, 1) for p in range(50)]


def test_observed_counts(spark):
    df, seen = observed(spark.range(7), "n")
    df.collect()
    assert seen.get["rows"] == 7


def chat(spark, rows):
    return spark.createDataFrame(rows, "cluster_id int, pos bigint, title string, summary string, source string, cluster_label string")


def test_quality_and_labels(spark):
    df = chat(spark, [(0, 0, "short", "s", "a", "L"), (0, 1, "a longer title", "s", "b", "M"), (0, 2, "b longer title", "s", None, "M"),
                      (1, 3, "x", "s", "a", "N"), (2, 4, "y", "s", "a", "N"), (2, 5, "y", "s", "a", "N"), (-1, 6, "z", "s", "b", "")])
    strong = K.reject_weak_clusters(df)
    assert {r["pos"]: r["cluster_id"] for r in strong.collect()} == {0: 0, 1: 0, 2: 0, 3: -1, 4: -1, 5: -1, 6: -1}
    labelled = K.attach_labels(strong, K.cluster_labels(strong))
    got = {r["pos"]: r["cluster_label"] for r in labelled.collect()}
    assert got[0] == "a longer title" and got[6] == C.NOISE_LABEL
    assert K.noise_report(strong).first().asDict() == {"n_clusters": 1, "n_noise": 4, "noise_pct": 4 / 7 * 100}


def test_label_falls_back_to_keywords_then_number(spark):
    df = chat(spark, [(0, 0, "", "market rally market oil", "a", ""), (0, 1, "ab", "oil market", "b", ""), (1, 2, " ", "", "a", "")])
    got = {r["cluster_id"]: r["cluster_label"] for r in K.cluster_labels(df).collect()}
    assert got == {0: "market oil rally", 1: "이슈 1"}


def test_material_numbers_five_articles(spark):
    df = chat(spark, [(0, i, f"t{i}", "s" * 500, "src", "label") for i in range(7)])
    row = K.issue_groups(df).select(K.material_text(F.col("cluster_label"), F.col("articles")).alias("m"), "n_articles").first()
    lines = row["m"].split("\n")
    assert row["n_articles"] == 7 and len(lines) == 3 + 10
    assert lines[0] == C.MATERIAL_LABEL_LINE + "label" and lines[3] == "1. (src) t0" and lines[4] == "   " + "s" * 400


def post_rows(spark, rows):
    return spark.createDataFrame(rows, "account string, followers bigint, pos bigint, shortcode string, likes bigint, comments bigint")


def test_rank_posts(spark):
    rows = [("a", 1000, i, f"p{i}", 10 * i, 0) for i in range(7)] + [("z", 0, 0, "q", 5, 1), ("z", 0, 1, "r", 9, None), ("a", 1000, 9, "c", 0, 65)]
    got = ranking.rank_posts(post_rows(spark, rows)).orderBy("account", F.desc("rank_key")).collect()
    assert [r["url"].split("/")[-2] for r in got] == ["c", "p6", "p5", "p4", "p3", "r", "q"]
    assert got[0]["metrics"]["engagement_rate"] == 0.065 and got[5]["metrics"]["engagement_rate"] == 0.0
    assert got[1]["reason"] == "engagement 6.00% (좋아요 60 + 댓글 0 / 팔로워 1,000)"


def test_rank_videos(spark):
    rows = [("c", 10000, 0, "u0", "t", 90000), ("c", 10000, 1, "u1", "t", None), ("d", 0, 0, "u2", None, 1234)]
    df = spark.createDataFrame(rows, "account string, subscribers bigint, pos bigint, url string, title string, view_count bigint")
    got = {r["url"]: r for r in ranking.rank_videos(df).collect()}
    assert got["u0"]["metrics"]["view_ratio"] == 9.0 and got["u1"]["metrics"]["views"] == 0
    assert got["u2"]["reason"] == "조회수 1,234 (구독자 미확인)"


def test_new_urls_are_idempotent(spark):
    given = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2), ("c", 3)], "url string, pos bigint")
    known = spark.createDataFrame([("b",)], "url string")
    fresh = ranking.new_urls(given, known)
    assert [r["url"] for r in fresh.orderBy("pos").collect()] == ["a", "c"]
    assert ranking.new_urls(given, known.union(fresh.select("url"))).isEmpty()


def test_trend_limits(spark):
    day = dt.date(2024, 1, 1)
    rows = [("flat", day + dt.timedelta(i), 100.0) for i in range(7)] + [("one", day, 5.0)]
    rows += [("drop", day + dt.timedelta(i), c) for i, c in enumerate([1.0, 200.0, 1.0, 1.0, 1.0, 199.0])]
    df = spark.createDataFrame(rows, "ticker string, date date, close double")
    got = {r["ticker"]: r for r in trend.recent_trend(df).collect()}
    assert got["flat"]["pct"] == 0.0 and got["one"]["pct"] == 0.0 and abs(got["drop"]["pct"] + 0.5) < 1e-9
    scaled = {(r["ticker"], r["date"].day): r["scaled"] for r in trend.scale_series(df).collect()}
    assert scaled[("flat", 1)] is None and scaled[("drop", 2)] == 100.0 and scaled[("drop", 1)] == 0.0


def score(evaluate, tags="city", w=1000, h=1500, d=0, q=""):
    return evaluate(hit_score(F.lit(tags), F.lit(w), F.lit(h), F.lit(d), F.lit(q)))


def test_hit_score(evaluate):
    assert score(evaluate, "planet, city") < score(evaluate, "city")
    assert score(evaluate, w=4000, h=1000) == -50 and score(evaluate, w=100, h=1000) == -50
    assert score(evaluate, d=20000) == 2.0 and score(evaluate, d=10 ** 7) == 10.0
    assert score(evaluate, "oil refinery", q="oil refinery sunset") == 20.0
    assert score(evaluate, w=0, h=0) == 0.0


def test_pools_and_best_hit(spark):
    schema = "query string, pos int, id bigint, tags string, width int, height int, downloads bigint"
    a = spark.createDataFrame([("q", 0, 1, "old", 1, 1, 5), ("q", 1, 2, "city", 1, 1, 7), ("q", 2, None, "none", 1, 1, 9)], schema)
    b = spark.createDataFrame([("q", 0, 1, "new", 1, 1, 7), ("bad", 1, 3, "flag map", 1, 1, 9)], schema)
    merged = {r["id"]: r["tags"] for r in covers.merge_pools(a, b).collect()}
    assert merged == {1: "new", 2: "city", 3: "flag map"}
    best = covers.best_hits(covers.merge_pools(a, b)).collect()
    assert [(r["query"], r["id"]) for r in best] == [("q", 1)]


def test_cover_choice(evaluate):
    pick = lambda *v: evaluate(covers.resolve_cover(*[F.lit(x).cast("string") for x in v]))
    assert pick("금리 인상", "중국", "", "") == dict(C.TOPIC_COVERS)["금리 인상"]
    assert pick(None, "rate\ncut", "", "") == dict(C.TOPIC_COVERS)["금리 인하"]
    assert pick("", "조용한 날", "", "defense expo") == "military technology aerospace"
    assert pick("모르는 토픽", "조용한 날", None, None) == C.DEFAULT_COVER


def test_rank_videos_drops_lines_before_they_are_added_up(spark, sf_dir):
    from newsloom.operators.articles import first_values
    from newsloom.queries.rank_queries import rank_videos

    rows = [("a", p, v) for p in (3, 1, 2, 1, 3) for v in (p, p + 10)] + [("b", 9, 0), (None, 5, 1)]
    kept = first_values(spark.createDataFrame(rows, "account string, pos long, v long"), ["account"], ["pos"], 2)
    assert sorted((r.account or "", r.pos, r.v) for r in kept.collect()) == sorted((a or "", p, v) for a, p, v in rows if p != 3)
    plan = rank_videos(spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    assert "dense_rank" in plan[plan.rindex("HashAggregate"):]  # below the aggregate
