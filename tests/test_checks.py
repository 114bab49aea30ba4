"""Checks on articles, draft parsing, and plans without a join on the noise key."""

from pyspark.sql import functions as F

from newsloom.operators import checks, clusters
from newsloom.plans.scripts import parse_drafts


def test_numbers_and_relevance(evaluate):
    assert evaluate(checks.numeric_outlier(F.lit("up 101%"))) and evaluate(checks.numeric_outlier(F.lit("10000.5 shares")))
    assert not evaluate(checks.numeric_outlier(F.lit("up 100%, 10000 shares"))) and not evaluate(checks.numeric_outlier(F.lit(None).cast("string")))
    assert evaluate(checks.relevant(F.lit("Oil and Fed"), ["oil", "fed", "war"])) and not evaluate(checks.relevant(F.lit("oil oil"), ["oil", "fed"]))


def test_source_and_text(evaluate):
    names = [("a.com", "A")]
    assert evaluate(checks.source_of_url(F.lit("https://News.a.com:80/x"), names)) == "A"
    assert evaluate(checks.source_of_url(F.lit("http://www.ba.com?q"), names)) == "ba.com"
    assert evaluate(checks.html_text(F.lit("<p>a <b>b</b></p><script>x < y</script>\n c"))) == "a b c"


def test_split_is_exact(spark):
    rows = spark.range(237).select("id", F.when(F.col("id") % 7 == 0, "x").otherwise("y").alias("class"))
    counts = {(r["class"], r.held_out): r["count"] for r in checks.stratified_split(rows, "class", "id").groupBy("class", "held_out").count().collect()}
    assert counts == {("x", True): 4, ("x", False): 30, ("y", True): 21, ("y", False): 182}


def test_scores(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1), (None, 1)], "y int, p int")
    r = checks.confusion(rows, "y", "p").first()
    assert (r.tp, r.fp, r.fn, r.tn, round(r.precision, 3), round(r.f1, 3)) == (2, 1, 1, 1, 0.667, 0.667)


def test_drafts(spark):
    rows = [("1", '{"hook_title": "t", "sources": ["a"], "other": 1}'), ("2", "no json"), ("3", ""), ("4", None), ("5", '{"hook_title": "cut')]
    good, unread = parse_drafts(spark.createDataFrame(rows, "issue_id string, answer string"))
    assert {r.issue_id: r.hook_title for r in good.collect()} == {"1": "t", "3": None, "4": None}
    assert sorted(r.issue_id for r in unread.collect()) == ["2", "5"]


def test_noise_takes_no_part_in_joins(spark):
    df = spark.createDataFrame([(-1, 0, "t", "a"), (1, 1, "t", "a"), (1, 2, "t", "b"), (2, 3, "t", "a"), (None, 4, "t", "a")], "cluster_id int, pos int, title string, source string")
    assert sorted(r.cluster_id for r in clusters.reject_weak_clusters(df).collect()) == [-1, -1, -1, 1, 1]
    labels = spark.createDataFrame([(1, "L")], "cluster_id int, cluster_label string")
    assert {r.pos: r.cluster_label == "L" for r in clusters.attach_labels(df, labels).collect()} == {0: False, 1: True, 2: True, 3: False, 4: False}
    for out in (clusters.reject_weak_clusters(df), clusters.attach_labels(df, labels)):
        assert ">= 0" in out._jdf.queryExecution().optimizedPlan().toString()
