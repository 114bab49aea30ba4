"""Landed files, script jobs, cache, discovery, collection, streams."""

import datetime as dt
import json

from pyspark.sql import functions as F

from newsloom import constants as C
from newsloom import schemas
from newsloom.operators import cache as K
from newsloom.plans import collect, discovery, scripts as S
from newsloom.sources import landed as L
from newsloom.streaming import incremental
from tests.test_records import GOOD


def test_jsonl_keeps_nulls_and_hangul(spark, tmp_path):
    path = str(tmp_path / "a")
    L.write_jsonl(spark.createDataFrame([("1", "금리", None)], "id string, title string, url string"), path)
    line = "".join(p.read_text() for p in (tmp_path / "a").glob("part*"))  # some parts are empty
    assert json.loads(line) == {"id": "1", "title": "금리", "url": None} and "금리" in line
    (tmp_path / "b.jsonl").write_text('{"id": "1"}\n\n{"id": "2"}\n')
    assert L.read_jsonl(spark, str(tmp_path / "b.jsonl")).count() == 2


def test_script_array(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"issue_id": "6", "inner": {"slide2_facts": ["a"]}}, {"issue_id": "7"}]))
    df = L.read_scripts(spark, str(tmp_path / "s.json"))
    assert L.select_script(df, 6).first()["inner"]["slide2_facts"] == ["a"] and L.select_script(df, None).count() == 2


FEED = """<?xml version="1.0"?><rss><channel><title>feed</title>
<item><title>A</title><link>u1</link><description>d</description><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item>
<item><title>B</title><link>u2</link><summary>s</summary><description>d</description><updated>2024-01-02T03:04:05Z</updated></item>
<item><title>C</title></item></channel></rss>"""


def test_feed(spark, tmp_path):
    (tmp_path / "nytimes.xml").write_text(FEED)
    rows = {r["title"]: r for r in L.read_feed(spark, str(tmp_path / "nytimes.xml")).collect()}
    assert rows["A"]["published_at"] == rows["B"]["published_at"] == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert (rows["A"]["description"], rows["B"]["description"], rows["C"]["url"]) == ("d", "s", "")
    assert rows["C"]["published_at"] is None and rows["A"]["source"] == "New York Times"


def test_account_and_url_lists(spark, tmp_path):
    (tmp_path / "acc.txt").write_text("# note\n\nig:@name\n yt: https://y/@c \nig: @@x\nbroken\n")
    good, bad = L.read_accounts(spark, str(tmp_path / "acc.txt"))
    assert sorted((r["platform"], r["account"]) for r in good.collect()) == [("ig", "name"), ("ig", "x"), ("yt", "https://y/@c")]
    assert [r["line"] for r in bad.collect()] == ["broken"]
    (tmp_path / "urls.txt").write_text("# c\nu1\n\n u2 \n")
    assert sorted(r["url"] for r in L.read_urls(spark, str(tmp_path / "urls.txt")).collect()) == ["u1", "u2"]


def test_patterns(spark, tmp_path):
    items = [{"id": str(i), "type": "hook" if i % 2 else "layout", "token": f"t{i}", "description": "d",
              "examples": ["e"] if i == 1 else []} for i in range(4)]
    for name, content in [("obj", json.dumps({"patterns": items}, indent=1)), ("arr", json.dumps(items)), ("bad", '{"patterns": [')]:
        (tmp_path / name).write_text(content)
    read = lambda n: L.read_patterns(spark, str(tmp_path / n))
    assert read("obj").count() == read("arr").count() == 4
    assert read("bad").count() == read("missing").count() == 0
    assert L.hook_snippet(read("obj")).first()[0] == C.HOOK_HEADER + '\n- t1: d (예: "e")\n- t3: d'
    assert L.hook_snippet(read("missing")).first()[0] == ""


def test_channels_are_flattened(spark, tmp_path):
    doc = {"channel": "c", "channel_follower_count": None, "entries": [
        None, {"id": "a", "title": "A", "view_count": 3},
        {"id": "tab", "entries": [{"url": "u", "entries": []}, {"id": "deep", "entries": [{"id": "b", "view_count": None}, None]}]},
        {"title": "no address"}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    rows = L.read_channels(spark, str(tmp_path / "c.json")).orderBy("pos").collect()
    assert [r["url"] for r in rows] == [C.VIDEO_URL_PREFIX + "a", "u", C.VIDEO_URL_PREFIX + "b"]
    assert [r["view_count"] for r in rows] == [3, 0, 0] and rows[0]["subscribers"] == 0


def clusters(spark):
    return spark.createDataFrame(
        [(6, 0, "t", "s", "Reuters", "금리"), (7, 1, "t", "s", "CNBC blog", "라벨"), (8, 2, "t", "s", "x", "rate hike"), (-1, 3, "n", "s", "x", "")],
        "cluster_id int, pos bigint, title string, summary string, source string, cluster_label string")


def drafts(spark, *rows):
    names = [p.split()[0] for p in schemas.DRAFT.split(", ")]
    data = [(i, *[{**GOOD, **changes}[n] for n in names]) for i, changes in rows]
    return spark.createDataFrame(data, f"issue_id string, {schemas.DRAFT}")


EMPTY_CACHE = f"key string, {schemas.SCRIPT}"


def by_issue(df):
    return {r["issue_id"]: r for r in df.collect()}


def test_fallbacks_are_viable_and_named(spark):
    got = by_issue(S.generate_scripts(clusters(spark), drafts(spark), spark.createDataFrame([], EMPTY_CACHE)))
    assert set(got) == {"6", "7", "8"} and all(r["from_fallback"] for r in got.values())
    assert got["6"]["hook_title"] == C.CURATED_SCRIPTS["6"]["hook_title"] and got["6"]["validation_issues"] == []
    assert got["7"]["sources"] == ["CNBC"] and got["7"]["inner"]["slide2_source"] == "출처 · CNBC"


def test_good_drafts_are_cached_and_fallbacks_are_not(spark):
    given = drafts(spark, ("7", {}), ("8", {"slide2_facts": []}))
    empty = spark.createDataFrame([], EMPTY_CACHE)
    first = S.generate_scripts(clusters(spark), given, empty)
    got = by_issue(first)
    assert [got[i]["from_fallback"] for i in "678"] == [True, False, True]
    poisoned = first.filter("from_fallback")
    stored = K.upsert(poisoned.select(empty.columns), first)
    assert [r["issue_id"] for r in stored.collect()] == ["7"]
    again = by_issue(S.generate_scripts(clusters(spark), drafts(spark), stored))
    assert again["7"]["from_cache"] and again["7"]["hook_title"] == "물가" and again["6"]["from_fallback"]


def test_conflicting_sectors_are_corrected(spark):
    given = drafts(spark, ("8", {"slide3_sectors": [("바이오·제약", "신약 임상")]}))
    row = by_issue(S.generate_scripts(clusters(spark), given, spark.createDataFrame([], EMPTY_CACHE)))["8"]
    assert row["fact_check"]["status"] == "failed"
    assert [s["name"] for s in row["inner"]["slide3_sectors"]] == ["은행·금융", "보험"]
    assert row["inner"]["slide3_sectors"][0]["reason"] == "신약 임상"


def test_prepare_rejects_missing_and_thin_scripts(spark):
    done = S.generate_scripts(clusters(spark), drafts(spark, ("7", {})), spark.createDataFrame([], EMPTY_CACHE))
    thin = F.col("inner").withField("slide2_facts", F.array().cast("array<string>"))
    mixed = done.withColumn("inner", F.when(F.col("issue_id") == "7", F.col("inner")).when(F.col("issue_id") == "8", thin))
    ready, rejected = S.prepare_scripts(mixed)
    assert [r["issue_id"] for r in ready.collect()] == ["7"]
    assert {tuple(r) for r in rejected.collect()} == {("6", "no slides"), ("8", "not viable")}


CACHE = "key string, from_fallback boolean, value string"


def test_cache_versions(spark, tmp_path):
    path = str(tmp_path / "cache")
    put = lambda rows, **kw: K.store(spark, path, CACHE, spark.createDataFrame(rows, CACHE), **kw)
    read = lambda: {r["key"]: r["value"] for r in K.current_cache(spark, path, CACHE).collect()}
    assert read() == {}
    put([("a", False, "1"), ("b", True, "1")], version=0)
    put([("a", False, "2"), ("c", False, "1")], version=1)
    assert read() == {"a": "2", "c": "1"}
    put([("a", False, "2"), ("c", False, "1")], version=1)  # a repeated batch
    assert read() == {"a": "2", "c": "1"}


def test_discovery_isolates_failures(spark):
    accounts = spark.createDataFrame([("ig", "a"), ("yt", "c"), ("ig", "gone")], "platform string, account string")
    posts = spark.createDataFrame([("a", 100, i, f"p{i}", i, 0) for i in range(8)],
                                  "account string, followers bigint, pos bigint, shortcode string, likes bigint, comments bigint")
    videos = spark.createDataFrame([("c", 10, i, f"v{i}", "t", i) for i in range(8)],
                                   "account string, subscribers bigint, pos bigint, url string, title string, view_count bigint")
    known = spark.createDataFrame([("v7",)], "url string")
    candidates, fresh, failed = discovery.discover(accounts, posts, videos, known)
    assert candidates.count() == 10 and fresh.count() == 9
    assert [r["account"] for r in failed.collect()] == ["ig:gone"]


def raw(spark, rows):
    return spark.createDataFrame(
        rows, "pos bigint, title string, description string, url string, published_at timestamp, source string, category string"
    ).withColumn("tickers", F.array().cast("array<string>"))


def test_collection_keeps_three_of_four(spark):
    now = dt.datetime(2024, 1, 2)
    feed = raw(spark, [(0, "Fed keeps rates at 2% this month", "x" * 600, "u0", now, "Reuters", None),
                       (1, "Oil exports recover in spring", "d", "u1", None, "Reuters", None)])
    api = raw(spark, [(0, "Fed keeps rates at 2.5% this month", "d", "u2", now, "CNBC", "general"),
                      (1, "Chip makers see strong demand", "d", "u3", now, "CNBC", "general"),
                      (2, "Not allowed", "d", "u4", now, "Blog", "general")])
    got = collect.merge_feeds(collect.feed_articles(feed, F.lit(now)), collect.api_articles(api)).orderBy("scan_id").collect()
    assert [r["url"] for r in got] == ["u0", "u1", "u3"]
    assert set(got[0].asDict()) == {"scan_id", "id", "title", "summary", "url", "published_at", "source", "tickers"}
    assert len(got[0]["summary"]) == C.DESCRIPTION_CHARS and got[1]["published_at"] == now


def test_stream_drops_repeats_across_batches(spark, tmp_path):
    landed, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "title string, summary string, url string, published_at timestamp"
    now = dt.datetime(2024, 1, 2)
    old = now - dt.timedelta(hours=30)
    for rows in ([("oil", "", "u1", now), ("cats", "", "u9", now), ("undated oil", "", "u4", None)],
                 [("oil again", "", "u1", now), ("trade", "", None, None)],
                 [("oil before", "", "u5", now - dt.timedelta(hours=20)), ("old oil", "", "u6", old)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landed)
    stream = incremental.article_stream(spark, landed, schema, files_per_batch=1)
    incremental.new_articles(stream, F.lit(now)).select("url").writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["url"] for r in spark.read.parquet(out).collect()) == ["", "u1", "u4", "u5"]


def test_stream_keywords(spark, tmp_path):
    landed, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "title string, summary string, url string, published_at timestamp"
    spark.createDataFrame([("oil", "", "u1", None), ("zzz", "", "u2", None)], schema).write.parquet(landed)
    stream = incremental.new_articles(incremental.article_stream(spark, landed, schema), F.current_timestamp(), keywords=["ZZ"])
    stream.select("url").writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    assert [r["url"] for r in spark.read.parquet(out).collect()] == ["u2"]


def test_cache_keeps_one_success_per_key(spark):
    schema = "key string, from_fallback boolean, value string"
    fresh = spark.createDataFrame([("a", True, "f"), ("a", False, "s"), ("b", True, "f"), ("c", False, "x"), ("c", None, "y")], schema)
    once = sorted((r.key, r.value) for r in K.upsert(spark.createDataFrame([("a", False, "old"), ("d", None, "kept")], schema), fresh).collect())
    assert [k for k, _ in once] == ["a", "c", "d"] and once[0] == ("a", "s") and once[2] == ("d", "kept")
    again = K.upsert(spark.createDataFrame([], schema), fresh).collect()
    assert {(r.key, r.value) for r in again} == set(once[:2])


def test_scripts_of_all_forms(spark, tmp_path):
    one = lambda i: {"issue_id": str(i)}
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(one(i)) for i in range(3)) + "\n")
    (tmp_path / "arrays.json").write_text("\n".join(json.dumps([one(i), one(i + 10)]) for i in range(3, 5)))
    (tmp_path / "pretty.json").write_text(json.dumps([one(20), one(21)], indent=2))
    (tmp_path / "bad.json").write_text('{"issue_id": \n')
    found = L.read_scripts(spark, str(tmp_path)).collect()
    assert sorted(int(r.issue_id) for r in found) == [0, 1, 2, 3, 4, 13, 14, 20, 21]
    L.write_scripts(spark.createDataFrame([(str(i),) for i in range(7)], "issue_id string").coalesce(1), str(tmp_path / "out"))
    assert L.read_scripts(spark, str(tmp_path / "out")).count() == 7


def test_profiles_without_posts(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"account": "a", "followers": 5, "posts": []}\n{"account": "b", "posts": [{"shortcode": "x"}]}\n{"account": "c"}\n')
    profiles, posts = L.read_profiles(spark, str(tmp_path / "p.json"))
    assert profiles.count() == 3 and [r.account for r in posts.collect()] == ["b"]
    accounts = spark.createDataFrame([("ig", x) for x in "abcd"], "platform string, account string")
    videos = spark.createDataFrame([], "account string, subscribers bigint, pos int, url string, title string, view_count bigint")
    failed = discovery.discover(accounts, posts, videos, spark.createDataFrame([], "url string"), profiles)[2]
    assert [r.account for r in failed.collect()] == ["ig:d"]


def test_feed_dates(spark, tmp_path):
    item = "<item><title>{}</title>{}</item>"
    dates = {
        "est": "<pubDate>Tue, 02 Jan 2024 03:04:05 EST</pubDate>", "pdt": "<pubDate>2 Jul 2024 03:04 PDT</pubDate>",
        "second": "<pubDate>soon</pubDate><updated>2024-01-02T03:04:05Z</updated>", "bad": "<pubDate>soon</pubDate>", "none": "",
    }
    (tmp_path / "f.xml").write_text("<rss>" + "".join(item.format(k, v) for k, v in dates.items()) + '<item><title>atom</title><link href="u"/></item></rss>')
    feed = L.read_feed(spark, str(tmp_path / "f.xml"))
    rows = {r.title: r for r in feed.collect()}
    assert rows["est"].published_at == dt.datetime(2024, 1, 2, 8, 4, 5) and rows["pdt"].published_at == dt.datetime(2024, 7, 2, 10, 4)
    assert rows["second"].published_at == dt.datetime(2024, 1, 2, 3, 4, 5) and rows["atom"].url == "u"
    good, unread = L.split_unread(feed)
    assert [r.title for r in unread.collect()] == ["bad"] and good.count() == 5
    assert [r.title for r in feed.orderBy("pos").collect()] == [*dates, "atom"]


def test_levels_of_tabs_are_read_one_at_a_time(spark, tmp_path):
    node = {"id": "deep", "view_count": 3}
    for _ in range(6):
        node = {"entries": [None, node]}
    lines = [{"channel": f"c{i}", "channel_follower_count": i, "entries": [{"id": f"v{i}"}, node, {"url": "u"}]} for i in range(5)]
    (tmp_path / "c.json").write_text("\n".join(json.dumps(x) for x in lines))
    rows = L.read_channels(spark, str(tmp_path / "c.json"))
    got = sorted((r.account, r.pos, r.url.rsplit("=", 1)[-1], r.view_count) for r in rows.collect())
    assert got == sorted(x for i in range(5) for x in [(f"c{i}", 0, f"v{i}", 0), (f"c{i}", 1, "deep", 3), (f"c{i}", 2, "u", 0)])
    assert "UnionLoop" not in rows._jdf.queryExecution().executedPlan().toString()  # which reads all levels together
