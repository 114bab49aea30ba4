"""Odd rows that the other tests leave out: URL rules, clashing names, huge components, empty tables of stages."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from newsloom.llm import language, line_dedup, topk, url_filter

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", "com", "/de/")]
URLS = [
    None, "", "no scheme", "http://", "https://a.org", "HTTPS://A.Example.ORG/es/x?q#f", "http://example.org/es", "http://xexample.org/es/", "http://shop.com/fr/1",
    "http://shop.com/de/1", "http://com/de/", "ftp://bad.net/x/", "http://www.bad.net/x", "http://bad.net/y", "x://bad.net/x#://other", "http://bad.net/" + "y" * 100_000,
]
LISTED = ["bad.net/x", None, "bad.net/x", "elsewhere.net/"]


def judged(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    key = re.sub("^(www|m)[.]", "", host)
    key = key + path.rstrip("/") if key else None
    best = max(fits, default=None)
    listed = key in [x for x in LISTED if x]
    return host, path, best and best[1], best[2] if best else "block" if listed else "allow", listed


def test_url_verdicts(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(5, URLS[5]), (None, URLS[11])]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' as host", "1 as block", "'r' as rule", "true as _maybe")
    for blocks in (1 << 19, 1):  # one block for all keys: every test says maybe, the exact join decides
        listed = spark.createDataFrame([(x,) for x in LISTED] + [(f"n{i}.net/",) for i in range(300)], "url_key string")
        got = url_filter.filter_urls(pages, listed, RULES, max_blocks=blocks).collect()
        want = [(i, *judged(u)) for i, u in rows]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_no_urls_and_no_list(spark):
    none = spark.createDataFrame([], "url_key string")
    pages = spark.createDataFrame([(1, "http://bad.net/x")], "page_id long, url string")
    assert [r.verdict for r in url_filter.filter_urls(pages, none, []).collect()] == ["allow"]
    assert url_filter.filter_urls(pages.limit(0), none, RULES).count() == 0


def test_line_dedup_keeps_columns_of_its_own_names(spark):
    line = "one two three four five six"
    df = spark.createDataFrame([(1, f"a\n{line}", 7, "g", "m"), (2, f"{line}\nb", 8, "h", "n")], "doc_id long, text string, removed int, _gone string, lines string")
    out = line_dedup.dedup_lines(df)
    assert sorted(out.columns) == sorted(df.columns)
    rows = {r.doc_id: r for r in out.collect()}
    assert (rows[1].text, rows[1]._gone, rows[1].lines, rows[1].removed) == (f"a\n{line}", "g", "m", None)
    assert rows[2].text == "b" and [tuple(x) for x in rows[2].removed] == [(0, 1)]


def test_top_k_of_huge_components(spark):
    rows = [(0, [1.0, 1.0]), (1, [1e30, 1.0]), (2, [-1e30, 0.0]), (3, [1e308, 0.0]), (4, [2.0, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 9).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**63 - 1), (4, 64 * 128), (2, -(2**63))]  # 64 * 1e308 is not finite


STAGES = dict(pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _n string, _copy string, n string, copy int, removed string, score string"


def test_stages_keep_clashing_columns(spark, sf_dir):
    rows = [(i, f"Some words of text number {i} that are like no other {i * i} {i * 7}", "en", "s", 60, "keep", "me", "n", 5, "r", "t") for i in range(6)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("language_id", "toxicity", "line_dedup", "jaccard_join"):
        out = STAGES[name](spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert len(kept) == 6 and {(r._n, r._copy, r.n, r.copy, r.score) for r in kept} == {("keep", "me", "n", 5, "t")}, name


def test_stages_of_nothing(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0, name


def plain_grams(text):
    words = ["".join(c for c in w) for w in re.findall(r"[^\W\d_]+", text.lower())]
    return [f"_{w}_"[i : i + 3] for w in words for i in range(len(w))]


def test_predictions_equal_plain_vectors(spark):
    """Profiles and cosines of the languages, gram by gram; equal cosines go to the first language by name."""
    rows = [(1, "the cat and the dog", "b"), (2, "le chat et le chien", "c"), (3, "der hund", "d"), (4, "the cat and the dog", "a")]
    asked = ["the dog", "le chien et", "hund der", "cat le", "zzz"]
    dims = 512
    vector = lambda text: sum(language.bound(np.array([c]), dims)[0].astype(float) for c in language.gram_codes([text])[1])
    assert all(len(language.gram_codes([t])[1]) == len(plain_grams(t)) for t in asked)
    profiles = {lang: vector(text) for _, text, lang in rows}
    learned = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), dims=dims)
    assert list(learned) == ["a", "b", "c", "d"]
    out = language.predict(spark.createDataFrame([(t,) for t in asked], "text string"), learned, keep=["text"], dims=dims).collect()
    for r in out:
        v = vector(r.text)
        cosines = {lang: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for lang, p in profiles.items()}
        best = max(cosines.values())
        assert math.isclose(r.score, max(best, 0), abs_tol=1e-5) and cosines[r.lang_pred] >= best - 1e-5 and r.lang_pred != "b"
