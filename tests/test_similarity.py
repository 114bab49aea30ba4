"""Similarity joins and leader selection against plain scans."""

import random
import re
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from newsloom.operators import dedup, density, leaders, pairs, vectors
from newsloom.queries.registry import articles


def scan(keys, similar):
    """One-by-one scan: {dropped: first kept it resembles}."""
    kept, dropped = [], {}
    for k in keys:
        hit = next((o for o in kept if similar(k, o)), None)
        if hit is None:
            kept.append(k)
        else:
            dropped[k] = hit
    return dropped


def as_dict(df):
    rows = [tuple(r) for r in df.select("id", "leader").collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return dict(rows)


@pytest.mark.parametrize("seed", range(4))
def test_greedy_leaders_equals_scan(spark, seed):
    rnd = random.Random(seed)
    edges = {tuple(sorted(rnd.sample(range(30), 2))) for _ in range(rnd.choice([15, 40, 90]))}
    got = as_dict(leaders.greedy_leaders(spark.createDataFrame(sorted(edges), "a bigint, b bigint")))
    assert got == scan(range(30), lambda k, o: (o, k) in edges)


def test_chain_keeps_first_and_third(spark):
    df = spark.createDataFrame([(1, 2), (2, 3)], "a bigint, b bigint")
    assert as_dict(leaders.greedy_leaders(df)) == {2: 1}
    assert as_dict(leaders.greedy_leaders(df.limit(0))) == {}


def token_set(text):
    return frozenset(re.findall(r"[가-힣A-Za-z0-9.%]+", text.lower()))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def near_copies(seed, n):
    """Texts of which a third are copies or near-copies of one."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = rnd.sample(words, 12)
    texts = []
    for i in range(n):
        if i % 3 == 0:
            t = list(base)
            for _ in range(rnd.randint(0, 4)):
                t[rnd.randrange(12)] = rnd.choice(words)
        else:
            t = rnd.sample(words, rnd.randint(0, 10))
        texts.append(" ".join(t))
    return texts


@pytest.mark.parametrize("seed, limits", [(1, {}), (2, {"split_rows": 10, "pairs_per_row": 0}), (3, {"split_rows": 1, "pairs_per_row": 0})])
def test_duplicate_texts_equals_scan(spark, seed, limits):
    texts = near_copies(seed, 90)
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    sets = [token_set(t) for t in texts]
    want = scan(range(len(texts)), lambda k, o: jaccard(sets[k], sets[o]) >= 0.6)
    assert as_dict(dedup.duplicate_texts(df, **limits)) == want


@pytest.mark.parametrize("limits", [{}, {"split_rows": 20, "pairs_per_row": 0}])
def test_duplicate_titles_equals_scan(spark, sf_dir, limits):
    rows = [(r["pos"], r["title"]) for r in articles(spark, sf_dir).select("pos", "title").orderBy("pos").collect()]
    rows += [(10_000 + p, t[:-1] + "x") for p, t in rows[:40]] + [(20_000, ""), (20_001, None)]
    text = {p: (t or "").lower() for p, t in rows}
    want = scan([p for p, t in rows if t], lambda k, o: SequenceMatcher(None, text[k], text[o]).ratio() > 0.9)
    df = spark.createDataFrame(rows, "id bigint, title string")
    assert as_dict(dedup.duplicate_titles(df, **limits)) == want


def test_titles_are_compared_inside_a_batch_only(spark):
    df = spark.createDataFrame([(1, "a", "Oil falls 2%"), (2, "b", "Oil falls 2%"), (3, "a", "Oil falls 2.5%")],
                               "id bigint, batch string, title string")
    assert as_dict(dedup.duplicate_titles(df)) == {3: 1}


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.85])
def test_cosine_pairs_equal_brute_force(spark, threshold):
    rnd = random.Random(5)
    raw = {i: {f"t{rnd.randrange(25)}": rnd.random() + 0.1 for _ in range(rnd.randint(1, 8))} for i in range(40)}
    for i in range(10):
        raw[40 + i] = {t: w * rnd.uniform(0.9, 1.1) for t, w in raw[i].items()}
    df_of = Counter(t for v in raw.values() for t in v)
    unit = {i: {t: w / sum(x * x for x in v.values()) ** 0.5 for t, w in v.items()} for i, v in raw.items()}
    rows = [(i, t, w, df_of[t]) for i, v in unit.items() for t, w in v.items()]
    got = {(r["a"], r["b"]): r["cosine"] for r in pairs.cosine_pairs(
        spark.createDataFrame(rows, "id bigint, term string, weight double, df bigint"), threshold).collect()}
    want = {}
    for i in unit:
        for j in unit:
            c = sum(w * unit[j].get(t, 0) for t, w in unit[i].items())
            if i < j and c > threshold:
                want[(i, j)] = c
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [tuple(rnd.sample(range(60), 2)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["id"]: r["root"] for r in density.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in {v for e in edges for v in e}}


TEXTS = [("Oil rises", "Oil rises again today"), ("", "just a body  here"), (" lead", "x y"), ("tail ", " z"), ("a", ""),
         ("금리 인상", "금리 인상\n\n발표"), ("The the", "the"), ("x y", "")]


def test_term_counts_equal_counts_of_the_full_text(spark):
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(TEXTS)], "id bigint, title string, body string")
    stop = ["the", "a"]
    words = df.select("id", F.inline(vectors.word_terms(F.col("title"), F.col("body"), stop)))
    chars = df.select("id", F.inline(vectors.char_terms(F.col("title"), F.col("body"))))
    for i, (title, body) in enumerate(TEXTS):
        text = ((title + " ") * 10 + body).lower()
        w = [x for x in re.findall(r"\w\w+", text) if x not in stop]
        want = Counter(w + [f"{x} {y}" for x, y in zip(w, w[1:])])
        got = Counter()
        for r in words.filter(F.col("id") == i).collect():
            got[r["term"]] += r["n"]
        assert got == want, title
        squeezed = re.sub(r"\s\s+", " ", text)
        want = Counter(squeezed[k:k + n] for n in (2, 3, 4) for k in range(len(squeezed) - n + 1))
        got = Counter()
        for r in chars.filter(F.col("id") == i).collect():
            got[r["term"]] += r["n"]
        assert got == want, title


def test_density_clusters(spark):
    # 0-1-2-3 chain of cores with border 4; 7 is a border of core 5 (5 stands for three copies); 9 is alone
    nodes = spark.createDataFrame([(i, 3 if i == 5 else 1) for i in range(10)], "id bigint, copies bigint")
    edges = spark.createDataFrame([(0, 1, .9), (0, 2, .9), (1, 2, .9), (2, 3, .9), (1, 3, .9), (3, 4, .8), (5, 7, .9)],
                                  "a bigint, b bigint, cosine double")
    got = {r["id"]: r["cluster_id"] for r in density.density_clusters(nodes, edges, 3, 2).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 7: 5, 6: -1, 8: -1, 9: -1}
    assert density.default_sizes(7) == (2, 1) and density.default_sizes(100) == (5, 2) and density.default_sizes(8) == (2, 1)


def test_similar_titles_merge_to_the_lowest_cluster(spark):
    rows = [(0, 3, "Oil price rises sharply"), (1, 3, "Oil price rises"), (2, 5, "Oil price rises sharply"),
            (3, 8, "Bank holds rates"), (4, -1, "Oil price rises sharply")]
    df = spark.createDataFrame(rows, "pos bigint, cluster_id int, title string")
    got = {r["pos"]: r["cluster_id"] for r in density.merge_similar_clusters(df).collect()}
    assert got == {0: 3, 1: 3, 2: 3, 3: 8, 4: -1}
