"""Katz scores against a model in plain dictionaries."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.llm import katz, queries

TOP = katz.TOP


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [""]


def discount(values):
    tally = Counter(values)
    out = {}
    for c in range(1, TOP + 1):
        out[c] = (c - 0.5) / c
        if tally[1] and tally[c]:
            beyond = (TOP + 1) * tally[TOP + 1] / tally[1]
            if beyond < 1:
                d = ((c + 1) * tally[c + 1] / tally[c] / c - beyond) / (1 - beyond)
                out[c] = d if 0 < d < 1 else out[c]
    return out


class Plain:
    def __init__(self, texts):
        self.one, self.two, self.after = Counter(), Counter(), Counter()
        for text in texts:
            before = None
            for w in tokens(text):
                self.one[w] += 1
                self.two[before, w] += 1
                self.after[before] += 1
                before = w
        self.n, self.v = sum(self.one.values()), len(self.one)
        self.d1, self.d2 = discount(self.one.values()), discount(self.two.values())
        left = sum((1 - self.d1[c]) * c for c in self.one.values() if c <= TOP)
        self.total = self.n if left else self.n + 1
        self.unknown = (left or 1) / self.total
        self.followers = {}
        for (v, w), c in self.two.items():
            self.followers.setdefault(v, {})[w] = c

    def word(self, w):
        c = self.one[w]
        return self.d1.get(c, 1) * c / self.total if c else self.unknown

    def pair(self, v, w):
        own = self.followers.get(v)
        if not own:
            return self.word(w)
        left = sum((1 - self.d2[c]) * c for c in own.values() if c <= TOP)
        events = self.after[v] if left else self.after[v] + 1
        if w in own:
            return self.d2.get(own[w], 1) * own[w] / events
        return (left or 1) / events * self.word(w) / (1 - sum(self.word(x) for x in own))

    def score(self, text):
        words = tokens(text)
        return sum(math.log10(self.pair(v, w)) for v, w in zip([None, *words], words, strict=False))

    def base(self, text):
        return sum(math.log10((self.one[w] + 1) / (self.n + self.v + 1)) for w in tokens(text))


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Das", "É", "ﬁ", "a b", "x\x1cy", "the"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = [(i, rng.choice(["", " ", "\t"]) + rng.choice([" ", "  ", "\n", "\x0b "]).join(rng.choices(vocabulary, weights, k=rng.randrange(0, 40)))) for i in range(n)]
    rows += [(n + i, "the same sentence again and again " * 3) for i in range(n // 3)]
    rows += [(900 + i, t) for i, t in enumerate([None, "", "  \n ", "unseen-word", "unseen the", "the unseen", "q " * 5000])] + [(3, "Repeated id"), (None, "no id"), (None, "no id")]
    return rows


def compare(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "'x' as part", "2 as teaches").repartition(3)
    aside = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    got = katz.score(df, ~aside, **sizes).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    model = Plain([t for i, t in rows if not held(i)])
    want = [
        (i, not held(i), len(tokens(t)), sum(model.one[w] > 0 for w in tokens(t)), model.n, round(model.base(t), 7), round(model.score(t), 7)) for i, t in rows
    ]
    mine = [(*r[:5], round(r.base_score, 7), round(r.score, 7)) for r in got]
    order = lambda r: (str(r[0]), r[2], r[6])
    for a, b in zip(sorted(mine, key=order), sorted(want, key=order), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=2e-7)
    return model


@pytest.mark.parametrize("seed, hot, sizes", [(1, 4096, {}), (2, 12, {"block_bytes": 700, "part_bytes": 500}), (3, 3, {"block_bytes": 3000, "part_bytes": 200})])
def test_equals_plain_model(spark, monkeypatch, seed, hot, sizes):
    monkeypatch.setattr(katz, "HOT", hot)
    model = compare(spark, corpus(seed, 120), **sizes)
    for v in [None, "w0", "w3", "the", "same", "not met"]:  # exactly normalised
        assert math.isclose(sum(model.pair(v, w) for w in model.one) + model.pair(v, "never met"), 1)


def test_nothing_learned_and_nothing_at_all(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in katz.score(df, F.lit(False)).collect()}
    assert [(got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].base_score, got[i].score) for i in (1, 2)] == [(3, 0, 0, 0, 0), (1, 0, 0, 0, 0)]
    assert katz.score(df.limit(0), F.lit(True)).count() == 0


def test_contexts_without_rare_words(spark):
    compare(spark, [(i, "a b c") for i in range(40)] + [(50 + i, "a b") for i in range(9)] + [(80, "a c b x")])


def test_pair_table_is_the_stored_model(spark):
    rows = corpus(5, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, pairs = katz.learn_and_score(df, F.lit(True), "doc_id", "text", 4000, 900, True)
    parts = [(katz.unpack(r.numbers), katz.unpack(r.counts)) for r in pairs.filter("kind = 'model'").collect()]
    model = Plain([t for _, t in rows])
    assert len(parts) > 1 and sorted(np.concatenate([c for _, c in parts]).tolist()) == sorted(model.two.values())


def test_packing():
    rng = np.random.default_rng(1)
    for x in (np.zeros(0, np.int64), np.arange(300), rng.integers(0, 1 << 40, 1000), np.array([True, False])):
        assert katz.unpack(katz.pack(x)).tolist() == x.astype(int).tolist()
    v, w = rng.integers(0, 9, 400), rng.integers(0, 9, 400)
    for base in (10, 1 << 40):  # both ways to number pairs
        a, b, at = katz.distinct_pairs(v, w, base)
        assert sorted(zip(a, b, strict=True)) == sorted(set(zip(v, w, strict=True))) and (a[at] == v).all() and (b[at] == w).all()


def test_words_of_a_text():
    texts = ["A b\tB", "", None, "  x\x1c   ", "Ä\r\nÄ"]
    codes, words, lengths = katz.tokens_of(pa.array([t or "" for t in texts]))
    flat = [words[c].decode() for c in codes]
    assert flat == [w for t in texts for w in tokens(t)] and lengths.tolist() == [len(tokens(t)) for t in texts]


def test_held_out_texts_are_likelier_than_by_words_alone(spark, sf_dir):
    rows = queries.op13_katz_scores(spark, sf_dir).filter("held_out").collect()
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


class PlainTriples(Plain):
    def __init__(self, texts):
        super().__init__(texts)
        self.three = Counter()
        for text in texts:
            words = [None, *tokens(text)]
            self.three.update(zip(words, words[1:], words[2:], strict=False))
        self.d3 = discount(self.three.values())
        self.ends = {}
        for (u, v, w), c in self.three.items():
            self.ends.setdefault((u, v), {})[w] = c

    def triple(self, u, v, w):
        own = self.ends.get((u, v))
        if not own:
            return self.pair(v, w)
        left = sum((1 - self.d3[c]) * c for c in own.values() if c <= TOP)
        events = self.two[u, v] if left else self.two[u, v] + 1
        if w in own:
            return self.d3.get(own[w], 1) * own[w] / events
        return (left or 1) / events * self.pair(v, w) / (1 - sum(self.pair(v, x) for x in own))

    def score(self, text):
        words = [None, *tokens(text)]
        return math.log10(self.pair(None, words[1])) + sum(math.log10(self.triple(*x)) for x in zip(words, words[1:], words[2:], strict=False))


@pytest.mark.parametrize("seed, hot, sizes", [(1, 4096, {}), (2, 12, {"block_bytes": 700, "part_bytes": 500}), (3, 200, {"block_bytes": 3000, "part_bytes": 200})])
def test_triples_equal_plain_model(spark, monkeypatch, seed, hot, sizes):
    monkeypatch.setattr(katz, "HOT", hot)
    monkeypatch.setattr(f"{__name__}.Plain", PlainTriples)
    model = compare(spark, corpus(seed, 120), order=3, **sizes)
    for u, v in [(None, "w0"), ("w0", "w1"), ("the", "same"), ("same", "sentence"), ("w1", "not met")]:  # exactly normalised
        assert math.isclose(sum(model.triple(u, v, w) for w in model.one) + model.triple(u, v, "never met"), 1)


def test_triples_without_training_rows_and_without_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [r.score for r in katz.score(df, F.lit(False), order=3).collect()] == [0, 0]
    assert katz.score(df.limit(0), F.lit(True), order=3).count() == 0


def test_query_scores_by_triples(spark, sf_dir):
    docs = {r.doc_id: r.text for r in queries.read(spark, sf_dir, "documents").collect()}
    model = PlainTriples([t for i, t in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2])
    for r in queries.op13_katz_scores(spark, sf_dir).collect():
        assert r.score == pytest.approx(model.score(docs[r.doc_id]), rel=1e-9)
