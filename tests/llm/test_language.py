"""Language identification: held-out accuracy, the method on single n-grams, and odd rows."""

import numpy as np

from newsloom.llm import language
from newsloom.llm.queries import op5_language_id


def test_held_out_accuracy(spark, sf_dir):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op5_language_id(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(langs)
    assert all(0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.held_out and langs[r.doc_id]]
    assert len(tested) > 20
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in tested]) > 0.97


def test_binding_and_bundling():
    own, codes = language.gram_codes(["Ab, c", "", "zz"])
    slot = {"_": 0, "a": 1, "b": 2, "c": 3, "z": 26}
    grams = [(0, "_ab"), (0, "ab_"), (0, "_c_"), (2, "_zz"), (2, "zz_")]
    assert [(o, [c // 4096, c // 64 % 64, c % 64]) for o, c in zip(own.tolist(), codes.tolist())] == [(o, [slot[x] for x in g]) for o, g in grams]
    first, second, third = language.letter_vectors(128)
    assert (language.bound(codes[:1], 128)[0] == first[0] * second[1] * third[2]).all()
    assert abs(language.bound(np.arange(200, 260), 1024) @ language.bound(np.array([5]), 1024)[0]).max() < 200


def test_long_texts_are_whole(monkeypatch):
    text = "some words and more words " * 40
    whole = np.bincount(language.gram_codes([text])[1], minlength=64**3)
    monkeypatch.setattr(language, "BATCH", 50)
    cut = sum(np.bincount(language.gram_codes(parts)[1], minlength=64**3) for _, parts in language._parts([text]))
    assert (cut == whole).all()


def test_odd_rows(spark):
    rows = [(1, "aaa bab aba", "x"), (2, "zzy yzz zyz", "y"), (3, None, "x"), (4, "", "y"), (5, "12 !?", "x"), (6, "aba", None), (6, "zyz", None), (None, "bab", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' as score", "2 as profile")
    profiles = language.learn(docs)
    got = sorted(((r.doc_id or 0, r.lang_pred) for r in language.predict(docs, profiles, keep=["doc_id"]).collect()))
    assert got == [(0, "x"), (1, "x"), (2, "y"), (3, "und"), (4, "und"), (5, "und"), (6, "x"), (6, "y")]
    assert {r.lang_pred for r in language.predict(docs, {}, keep=["doc_id"]).collect()} == {"und"}
    assert language.learn(docs.limit(0)) == {} and language.predict(docs.limit(0), profiles, keep=["doc_id"]).count() == 0
