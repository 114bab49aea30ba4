"""Toxicity: held-out recall and false alarms, folding, exceptions, odd rows."""

import pytest
from pyspark.sql import functions as F

from newsloom.llm import toxicity
from newsloom.llm.queries import op7_toxicity


def test_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = op7_toxicity(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    tested = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    caught = sum(p for p, y in tested if y) / sum(y for _, y in tested)
    false = sum(p for p, y in tested if not y) / sum(1 - y for _, y in tested)
    assert caught > 0.65 and false < 0.02


@pytest.fixture(scope="module")
def model():
    out = toxicity.Model({" idiot ": 5.0, " lostra": 4.0, " trash ": 5.0}, 9.0, -4.0)
    return out


def test_folding_and_exceptions(spark, model):
    texts = {
        0: "You IDIOT!", 1: "an 1d10t", 2: "an ｉｄｉｏｔ", 3: "аn іdіоt", 4: "lostrabau", 5: "idiotic word", 6: "the trash can", 7: "trash", 8: None, 9: "",
        10: "blostra", 11: "idiot " + "word " * 50_000,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 as amount", "'x' as toxic")
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model, keep=["doc_id"]).collect()}
    assert [k for k, v in sorted(got.items()) if v] == [0, 1, 2, 3, 4, 7]
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model, keep=["doc_id"]).collect()}
    assert scores[8] < scores[11] < scores[0]  # the longer, the weaker


def test_learns_words_and_beginnings_not_copies(spark):
    bad = [(i, f"w{chr(97 + i % 26)} gunk{'abcdefgh'[i % 8]} tail{chr(97 + i % 20)}", 1) for i in range(80)]
    copies = [(100 + i, "rareone rarely seen", 1) for i in range(80)]
    good = [(300 + i, f"w{chr(97 + i % 26)} plain tail{chr(97 + i % 20)}", 0) for i in range(600)]
    rows = spark.createDataFrame(bad + copies + good, "doc_id long, text string, toxic int")
    found = toxicity.learn(rows.drop("toxic"), rows.drop("text").unionByName(rows.select("doc_id", F.lit(None).cast("int").alias("toxic"))))
    assert set(found.weights) == {" gunk"}


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (2, 1), (None, 1)], "doc_id long, toxic int")
    empty = toxicity.learn(docs, labels)
    assert empty.weights == {}
    assert [(r.score, r.predicted) for r in toxicity.score(docs, empty, keep=["doc_id"]).collect()] == [(0.0, 0)] * 3
    assert toxicity.score(docs.limit(0), empty, keep=["doc_id"]).count() == 0
