"""The pipeline's Jaccard stage where ids clash."""

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(name, n=40):
    return " ".join(f"{name}{i}" for i in range(n))


def kept(spark, rows):
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], SCHEMA).repartition(3)
    out = pipeline.keep_one_of_group(spark, docs, "")
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    a, b, c = words("a"), words("b"), words("c")
    rows = [(1, a), (1, b), (2, b + " more"), (3, a + " more"), (3, c), (4, c), (5, words("e")), (5, words("e")), (6, ""), (6, ""), (7, None), (None, a)]
    want = [(1, a), (1, b), (3, c), (5, words("e")), (6, ""), (7, None), (None, a)]
    assert kept(spark, rows) == sorted(want, key=str)


def test_equal_rows_are_one(spark):
    a = words("a")
    assert kept(spark, [(1, a), (1, a), (2, a), (3, words("b"))]) == sorted([(1, a), (3, words("b"))], key=str)
