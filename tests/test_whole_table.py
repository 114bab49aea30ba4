"""The registered near-copy queries compare the whole table, however far apart the ids are."""

import pytest

import __spark_entry__ as entry_points


@pytest.fixture(scope="module")
def far_copies(spark, tmp_path_factory):
    """2,100 documents of which three pairs are copies or near-copies, more than 1,000 ids apart."""
    texts = [f"title{i:04d}{i * 7919 % 9973:04d}\n" + " ".join(f"w{i}x{k}" for k in range(9)) for i in range(2100)]
    texts[5] = texts[2005] = "Oil prices fall two percent\n" + " ".join(f"oil{k}" for k in range(9))
    texts[7] = "Banks keep rates as they are\n" + " ".join(f"bank{k}" for k in range(9))
    texts[1700] = texts[7].replace("rates", "Rates") + " more"
    texts[9], texts[1009] = ("Gold rises to a record today\n" + " ".join(f"gold{k}" for k in range(n)) for n in (9, 10))
    rows = [(i, t, "en", f"s{i % 1001}", len(t)) for i, t in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("far"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder


PAIRS = {2005: 5, 1700: 7, 1009: 9}


def test_near_duplicate_texts(spark, far_copies):
    assert {r.id: r.leader for r in entry_points.queries()["near_duplicate_texts"](spark, far_copies).collect()} == PAIRS


def test_issue_digest(spark, far_copies):
    rows = entry_points.queries()["issue_digest"](spark, far_copies).collect()
    assert {r.cluster_id: (r.n_articles, r.n_sources) for r in rows} == dict.fromkeys(PAIRS.values(), (2, 2))


def test_near_duplicate_titles(spark, far_copies):
    found = {r.id: r.leader for r in entry_points.queries()["near_duplicate_titles"](spark, far_copies).collect()}
    assert {k: found.get(k) for k in PAIRS} == PAIRS
