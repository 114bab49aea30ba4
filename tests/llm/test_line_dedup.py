"""Line dedup against all pairs of runs, and odd rows."""

import random

import pytest

from newsloom.llm.line_dedup import dedup_lines


def brute(docs, min_words):
    """Texts after deletion, by comparing every run with every earlier place."""
    sequence = []  # (doc, line number, text), None between documents
    for doc, text in docs:
        sequence += [(doc, i, x) for i, x in enumerate(text.split("\n")) if x.strip()] + [None]
    gone = set()
    for s in range(len(sequence)):
        for t in range(s):
            size = 0
            while sequence[s + size] and sequence[t + size] and sequence[s + size][2] == sequence[t + size][2]:
                size += 1
            if sum(len(x[2].split()) for x in sequence[s : s + size]) >= min_words:
                gone |= {x[:2] for x in sequence[s : s + size]}
    out = {}
    for doc, text in docs:
        kept = [x for i, x in enumerate(text.split("\n")) if (doc, i) not in gone]
        out[doc] = text if len(kept) == text.count("\n") + 1 else "\n".join(kept) if any(x.strip() for x in kept) else ""
    return out


@pytest.mark.parametrize("seed, min_words", [(1, 1), (2, 4), (3, 7)])
def test_equals_brute_force(spark, seed, min_words):
    rng = random.Random(seed)
    lines = ["a", "b", "c d", "e f g", "h i j k l m n", "", " "] + [f"own {i}" for i in range(40)]
    texts = ["\n".join(rng.choices(lines, k=rng.randint(1, 14))) for _ in range(50)]
    texts += [texts[3], "\n".join(texts[5:8]), "a\n" * 9, "x " + texts[4]]
    docs = list(enumerate(texts))
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_words).collect()}
    assert got == brute(docs, min_words)


def test_maximal_runs(spark):
    docs = [(1, "one two\nthree four\n\nfive six\nend of one"), (2, "start\none two\nthree four\n\nfive six\nend of two")]
    rows = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), 5).orderBy("doc_id").collect()
    assert rows[0].removed is None and rows[0].text == docs[0][1]
    assert rows[1].text == "start\n\nend of two"
    assert [tuple(r) for r in rows[1].removed] == [(1, 2), (4, 1)]


def test_odd_rows(spark):
    line = "a line of six words here"
    rows = [(3, None), (4, ""), (5, "\n\n"), (6, line), (6, line), (6, line + "\nmore"), (None, line), (7, line), (8, "\n" + line + "\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as doc", "'k' as copy", "2 as q", "doc_id as _gone_too")
    out = dedup_lines(df)
    assert out.columns == [*df.columns, "removed"]
    got = sorted(((r.doc_id or 0, r.text) for r in out.collect()), key=str)
    assert got == sorted([(0, line), (3, None), (4, ""), (5, "\n\n"), (6, ""), (6, ""), (6, "more"), (7, ""), (8, "")], key=str)
    assert dedup_lines(df.limit(0)).count() == 0
