"""Jaccard components against all pairs, with small parts so that families are cut, and odd rows."""

import random
import re

import numpy as np
import pytest

from newsloom.llm import jaccard


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def brute(docs, size, share):
    sets = {d: shingles(t, size) for d, t in docs}
    low = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(low[a], low[b])
            changed |= low[a] != least or low[b] != least
            low[a] = low[b] = least
    return {d: (len(s), low[d]) for d, s in sets.items()}


def corpus(seed):
    """Families with slight and with large changes, copies, a passage many share, short texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("ABcdefghij") + rng.choice("klmnop") + str(rng.randint(0, 99))
    texts = ["", "a", "A", "a b", "a b c", "A b C", "a b c d", "a b c d e", " \n\t", "é É"]
    passage = [word() for _ in range(40)]
    for family in range(6):
        base = [word() for _ in range(rng.randint(20, 90))]
        for _ in range(30):
            own = list(base)
            for _ in range(rng.randint(0, 2 + family)):
                own[rng.randrange(len(own))] = word()
            texts.append(rng.choice([" ", "\n", "  "]).join(own))
    texts += [" ".join(passage + [word() for _ in range(rng.randint(1, 60))]) for _ in range(60)]
    texts += [texts[20]] * 25 + [" ".join(word() for _ in range(30)) for _ in range(40)]
    rng.shuffle(texts)
    return list(enumerate(texts, start=5))


@pytest.mark.parametrize("seed, size, share, part_rows", [(1, 4, 85, 1000), (2, 4, 85, 7), (3, 5, 80, 11), (4, 1, 60, 13)])
def test_components_equal_brute_force(spark, monkeypatch, seed, size, share, part_rows):
    monkeypatch.setattr(jaccard, "BYTES_PER_RANGE", 9000)
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as doc", "1 as key", "2 as n").repartition(3)
    rows = jaccard.jaccard_components(df, size, share, part_rows=part_rows).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(docs, size, share)
    assert len(rows) == len(docs)


def test_odd_rows(spark):
    text = "one two three four five six seven eight"
    other = "nine ten eleven twelve thirteen fourteen"
    rows = [(9, text), (3, text), (None, text), (4, None), (5, ""), (6, other), (6, text), (7, other), (7, other), (8, "  x")]
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()))
    assert got == [(0, 5, 0), (3, 5, 3), (4, 0, 4), (5, 0, 5), (6, 3, 3), (6, 5, 3), (7, 3, 3), (7, 3, 3), (8, 1, 8), (9, 5, 3)]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(none).count() == 0


def test_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(50)]
    got = jaccard.overlaps(sets[:20], sets)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:20]]
