"""Tiles of sets, titles and vectors against brute force, and what the tasks exchange."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import dedup, meets


def shuffled_tables(monkeypatch):
    """Rows that go from task to task to be compared."""
    seen = []
    met = meets._meet

    def watched(pieces, rule):
        seen.append(pieces.count())
        return met(pieces, rule)

    monkeypatch.setattr(meets, "_meet", watched)
    return seen


def test_no_meetings_leave_the_tasks(spark, monkeypatch):
    """500 texts with common words meet as a few packed rows, not as 100,000 shared words."""
    seen = shuffled_tables(monkeypatch)
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.sample([f"w{k}" for k in range(40)], 14))) for i in range(500)]
    got = dedup.duplicate_texts(spark.createDataFrame(rows, "id long, text string").repartition(2)).collect()
    sets, kept, want = [set(t.split()) for _, t in rows], [], {}
    for i, s in enumerate(sets):
        hit = next((k for k in kept if len(s & sets[k]) / len(s | sets[k]) >= 0.6), None)
        if hit is None:
            kept.append(i)
        else:
            want[i] = hit
    assert {r.id: r.leader for r in got} == want and want
    assert seen and sum(seen) <= 40


@pytest.mark.parametrize("ratio", [0.9, 0.6])
def test_titles_of_all_lengths(spark, monkeypatch, ratio):
    """Short titles, long ones, repeated letters; tiles meet tiles."""
    monkeypatch.setattr(meets, "_tiles", lambda rows, entries: 3)
    rnd = random.Random(2)
    titles = ["", "a", "aa", "ab", "a" * 15, "a" * 16, "a" * 17, "a" * 18, "ab" * 8, "ab" * 9, "x" * 300, "x" * 299 + "y", None]
    for n in (3, 8, 14, 15, 16, 17, 18, 30, 60, 250):
        base = "".join(rnd.choices("abcdefg hij", k=n))
        for _ in range(5):
            t = list(base)
            for _ in range(rnd.randrange(0, max(2, n // 10 + 2))):
                t[rnd.randrange(len(t))] = rnd.choice(["", "z", "qq"])
            titles.append("".join(t))
    text = [(t or "").lower() for t in titles]
    kept, want = [], {}
    for i, t in enumerate(text):
        hit = next((k for k in kept if SequenceMatcher(None, t, text[k]).ratio() > ratio), None) if t else None
        if hit is not None:
            want[i] = hit
        elif t:
            kept.append(i)
    df = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    assert {r.id: r.leader for r in dedup.duplicate_titles(df, ratio, split_rows=25).collect()} == want and len(want) > 10


def test_vectors_and_batches(spark, monkeypatch):
    monkeypatch.setattr(meets, "_tiles", lambda rows, entries: 2)
    rnd = random.Random(3)
    rows = []
    for i in range(60):
        v = {f"t{rnd.randrange(12)}": rnd.random() + 0.1 for _ in range(rnd.randrange(1, 7))}
        norm = sum(x * x for x in v.values()) ** 0.5
        rows.append((i, None if i % 3 == 0 else str(i % 3), list(v), [x / norm for x in v.values()]))
    want = {
        (a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1]
        and sum(x * dict(zip(b[2], b[3])).get(t, 0.0) for t, x in zip(a[2], a[3])) > 0.7
    }
    df = spark.createDataFrame(rows, "id long, batch string, tokens array<string>, weights array<double>")
    rule = meets.Vectors(0.7)
    assert {(r.a, r.b) for r in meets.similar_within(df, rule, 60, 5).collect()} == want and len(want) > 5
    old, new = df.filter("id < 25"), df.filter("id >= 25")
    assert {(r.a, r.b) for r in meets.similar_between(old, new, rule, (25, 35), 5).collect()} == {p for p in want if p[0] < 25 <= p[1]}


def test_many_equal_titles_make_no_pairs(spark, monkeypatch):
    """600 clusters, 400 of them with one title: the copies join the first without being paired."""
    from newsloom.operators import density

    seen = []
    greedy = meets.greedy_leaders
    monkeypatch.setattr(meets, "greedy_leaders", lambda pairs: seen.append(pairs.count()) or greedy(pairs))
    rows = [(i, i, "oil price rises sharply" if i % 3 else f"bank number{i} holds rate{i} today{i}") for i in range(600)]
    rows += [(600, 600, "oil price rises sharply"), (601, 601, "bank number0 holds rate0 today0"), (602, 602, "gold falls"), (603, 603, "gold falls gold falls")]
    df = spark.createDataFrame(rows, "pos bigint, cluster_id int, title string")
    got = {r["pos"]: r["cluster_id"] for r in density.merge_similar_clusters(df).collect()}
    assert got == {p: 1 if t.startswith("oil") else 0 if p == 601 else got[p] if p == 603 else p for p, _, t in rows}
    assert sum(seen) <= 2


def test_landed_files_grow_with_the_table(spark):
    from newsloom.queries import plan_queries

    assert plan_queries._files(spark.range(10).repartition(40)) == 40 and plan_queries._files(spark.range(10).coalesce(1)) == 3


def test_scripts_are_checked_once(spark, sf_dir, monkeypatch):
    """Ready and rejected scripts are read from one check of the records."""
    from newsloom.plans import scripts
    from newsloom.queries.record_queries import script_gate

    made = []
    cut = scripts.cut_lineage
    monkeypatch.setattr(scripts, "cut_lineage", lambda df, name="step": made.append(name) or cut(df, name))
    assert script_gate(spark, sf_dir).count() > 0 and made == ["validated"]


def test_runs_exchange_no_meetings(spark, monkeypatch):
    """A run meets what earlier runs kept as packed rows."""
    from newsloom.operators.run_index import text_index
    from newsloom.session import scratch_path

    seen = shuffled_tables(monkeypatch)
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.sample([f"w{k}" for k in range(40)], 14))) for i in range(200)]
    index = text_index(spark, scratch_path(spark, "index"))
    found = []
    for run in (0, 1):
        part = spark.createDataFrame(rows[run * 100 : run * 100 + 100], "id long, text string").repartition(2)
        found += [(r.id, r.leader) for r in index.add(part, run).collect()]
    whole = spark.createDataFrame(rows, "id long, text string")
    assert len(seen) == 4 and sum(seen) <= 16  # before, 0: pairs of entries were joined
    assert sorted(found) == sorted((r.id, r.leader) for r in dedup.duplicate_texts(whole).collect())


def test_few_long_titles_are_compared_letter_by_letter(monkeypatch):
    rng = random.Random(3)
    parts = [s for s in "the er on and ing tion st ent re ed or in of to a is th ou ea ble wh es".split() for _ in range(1 + rng.randrange(9))]
    texts = ["".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randrange(260, 330))) for _ in range(80)]
    texts += [t[:100] + "x" + t[101:400] + t[402:] for t in texts[::8]]
    tile = meets.Tile(np.arange(len(texts)), np.zeros(len(texts), np.int64), None, texts)
    calls, plain = [], meets.Titles._match
    monkeypatch.setattr(meets.Titles, "_match", lambda *args: calls.append(1) or plain(*args))
    found = {(int(j), int(i)) for a, b in meets.Titles(0.9).similar(tile, tile, 0, True) for i, j in zip(np.maximum(a, b), np.minimum(a, b))}
    assert found == {(8 * k, 80 + k) for k in range(10) if SequenceMatcher(None, texts[80 + k], texts[8 * k]).ratio() > 0.9} and len(found) > 5
    assert len(calls) < 400  # of some 4,000 pairs, most of which have half of their runs in common
