"""Merkle manifests against a plain tree, and the states that parents retain."""

import hashlib
import zlib

from pyspark.sql import functions as F

from newsloom.llm import merkle

SCHEMA = "doc_id long, source string, text string, key string, pos int, n string, digest string, changed string, id int, row int, subtree int"
CLASH = ("k", 1, "n", "d", "c", 7, 8, 9)
FIELDS = ["doc_id", "source", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:3]))


def climb(nodes, place):
    """Siblings of every level above ``place`` and the last node."""
    levels = []
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        levels.append((place % 16, runs[place // 16]))
        nodes, place = [h(*run) for run in runs], place // 16
    return levels, nodes[0]


def plain(rows, changed):
    """(doc_id, leaf, subroot, root, proof, folded root) of every row."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = {}, []
    for source in order:
        own = sorted(groups[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[source] = own, [leaf(r) for r in own]
    tops = [climb(leaves, 0)[1] for _, leaves in trees.values()]
    for place, source in enumerate(order):
        above, root = climb(tops, place)
        own, leaves = trees[source]
        for i, row in enumerate(own):
            inside, subroot = climb(leaves, i)
            now, proof = leaf(changed(row)), []
            for slot, run in inside + above:
                proof += run[:slot] + run[slot + 1 :]
                now = h(*run[:slot], now, *run[slot + 1 :])
            out.append((row[0], leaves[i], subroot, root, h(*proof), now, now == root))
    return out


def tampered(row):
    hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
    return (row[0], row[1], None if row[2] is None else row[2].lower()) if hit else row


def check(spark, rows):
    docs = spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA).repartition(3)
    fields = [F.col(f) for f in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    manifest = merkle.build(docs, fields, id_col="doc_id", group_col="source", changed=[*fields[:2], F.lower("text")], where=hit)
    got = [tuple(r) for r in manifest.check().collect()]
    assert sorted(got, key=str) == sorted(plain(rows, tampered), key=str)
    return manifest


def test_trees_of_all_sizes(spark):
    """A hot source of several rounds, a lone leaf, runs of one, more than 16 sources."""
    rows = [(i, "hot", f"Text {i}") for i in range(600)]
    rows += [(1000 + i, f"s{i % 19}", f"Word{i} Ä" * (i % 4)) for i in range(40)]
    rows += [(2000 + i, "seventeen", "A") for i in range(17)] + [(3000, "alone", "B"), (3001, "", "empty name"), (3002, "é", "C")]
    manifest = check(spark, rows)
    assert len(manifest.rounds) == 3 and len(manifest.tops) == 2


def test_nulls_repeats_and_long_texts(spark):
    rows = [(None, None, None), (None, "a", "X"), (None, "a", "X"), (5, "a", "Same"), (5, "a", "Same"), (5, "a", "Other"), (6, None, "-"), (6, None, None)]
    check(spark, rows + [(7, "a", "Q" * 3_000_000), (8, "a", "")])


def test_lone_leaf_and_nothing(spark):
    manifest = check(spark, [(1, "a", "Only")])
    row = manifest.check().first()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == h()
    assert check(spark, []).root is None


def test_null_is_unlike_its_dash(spark):
    df = spark.createDataFrame([(None,), ("-",), ("",)], "t string")
    assert [r[0] for r in df.select(merkle.leaf_of([F.col("t")])).collect()] == [h("-"), h("1:-"), h("0:")]


def test_parents_fold_from_the_state_of_the_slot():
    """What stands left of the slot is not looked at: only the retained state knows it."""
    children = [h(str(i)).encode() for i in range(9)]
    parent = merkle.Parent(b"".join(children))
    assert len(parent.states) == 9
    new = h("new").encode()
    for slot in range(9):
        want = hashlib.sha256(b"".join([*children[:slot], new, *children[slot + 1 :]])).hexdigest().encode()
        parent.run = b"?" * 64 * slot + b"".join(children[slot:])
        assert parent.fold(slot, new) == want
        assert parent.fold(slot, children[slot]) == parent.digest  # the retained copies are not used up
