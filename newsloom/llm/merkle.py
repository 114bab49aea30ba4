"""Merkle manifest of a dataset: digests by group, proofs, and checks by retained hash states.

A leaf is the sha256 of a row's fields. The leaves of a group, in order, are joined by runs of
16 until one node is left, the group's subroot; the subroots, in order of their groups, give the
root in the same way. All digests are lowercase hex text, and a parent hashes the text of its
children.

A child is one block of sha256, so the hash of a parent passes through a well-defined state
before each child slot. :class:`Parent` retains a copy of the state before every slot. To see
what a changed child does to the root, a parent takes the copy of the slot, adds the replacement
and the siblings to the right; what lies to the left is not hashed again. Hash states cannot
leave a process, so a task sets up each parent of its subtree and of the path above it once, and
all rows of the subtree are folded by it.

Leaves are numbered inside their group by a range sort (no group is held in one place) and dealt
out in subtrees of 16 x 16 leaves. One round rises two levels: it turns each subtree into its top
node, so n leaves need log256(n) rounds. Then the paths go down the same rounds: a subtree meets
the one path above it, which has 16 digests a level.

Edge cases: a null field is ``-``, unlike the text ``-``, which has a length before it. Rows with
a null group are a group of their own, the first. Rows that share an id, or have none, are leaves of
their own, ordered by id (null first), then leaf; equal rows are equal leaves in neighbouring
slots. A lone leaf is its group's subroot, a lone subroot the root, and its proof the hash of
nothing. An empty table has no root and gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.ranks import with_positions
from newsloom.session import cut_lineage

ARITY, RISE = 16, 2  # children of a node; levels of one round
SPAN = ARITY**RISE
DIGEST = 64
KEY = ("known", "key")
NODE = "known boolean, key string, pos long, n long, digest string"
PATH = "known boolean, key string, pos long, subroot string, path array<struct<slot:int,run:string>>"


def leaf_of(fields: list[Column]) -> Column:
    """Digest of a row: each field as its UTF-8 length, a colon and its text; null as a dash."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


class Parent:
    """A node with the hash state before each of its child slots."""

    __slots__ = ("digest", "run", "states")

    def __init__(self, run: bytes):
        self.run, self.states, state = run, [], sha256()
        for at in range(0, len(run), DIGEST):
            self.states.append(state.copy())
            state.update(run[at : at + DIGEST])
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, child: bytes) -> bytes:
        """Digest with another child in ``slot``."""
        state = self.states[slot].copy()
        state.update(child)
        state.update(self.run[DIGEST * (slot + 1) :])
        return state.hexdigest().encode()

    def siblings(self, slot: int) -> bytes:
        return self.run[: DIGEST * slot] + self.run[DIGEST * (slot + 1) :]


def _parents(digests: list[bytes], n: int) -> list[list[Parent]]:
    """Parents of a subtree by level; ``n`` nodes has the whole group at the lowest level."""
    levels: list[list[Parent]] = []
    while n > 1 and len(levels) < RISE:
        levels.append([Parent(b"".join(digests[at : at + ARITY])) for at in range(0, len(digests), ARITY)])
        digests, n = [p.digest for p in levels[-1]], -(-n // ARITY)
    return levels


def _above(n: int) -> int:
    """Nodes of a group one round above ``n``."""
    for _ in range(RISE):
        n = -(-n // ARITY)
    return n


def _in_order(frame: pd.DataFrame) -> tuple[pd.DataFrame, list[bytes], int]:
    frame = frame.sort_values("pos")
    return frame, [d.encode() for d in frame["digest"]], int(frame["n"].iloc[0])


def _rise(nodes: DataFrame) -> DataFrame:
    """The top node of every subtree."""

    def top(frame: pd.DataFrame) -> pd.DataFrame:
        frame, digests, n = _in_order(frame)
        levels = _parents(digests, n)
        return pd.DataFrame({
            "known": [frame["known"].iloc[0]], "key": [frame["key"].iloc[0]], "pos": [int(frame["pos"].iloc[0]) // SPAN],
            "n": [_above(n)], "digest": [(levels[-1][0].digest if levels else digests[0]).decode()],
        })

    return nodes.withColumn("subtree", F.floor(F.col("pos") / SPAN)).groupBy(*KEY, "subtree").applyInPandas(top, NODE)


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """Nodes by round, the last with one node a group."""
    rounds, most = [nodes], nodes.agg(F.max("n")).first()[0] or 1
    while most > 1:
        rounds.append(cut_lineage(_rise(rounds[-1].select("known", "key", "pos", "n", "digest")), "nodes"))
        most = _above(most)
    return rounds


def _with_paths(nodes: DataFrame, paths: DataFrame, step, schema: str) -> DataFrame:
    """``step(nodes of a subtree, the one path above it)`` for every subtree."""
    left = nodes.withColumn("subtree", F.floor(F.col("pos") / SPAN)).groupBy(*KEY, "subtree")
    return left.cogroup(paths.withColumnRenamed("pos", "subtree").groupBy(*KEY, "subtree")).applyInPandas(step, schema)


def _descend(frame: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
    frame, digests, n = _in_order(frame)
    levels, above = _parents(digests, n), list(upper["path"].iloc[0])
    paths = []
    for i in range(len(frame)):
        path = []
        for level in levels:
            path.append({"slot": i % ARITY, "run": level[i // ARITY].run.decode()})
            i //= ARITY
        paths.append(path + above)
    return pd.DataFrame({"known": frame["known"], "key": frame["key"], "pos": frame["pos"], "subroot": upper["subroot"].iloc[0], "path": paths})


def _fold(frame: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
    frame, digests, n = _in_order(frame)
    levels = _parents(digests, n)
    above = [(step["slot"], Parent(step["run"].encode())) for step in upper["path"].iloc[0]]
    out = []
    for i, (leaf, changed) in enumerate(zip(digests, frame["changed"], strict=True)):
        node, proof = changed.encode() if isinstance(changed, str) else leaf, sha256()
        for level in levels:
            parent, slot = level[i // ARITY], i % ARITY
            proof.update(parent.siblings(slot))
            node, i = parent.fold(slot, node), i // ARITY
        for slot, parent in above:
            proof.update(parent.siblings(slot))
            node = parent.fold(slot, node)
        out.append((proof.hexdigest(), node.decode()))
    proofs, folded = zip(*out, strict=True)
    return pd.DataFrame({
        "row": frame["row"], "leaf": frame["digest"], "subroot": upper["subroot"].iloc[0], "proof_sha256": proofs, "folded_root": folded,
    })


@dataclass
class Manifest:
    """Tables of a manifest; ``leaves`` has one row per row of the dataset."""

    leaves: DataFrame
    rounds: list[DataFrame]  # of the groups' trees, from the leaves up
    tops: list[DataFrame]  # of the tree over the subroots
    subroots: DataFrame
    root: str | None

    def check(self) -> DataFrame:
        """One row per leaf: (id, leaf, subroot, root, proof_sha256, folded_root, verified).

        ``folded_root`` is the root that the changed leaf gives, or the leaf itself where
        nothing was changed, by its path of retained states.
        """
        top = "known boolean, key string, pos long, subroot string, path array<struct<slot:int,run:string>>"
        paths = self.leaves.sparkSession.createDataFrame([(True, "", 0, None, [])], top)
        for nodes in self.tops[-2::-1]:
            paths = _with_paths(nodes, paths, _descend, PATH)
        paths = self.subroots.join(paths.select(F.col("pos").alias("place"), "path"), "place").select(
            "known", "key", F.lit(0).cast("long").alias("pos"), F.col("digest").alias("subroot"), "path"
        )
        for nodes in self.rounds[-2:0:-1]:
            paths = _with_paths(nodes, paths, _descend, PATH)
        leaves = self.leaves.withColumn("row", F.struct("id"))
        schema = f"row {leaves.schema['row'].dataType.simpleString()}, leaf string, subroot string, proof_sha256 string, folded_root string"
        folded = _with_paths(leaves, paths, _fold, schema)
        return folded.select(
            "row.id", "leaf", "subroot", F.lit(self.root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == self.root).alias("verified")
        )


def build(docs: DataFrame, fields: list[Column], *, id_col: str, group_col: str, changed: list[Column] | None = None, where: Column | None = None) -> Manifest:
    """The manifest of ``docs``; ``changed`` gives the fields of rows that are tampered ``where`` it says so."""
    leaf, other = leaf_of(fields), F.lit(None).cast("string")
    if changed is not None:
        other = F.when(F.lit(True) if where is None else where, leaf_of(changed))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(group_col).isNotNull().alias("known"), F.coalesce(F.col(group_col).cast("string"), F.lit("")).alias("key"),
        leaf.alias("digest"), other.alias("changed"),
    )
    # Equal rows could otherwise not be told apart by ranges.
    rows = cut_lineage(rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id())), "leaves")
    leaves = with_positions(rows, [F.col("id"), F.col("digest"), F.col("tie")], keys=KEY, total="n").drop("tie")
    leaves = cut_lineage(leaves, "leaves")
    rounds = _rounds(leaves)
    tops = rounds[-1].select("known", "key", "digest")
    subroots = cut_lineage(with_positions(tops, [F.col("known"), F.col("key")], pos="place", total="n"), "subroots")
    top = _rounds(subroots.select(F.lit(True).alias("known"), F.lit("").alias("key"), F.col("place").alias("pos"), "n", "digest"))
    root = top[-1].select("digest").first()
    return Manifest(leaves, rounds, top, subroots.select("known", "key", "place", "digest"), root[0] if root else None)
