"""Exact n-gram Jaccard join with set-relation skipping, as connected components.

Two documents link if their sets of word shingles overlap by ``share``. Equal sets are one set.

1. Every task turns its texts into blocks of hashed shingles (64 bits) and sends half of them
   (those with a clear top bit), by range of the hash, to be counted. Only what at least two
   documents have comes back. The order of shingles is: the counted half, rarest first, then
   the other half by hash.
2. Two sets that link share a shingle among the first n - ceil(share * n) + 1 of each. Those
   that only one document has cannot be shared, so a document whose first shingles are all
   its own is done. The others form an inverted index of first shingles.
3. Index skipping: a list of the index is named after its smallest document, the leader, and
   lists with one leader are one family, however many shingles its members share. Each
   document is compared with its leader once, not once a list.
4. Answer skipping: a member that links with the leader has the leader's component as its
   answer. Only members that do not are compared with the rest of the family, by sparse and
   dense products over the shingles that two members share, and pairs whose sizes alone rule
   a link out are skipped. Families are cut into parts of ``part_rows`` documents; the
   members without a link to the leader meet the other parts part by part.

No link between two different sets is lost: if they share a first shingle, both belong to the
family of its list, and then either both have the leader's answer or they are compared.

Edge cases: null and empty texts, and texts of white space, have no set, size 0, and a
component of their own. Rows without an id get their size and no component, and link with
nothing. Rows that share an id are one document with several texts. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import pieces
from newsloom.llm.embedding_links import lowest
from newsloom.llm.url_filter import maybe_listed
from newsloom.operators.density import components
from newsloom.session import cut_lineage

BLOCK_CHARS = 1 << 22
BYTES_PER_RANGE = 8 << 20
HALF = np.uint64(1 << 63)
META = np.dtype([("doc", "<i8"), ("n", "<i4"), ("counted", "<i4"), ("first", "<i4"), ("key", "V16")])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles, A-Z lower-cased."""
    import xxhash

    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.string())))
    coded = split.values.cast(pa.binary()).dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    filled = np.fromiter(map(len, distinct), np.int64, len(distinct)) > 0
    at = coded.indices.to_numpy(zero_copy_only=False)
    edges = split.offsets.to_numpy()
    keep = filled[at]
    words = hashes[at[keep]]
    edges = np.r_[0, np.cumsum(keep)][edges]
    factors = _mixed(np.arange(1, size + 2, dtype=np.uint64)) | np.uint64(1)
    grams = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for i in range(size):
        grams += words[i : len(words) - size + 1 + i] * factors[i]
    grams = _mixed(grams)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            whole = words[a:b] * factors[: b - a]
            out.append(_mixed(whole.sum(keepdims=True) + factors[size : size + 1] * np.uint64(b - a)))
        else:
            out.append(grams[:0])
    return out


def _key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _parts(docs: list[int], texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= BLOCK_CHARS or i - start >= 60_000:
            yield docs[start : i + 1], texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield docs[start:], texts[start:]


def _counted(docs: DataFrame, size: int, share: int, ranges: int) -> DataFrame:
    """What step 1 knows: (block, kind, a, b, c).

    Kind 0 is a block's documents (``META`` records in ``a``). Kind 1 holds shingles that are not
    one document's own: hashes, the documents' numbers in the block, a class of frequency.
    """

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces.forget()
        block = TaskContext.get().partitionId() << 24
        for frame in frames:
            for ids, texts in _parts(frame["doc"].tolist(), frame["text"].tolist()):
                sets = shingle_sets(texts, size)
                meta = np.zeros(len(ids), META)
                tokens, owners = [], []
                for i, own in enumerate(sets):
                    counted = int(np.searchsorted(own, HALF))
                    first = len(own) - -(-share * len(own) // 100) + 1 if len(own) else 0
                    meta[i] = (ids[i], len(own), counted, first, _key(own))
                    sent = own[: max(counted, first)]
                    tokens.append(sent)
                    owners.append(np.full(len(sent), i, np.uint16))
                token, owner = np.concatenate(tokens), np.concatenate(owners)
                where = (token >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(31)
                where %= np.uint64(ranges)  # both halves are spread alike
                order = np.argsort(where, kind="stable")
                cuts = np.searchsorted(where[order], np.arange(ranges + 1))
                token, owner = token[order], owner[order]
                rows = [(-1 - block % ranges, block, meta.tobytes(), b"")]
                rows += [(r, block, token[a:b].tobytes(), owner[a:b].tobytes()) for r, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
                del sets, tokens, owners, token, owner, where, order
                yield pd.DataFrame(rows, columns=["range", "block", "a", "b"])
                del rows
                block += 1
        pieces.trim()

    def count(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return pd.DataFrame({"block": frame["block"], "kind": 0, "a": frame["a"], "b": frame["b"], "c": frame["b"]})
        pieces.trim()
        tokens = [np.frombuffer(x, np.uint64) for x in frame["a"]]
        _, inverse, counts = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        classes = np.minimum(255, np.floor(8 * np.log2(counts))).astype(np.uint8)
        often = (counts > 1)[inverse]
        classes = classes[inverse]
        rows, start = [], 0
        for block, own, owner in zip(frame["block"], tokens, frame["b"], strict=True):
            shared = often[start : start + len(own)]
            if shared.any():
                owners, own_classes = np.frombuffer(owner, np.uint16)[shared], classes[start : start + len(own)][shared]
                rows.append((block, 1, own[shared].tobytes(), owners.tobytes(), own_classes.tobytes()))
            start += len(own)
        return pd.DataFrame(rows, columns=["block", "kind", "a", "b", "c"])

    sent = docs.mapInPandas(send, "range int, block long, a binary, b binary")
    return sent.groupBy("range").applyInPandas(count, "block long, kind int, a binary, b binary, c binary")


def _meta(counted: DataFrame) -> DataFrame:
    """(doc, n, key) of every row."""

    def explode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for raw in frame["a"]:
                meta = np.frombuffer(raw, META)
                yield pd.DataFrame({"doc": meta["doc"], "n": meta["n"], "key": [x.tobytes() for x in meta["key"]]})

    return counted.filter("kind = 0").select("a").mapInPandas(explode, "doc long, n int, key binary")


def _index(counted: DataFrame) -> DataFrame:
    """Postings (token, doc, key) of the first shingles that another document has, too."""

    def first(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        meta = np.concatenate([np.frombuffer(x, META) for x in frame["a"][frame["kind"] == 0]])
        shared = frame[frame["kind"] == 1]
        if not len(shared):
            return pd.DataFrame({"token": np.zeros(0, np.int64), "doc": np.zeros(0, np.int64), "key": np.zeros(0, object)})
        token = np.concatenate([np.frombuffer(x, np.uint64) for x in shared["a"]])
        owner = np.concatenate([np.frombuffer(x, np.uint16) for x in shared["b"]])
        rarity = np.concatenate([np.frombuffer(x, np.uint8) for x in shared["c"]]).astype(np.int64)
        rarity[token >= HALF] = 256  # the half that is not counted comes last, by hash
        several = np.bincount(owner[token < HALF], minlength=len(meta))
        room = meta["first"] - (meta["counted"] - several)  # places left by shingles of its own
        wanted = room[owner] > 0
        token, owner, rarity = token[wanted], owner[wanted], rarity[wanted]
        order = np.lexsort((token, rarity, owner))
        token, owner, rarity = token[order], owner[order], rarity[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        chosen = (place < room[owner]) | (rarity == 256)
        token, owner = token[chosen], owner[chosen]
        return pd.DataFrame({"token": token.astype(np.int64), "doc": meta["doc"][owner], "key": [x.tobytes() for x in meta["key"][owner]]})

    return counted.groupBy("block").applyInPandas(first, "token long, doc long, key binary")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc, key, tokens) of each row, tokens as bytes."""

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for ids, texts in _parts(frame["doc"].tolist(), frame["text"].tolist()):
                sets = shingle_sets(texts, size)
                yield pd.DataFrame({"doc": ids, "key": [_key(s) for s in sets], "tokens": [s.tobytes() for s in sets]})

    return docs.mapInPandas(build, "doc long, key binary, tokens binary")


def overlaps(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set with each other set.

    Rare shingles add to the pairs that have them; the frequent ones are a dense product.
    """
    out = np.zeros((len(one), len(other)), np.int32)
    if not one or not other:
        return out
    token = np.concatenate([*one, *other])
    row = np.repeat(np.arange(len(one) + len(other)), [len(s) for s in [*one, *other]])
    _, column, counts = np.unique(token, return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    starts = np.flatnonzero(np.r_[True, column[1:] != column[:-1]]) if len(column) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(column)]
    dense = ends - starts >= 16
    for a, b in zip(starts[~dense].tolist(), ends[~dense].tolist(), strict=True):
        rows = row[a:b]
        left = rows[rows < len(one)]
        out[np.ix_(left, rows[len(left) :] - len(one))] += 1
    often = np.flatnonzero(dense)
    for start in range(0, len(often), 2048):
        part = often[start : start + 2048]
        matrix = np.zeros((len(one) + len(other), len(part)), np.float32)
        for k, c in enumerate(part):
            matrix[row[starts[c] : ends[c]], k] = 1
        out += (matrix[: len(one)] @ matrix[len(one) :].T).astype(np.int32)
    return out


def _links(one: list[np.ndarray], other: list[np.ndarray], share: int) -> np.ndarray:
    a, b = np.array([len(s) for s in one], np.int64), np.array([len(s) for s in other], np.int64)
    inter = overlaps(one, other).astype(np.int64)
    return 100 * inter >= share * (a[:, None] + b[None, :] - inter)


def _edges(links: np.ndarray, one: np.ndarray, other: np.ndarray) -> list[tuple[int, int]]:
    low, other_low = lowest(links, one, other)
    pairs = {(int(a), int(b)) for a, b in [*zip(one, low, strict=True), *zip(other, other_low, strict=True)] if a != b}
    return sorted(pairs)


def _with_leader(families: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Steps 3 and 4 inside each part: (a, b, leader, part); b is null for members without the leader's link.

    Every part holds the leader's set as well.
    """

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        leader, part = int(key[0]), int(key[1])
        sets_ = [np.frombuffer(x, np.uint64) for x in frame["tokens"]]
        docs = frame["doc"].to_numpy(np.int64)
        leads = docs == leader
        size = np.array([len(s) for s in sets_], np.int64)
        whole = np.concatenate(sets_)
        starts = np.cumsum(size) - size
        same = np.zeros(len(docs), bool)
        for own in (sets_[i] for i in np.flatnonzero(leads)):
            inter = np.add.reduceat(np.isin(whole, own), starts, dtype=np.int64)
            same |= 100 * inter >= share * (size + len(own) - inter)
        rows = [(int(d), leader, leader, part) for d in np.unique(docs[same & ~leads])]
        alone = np.flatnonzero(~same)
        if len(alone):
            for start in range(0, len(alone), 1024):
                some = alone[start : start + 1024]
                links = _links([sets_[i] for i in some], sets_, share)
                links[np.arange(len(some)), some] = False
                rows += [(a, b, leader, part) for a, b in _edges(links, docs[some], docs)]
            rows += [(int(d), None, leader, part) for d in np.unique(docs[alone])]
        return pd.DataFrame(rows, columns=["a", "b", "leader", "part"]).astype({"b": "Int64"})

    members = families.join(sets, "doc")
    return members.groupBy("leader", "part").applyInPandas(compare, "a long, b long, leader long, part int")


def _between_parts(families: DataFrame, alone: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Step 4 across the parts of large families: edges (a, b)."""
    large = families.filter("parts > 1")
    asking = alone.select("leader", F.col("part").alias("from_part")).distinct()
    one = alone.join(large.select("leader", "parts").distinct(), "leader").select(
        "leader", F.col("part").alias("from_part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.col("a").alias("doc"), F.lit(True).alias("asks"),
    ).filter("part <> from_part")
    other = large.filter("doc <> leader").join(asking, "leader").filter("part <> from_part").select(
        "leader", "from_part", "part", "doc", F.lit(False).alias("asks")
    )

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        asks, sets_ = frame["asks"].to_numpy(bool), [np.frombuffer(x, np.uint64) for x in frame["tokens"]]
        docs = frame["doc"].to_numpy(np.int64)
        one_sets, other_sets = [s for s, x in zip(sets_, asks, strict=True) if x], [s for s, x in zip(sets_, asks, strict=True) if not x]
        return pd.DataFrame(_edges(_links(one_sets, other_sets, share), docs[asks], docs[~asks]), columns=["a", "b"])

    members = one.unionByName(other).join(sets, "doc")
    return members.groupBy("leader", "from_part", "part").applyInPandas(compare, "a long, b long")


def jaccard_components(
    docs: DataFrame, size: int = 5, share: int = 80, *, id_col: str = "doc_id", text_col: str = "text", part_rows: int = 1000,
) -> DataFrame:
    """Size of each row's set and its component: (doc_id, n_shingles, component_id).

    Documents link if 100 x intersection >= ``share`` x union of their sets of ``size``-word shingles.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(text_col, F.lit("")).alias("text"))
    known, nameless = rows.filter("doc is not null"), rows.filter("doc is null").withColumn("doc", F.lit(0).cast("long"))
    volume = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counted = cut_lineage(_counted(known, size, share, max(1, -(-volume // BYTES_PER_RANGE))), "shingles")
    meta = cut_lineage(_meta(counted), "documents")
    groups = meta.filter("n > 0").groupBy("key").agg(F.min("doc").alias("rep"))
    index = _index(counted).join(groups.select("key", F.col("rep").alias("doc")), ["key", "doc"], "left_semi")
    index = cut_lineage(index.select("token", "doc"), "index")
    lists = index.groupBy("token").agg(F.min("doc").alias("leader"), F.max("doc").alias("last")).filter("leader < last")
    families = cut_lineage(index.join(lists, "token").select("leader", "doc").distinct(), "families")
    parts = families.groupBy("leader").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    families = families.join(parts, "leader").filter("doc <> leader")
    families = families.withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    leaders = families.select("leader", F.col("leader").alias("doc"), "parts", "part").distinct()
    families = cut_lineage(families.unionByName(leaders.select(*families.columns)), "parts")
    named = families.select("doc").distinct()
    wanted = cut_lineage(named.join(meta, "doc").join(groups.select("key", F.col("rep").alias("doc")), ["key", "doc"], "left_semi").distinct(), "wanted")
    close = maybe_listed(known.select(F.col("doc").alias("url_key"), "text"), wanted.select(F.col("doc").alias("url_key")).distinct())
    close = close.filter("_maybe").select(F.col("url_key").alias("doc"), "text").join(wanted.select("doc").distinct(), "doc", "left_semi")
    sets = _sets(close, size).join(wanted.select("doc", "key"), ["doc", "key"], "left_semi").dropDuplicates(["doc", "key"]).drop("key")
    sets = cut_lineage(sets, "sets")
    found = cut_lineage(_with_leader(families, sets, share), "links")
    edges = found.filter("b is not null").select("a", "b")
    if families.filter("parts > 1").limit(1).count():
        alone = found.filter("b is null").select("a", "leader", "part")
        edges = edges.unionByName(_between_parts(families, alone, sets, share))
    several = meta.filter("n > 0").groupBy("doc").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low <> high")
    own = meta.join(several.select("doc"), "doc").join(groups, "key").filter("doc <> rep")
    edges = edges.unionByName(own.select(F.col("doc").alias("a"), F.col("rep").alias("b")))
    roots = components(edges).withColumnRenamed("id", "rep")
    answers = groups.join(roots, "rep", "left").select("key", F.coalesce("root", "rep").alias("component"))
    result = meta.join(answers, "key", "left").select(
        F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc")).alias("component_id"),
    )
    sizes = _sets(nameless, size).select(
        F.lit(None).cast("long").alias("doc_id"), (F.octet_length("tokens") / 8).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")
    )
    return result.unionByName(sizes)
