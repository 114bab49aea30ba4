"""Byte-level BPE by merge replay over the distinct words of a block of the corpus.

A block is one task's share of the documents. Its distinct words lie end to end; an inverted
index gives, for the rank of every token pair, the places where the pair stands. The lowest
rank in the index is applied everywhere at once, and only the pairs with the two neighbours of
a merged place are indexed anew, until no pair is left. Words are independent of each other,
so the blocks are, too, and a word met again is looked up. Some ranks can be formed along
several splits, so a merge may give a pair of a lower rank than its own: the places after it
in the same word then wait, which keeps the order of the single-word algorithm.

Edge cases: null and empty texts have no ids, and decode to no bytes. Rows that share an id,
or have none, are encoded each for itself. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import pieces

BORDER, GONE, SHIFT = -1, -2, 32
BLOCK_BYTES = 1 << 22  # of words replayed at a time


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file (base64, space, number)."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def pair_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank by pair of tokens, for every split of a token into two tokens."""
    table = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                table[left << SHIFT | right] = rank
    return table


class Replay:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.pairs = ranks, pair_table(ranks)
        self.of_byte = [ranks[bytes([b])] for b in range(256)]
        codes = np.fromiter(self.pairs, np.int64, len(self.pairs))
        order = np.argsort(codes)
        self.pair_codes, self.pair_ranks = codes[order], np.fromiter(self.pairs.values(), np.int64, len(codes))[order]

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        known = [self.ranks.get(w) for w in words]
        found: list[list[int]] = [[k] if k is not None else [] for k in known]
        todo = [i for i, k in enumerate(known) if k is None and words[i]]
        start = 0
        while start < len(todo):
            end, size = start, 0
            while end < len(todo) and size < BLOCK_BYTES:
                size += len(words[todo[end]])
                end += 1
            for i, ids in zip(todo[start:end], self._replay([words[i] for i in todo[start:end]]), strict=True):
                found[i] = ids
            start = end
        return found

    def _replay(self, words: list[bytes]) -> Iterator[list[int]]:
        token, of_byte, pairs = [BORDER], self.of_byte, self.pairs.get
        for word in words:
            token.extend([of_byte[b] for b in word])
            token.append(BORDER)
        after = list(range(1, len(token) + 1))
        before = list(range(-1, len(token) - 1))
        index = self._first_index(np.array(token, np.int64))
        lowest = list(index)
        heapq.heapify(lowest)
        push, pop = heapq.heappush, heapq.heappop
        while lowest:
            rank = pop(lowest)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            waits_until = -1
            for place in places:
                left = token[place]
                if left < 0:
                    continue
                second = after[place]
                right = token[second]
                if right < 0 or pairs(left << SHIFT | right) != rank:
                    continue
                if place < waits_until:
                    self._add(index, lowest, rank, place)
                    continue
                third = after[second]
                token[place], token[second] = rank, GONE
                after[place], before[third] = third, place
                first = before[place]
                lower = False
                other = token[first]
                if other >= 0:
                    new = pairs(other << SHIFT | rank)
                    if new is not None:
                        if new in index:
                            index[new].append(first)
                        else:
                            index[new] = [first]
                            push(lowest, new)
                        lower = new < rank
                other = token[third]
                if other >= 0:
                    new = pairs(rank << SHIFT | other)
                    if new is not None:
                        if new in index:
                            index[new].append(place)
                        else:
                            index[new] = [place]
                            push(lowest, new)
                        lower = lower or new < rank
                if lower:
                    waits_until = third
                    while token[waits_until] != BORDER:
                        waits_until = after[waits_until]
        ids: list[int] = []
        place = after[0]
        for _ in words:
            while token[place] != BORDER:
                ids.append(token[place])
                place = after[place]
            yield ids
            ids, place = [], after[place]

    def _first_index(self, token: np.ndarray) -> dict[int, list[int]]:
        """Places of all pairs of single bytes by rank."""
        codes = np.where((token[:-1] >= 0) & (token[1:] >= 0), token[:-1] << SHIFT | token[1:], -1)
        at = np.minimum(np.searchsorted(self.pair_codes, codes), len(self.pair_codes) - 1)
        places = np.flatnonzero(self.pair_codes[at] == codes)
        ranks = self.pair_ranks[at[places]]
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        starts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]]) if len(ranks) else np.zeros(0, np.int64)
        return {int(ranks[a]): own.tolist() for a, own in zip(starts, np.split(places, starts[1:]), strict=True)} if len(ranks) else {}

    @staticmethod
    def _add(index: dict[int, list[int]], lowest: list[int], rank: int, place: int) -> None:
        own = index.get(rank)
        if own is None:
            index[rank] = [place]
            heapq.heappush(lowest, rank)
        else:
            own.append(place)


def own_white_space(pattern: str) -> str:
    r"""The pattern with ``\s`` and ``\S`` spelled out, so that no library's reading of them matters."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(pieces.WHITE if inside else f"[{pieces.WHITE}]")
        elif two == r"\S":
            out.append(f"[^{pieces.WHITE}]")
        elif two[:1] == "\\":
            out.append(two)
        else:
            inside = (inside or two[0] == "[") and two[0] != "]"
            out.append(two[0])
            i -= 1
        i += 2
    return "".join(out)


class Codec:
    """Text to ids and back, with the pieces of texts remembered."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex

        ranks = read_ranks(ranks_path)
        self.replay, self.find = Replay(ranks), regex.compile(own_white_space(pattern)).findall
        by_rank = {rank: token for token, rank in ranks.items()}
        self.bytes_of = [by_rank.get(rank, b"") for rank in range(max(by_rank) + 1)]
        self.digits_of = [b"%d" % rank for rank in range(max(by_rank) + 1)]
        self.encoder = pieces.Encoder(self._encode_pieces, pieces.spaced, "<u4")

    def _encode_pieces(self, texts: list[str], prefix: str) -> list[bytes]:
        split = [self.find(prefix + t) for t in texts]
        new = list({w for own in split for w in own})
        ids = {w: array("I", x).tobytes() for w, x in zip(new, self.replay.encode([w.encode() for w in new]), strict=True)}
        return [b"".join([ids[w] for w in own]) for own in split]


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def encode_decode(
    docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Digests of every text's ids and of the bytes they decode to.

    (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]). No shuffle: each task
    encodes its own documents.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(ranks_path, pattern)
        for frame in frames:
            out = []
            for doc, raw in zip(frame["doc_id"], own.encoder.encode(frame["text"].tolist()), strict=True):
                ids = np.frombuffer(raw, "<u4").tolist()
                decoded = b"".join(map(own.bytes_of.__getitem__, ids))
                digits = b",".join(map(own.digits_of.__getitem__, ids))
                digests = hashlib.sha256(digits).hexdigest(), hashlib.sha256(decoded).hexdigest()
                out.append((doc, len(ids), *digests, *((ids, decoded) if with_ids else ())))
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
            yield pd.DataFrame(out, columns=names)

    rows = docs.select(pieces.filled(F.col(id_col)).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if with_ids else "")
    return rows.mapInPandas(run, schema).withColumn("doc_id", pieces.unfilled("doc_id"))
