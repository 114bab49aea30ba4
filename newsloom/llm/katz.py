"""Language-model scores of texts: a Katz backoff model over words, learned and applied in one flow.

Tokens are words, lower-cased in A-Z, and one end token a text. The model backs off from word triples
(``order`` 3; with 2 it begins with pairs) to word pairs to words to the class of all words not met in training:

    P(w | u, v) = d(c) c(u, v, w) / c(u, v)   if the triple was met,   else  a(u, v) P(w | v)   (1 P(w | v) if u, v was not met)
    P(w | v)    = d(c) c(v, w) / c(v)         if the pair was met,     else  a(v) P(w)
    P(w)        = d1(c) c(w) / N              if the word was met,     else  what the words leave over

``d`` are Good-Turing discounts of counts up to ``TOP`` (Katz), by order; where the counts of counts do not give
one between 0 and 1, half a count is taken off. A context all of whose words were met more often
than that would leave nothing: it counts one more event. ``a`` is what the met words leave after the context, over
what they leave in the next lower order, so the probabilities after any context sum to one.

Flow. Texts are cut into blocks by tasks as they are read, and stored once as codes of block-local words. A
block's distinct words go to word partitions, which add the counts and send back each word's
number and count. With these a block knows its distinct pairs; they go to pair partitions
(the stored model: sorted pairs with counts), which send back, in the same order, the count of each pair
and, for contexts with unmet pairs, what ``a`` needs. Triples take a third round of the same kind: distinct
triples whose pair was met go to triple partitions by that pair, with the count of their last two words. The block
then looks up every token and sums by document. Only distinct words, pairs and triples of a block travel, packed as
arrays, and counts are added before anything is shuffled.

A partition holds all pairs (triples) of a context. Contexts with more than 1/4,096 of all tokens, of which there are
fewer than that, are spread over all partitions by pair (triple), and their parts of ``a`` are summed. The driver
holds these and the counts of counts. A partition has about ``part_bytes`` of text, however many there
are; blocks x partitions is the number of messages, so on very large tables raise both sizes
with the memory of the executors.

Edge cases: null and empty texts are the end token alone. Rows that share an id, or have none, are
texts of their own. Without training rows every probability is 1 and every score 0. An empty
table gives no rows. Other columns are ignored. Very long texts are blocks of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm import pieces
from newsloom.operators.packs import pack, unpack
from newsloom.session import cut_lineage

TOP = 5  # the largest count that is discounted
HOT = 4096  # a context with more than one in so many tokens is spread by pair
END = ""  # no word of a text is empty
WORDS, CODES = "words", "codes"
PAIRS, TRIPLES, HOT_PART, HOT_PAIR, TALLY, MODEL = "pairs", "triples", "hot", "hot pair", "tally", "model"


def pack_words(words: list[bytes]) -> bytes:
    raw = b"\n".join(words)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_words(raw: bytes) -> list[bytes]:
    return pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True).split(b"\n")


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(word codes of all texts with their end tokens, words by code, tokens of each text)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
    end = words.index(b"") if b"" in words else len(words)
    if end == len(words):
        words.append(b"")
    real = codes != end  # white space at the borders of a text splits off empty words
    before = np.r_[0, np.cumsum(real)][offsets]
    lengths = np.diff(before) + 1
    out = np.empty(int(lengths.sum()), np.int64)
    ends = np.cumsum(lengths) - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = codes[real], end
    return out, words, lengths


def distinct_pairs(v: np.ndarray, w: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs of numbers below ``base``, and the place of each given pair among them."""
    if base < 3_000_000_000:
        keys, at = np.unique(v * base + w, return_inverse=True)
        return keys // base, keys % base, at
    order = np.lexsort((w, v))
    v, w = v[order], w[order]
    new = np.r_[True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])][: len(v)]
    at = np.empty(len(v), np.int64)
    at[order] = np.cumsum(new) - 1
    return v[new], w[new], at


def discounts(tally: list[int]) -> np.ndarray:
    """Discount of the counts 1..TOP (0 at place 0) from the numbers of items with count 1..TOP + 1."""
    out = np.r_[0.0, [(c - 0.5) / c for c in range(1, TOP + 1)]]
    if tally[0]:
        beyond = (TOP + 1) * tally[TOP] / tally[0]
        for c in range(1, TOP + 1):
            if tally[c - 1] and beyond < 1:
                d = ((c + 1) * tally[c] / (c * tally[c - 1]) - beyond) / (1 - beyond)
                if 0 < d < 1:
                    out[c] = d
    return out


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= TOP, d[np.minimum(counts, TOP)], 1.0)


@dataclass
class Words:
    """The unigrams: ``prob`` takes counts."""

    tokens: int
    distinct: int
    d: np.ndarray
    unknown: float  # probability of the class of words not met
    total: int  # tokens, or one more

    @classmethod
    def of(cls, tokens: int, distinct: int, tally: list[int]) -> Words:
        d = discounts(tally)
        left = sum((1 - d[c]) * c * tally[c - 1] for c in range(1, TOP + 1))
        total = tokens if left else tokens + 1
        return cls(tokens, distinct, d, (left or 1.0) / total, total)

    def prob(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.d) / self.total, self.unknown)


def _mix(v: np.ndarray) -> np.ndarray:
    v = (v.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    v = (v ^ (v >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return v ^ (v >> np.uint64(32))


BLOCK = "block long, kind string, part int, ids binary, teaches binary, lengths binary, codes binary, sizes binary, words binary, counts binary"


def _blocks(rows: DataFrame, block_bytes: int, word_parts: int) -> DataFrame:
    """Rows of kind CODES (one a block) and WORDS (one a block and word partition with words)."""

    def block(number: int, batch: pa.Table) -> list[dict]:
        codes, words, lengths = tokens_of(batch.column("text").combine_chunks())
        teaches = batch.column("teaches").to_numpy()
        counts = np.bincount(codes[np.repeat(teaches, lengths)], minlength=len(words))
        parts = np.array([zlib.crc32(w) % word_parts for w in words], np.int64)
        order = np.argsort(parts, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sizes = np.bincount(parts, minlength=word_parts)
        out = [{
            "block": number, "kind": CODES, "part": -1, "ids": batch.column("doc_id").to_numpy().tobytes(), "teaches": pack(teaches),
            "lengths": pack(lengths), "codes": pack(place[codes]), "sizes": pack(sizes),
        }]
        ends = np.cumsum(sizes)
        for part in np.flatnonzero(sizes):
            own = order[ends[part] - sizes[part] : ends[part]]
            out.append({"block": number, "kind": WORDS, "part": int(part), "words": pack_words([words[i] for i in own]), "counts": pack(counts[own])})
        return out

    names = [c.split()[0] for c in BLOCK.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces.forget()
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, number
            if held:
                frame = pd.DataFrame(block(number, pa.Table.from_batches(held)), columns=names)
                held, size, number = [], 0, number + 1
                yield pa.RecordBatch.from_pandas(frame, schema=schema)

        schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for n, c in zip(names, BLOCK.split(", "), strict=True)])
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                used = sizes[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, used + block_bytes - size, side="right")))
                held.append(batch.slice(start, stop - start))
                size += int(sizes[stop - 1] - used)
                start = stop
                if size >= block_bytes or start < batch.num_rows:
                    yield from flush()
        yield from flush()

    return rows.mapInArrow(cut, BLOCK)


def _merge_words(frame: pd.DataFrame) -> pd.DataFrame:
    """Adds the counts of a word partition; answers each block with (number in the partition, count)."""
    lists = [unpack_words(w) for w in frame["words"]]
    sizes = [len(x) for x in lists]
    coded = pa.array([w for x in lists for w in x], pa.large_binary()).dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    counts = np.zeros(len(coded.dictionary), np.int64)
    np.add.at(counts, codes, np.concatenate([unpack(c) for c in frame["counts"]]))
    order = np.argsort(-counts, kind="stable")  # frequent words get low numbers, which pack well
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    cuts = np.cumsum(sizes)[:-1]
    answers = [(pack(number[c]), pack(counts[c])) for c in np.split(codes, cuts)]
    known = counts[counts > 0]
    tally = np.bincount(known[known <= TOP + 1], minlength=TOP + 2)[1:]
    out = pd.DataFrame({"block": frame["block"], "part": frame["part"], "kind": WORDS})
    out["numbers"], out["counts"] = zip(*answers, strict=True)
    extra = pd.DataFrame({"block": [-1], "part": [int(frame["part"].iloc[0])], "kind": [TALLY]})
    extra["tally"] = [[len(known), int(known.sum()), *tally.tolist()]]
    return pd.concat([out, extra], ignore_index=True)


ANSWER = "block long, part int, kind string, numbers binary, counts binary, below binary, tally array<long>, context long, lower double"


def _fill(frame: pd.DataFrame) -> pd.DataFrame:
    names = [c.split()[0] for c in ANSWER.split(", ")]
    out = pd.DataFrame({n: frame[n] if n in frame else None for n in names})
    return out.assign(**{n: out[n].where(out[n].notna(), None) for n in names if out[n].dtype == object})


class Block:
    """The tokens of a block by the numbers of their words, and their distinct pairs."""

    def __init__(self, codes: pd.Series, answers: pd.DataFrame, model: Model):
        self.lengths, self.teaches = unpack(codes["lengths"]), unpack(codes["teaches"]).astype(bool)
        self.doc_ids = np.frombuffer(codes["ids"], np.int64)
        answers = answers.sort_values("part")
        first = np.repeat(np.array([model.first[p] for p in answers["part"]], np.int64), [int.from_bytes(x[1:9], "little") for x in answers["numbers"]])
        counts = np.concatenate([unpack(c) for c in answers["counts"]])
        numbers = np.where(counts > 0, np.concatenate([unpack(n) for n in answers["numbers"]]) + first, model.unknown)
        tokens = unpack(codes["codes"])
        starts = np.cumsum(self.lengths) - self.lengths
        self.w, self.count = numbers[tokens], counts[tokens]
        self.v, self.before = np.r_[0, self.w[:-1]], np.r_[0, self.count[:-1]]
        self.v[starts], self.before[starts] = model.start, model.texts
        self.pair_v, self.pair_w, self.at = distinct_pairs(self.v, self.w, model.start + 1)
        hot = np.isin(self.pair_v, model.hot)
        parts = (_mix(self.pair_v + np.where(hot, _mix(self.pair_w).astype(np.int64), 0)) % np.uint64(model.parts)).astype(np.int64)
        parts[self.pair_v == model.unknown] = -1  # words not met are followed by nothing that was
        self.order = np.argsort(parts, kind="stable")
        self.sizes = np.bincount(parts + 1, minlength=model.parts + 1)

    def by_part(self) -> Iterator[tuple[int, np.ndarray]]:
        ends = np.cumsum(self.sizes)
        for part in np.flatnonzero(self.sizes[1:]):
            yield int(part), self.order[ends[part] : ends[part + 1]]


def _rises(heads: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Differences of values that rise between ``heads`` (true where a run begins), the first of a run as it is."""
    return np.where(heads, values, values - np.r_[0, values[:-1]])


def _risen(heads: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The values of ``_rises``."""
    at = np.flatnonzero(heads)
    total = np.cumsum(steps)
    return total - np.repeat(total[at] - steps[at], np.diff(np.r_[at, len(steps)]))


@dataclass
class Model:
    """What the driver knows: sizes, the unigrams, hot contexts, and later the discounts of pairs and triples."""

    words: Words
    texts: int
    first: dict[int, int]  # number of a word partition's first word
    hot: np.ndarray
    parts: int
    d: np.ndarray | None = None
    hot_lower: np.ndarray | None = None  # by hot context: P of the words met after it
    hot_tally: np.ndarray | None = None
    hot_pairs: np.ndarray | None = None  # (first, second word) of the pairs that are hot contexts of triples, sorted
    d3: np.ndarray | None = None
    hot_pair_lower: np.ndarray | None = None  # discounted counts of the last two words of the triples met after it
    hot_pair_tally: np.ndarray | None = None

    def hot_place(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Place of pairs among the hot ones, or -1."""
        at = {(int(a), int(b)): i for i, (a, b) in enumerate(self.hot_pairs)}
        near = np.flatnonzero(np.isin(v, self.hot_pairs[:, 0]) & np.isin(w, self.hot_pairs[:, 1]))
        out = np.full(len(v), -1, np.int64)
        out[near] = [at.get((a, b), -1) for a, b in zip(v[near].tolist(), w[near].tolist(), strict=True)]
        return out

    @property
    def unknown(self) -> int:
        return self.words.distinct

    @property
    def start(self) -> int:
        return self.words.distinct + 1


def _messages(model: Model):
    def send(codes: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        pieces.trim()
        block = Block(codes.iloc[0], answers, model)
        taught = np.bincount(block.at[np.repeat(block.teaches, block.lengths)], minlength=len(block.pair_v))
        count = np.zeros(len(block.pair_v), np.int64)
        count[block.at] = block.count  # of the second word
        out = []
        for part, own in block.by_part():
            v, w = block.pair_v[own], block.pair_w[own]
            step = np.r_[v[:1], np.diff(v)]
            out.append((codes["block"].iloc[0], part, pack(step), pack(np.where(step == 0, w - np.r_[0, w[:-1]], w)), pack(taught[own]), pack(count[own])))
        return pd.DataFrame(out, columns=["block", "part", "steps", "seconds", "taught", "counts"])

    return send


def _merge_pairs(model: Model, keep: bool):
    words, base, hot = model.words, model.start + 1, model.hot

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        steps = [unpack(x) for x in frame["steps"]]
        sizes = [len(x) for x in steps]
        v = np.concatenate([np.cumsum(x) for x in steps])
        step, w = np.concatenate(steps), np.concatenate([unpack(x) for x in frame["seconds"]])
        heads = np.flatnonzero((step != 0) | np.isin(np.arange(len(step)), np.r_[0, np.cumsum(sizes)[:-1]]))
        total = np.cumsum(w)  # seconds are differences inside a run of one context
        w = total - np.repeat(total[heads] - w[heads], np.diff(np.r_[heads, len(w)]))
        pair_v, pair_w, at = distinct_pairs(v, w, base)
        counts = np.zeros(len(pair_v), np.int64)
        np.add.at(counts, at, np.concatenate([unpack(x) for x in frame["taught"]]))
        second = np.zeros(len(pair_v), np.int64)
        second[at] = np.concatenate([unpack(x) for x in frame["counts"]])
        met = counts > 0
        contexts, of = np.unique(pair_v, return_inverse=True)
        lower = np.bincount(of[met], weights=words.prob(second[met]), minlength=len(contexts))
        tallies = np.zeros((len(contexts), TOP), np.int64)
        few = met & (counts <= TOP)
        np.add.at(tallies, (of[few], counts[few] - 1), 1)
        is_hot = np.isin(contexts, hot)
        sated = (tallies.sum(axis=1) == 0) & ~is_hot
        part = int(frame["part"].iloc[0])
        out = []
        cuts = np.cumsum(sizes)[:-1]
        for block, own in zip(frame["block"], np.split(at, cuts), strict=True):
            unmet = np.unique(of[own[~met[own]]])
            unmet = unmet[~is_hot[unmet]]
            out.append({
                "block": block, "part": part, "kind": PAIRS, "counts": pack(2 * counts[own] + sated[of[own]]),
                "numbers": pack(tallies[unmet].ravel()), "below": lower[unmet].tobytes(),
            })
        out.append({"block": -1, "part": part, "kind": TALLY, "tally": np.bincount(counts[met & (counts <= TOP + 1)], minlength=TOP + 2)[1:].tolist()})
        for c in np.flatnonzero(is_hot):
            out.append({"block": -1, "part": part, "kind": HOT_PART, "context": int(contexts[c]), "tally": tallies[c].tolist(), "lower": float(lower[c])})
        for c in np.flatnonzero(counts > words.tokens // HOT):
            out.append({"block": -1, "part": part, "kind": HOT_PAIR, "tally": [int(pair_v[c]), int(pair_w[c])]})
        if keep:
            step = np.r_[pair_v[met][:1], np.diff(pair_v[met])]
            seconds = pair_w[met]
            out.append({
                "block": -1, "part": part, "kind": MODEL, "numbers": pack(step), "counts": pack(counts[met]),
                "below": pack(np.where(step == 0, seconds - np.r_[0, seconds[:-1]], seconds)),
            })
        return _fill(pd.DataFrame(out))

    return merge


def _left(tallies: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Events that the discounts take off the items of contexts."""
    return tallies @ ((1 - d[1:]) * np.arange(1, TOP + 1))


class Pairs(Block):
    """A block with the counts of its pairs, and what its contexts leave over."""

    def __init__(self, codes: pd.Series, answers: pd.DataFrame, model: Model):
        super().__init__(codes, answers[answers["kind"] == WORDS], model)
        pairs = len(self.pair_v)
        self.met, self.sated = np.zeros(pairs, np.int64), np.zeros(pairs, bool)
        self.left, self.lower = np.zeros(pairs), np.zeros(pairs)
        answer = answers[answers["kind"] == PAIRS].set_index("part")
        is_hot = np.isin(self.pair_v, model.hot)
        hot_left = _left(model.hot_tally, model.d)
        for part, own in self.by_part():
            got = answer.loc[part]
            coded = unpack(got["counts"])
            self.met[own], self.sated[own] = coded >> 1, coded & 1
            unmet = own[(self.met[own] == 0) & ~is_hot[own]]
            contexts, of = np.unique(self.pair_v[unmet], return_inverse=True)
            self.left[unmet] = _left(unpack(got["numbers"]).reshape(len(contexts), TOP), model.d)[of]
            self.lower[unmet] = np.frombuffer(got["below"])[of]
        place = np.searchsorted(model.hot, self.pair_v[is_hot])
        self.left[is_hot], self.lower[is_hot] = hot_left[place], model.hot_lower[place]
        self.sated[is_hot] = hot_left[place] == 0
        self.left[self.sated] = 1.0
        self.events = self.before + self.sated[self.at]

    def probs(self, model: Model) -> np.ndarray:
        """P(w | v) of every token."""
        met, own = self.met[self.at], model.words.prob(self.count)
        with np.errstate(divide="ignore", invalid="ignore"):
            pair = discounted(met, model.d) / self.events
            back = np.where(self.before > 0, self.left[self.at] / self.events / (1 - self.lower[self.at]), 1.0) * own
        return np.where(met > 0, pair, back)


class Triples:
    """The distinct triples of a block whose first two words were met as a pair."""

    def __init__(self, block: Pairs, model: Model):
        follows = np.ones(len(block.w), bool)
        follows[np.cumsum(block.lengths) - block.lengths] = False
        at = np.flatnonzero(follows)
        self.tokens = at[block.met[block.at[at - 1]] > 0]
        context = block.at[self.tokens - 1]
        self.pair, self.third, self.at = distinct_pairs(context, block.w[self.tokens], model.start + 1)
        self.v, self.w = block.pair_v[self.pair], block.pair_w[self.pair]
        self.below = np.zeros(len(self.pair), np.int64)
        self.below[self.at] = block.met[block.at[self.tokens]]  # count of the last two words
        place = model.hot_place(block.pair_v, block.pair_w)[self.pair]
        self.hot = place
        key = _mix(self.v).astype(np.int64) + self.w + np.where(place >= 0, _mix(self.third).astype(np.int64), 0)
        parts = (_mix(key) % np.uint64(model.parts)).astype(np.int64)
        self.order = np.argsort(parts, kind="stable")
        self.sizes = np.bincount(parts, minlength=model.parts)

    def by_part(self) -> Iterator[tuple[int, np.ndarray]]:
        ends = np.cumsum(self.sizes)
        for part in np.flatnonzero(self.sizes):
            yield int(part), self.order[ends[part] - self.sizes[part] : ends[part]]


TRIPLE = "block long, part int, steps binary, seconds binary, sizes binary, thirds binary, taught binary, counts binary"


def _triple_messages(model: Model):
    def send(codes: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        pieces.trim()
        block = Pairs(codes.iloc[0], answers, model)
        triples = Triples(block, model)
        teaches = np.repeat(block.teaches, block.lengths)[triples.tokens]
        taught = np.bincount(triples.at[teaches], minlength=len(triples.pair))
        out = []
        for part, own in triples.by_part():
            pair = triples.pair[own]
            heads = np.r_[True, pair[1:] != pair[:-1]]
            first = own[heads]
            step = np.r_[triples.v[first][:1], np.diff(triples.v[first])]
            new = np.r_[True, step[1:] != 0]
            sizes = np.diff(np.r_[np.flatnonzero(heads), len(own)])
            out.append((
                codes["block"].iloc[0], part, pack(step), pack(_rises(new, triples.w[first])), pack(sizes),
                pack(_rises(heads, triples.third[own])), pack(taught[own]), pack(triples.below[own]),
            ))
        return pd.DataFrame(out, columns=[c.split()[0] for c in TRIPLE.split(", ")])

    return send


def _merge_triples(model: Model):
    """Adds the counts of a triple partition; answers each block as ``_merge_pairs`` does."""
    base = model.start + 1

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        pieces.trim()
        v, w, third, sizes, ends = [], [], [], [], []
        for row in frame.itertuples(index=False):
            step, size = unpack(row.steps), unpack(row.sizes)
            v.append(np.cumsum(step))
            w.append(_risen(np.r_[True, step[1:] != 0], unpack(row.seconds)))
            heads = np.zeros(int(size.sum()), bool)
            heads[np.cumsum(size) - size] = True
            third.append(_risen(heads, unpack(row.thirds)))
            sizes.append(size)
            ends.append(len(heads))
        context_v, context_w, of = distinct_pairs(np.concatenate(v), np.concatenate(w), base)
        of = np.repeat(of, np.concatenate(sizes))
        of, _, at = distinct_pairs(of, np.concatenate(third), base)
        counts = np.zeros(len(of), np.int64)
        np.add.at(counts, at, np.concatenate([unpack(x) for x in frame["taught"]]))
        below = np.zeros(len(of), np.int64)
        below[at] = np.concatenate([unpack(x) for x in frame["counts"]])
        met = counts > 0
        lower = np.bincount(of[met], weights=discounted(below[met], model.d), minlength=len(context_v))
        tallies = np.zeros((len(context_v), TOP), np.int64)
        few = met & (counts <= TOP)
        np.add.at(tallies, (of[few], counts[few] - 1), 1)
        place = model.hot_place(context_v, context_w)
        sated = (tallies.sum(axis=1) == 0) & (place < 0)
        part = int(frame["part"].iloc[0])
        out = []
        for block, own in zip(frame["block"], np.split(at, np.cumsum(ends)[:-1]), strict=True):
            unmet = np.unique(of[own[~met[own]]])
            unmet = unmet[place[unmet] < 0]
            out.append({
                "block": block, "part": part, "kind": TRIPLES, "counts": pack(2 * counts[own] + sated[of[own]]),
                "numbers": pack(tallies[unmet].ravel()), "below": lower[unmet].tobytes(),
            })
        out.append({"block": -1, "part": part, "kind": TALLY, "tally": np.bincount(counts[met & (counts <= TOP + 1)], minlength=TOP + 2)[1:].tolist()})
        for c in np.flatnonzero(place >= 0):
            out.append({"block": -1, "part": part, "kind": HOT_PART, "context": int(place[c]), "tally": tallies[c].tolist(), "lower": float(lower[c])})
        return _fill(pd.DataFrame(out))

    return merge


def _triple_probs(block: Pairs, answers: pd.DataFrame, model: Model) -> np.ndarray:
    """P(w | u, v) of every token."""
    probs = block.probs(model)
    triples = Triples(block, model)
    n = len(triples.pair)
    counts, sated, left, lower = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n), np.zeros(n)
    answer = answers[answers["kind"] == TRIPLES].set_index("part")
    hot = triples.hot >= 0
    for part, own in triples.by_part():
        got = answer.loc[part]
        coded = unpack(got["counts"])
        counts[own], sated[own] = coded >> 1, coded & 1
        unmet = own[(counts[own] == 0) & ~hot[own]]
        # Contexts of a partition are sorted by their words, as the pairs of a block are.
        contexts, of = np.unique(triples.pair[unmet], return_inverse=True)
        left[unmet] = _left(unpack(got["numbers"]).reshape(len(contexts), TOP), model.d3)[of]
        lower[unmet] = np.frombuffer(got["below"])[of]
    hot_left = _left(model.hot_pair_tally, model.d3)
    left[hot], lower[hot] = hot_left[triples.hot[hot]], model.hot_pair_lower[triples.hot[hot]]
    sated[hot] = hot_left[triples.hot[hot]] == 0
    left[sated] = 1.0
    at, own = triples.tokens, triples.at
    events = block.met[block.at[at - 1]] + sated[own]
    back = left[own] / events / (1 - lower[own] / block.events[at])
    probs[at] = np.where(counts[own] > 0, discounted(counts[own], model.d3) / events, back * probs[at])
    return probs


def _scores(model: Model):
    words = model.words

    def score(codes: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        pieces.trim()
        block = Pairs(codes.iloc[0], answers, model)
        logs = np.log10(block.probs(model) if model.d3 is None else _triple_probs(block, answers, model))
        base = np.log10((block.count + 1) / (words.tokens + words.distinct + 1))
        starts = np.cumsum(block.lengths) - block.lengths
        return pd.DataFrame({
            "doc_id": block.doc_ids, "teaches": block.teaches, "n_tokens": block.lengths,
            "n_known": np.add.reduceat((block.count > 0).astype(np.int64), starts), "train_tokens": words.tokens,
            "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(logs, starts),
        })

    return score


def score(
    docs: DataFrame, teaches: Column, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 12 << 20, part_bytes: int = 4 << 20, keep_model: bool = True,
    order: int = 2,
) -> DataFrame:
    """Scores of all texts by a model of those that ``teaches`` is true for, of word pairs or (``order`` 3) triples.

    (doc_id, teaches, n_tokens, n_known, train_tokens, base_score, score); ``base_score`` is that of single
    words with one added to each count. Scores are base-10 logarithms.
    """
    return learn_and_score(docs, teaches, id_col, text_col, block_bytes, part_bytes, keep_model, order)[0]


def learn_and_score(
    docs: DataFrame, teaches: Column, id_col: str, text_col: str, block_bytes: int, part_bytes: int, keep_model: bool, order: int = 2
) -> tuple[DataFrame, DataFrame]:
    """The scores, and the pair partitions' table (kind MODEL: first words, second words and counts, packed)."""
    spark = docs.sparkSession
    rows = docs.select(
        pieces.filled(F.col(id_col)).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), F.coalesce(teaches, F.lit(False)).alias("teaches")
    )
    size, texts = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.when(F.col("teaches"), 1))).first()
    blocks = cut_lineage(_blocks(rows, block_bytes, max(1, -(-size // (2 * part_bytes)))), "blocks")
    codes = blocks.filter(F.col("kind") == CODES).select("block", "ids", "teaches", "lengths", "codes")
    sent = blocks.filter(F.col("kind") == WORDS).select("block", "part", "words", "counts")
    answers = cut_lineage(sent.groupBy("part").applyInPandas(lambda f: _fill(_merge_words(f)), ANSWER), "words")
    tallies = sorted((r["part"], r["tally"]) for r in answers.filter(F.col("kind") == TALLY).select("part", "tally").collect())
    first, distinct, total = {}, 0, np.zeros(TOP + 2, np.int64)
    for part, tally in tallies:
        first[part], distinct, total = distinct, distinct + tally[0], total + np.array(tally[1:])
    model = Model(Words.of(int(total[0]), distinct, total[1:].tolist()), texts, first, np.zeros(0, np.int64), max(1, -(-size // part_bytes)))
    model.hot = _hot(answers, model)
    known = answers.filter(F.col("kind") == WORDS)
    messages = codes.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(
        _messages(model), "block long, part int, steps binary, seconds binary, taught binary, counts binary"
    )
    pairs = cut_lineage(messages.groupBy("part").applyInPandas(_merge_pairs(model, keep_model), ANSWER), "pairs")
    model.d, model.hot_tally, model.hot_lower = _totals(pairs, model.hot)
    back = known.unionByName(pairs.filter(F.col("kind") == PAIRS))
    if order > 2:
        hot = sorted(tuple(r["tally"]) for r in pairs.filter(F.col("kind") == HOT_PAIR).select("tally").collect())
        model.hot_pairs = np.array(hot, np.int64).reshape(-1, 2)
        messages = codes.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(_triple_messages(model), TRIPLE)
        triples = cut_lineage(messages.groupBy("part").applyInPandas(_merge_triples(model), ANSWER), "triples")
        model.d3, model.hot_pair_tally, model.hot_pair_lower = _totals(triples, np.arange(len(hot)))
        back = back.unionByName(triples.filter(F.col("kind") == TRIPLES))
    scored = codes.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(
        _scores(model), "doc_id long, teaches boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return scored.withColumn("doc_id", pieces.unfilled("doc_id")), pairs


def _totals(answers: DataFrame, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Discounts of an order, and by hot context the tally and the lower order's share of what was met after it."""
    items = answers.filter(F.col("kind").isin(TALLY, HOT_PART)).select("kind", F.coalesce("context", F.lit(-1)).alias("context"), "lower", F.posexplode("tally").alias("at", "n"))
    summed: dict[int, dict[int, tuple]] = {}
    for r in items.groupBy("context", "at").agg(F.sum("n").alias("n"), F.sum("lower").alias("lower")).collect():
        summed.setdefault(r["context"], {})[r["at"]] = (r["n"], r["lower"])
    tally = np.array([[summed.get(int(v), {}).get(i, (0, 0))[0] for i in range(TOP)] for v in hot], np.int64).reshape(-1, TOP)
    lower = np.array([summed.get(int(v), {}).get(0, (0, 0.0))[1] for v in hot], float)
    return discounts([summed.get(-1, {}).get(i, (0, 0))[0] for i in range(TOP + 1)]), tally, lower


def _hot(answers: DataFrame, model: Model) -> np.ndarray:
    """Numbers of the words that are more than 1/HOT of all tokens, and of the start of texts."""
    least, first = model.words.tokens // HOT, model.first

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                counts = unpack(row.counts)
                at = counts > max(least, 0)
                yield pd.DataFrame({"number": np.unique(unpack(row.numbers)[at]) + first[row.part]})

    found = answers.filter(F.col("kind") == WORDS).select("part", "numbers", "counts").mapInPandas(find, "number long").distinct()
    return np.array(sorted({r["number"] for r in found.collect()} | {model.start}), np.int64)
