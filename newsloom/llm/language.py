"""Language by hyperdimensional profiles of letter n-grams.

Every letter has a random vector of ±1 (drawn from its code by a fixed seed). An n-gram binds
its letters: their vectors, permuted (rolled) by their place, are multiplied. A text is the
bundle (sum) of its n-gram vectors, a language the bundle of all its training texts, and a
text has the language whose prototype is nearest by cosine. As binding depends on the n-gram
only, a task counts the n-grams of its texts and multiplies counts by bound vectors.

Letters beyond a-z share a fixed number of slots by a hash of their code. N-grams run inside
words, with the word's borders as a letter of their own.

Edge cases: a text that is null or has no letter is ``und`` with score 0, and so is every text
if nothing could be learned. Rows without a language do not teach. Rows that share an id, or
have none (never held out), are judged each for itself; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import pieces

SLOTS = 64  # word border, a-z, and hashed other letters
N = 3
UNKNOWN = "und"
SEED = 20_011
BATCH = 1 << 20  # characters
ROWS = 1000  # judged at a time


@lru_cache(maxsize=1)
def slot_of_code() -> np.ndarray:
    """Slot by code point: 0 for all that is no letter, capitals as small letters."""
    slots = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            small = ord(char.lower()[0])
            slots[code] = small - 96 if 97 <= small <= 122 else 27 + small * 2_654_435_761 % (1 << 32) % (SLOTS - 27)
    return slots


@lru_cache(maxsize=4)
def letter_vectors(dims: int) -> tuple[np.ndarray, ...]:
    """Vectors of all letters, permuted for each place in the n-gram."""
    letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (SLOTS, dims))
    return tuple(np.roll(letters, N - 1 - place, axis=1) for place in range(N))


def bound(codes: np.ndarray, dims: int) -> np.ndarray:
    """Vectors of n-gram codes."""
    out = np.ones((len(codes), dims), np.float32)
    for place, letters in enumerate(letter_vectors(dims)):
        out *= letters[codes // SLOTS ** (N - 1 - place) % SLOTS]
    return out


def gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the texts: (text number, code)."""
    raw = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    own = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[: len(raw)]
    slots = slot_of_code()[raw].astype(np.int64)
    keep = np.ones(len(slots), bool)
    keep[1:] = (slots[1:] > 0) | (slots[:-1] > 0)
    slots, own = np.r_[0, slots[keep], 0], np.r_[own[:1], own[keep], own[-1:]]
    if len(slots) < N:
        return own[:0], slots[:0]
    code = slots[:-2] * SLOTS**2 + slots[1:-1] * SLOTS + slots[2:]
    middle = slots[1:-1] > 0
    return own[1:-1][middle], code[middle]


def _parts(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in groups of about ``BATCH`` characters; a longer one is cut at its spaces."""
    numbers, parts, size = [], [], 0
    for i, text in enumerate(texts):
        start = 0
        while start < len(text) or not text:
            cut = text.find(" ", start + BATCH) if len(text) - start > BATCH else -1
            part = text[start:] if cut < 0 else text[start:cut]
            numbers.append(i)
            parts.append(part)
            size += len(part)
            if size >= BATCH or len(parts) >= 512:
                yield numbers, parts
                numbers, parts, size = [], [], 0
            if cut < 0:
                break
            start = cut
    if parts:
        yield numbers, parts


def _counted(parts: list[str], groups: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each group's n-grams (groups x codes) and the codes that occur."""
    own, code = gram_codes(parts)
    seen = np.zeros(SLOTS**N, bool)
    seen[code] = True
    codes = np.flatnonzero(seen)
    place = np.zeros(SLOTS**N, np.int64)
    place[codes] = np.arange(len(codes))
    flat = np.bincount(groups[own] * max(1, len(codes)) + place[code], minlength=n_groups * max(1, len(codes)))
    return flat.reshape(n_groups, -1)[:, : len(codes)].astype(np.float32), codes


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", dims: int = 1024) -> dict[str, np.ndarray]:
    """Prototype of every language, from all rows given (few languages, ``dims`` numbers each)."""

    def bundle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces.forget()
        total: dict[str, np.ndarray] = {}
        for frame in frames:
            langs, texts = frame["lang"].tolist(), frame["text"].tolist()
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs])
            for numbers, parts in _parts(texts):
                counts, codes = _counted(parts, number[numbers], len(names))
                counts = counts.astype(np.float64)
                for start in range(0, len(codes), 4096):
                    vectors = counts[:, start : start + 4096] @ bound(codes[start : start + 4096], dims)
                    for name, vector in zip(names, vectors, strict=True):
                        total[name] = total.get(name, 0) + vector
        if total:
            yield pd.DataFrame({"lang": list(total), "profile": [v.tolist() for v in total.values()]})

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    partial = rows.mapInPandas(bundle, "lang string, profile array<double>")
    summed = partial.select("lang", F.posexplode("profile").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    profiles: dict[str, np.ndarray] = {}
    for lang, i, x in summed.collect():
        profiles.setdefault(lang, np.zeros(dims))[i] = x
    return {lang: v / np.linalg.norm(v) for lang, v in sorted(profiles.items()) if v.any()}


def predict(
    docs: DataFrame, profiles: dict[str, np.ndarray], *, keep: list[str], text_col: str = "text", dims: int = 1024,
) -> DataFrame:
    """``keep`` columns with lang_pred and score, the cosine to the nearest prototype (0 if negative)."""
    names = list(profiles)
    prototypes = np.array([profiles[n] for n in names], np.float32).reshape(len(names), dims)
    schema = docs.select(*keep).schema
    text = "_text_of_language"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces.forget()
        for batch in (whole.slice(start, ROWS) for whole in batches for start in range(0, whole.num_rows, ROWS)):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            vectors = np.zeros((len(texts), dims), np.float32)
            for numbers, parts in _parts(texts):
                own = np.unique(numbers)
                counts, codes = _counted(parts, np.searchsorted(own, numbers), len(own))
                for start in range(0, len(codes), 4096):
                    vectors[own] += counts[:, start : start + 4096] @ bound(codes[start : start + 4096], dims)
            size = np.linalg.norm(vectors, axis=1)
            cosine = vectors @ prototypes.T / np.maximum(size, 1e-9)[:, None] if names else np.zeros((len(texts), 1))
            best = cosine.argmax(axis=1)
            known = (size > 0) & bool(names)
            langs = [names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            scores = np.where(known, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0).astype(float)
            kept = [batch.column(name) for name in schema.names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores)], [*schema.names, "lang_pred", "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + ["lang_pred string", "score double"]
    return docs.select(*keep, F.col(text_col).alias(text)).mapInArrow(judge, ", ".join(fields))

