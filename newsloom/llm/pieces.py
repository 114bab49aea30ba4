"""Encode texts piece by piece, each distinct piece once per worker.

A piece is a run of white space with the run of other characters after it. No pattern of the
tokenizers used here matches across the border between two pieces, so the ids of a text are
the ids of its pieces in order. Encoded pieces are remembered in the worker up to ``LIMIT``
entries; then the memory starts afresh, which only costs time.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
import string
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 600_000
SEGMENT = 1 << 22

# The characters with the Unicode property White_Space.
WHITE = "\t-\r \x85\xa0  -     　"

MARKS = ",.;:!?"
ALL_MARKS = string.punctuation  # of ASCII; a pattern takes a run of them at the end of a piece as one match
NO_ID = -(1 << 63)

_OTHER = re.compile(f"[{WHITE}] | [{WHITE}]")
_PIECES = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_MIXED = re.compile(f"[{WHITE}\x01]")
_RARE = re.compile(f"[\t\x0b-\r{WHITE.split(' ')[1]}]")  # other white space than spaces and line breaks
_CUT = re.compile(f"(?<=[^{WHITE}]) (?=[^{WHITE}])")
_ASCII_WHITE = ("  ", " \n", "\n ", "\t", "\r", "\v", "\f")


def filled(doc_id: Column) -> Column:
    """Ids for pandas, which would turn longs beside nulls into doubles."""
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def unfilled(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(NO_ID))


def segments(text: str) -> Iterator[str]:
    """Parts of a very long text, cut between pieces, so that only one at a time is split."""
    start = 0
    while len(text) - start > SEGMENT:
        cut = _CUT.search(text, start + SEGMENT)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def spaced(text: str) -> str | None:
    """The text if it splits into pieces at single spaces alone, else None."""
    odd = any(x in text for x in _ASCII_WHITE) if text.isascii() else _OTHER.search(text)
    return None if odd else text


def _with_lines(text: str) -> str | None:
    """A text of :func:`spaced` with a space before each line break, unless several could be one match."""
    if "\n" not in text:
        return text
    if "\n\n\n" in text or text.endswith("\n\n") or not text.isascii() and _RARE.search(text):
        return None
    return text.replace("\n", " \n")


def words(text: str) -> str:
    """The text for tokenizers that drop white space, line breaks as spaces."""
    return text.replace("\n", " ")


class Encoder:
    """Texts to ids by way of remembered pieces.

    ``encode_all`` gives the ids of each of a list of strings with a prefix, as bytes of ``dtype``; ``split`` is
    :func:`spaced` or :func:`words`; ``fold`` a change to ASCII pieces that makes no difference
    to their ids.
    """

    def __init__(
        self, encode_all: Callable[[list[str], str], Sequence[bytes]], split: Callable, dtype: str, fold: Callable[[str], str] | None = None,
        limit: int = LIMIT, *, end_marks: str = MARKS, by_line: bool = False, markers: Sequence[str] = (),
    ):
        """``by_line``: every line break before a word or another break is a match of its own. Parts of texts that hold one of
        ``markers`` (how special tokens begin) are encoded whole."""
        self.encode_all, self.split, self.dtype, self.fold, self.limit = encode_all, split, dtype, fold, limit
        self.end_marks, self.by_line, self.markers = end_marks, by_line, markers
        self.plain: dict[str, bytes] = {}
        self.after_space: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def _ids_of(self, known: dict[str, bytes], pieces: list[str], prefix: str) -> list[bytes]:
        found = list(map(known.get, pieces))
        holes = [i for i, ids in enumerate(found) if ids is None]
        if holes:
            new = {pieces[i] for i in holes}
            if len(known) + len(new) > self.limit:
                known.clear()
            self._learn(known, new, prefix)
            for i in holes:
                found[i] = known[pieces[i]]
        return found

    def _learn(self, known: dict[str, bytes], new: set[str], prefix: str) -> None:
        lined = [p for p in new if p[:1] == "\n"] if self.by_line and prefix else []
        if lined:
            line, rest = self.encode_all(["\n"], "")[0], self._ids_of(self.plain, [p[1:] for p in lined], "")
            known.update(zip(lined, [line + ids for ids in rest], strict=True))
            new = new.difference(lined)
        stems = {p: self._stem(p) for p in new if p[-1:] in self.end_marks or (self.fold and not p.islower())}
        whole = list((new - stems.keys()) | {stem for stem, _ in stems.values() if stem not in known})
        known.update(zip(whole, self.encode_all(whole, prefix), strict=True))
        marks = list({mark for _, mark in stems.values() if mark not in self.marks})
        self.marks.update(zip(marks, self.encode_all(marks, ""), strict=True))
        for piece, (stem, mark) in stems.items():
            if piece != stem:
                known[piece] = known[stem] + self.marks[mark]

    def _stem(self, piece: str) -> tuple[str, str]:
        """What needs to be encoded of a piece: the folded word and the marks that close it.

        The patterns match letters and marks apart, so such a piece is two in one.
        """
        at = len(piece.rstrip(self.end_marks))
        if not (0 < at < len(piece) and piece[at - 1] < "\u0250" and piece[at - 1].isalpha()):
            at = len(piece)
        stem = piece[:at]
        return self.fold(stem) if self.fold and stem.isascii() else stem, piece[at:]

    def encode(self, texts: list[str], batch: int = 1 << 22) -> Iterator[bytes]:
        """Ids of each text as bytes; about ``batch`` characters are split at a time."""
        numbers: list[int] = []
        parts: list[str] = []
        size, now, whole = 0, 0, []

        def flush() -> Iterator[bytes]:
            nonlocal now, whole
            for number, ids in zip(numbers, self._encode_parts(parts), strict=True):
                if number != now:
                    yield b"".join(whole)
                    now, whole = number, []
                whole.append(ids)

        for i, text in enumerate(texts):
            for part in segments(text):
                numbers.append(i)
                parts.append(part)
                size += len(part)
                if size >= batch:
                    yield from flush()
                    numbers, parts, size = [], [], 0
        yield from flush()
        if texts:
            yield b"".join(whole)

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        marked = [i for i, p in enumerate(parts) if any(m in p for m in self.markers)]
        if not marked:
            return self._encode_plain(parts)
        out = dict(zip(marked, self.encode_all([parts[i] for i in marked], ""), strict=True))
        plain = iter(self._encode_plain([p for i, p in enumerate(parts) if i not in out]))
        return [out[i] if i in out else next(plain) for i in range(len(parts))]

    def _encode_plain(self, parts: list[str]) -> list[bytes]:
        """Arrow splits and numbers the pieces, so that only distinct ones are looked up."""
        if not parts:
            return []
        lines = [self.split(p) for p in parts]
        if self.by_line:
            lines = [x and _with_lines(x) for x in lines]
        split = pc.split_pattern(pa.array([x or "" for x in lines], pa.string()), " ")
        coded = split.values.dictionary_encode()
        distinct, at = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        edges = split.offsets.to_numpy()
        ids = self._ids_of(self.after_space, distinct, " " if self.split is spaced else "")
        if self.split is spaced:  # the first piece of a part has no space before it
            heads = self._ids_of(self.plain, [distinct[i] for i in at[edges[:-1]]], "")
            odd = [i for i, x in enumerate(lines) if x is None]
            pieces = [_PIECES.findall(parts[i]) for i in odd]
            flat = iter(self._ids_of(self.plain, [p for own in pieces for p in own], ""))
            for i, own in zip(odd, pieces, strict=True):
                heads[i] = b"".join(next(flat) for _ in own)
            at[edges[:-1]] = len(ids) + np.arange(len(parts))
            ids = ids + heads
        width = np.dtype(self.dtype).itemsize
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // width
        starts = np.cumsum(sizes) - sizes
        own = sizes[at]
        ends = np.cumsum(own)
        where = np.repeat(starts[at] - (ends - own), own) + np.arange(ends[-1])
        out = np.frombuffer(b"".join(ids), self.dtype)[where]
        borders = np.r_[0, ends][edges].tolist()
        return [out[a:b].tobytes() for a, b in zip(borders, borders[1:], strict=False)]


@lru_cache(maxsize=4)
def library_encoder(path: str, split: Callable, dtype: str, limit: int = LIMIT) -> Encoder:
    """Encoder by a file of the tokenizers library; kept by the worker.

    New pieces are encoded many at a time, with a separator between them that no piece has and
    that is one id of its own; those that could mix with it are encoded alone.
    """
    trim()
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    separator = " \x01 " if split is words else "\n"

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    own = encode([separator])[0]
    width = np.dtype(dtype).itemsize

    def alone(texts: list[str], prefix: str) -> list[bytes]:
        return [x.tobytes() for x in encode([prefix + t for t in texts])]

    def together(texts: list[str], prefix: str) -> Sequence[bytes]:
        if len(own) != 1:
            return alone(texts, prefix)
        ids = encode([prefix + (separator + prefix).join(texts)])[0]
        cuts = np.flatnonzero(ids == own[0])
        if len(cuts) != len(texts) - 1:
            return alone(texts, prefix)
        raw, starts, ends = ids.tobytes(), np.r_[0, cuts + 1] * width, np.r_[cuts, len(ids)] * width
        return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def encode_all(texts: list[str], prefix: str) -> Sequence[bytes]:
        """In lots of 256; what cannot go together does not keep the others apart."""
        everything = "".join(texts)
        odd = not all(texts) or _MIXED.search(everything) or any(m in everything for m in markers)
        mixed = [i for i, t in enumerate(texts) if not t or _MIXED.search(t) or any(m in t for m in markers)] if odd else []
        out = dict(zip(mixed, alone([texts[i] for i in mixed], prefix), strict=True))
        rest = [t for i, t in enumerate(texts) if i not in out]
        found = iter([ids for start in range(0, len(rest), 256) for ids in together(rest[start : start + 256], prefix)])
        return [out[i] if i in out else next(found) for i in range(len(texts))]

    markers = sorted({t[:2] for t in special if t})
    return Encoder(
        encode_all, split, dtype, str.lower if split is words else None, limit, end_marks=ALL_MARKS, by_line=split is spaced, markers=markers
    )


def trim() -> None:
    """Give memory that nothing uses any more back to the system."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def forget() -> None:
    """Give back what this worker keeps for tokenizing; other stages' tasks begin with it.

    Workers outlive a stage, and the pieces they know are of no use to the next one.
    """
    if library_encoder.cache_info().currsize:
        library_encoder.cache_clear()
        gc.collect()
    trim()
