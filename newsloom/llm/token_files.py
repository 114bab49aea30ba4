"""Token id files: a concatenated id array with Elias-Fano coded document borders.

One file holds the documents of one range of ids in ascending order. Layout, little-endian:

    header   magic "TOKF", version, id width, low bits, 0 (u32 each), documents, ids, ones
             per sample (u64 each)
    doc ids  i64 each; the smallest i64 stands for null
    borders  Elias-Fano code of the end of each document in the id array: `low bits` bits of
             each, packed; then the high parts in unary (a one for each document, a zero for
             each step), packed; then the place of every 64th one (u64 each)
    ids      u16 if the vocabulary allows it, else u32

About two bits plus the logarithm of the mean length are spent on a border, and
:meth:`TokenFile.span` finds any document by a select on the ones, without reading the rest.

Edge cases: null and empty texts are the end id alone. Rows that share an id are kept, one
after the other; rows without an id come first. An empty table makes no file. Other columns
are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm import pieces
from newsloom.session import cut_lineage, scratch_path

MAGIC, VERSION, SAMPLE = b"TOKF", 1, 64
HEADER = struct.Struct("<4s4I3Q")


def _pack_bits(bits: np.ndarray) -> bytes:
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def encode_borders(ends: np.ndarray) -> tuple[int, bytes]:
    """Elias-Fano code of ascending numbers: (low bits, low parts + high parts + samples)."""
    n = len(ends)
    most = int(ends[-1]) if n else 0
    low_bits = max(0, (most // n).bit_length() - 1) if n else 0
    ends = ends.astype(np.uint64)
    shifts = np.arange(low_bits, dtype=np.uint64)
    low = (ends[:, None] >> shifts[None, :]) & np.uint64(1)
    ones = (ends >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    high = np.zeros(n + (most >> low_bits) + 1, np.uint8)
    high[ones] = 1
    return low_bits, _pack_bits(low.ravel()) + _pack_bits(high) + ones[::SAMPLE].astype("<u8").tobytes()


def encode_file(doc_ids: np.ndarray, ids: list[bytes], width: int) -> bytes:
    ends = np.cumsum([len(x) // width for x in ids], dtype=np.int64)
    low_bits, borders = encode_borders(ends)
    head = HEADER.pack(MAGIC, VERSION, width, low_bits, 0, len(ids), int(ends[-1]) if len(ids) else 0, SAMPLE)
    return b"".join([head, doc_ids.astype("<i8").tobytes(), borders, *ids])


class TokenFile:
    """Random access to one file, given as an open file with ``seek`` and ``read``."""

    def __init__(self, file):
        self.file = file
        magic, version, self.width, self.low_bits, _, self.n_docs, self.n_ids, self.sample = HEADER.unpack(self._at(0, HEADER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file")
        self.doc_ids = np.frombuffer(self._at(HEADER.size, 8 * self.n_docs), "<i8")
        start = HEADER.size + 8 * self.n_docs
        low = -(-self.n_docs * self.low_bits // 8)
        high = -(-(self.n_docs + (self.n_ids >> self.low_bits) + 1) // 8)
        samples = -(-self.n_docs // self.sample)
        self.low, self.high = self._at(start, low), self._at(start + low, high)
        self.samples = np.frombuffer(self._at(start + low + high, 8 * samples), "<u8")
        self.ids_start = start + low + high + 8 * samples

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def end(self, i: int) -> int:
        """End of document ``i`` in the id array, by select from the nearest sample."""
        place, left = int(self.samples[i // self.sample]), i % self.sample
        while left:
            place += 1
            left -= (self.high[place >> 3] >> (place & 7)) & 1
        low = 0
        for b in range(self.low_bits):
            at = i * self.low_bits + b
            low |= ((self.low[at >> 3] >> (at & 7)) & 1) << b
        return ((place - i) << self.low_bits) | low

    def span(self, i: int) -> tuple[int, int]:
        """Start and end of document ``i``."""
        return (self.end(i - 1) if i else 0), self.end(i)

    def ends(self) -> np.ndarray:
        """Ends of all documents."""
        high = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n_docs]
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n_docs * self.low_bits]
        low = bits.reshape(self.n_docs, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return ((high - np.arange(self.n_docs)) << self.low_bits) | low

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` to ``end`` of the array as u32."""
        found = self._at(self.ids_start + start * self.width, (end - start) * self.width)
        return np.frombuffer(found, f"<u{self.width}").astype("<u4")


def open_store(path: str):
    """File system and path inside it, for any address pyarrow knows."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path)


def write_token_files(
    docs: DataFrame, tokenizer: str, path: str, *, end_id: int = 1, vocabulary: int = 65_536, split=pieces.words,
    id_col: str = "doc_id", text_col: str = "text", bytes_per_file: int = 48 << 20,
) -> DataFrame:
    """Write the files below ``path``; returns their list (file, path, n_docs, n_ids).

    The ranges of ids are set from quantiles of the ids so that a file has about
    ``bytes_per_file`` bytes of text. Files get their names from the range and are moved into
    place when complete, so a task that runs again replaces its own file.
    """
    width = 2 if vocabulary <= 1 << 16 else 4
    rows = docs.select(pieces.filled(F.col(id_col)).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_files = max(1, -(-size // bytes_per_file))
    steps = [i / n_files for i in range(1, n_files)]
    bounds = np.array(sorted(set(rows.stat.approxQuantile("doc_id", steps, 0.1 / n_files) if steps else [])), np.float64)

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = pieces.library_encoder(tokenizer, split, f"<u{width}")
        end = np.array([end_id], f"<u{width}").tobytes()
        for frame in frames:
            keys = frame["doc_id"]
            ids = [x + end for x in encoder.encode(frame["text"].tolist())]
            yield pd.DataFrame({"file": np.searchsorted(bounds, keys, side="right"), "doc_id": keys, "ids": ids})

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = open_store(path)
        store.create_dir(folder, recursive=True)

        def close(file: int, keys: list[np.ndarray], ids: list[bytes]) -> pd.DataFrame:
            name, draft = f"{folder}/{file:08d}.tok", f"{folder}/.{file:08d}-{uuid.uuid4().hex}"
            doc_ids = np.concatenate(keys)
            with store.open_output_stream(draft) as out:
                out.write(encode_file(doc_ids, ids, width))
            store.move(draft, name)
            return pd.DataFrame({
                "file": [file], "name": [f"{file:08d}.tok"], "n_docs": [len(doc_ids)], "n_ids": [sum(map(len, ids)) // width],
            })

        now, keys, ids = None, [], []
        for frame in frames:
            for file, own in frame.groupby("file", sort=True):
                if now is not None and file != now:
                    yield close(now, keys, ids)
                    keys, ids = [], []
                now = file
                keys.append(own["doc_id"].to_numpy(np.int64))
                ids.extend(own["ids"])
        if now is not None:
            yield close(now, keys, ids)

    encoded = rows.mapInPandas(encode, "file int, doc_id long, ids binary")
    dealt = encoded.repartition(n_files, "file").sortWithinPartitions("file", "doc_id", "ids")
    written = cut_lineage(dealt.mapInPandas(write, "file int, name string, n_docs long, n_ids long"), "token-files")
    return written.select("file", F.concat(F.lit(path + "/"), "name").alias("path"), "n_docs", "n_ids")


def read_token_files(files: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """Documents of the files: (doc_id, start, n_tokens, ids_crc32[, ids]).

    ``start`` counts the ids of all documents before it. Only the list of files is summed up
    in one place; the files are read by as many tasks.
    """
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("before", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                store, name = open_store(row.path)
                with store.open_input_file(name) as file:
                    tokens = TokenFile(file)
                    ends = tokens.ends()
                    starts = np.r_[0, ends[:-1]]
                    for a in range(0, tokens.n_docs, 4096):
                        b = min(a + 4096, tokens.n_docs)
                        ids = memoryview(tokens.ids(int(starts[a]), int(ends[b - 1])).tobytes())
                        spans = [ids[4 * (s - starts[a]) : 4 * (e - starts[a])] for s, e in zip(starts[a:b], ends[a:b], strict=True)]
                        out = {
                            "doc_id": tokens.doc_ids[a:b], "start": starts[a:b] + row.before,
                            "n_tokens": ends[a:b] - starts[a:b], "ids_crc32": [zlib.crc32(x) for x in spans],
                        }
                        yield pd.DataFrame(out | ({"ids": [bytes(x) for x in spans]} if with_ids else {}))

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    # A given number of partitions: adaptive execution would put these few rows into one.
    tasks = max(1, min(files.count(), 10_000))
    return placed.repartition(tasks, "file").mapInPandas(read, schema).withColumn("doc_id", pieces.unfilled("doc_id"))


def fresh_folder(docs: DataFrame) -> str:
    """A new place for files in the shared folder."""
    return scratch_path(docs.sparkSession, "tokens")
