"""Best-fit packing of tokenized documents into sequences of fixed length.

Bulk-synchronous best fit. Documents and gaps are ranged by size; those of one size are told
apart by their rank only, so a block (size, ranks) stands for all of them and the state has at
most ``capacity`` sizes, however many documents there are. Every round sweeps both from large to
small: a document takes the smallest free gap that holds it (its successor), larger documents
and lower ranks first; the gaps taken shrink, and the next round begins. New sequences open
only when no gap holds the largest document left. Spark tokenizes, counts sizes, ranks the
documents of a size and looks up their places.

Edge cases: null and empty texts are one end id. Texts longer than a sequence are cut; the
first piece is the shorter one. Rows with the same id, or without one, are documents of their
own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.llm import pieces
from newsloom.session import cut_lineage

SALTS = 32  # parts in which the documents of one size are ranked


def tokenized_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
    remember: int = pieces.LIMIT,
) -> DataFrame:
    """Pieces of every document: (doc_id, piece, start, length, ids_crc32[, ids])."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = pieces.library_encoder(tokenizer, pieces.spaced, "<u4", remember)
        end = np.array([end_id], "<u4").tobytes()
        for frame in frames:
            out = []
            for doc, ids in zip(frame["doc_id"], encoder.encode(frame["text"].tolist()), strict=True):
                whole = memoryview(ids + end)
                n = len(whole) // 4
                first = n % capacity or min(n, capacity)
                edges = [0, *range(first, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    part = whole[4 * a : 4 * b]
                    out.append((doc, piece, a, b - a, zlib.crc32(part), *((bytes(part),) if with_ids else ())))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
            yield pd.DataFrame(out, columns=names)
            if remember < pieces.LIMIT:  # memory is short
                del out
                pieces.trim()

    rows = docs.select(pieces.filled(F.col(id_col)).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return rows.mapInPandas(cut, schema).withColumn("doc_id", pieces.unfilled("doc_id"))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places of all documents: blocks (size, from_rank, to_rank, sequence, sequences, offset).

    Rank r of a block lies in sequence ``sequence + (r - from_rank) % sequences`` at
    ``offset + size * ((r - from_rank) // sequences)``.
    """
    left = {size: n for size, n in counts.items() if n > 0}
    at = dict.fromkeys(left, 0)
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, sequences)
    blocks: list[tuple[int, int, int, int, int, int]] = []
    opened = 0

    def place(size: int, gap: int, sequence: int, n: int, each: int) -> tuple[int, int, int]:
        blocks.append((size, at[size], at[size] + n * each, sequence, n, capacity - gap))
        at[size] += n * each
        left[size] -= n * each
        if not left[size]:
            del left[size]
        return gap - size * each, sequence, n

    while left:
        widest = max((gap for gap, _, _ in gaps), default=0)
        if max(left) > widest:
            homeless = {size: n for size, n in left.items() if size > widest}
            must = sum(n for size, n in homeless.items() if 2 * size > capacity)
            room = max(1, must, -(-sum(size * n for size, n in homeless.items()) // capacity))
            for size in sorted(homeless, reverse=True):
                if n := min(room, homeless[size]):
                    gaps.append(place(size, capacity, opened, n, 1))
                    opened, room = opened + n, room - n
        waiting = sorted((g for g in gaps if g[0] > 0), key=lambda g: (g[0], -g[1]))
        free: list[tuple[int, int, int]] = []  # a stack, the smallest gap on top
        taken: list[tuple[int, int, int]] = []
        for size in sorted(left, reverse=True):
            while waiting and waiting[-1][0] >= size:
                free.append(waiting.pop())
            each = max(1, left[size] // max(1, sum(n for _, _, n in free)))
            while free and size in left:
                gap, sequence, n = free.pop()
                fit = min(each, gap // size, left[size])
                use = min(n, left[size] // fit)
                taken.append(place(size, gap, sequence, use, fit))
                if use < n:
                    free.append((gap, sequence + use, n - use))
        gaps = _merged(waiting + free + taken)
    return blocks


def _merged(gaps: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Gaps of one size with adjoining sequences as one."""
    out: list[tuple[int, int, int]] = []
    for gap, sequence, n in sorted(gaps):
        if gap == 0:
            continue
        if out and out[-1][0] == gap and out[-1][1] + out[-1][2] == sequence:
            out[-1] = (gap, out[-1][1], out[-1][2] + n)
        else:
            out.append((gap, sequence, n))
    return out


def pack(
    docs: DataFrame, tokenizer: str, *, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False, remember: int = pieces.LIMIT,
) -> DataFrame:
    """Placed pieces: (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset).

    ``remember`` bounds the words a worker keeps, at about 200 bytes each; more save time.
    """
    spark = docs.sparkSession
    parts = tokenized_pieces(docs, tokenizer, end_id, capacity, id_col=id_col, text_col=text_col, with_ids=with_ids, remember=remember)
    parts = cut_lineage(parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int")), "pieces")
    sizes = parts.groupBy("length", "salt").count().collect()  # capacity x SALTS rows at most
    counts: dict[int, int] = {}
    before = []
    for length, salt, n in sorted(sizes):
        before.append((length, salt, counts.get(length, 0)))
        counts[length] = counts.get(length, 0) + n
    places: dict[int, list[tuple]] = {}
    for size, *block in best_fit(counts, capacity):
        places.setdefault(size, []).append(tuple(block))
    before_table = spark.createDataFrame(before, "length long, salt int, before long")
    place_table = spark.createDataFrame(
        sorted(places.items()),
        "length long, places array<struct<from_rank:long,to_rank:long,sequence:long,sequences:long,offset:long>>",
    )
    ranked = parts.withColumn("n", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(F.broadcast(before_table), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("n") - 1)
    rank = F.col("rank")
    placed = ranked.join(F.broadcast(place_table), "length").withColumn(
        "place", F.filter("places", lambda p: (p["from_rank"] <= rank) & (rank < p["to_rank"]))[0]
    )
    step = F.col("rank") - F.col("place.from_rank")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []),
        (F.col("place.sequence") + step % F.col("place.sequences")).alias("sequence_id"),
        (F.col("place.offset") + F.col("length") * F.floor(step / F.col("place.sequences"))).cast("long").alias("offset"),
    )
