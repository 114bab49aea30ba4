"""Line dedup: repeated runs of lines, found by prefix doubling over sequences of line ids.

The lines of all documents form one text of line ids. Prefix doubling ranks its suffixes by
their first line, then by the first 2, 4, 8 ... lines: the rank of 2h lines comes from sorting
the pairs (rank of h lines here, rank of h lines h further on), with the pairs spread over the
cluster by range. Suffixes that agree in their first L lines stand together; such an interval
of common prefix L is named by two overlapping ranks, (rank of 2^k lines at the start, rank of
2^k lines at the end), 2^k <= L. Its smallest position is the first copy, all others are later
copies, and the lines of later copies are deleted. Overlapping copies merge into maximal runs.

A run counts from ``min_words`` words on. Every longer repeated run is the union of its
shortest parts with so many words, which begin or end at each of its lines; so doubling stops
at ``min_words`` lines, and lines that occur once never take part.

Order is that of the ids (rows without one first), then of the lines. Edge cases: blank lines
do not count as lines of a run and stay where they are; a text of which only blank lines are
left becomes empty. Null and empty texts stay as they are. Rows alike in id and text are one
document and come back alike; rows with one id and different texts are two. All columns
of the input come back and only the text changes, but for one named ``removed``, whose place the
result's own takes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm import pieces
from newsloom.session import cut_lineage

PLACE = ["doc", "copy"]
BLANK = " \t\n\x0b\f\r"  # as \s in Spark's patterns


def line_sequence(docs: DataFrame, min_words: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines with a word: (doc, copy, line, q, a, b, words), q the number among them, (a, b) the line's id."""
    text = F.col(text_col)
    numbered = F.filter(F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("line"), x.alias("text"))), lambda s: s["text"].rlike("\\S"))
    rows = docs.filter(text.isNotNull()).select(
        pieces.filled(F.col(id_col)).alias("doc"), F.xxhash64(text).alias("copy"), F.posexplode(numbered).alias("q", "s")
    )
    return rows.select(
        *PLACE, "s.line", "q", F.xxhash64("s.text").alias("a"), F.xxhash64(F.lit(7), "s.text").alias("b"),
        F.least(F.regexp_count("s.text", F.lit("\\S+")), F.lit(min_words)).alias("words"),
    )


def _position() -> Column:
    return F.struct("doc", "copy", "q")


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur at two positions or more: (*keys, rank, first), ranks in the order of the keys."""
    classes = rows.groupBy(*keys).agg(F.min(_position()).alias("first"), F.max(_position()).alias("last")).filter("first < last")
    ordered = classes.drop("last").repartitionByRange(*keys).sortWithinPartitions(*keys)
    return cut_lineage(ordered.withColumn("rank", F.monotonically_increasing_id()), "ranks")


def _shortest_runs(rows: DataFrame, min_words: int) -> DataFrame:
    """Runs of several lines with ``min_words`` words and none to spare: (doc, copy, q, size, lines).

    From every line the shortest run that begins there, and the shortest that ends there.
    """

    def runs(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("q").sort_values("q")
        q, line, words = frame["q"].tolist(), frame["line"].tolist(), frame["words"].tolist()
        found = set()
        for ahead, step in ((True, 1), (False, -1)):
            for start in range(len(q)):
                total, end = words[start], start
                while total < min_words and 0 <= end + step < len(q) and q[end + step] == q[end] + step:
                    end += step
                    total += words[end]
                if total >= min_words and end != start:
                    found.add((start, end) if ahead else (end, start))
        return pd.DataFrame(
            [(*key, q[a], b - a + 1, line[a : b + 1]) for a, b in sorted(found)], columns=["doc", "copy", "q", "size", "lines"]
        )

    # A given number of partitions: adaptive execution would put so few bytes into one.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *PLACE).groupBy(*PLACE).applyInPandas(runs, "doc long, copy long, q int, size int, lines array<int>")


def later_copies(docs: DataFrame, min_words: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines to delete: (doc, copy, lines), a row for each later copy."""
    lines = cut_lineage(line_sequence(docs, min_words, id_col=id_col, text_col=text_col), "lines")
    rows = lines.join(_ranked(lines, ["a", "b"]), ["a", "b"])
    whole = rows.filter((F.col("words") >= min_words) & (_position() > F.col("first"))).select(*PLACE, F.array("line").alias("lines"))
    short = rows.filter(F.col("words") < min_words).select(*PLACE).distinct()
    rows = cut_lineage(rows.select(*PLACE, "line", "q", "words", "rank").join(short, PLACE, "left_semi"), "short-lines")
    runs = cut_lineage(_shortest_runs(rows, min_words), "runs")
    level, found, h = rows.select(*PLACE, "q", "rank"), [whole], 1
    while True:
        here = runs.filter((F.col("size") >= h) & (F.col("size") < 2 * h))
        ends = level.select(*PLACE, (F.col("q") + h).alias("end"), F.col("rank").alias("end_rank"))
        named = here.withColumn("end", F.col("q") + F.col("size")).join(level, [*PLACE, "q"]).join(ends, [*PLACE, "end"])
        interval = ["rank", "end_rank", "size"]
        firsts = named.groupBy(*interval).agg(F.min(_position()).alias("first"))
        found.append(named.join(firsts, interval).filter(_position() > F.col("first")).select(*PLACE, "lines"))
        h *= 2
        if h > min_words:
            break
        further = Window.partitionBy(*PLACE).orderBy("q").rangeBetween(h // 2, h // 2)
        pairs = level.withColumn("next", F.max("rank").over(further)).filter("next is not null").withColumnRenamed("rank", "here")
        level = pairs.join(_ranked(pairs, ["here", "next"]), ["here", "next"]).select(*PLACE, "q", "rank")
        level = cut_lineage(level.distinct(), "level")
    return reduce(DataFrame.unionByName, found)


def dedup_lines(docs: DataFrame, min_words: int = 5, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with later copies of runs taken out of the text, and ``removed``.

    ``removed``: the maximal runs deleted, as structs (first_line, lines), null if there are none.
    """
    gone = later_copies(docs, min_words, id_col=id_col, text_col=text_col)
    names = [n for n in docs.columns if n != "removed"]
    mark = "_" * (1 + max(map(len, names)))  # a name that no column has
    gone = gone.groupBy(*PLACE).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias(mark))
    whole = docs.select(F.struct(*names).alias("row"), pieces.filled(F.col(id_col)).alias("doc"), F.xxhash64(text_col).alias("copy"))
    joined = whole.join(gone, PLACE, "left").select("row.*", F.col(mark))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for text, lines in zip(batch.column(text_col).to_pylist(), batch.column(mark).to_pylist(), strict=True):
                if lines:
                    out = set(lines)
                    kept = [x for i, x in enumerate(text.split("\n")) if i not in out]
                    text = "\n".join(kept) if any(x.strip(BLANK) for x in kept) else ""
                texts.append(text)
                removed.append(_maximal(lines) if lines else None)
            columns = [pa.array(texts, pa.string()) if n == text_col else batch.column(n) for n in names]
            runs = pa.array(removed, pa.list_(pa.struct([("first_line", pa.int32()), ("lines", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*columns, runs], [*names, "removed"])
            del texts, removed, columns, runs
        pieces.trim()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "removed")
    return joined.mapInArrow(cut, f"{fields}, removed array<struct<first_line:int,lines:int>>")


def _maximal(lines: list[int]) -> list[dict[str, int]]:
    """Ascending line numbers as runs."""
    runs: list[dict[str, int]] = []
    for line in lines:
        if runs and runs[-1]["first_line"] + runs[-1]["lines"] == line:
            runs[-1]["lines"] += 1
        else:
            runs.append({"first_line": line, "lines": 1})
    return runs
