"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: small letters, homoglyphs and digit substitutions to plain letters,
words one space apart. The lexicon is learned from labelled rows: whole words, and beginnings
shared by several words, that stand in toxic texts far more often than chance among so many
candidates allows, in several contexts (copies of one text are one context). The weight of an
entry is its log-odds. A text's matches add up, those inside an exception phrase do not
count, and the sum is normalised by the text's length; a logistic curve through the labelled
rows turns it into a score.

Edge cases: null and empty texts score as a text without matches. Labels that are null teach
nothing; of several labels of a document the largest counts. Without labels of both kinds all
texts score 0. Rows that share an id, or have none, are scored each for itself; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm import pieces
from newsloom.llm.url_filter import maybe_listed
from newsloom.session import cut_lineage

# Look-alikes of Latin letters (Greek, Cyrillic, full width) and digits in their place.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m",
    "т": "t", "н": "h", "в": "b", "ԁ": "d", "ӏ": "l", "ο": "o", "α": "a", "ι": "i", "ν": "v", "ρ": "p", "τ": "t", "υ": "u",
    "κ": "k", "η": "n", "ѡ": "w", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
} | {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
# Phrases in which an otherwise insulting word means no harm.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "class clown", "clown fish", "sore loser", "pond scum", "soap scum", "stupid simple")

SHORTEST, LONGEST = 4, 8  # of a word's beginnings
FOLDED, AMOUNT = "_folded_text", "_amount_of_matches"
WORD = re.compile(r"[^\W\d_]+")


def folded(text: Column) -> Column:
    """Small letters without look-alikes."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), "".join(LOOKALIKES), "".join(LOOKALIKES.values()))


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)  # " word " or " beginning"
    slope: float = 0.0
    intercept: float = -math.inf


def _candidates(texts: DataFrame) -> DataFrame:
    """Entries with (toxic, n, contexts): texts with the word, and a sketch of the words before it."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces.forget()
        seen: dict[str, list[int]] = {}

        def out() -> pd.DataFrame:
            rows = [(w, *v) for w, v in seen.items()]
            seen.clear()
            return pd.DataFrame(rows, columns=["word", "toxic", "n", "contexts"])

        for frame in frames:
            for text, toxic in zip(frame[FOLDED], frame["toxic"], strict=True):
                own: dict[str, int] = {}
                before = ""
                for word in WORD.findall(text):
                    own[word] = own.get(word, 0) | 1 << zlib.crc32(before.encode()) % 63
                    before = word
                for word, contexts in own.items():
                    has = seen.get(word)
                    if has is None:
                        seen[word] = [toxic, 1, contexts]
                    else:
                        has[0] += toxic
                        has[1] += 1
                        has[2] |= contexts
                if len(seen) > 500_000:
                    yield out()
        if seen:
            yield out()

    sums = [F.sum("toxic").alias("toxic"), F.sum("n").alias("n"), F.bit_or("contexts").alias("contexts")]
    words = texts.mapInPandas(count, "word string, toxic long, n long, contexts long").groupBy("word").agg(*sums)
    size = F.length("word")
    starts = F.when(size > SHORTEST, F.transform(
        F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), size - 1)), lambda k: F.concat(F.lit(" "), F.substr("word", F.lit(1), k))
    )).otherwise(F.array().cast("array<string>"))
    entries = F.array_union(F.array(F.concat(F.lit(" "), "word", F.lit(" "))), starts)
    return (
        words.select(F.explode(entries).alias("entry"), "toxic", "n", "contexts")
        .groupBy("entry").agg(*sums, F.count("*").alias("words"))
    )


def _evidence(base: float) -> Column:
    """Log-likelihood ratio of an entry's share of toxic texts against the base rate."""
    p = F.col("toxic") / F.col("n")
    term = lambda k, share, rate: F.when(k > 0, k * F.log(share / rate)).otherwise(0.0)
    return term(F.col("toxic"), p, base) + term(F.col("n") - F.col("toxic"), 1 - p, 1 - base)


def learn(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    min_share: float = 0.8,
) -> Model:
    """Lexicon and curve from all labelled documents given.

    The lexicon reaches the driver without entries whose beginning is in it as well.
    """
    marks = labels.filter(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("long")).alias("toxic"))
    copies = docs.select(id_col, F.xxhash64(text_col).alias("copy")).join(marks, id_col)
    first = cut_lineage(copies.groupBy("copy").agg(F.min(id_col).alias("url_key"), F.max("toxic").alias("toxic")).drop("copy"), "labelled")
    n, toxic = first.agg(F.count("*"), F.sum("toxic")).first()
    if not toxic or toxic == n:
        return Model()
    base = toxic / n
    # Texts are shuffled only if a Bloom filter of bounded size lets their id pass.
    rows = maybe_listed(docs.select(F.col(id_col).alias("url_key"), folded(F.col(text_col)).alias(FOLDED)), first.select("url_key"))
    texts = cut_lineage(rows.filter("_maybe").drop("_maybe").join(first, "url_key").select(FOLDED, "toxic"), "texts")
    entries = _candidates(texts)
    enough = 5 + math.log(1_000 + 50 * n)  # for about 50 new words in a text
    chosen = (
        entries.withColumn("evidence", _evidence(base))
        .filter((F.col("toxic") >= min_share * F.col("n")) & (F.col("evidence") >= enough))
        .filter("bit_count(contexts) >= 4 and (entry like '% ' or words >= 3)").select("entry", "toxic", "n")
    )
    chosen = cut_lineage(chosen, "lexicon")
    longer = chosen.filter(F.length("entry") > 2)
    starts = longer.select("entry", F.explode(F.sequence(F.lit(2), F.length("entry") - 1)).alias("k")).select(
        F.col("entry").alias("longer"), F.substring("entry", F.lit(1), F.col("k")).alias("entry")
    )
    covered = starts.join(chosen.select("entry"), "entry", "left_semi").select(F.col("longer").alias("entry"))
    chosen = chosen.join(covered, "entry", "left_anti").collect()
    weights: dict[str, float] = {}
    for row in sorted(chosen, key=lambda r: (len(r.entry), r.entry)):
        weights[row.entry] = math.log((row.toxic + 0.5) / (row.n - row.toxic + 0.5)) - math.log(base / (1 - base))
    model = Model(weights)
    amounts = _amounts(texts, model, ["toxic"])
    bins = amounts.groupBy(F.round(AMOUNT, 2).alias("x"), "toxic").count().collect()
    model.slope, model.intercept = _curve([(x, y, k) for x, y, k in bins])
    return model


def _curve(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Logistic curve through (amount, label, rows) by Newton's method, with a little shrinkage."""
    x, y, k = (np.array(v, float) for v in zip(*bins, strict=True))
    features = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ beta, -30, 30)))
        gradient = features.T @ (k * (p - y)) + 0.1 * beta
        hessian = features.T @ (features * (k * p * (1 - p))[:, None]) + 0.1 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return max(0.0, float(beta[0])), float(beta[1])


def _automaton(weights: dict[str, float]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for entry, weight in weights.items():
        found.add_word(entry, (len(entry), weight))
    for phrase in EXCEPTIONS:
        if f" {phrase} " not in weights:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
    found.make_automaton()
    return found


def amount(text: str, automaton) -> float:
    """Weight of all matches, normalised by the logarithm of the text's words."""
    words = WORD.findall(text)
    hits, safe = [], []
    for end, (size, weight) in automaton.iter(f" {' '.join(words)} "):
        if weight is None:
            safe.append((end - size + 1, end))
        else:
            hits.append((end - size + 1, end, weight))
    total = sum(w for a, b, w in hits if not any(s <= a and b <= e for s, e in safe))
    return total / (10 + math.log1p(len(words)))


def _amounts(texts: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns and the amount of each row of folded texts."""
    weights, schema = model.weights, texts.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces.forget()
        automaton = _automaton(weights)
        for batch in batches:
            amounts = [amount(t, automaton) for t in batch.column(FOLDED).to_pylist()]
            kept = [batch.column(name) for name in schema.names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(amounts, pa.float64())], [*schema.names, AMOUNT])
        del automaton
        pieces.trim()

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + [f"{AMOUNT} double"]
    return texts.select(*keep, FOLDED).mapInArrow(run, ", ".join(fields))


def score(docs: DataFrame, model: Model, *, keep: list[str], text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``keep`` columns with score and predicted (1 from ``threshold`` on)."""
    texts = docs.select(*keep, folded(F.col(text_col)).alias(FOLDED))
    if math.isinf(model.intercept):
        value = F.lit(0.0)
    else:
        value = 1 / (1 + F.exp(-(F.col(AMOUNT) * model.slope + model.intercept)))
    scored = _amounts(texts, model, keep).withColumn("score", value).drop(AMOUNT)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
