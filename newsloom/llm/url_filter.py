"""URL filter: prefix rules first, then a list of canonical URLs behind a blocked Bloom filter.

All steps are DataFrame functions. The filter is a table of 256-bit blocks (four longs each);
a URL sets and tests eight bits inside one block. Only URLs whose bits are all set reach the
exact hash join with the list, which removes the false positives. The broadcast table never
has more than ``max_blocks`` rows; beyond that it lets more URLs through to the join, and the
result stays the same.

Edge cases: a null URL, or one without ``://``, has an empty host and path, fits no rule, is
never listed and is allowed. Repeated rows are judged each for itself. Other columns of the
input stay outside the operator; name them in ``keep`` to carry them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 4  # longs of a block
MAX_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """Host with A-Z lower-cased, empty if there is none."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Path up to the query or fragment, empty if there is none."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` or ``m.`` plus the path without closing slashes; null without a host."""
    bare = F.regexp_replace(host, "^(www|m)[.]", "")
    return F.when(bare != "", F.concat(bare, F.regexp_replace(path, "/+$", "")))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path) that fits, as a struct (size, rule, verdict), else null.

    Of two that are equally long the one with the longer host wins.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules; list single pages in the URL list")
    best = F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    ranked = sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1])))
    for verdict, rule_host, rule_path in ranked:
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        value = F.struct(
            F.lit(len(rule_host + rule_path)).alias("size"), F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict")
        )
        best = F.when(fits, value).otherwise(best)
    return best


def _masks(key: Column) -> list[Column]:
    """Two bits of each word of the block."""
    h = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("long")
    masks = []
    for j in range(WORDS):
        first = F.shiftrightunsigned(h, 12 * j).bitwiseAND(F.lit(63)).cast("int")
        second = F.shiftrightunsigned(h, 12 * j + 6).bitwiseAND(F.lit(63)).cast("int")
        left = F.call_function("shiftleft", one, first)
        right = F.call_function("shiftleft", one, second)
        masks.append(left.bitwiseOR(right))
    return masks


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """Blocks of the filter over column ``url_key``: (block, w0..w3); at most ``n_blocks`` rows."""
    masks = {f"m{j}": m for j, m in enumerate(_masks(F.col("url_key")))}
    return (
        listed.select(F.pmod(F.xxhash64("url_key"), F.lit(n_blocks)).alias("block"), *[m.alias(n) for n, m in masks.items()])
        .groupBy("block")
        .agg(*[F.bit_or(f"m{j}").alias(f"w{j}") for j in range(WORDS)])
    )


def maybe_listed(rows: DataFrame, keys: DataFrame, bits_per_key: int = 12, max_blocks: int = 1 << 19) -> DataFrame:
    """Rows with ``_maybe``: false only if their ``url_key`` is null or not among the distinct ``keys``."""
    n_blocks = min(max_blocks, max(1, keys.count() * bits_per_key // (64 * WORDS) + 1))
    blocks = F.broadcast(bloom_blocks(keys, n_blocks))  # n_blocks rows at most
    tested = rows.withColumn("block", F.pmod(F.xxhash64("url_key"), F.lit(n_blocks))).join(blocks, "block", "left")
    hit = F.col("url_key").isNotNull()
    for j, mask in enumerate(_masks(F.col("url_key"))):
        hit = hit & (F.coalesce(F.col(f"w{j}"), F.lit(0)).bitwiseAND(mask) == mask)
    return tested.withColumn("_maybe", hit).drop("block", *[f"w{j}" for j in range(WORDS)])


def filter_urls(
    pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]], *, id_col: str = "page_id",
    url_col: str = "url", keep: Sequence[str] = (), bits_per_url: int = 12, max_blocks: int = 1 << 19,
) -> DataFrame:
    """Verdict of every page: (id, host, path, rule, verdict, listed, *keep).

    ``listed``: one column ``url_key`` of canonical URLs (see :func:`canonical`); nulls and
    repetitions are harmless. A page that no rule fits is blocked if its URL is listed.
    """
    keys = listed.select("url_key").filter("url_key is not null").distinct()
    judged = (
        pages.select(id_col, *keep, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
        .withColumn("url_key", canonical(F.col("host"), F.col("path")))
        .withColumn("_rule", best_rule(F.col("host"), F.col("path"), rules))
    )
    tested = maybe_listed(judged, keys, bits_per_url, max_blocks)
    known = keys.withColumn("listed", F.lit(True)).hint("shuffle_hash")
    hits = tested.filter("_maybe").join(known, "url_key", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    clear = tested.filter("not _maybe").withColumn("listed", F.lit(False))
    return hits.unionByName(clear).select(
        id_col, "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "listed", *keep,
    )
