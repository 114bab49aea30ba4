"""Density clusters on a similarity graph and merging of similar clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom import constants as C
from newsloom.operators.clusters import NOISE, cluster_terms, drop_noise, noise_rows
from newsloom.operators.forest import local_forests
from newsloom.operators.leaders import collapse_copies, follow, greedy_leaders
from newsloom.operators.meets import Vectors, scan_tiles
from newsloom.operators.pairs import FEW, few_cosines
from newsloom.operators.vectors import added_up, english_stop_words, tfidf, word_grams
from newsloom.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): (id, root), root the lowest id of each.

    Tasks first thin their own edges to forests. Edges are contracted to stars by turns: every node links its larger neighbours, then its
    smaller ones, to the smallest it knows. Each turn only joins edges with per-node minima.
    """
    stars = local_forests(edges).select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).filter("low < high").distinct()
    stars = cut_lineage(stars, "stars")
    before = None
    while True:
        both = stars.select("low", "high").unionByName(stars.select(F.col("high").alias("low"), F.col("low").alias("high")))
        least = both.groupBy("low").agg(F.least(F.min("high"), F.col("low")).alias("root"))
        large = both.filter("high > low").join(least, "low").select(F.col("root").alias("low"), "high")
        large = large.filter("low < high").distinct()
        root = large.groupBy("high").agg(F.min("low").alias("root"))
        linked = large.join(root, "high")
        small = (
            linked.select(F.col("root").alias("low"), "high")
            .unionByName(linked.filter("low <> root").select(F.col("root").alias("low"), F.col("low").alias("high")))
            .distinct()
        )
        stars = cut_lineage(small, "stars")
        now = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("low", "high"))).first()
        if now == before:
            break
        before = now
    return stars.select(F.col("high").alias("id"), F.col("low").alias("root")).unionByName(
        stars.select(F.col("low").alias("id"), F.col("low").alias("root")).distinct()
    )


def default_sizes(n: int) -> tuple[int, int]:
    """Least cluster size and neighbour count for ``n`` articles of a small run."""
    if n < 8:
        return 2, 1
    size = max(2, int(n * 0.05))
    return size, max(1, size // 2)


def density_clusters(nodes: DataFrame, pairs: DataFrame, min_size: int, min_neighbours: int) -> DataFrame:
    """Cluster of every node: (id, cluster_id), -1 for noise.

    ``nodes``: id, copies (how many equal articles it stands for). ``pairs``: a, b, cosine.
    Nodes with enough neighbours are cores; connected cores form a cluster, other nodes join
    the cluster of their most similar core. A cluster bears the lowest id of its cores.
    """
    sides = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "cosine").unionByName(
        pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "cosine")
    )
    weights = nodes.select(F.col("id").alias("other"), "copies")
    near = sides.join(weights, "other").groupBy("id").agg(F.sum("copies").alias("near"))
    cores = cut_lineage(
        nodes.join(near, "id", "left")
        .filter(F.coalesce("near", F.lit(0)) + F.col("copies") - 1 >= min_neighbours).select("id"),
        "cores",
    )
    inner = pairs.join(cores.withColumnRenamed("id", "a"), "a", "left_semi").join(
        cores.withColumnRenamed("id", "b"), "b", "left_semi"
    )
    roots = components(inner.select("a", "b"))
    core_roots = cut_lineage(
        cores.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root")), "roots"
    )
    border = (
        sides.join(cores, "id", "left_anti")
        .join(core_roots.withColumnsRenamed({"id": "other"}), "other")
        .groupBy("id").agg(F.max_by("root", F.struct("cosine", -F.col("other"))).alias("root"))
    )
    members = core_roots.unionByName(border)
    sized = members.join(nodes, "id").groupBy("root").agg(F.sum("copies").alias("size"))
    kept = members.join(sized.filter(F.col("size") >= min_size).select("root"), "root", "left_semi")
    return nodes.select("id").join(kept, "id", "left").select("id", F.coalesce("root", F.lit(NOISE)).alias("cluster_id"))


def cluster_title_vectors(df: DataFrame, stop_words: Sequence[str] | None = None) -> DataFrame:
    """Unit word vectors of all titles of each cluster."""
    stop_words = english_stop_words() if stop_words is None else stop_words
    counts = cut_lineage(cluster_terms(df, word_grams(F.col("title"), stop_words)), "title-terms")
    n = df.filter("cluster_id >= 0").select("cluster_id").distinct().count()
    return tfidf(counts, added_up(counts), n)


def similar_vectors(vectors: DataFrame, threshold: float) -> DataFrame:
    """Dropped vectors (id, leader) of rows (id, term, weight, df): those with a cosine above ``threshold`` (below 1) to an earlier kept one.

    Equal vectors are collapsed first; more than ``FEW`` are compared tile by tile.
    """
    if vectors.select("id").distinct().count() <= FEW:
        return greedy_leaders(few_cosines(vectors).filter(F.col("cosine") > threshold))
    entries = F.array_sort(F.collect_list(F.struct("term", "weight")))
    rows = vectors.groupBy("id").agg(entries.alias("e")).select(
        "id", F.lit(0).alias("batch"), F.col("e.term").alias("tokens"), F.col("e.weight").alias("weights")
    )
    rows = cut_lineage(rows, "packed-titles")
    rounded = F.transform("weights", lambda w: F.round(w, 9))
    same = F.sha2(F.to_json(F.struct("tokens", rounded.alias("weights"))), 256)
    copies = cut_lineage(collapse_copies(rows.select("id", same.alias("same")), "same"), "title-copies")
    return follow(copies, scan_tiles(rows.join(copies, "id", "left_anti"), Vectors(threshold), F.size("tokens")))


def merge_similar_clusters(df: DataFrame, threshold: float = C.MERGE_COSINE,
                           stop_words: Sequence[str] | None = None) -> DataFrame:
    """Give clusters with similar titles the id of the lowest cluster they resemble."""
    vectors = cut_lineage(cluster_title_vectors(df, stop_words), "title-vectors")
    merged = similar_vectors(vectors, threshold)
    joined = drop_noise(df).join(merged.withColumnsRenamed({"id": "cluster_id"}), "cluster_id", "left")
    joined = joined.withColumn("cluster_id", F.coalesce("leader", "cluster_id")).select(*df.columns)
    return joined.unionByName(noise_rows(df))
