"""Session defaults and the shared folder for cut lineage and landed tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "newsloom", **conf: str) -> SparkSession:
    """A session with the settings every job here relies on.

    Partition counts are left to AQE: give ``spark.sql.shuffle.partitions`` as the
    upper bound for the cluster at hand and let coalescing shrink it.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that results depend on, for sessions made elsewhere.

    A union that reuses the partitioning of its inputs goes wrong when adaptive execution
    has coalesced them differently: a later ``groupBy`` then yields a key twice.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    for limit in ("RowLimit", "LevelLimit"):  # recursive queries end by themselves
        spark.conf.set(f"spark.sql.cteRecursion{limit}", "-1")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, set as checkpoint folder.

    Only a local-mode session (tests) may fall back to a folder of its own; on a
    cluster a machine-local folder would not survive the loss of an executor.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(path)
    return context._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: one computation, short plan."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return prepare(spark).read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on a file too small to be split; a large table is left as it is scanned."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
