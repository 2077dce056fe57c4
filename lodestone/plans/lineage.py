"""Cutting lineage and sizing shuffles."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes of input, as it lies compressed in its files, that one partition of a stage
#: spread by ``width`` holds at most, about.
PARTITION_BYTES = 128 << 20


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.  ``spark.checkpoint.dir`` names one that all
    executors share; a folder of this machine is set only where it is unset and the
    session is a local one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"lodestone-checkpoints-{os.getuid()}")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


#: Estimated bytes beyond which an estimate is not carried on.
ESTIMATE = 1 << 50


def cut(df: DataFrame) -> DataFrame:
    """The same rows, materialised in the checkpoint folder: later reads neither
    compute them again nor depend on an executor's memory.

    Spark keeps the estimated size of what was cut.  In a loop of joins estimates are
    multiplied round by round until they have thousands of digits, so one that has
    grown beyond all bounds is dropped; adaptive execution goes by real sizes."""
    checkpoint_folder(df.sparkSession)
    held = df.checkpoint(eager=True)
    if _estimate(held) <= ESTIMATE:
        return held
    spark = held.sparkSession
    rows = held._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, held._jdf.schema(), False), spark)


def _estimate(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that the rows are read from, by their sizes alone; what Spark
    has no size of counts as nothing."""
    sizes = [int(leaf.stats().sizeInBytes()) for leaf in _leaves(df._jdf.queryExecution().optimizedPlan())]
    return sum(x for x in sizes if x < 1 << 60)


def _leaves(plan) -> list:
    found = plan.collectLeaves()
    return [found.apply(i) for i in range(found.size())]


def width(spark: SparkSession, per_core: int = 3, rows: DataFrame | None = None) -> int:
    """Partitions for a stage that costs much CPU per row: enough for every core to
    get several, at least what the session shuffles into, and as many as keep a
    partition of ``rows`` under PARTITION_BYTES, however large the input is."""
    cores = spark.sparkContext.defaultParallelism
    least = max(cores * per_core, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return least if rows is None else max(least, -(-input_bytes(rows) // PARTITION_BYTES))


def for_every_core(df: DataFrame, *keys: str) -> DataFrame:
    """The rows as they are read where that gives each core a partition, else spread by
    the keys: wide columns are shuffled only when work would stand still without."""
    spark = df.sparkSession
    if df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(width(spark, 2, df), *keys)
