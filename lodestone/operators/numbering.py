"""Row numbers, running sums and percentiles over a whole table, without one task that
holds it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


def numbered(df: DataFrame, order: list[Column], name: str = "row") -> DataFrame:
    """The rows with their place (from 1, bigint) in the order, which must be total.

    Rows are spread by ranges of the order and numbered within each; the ranges' sizes,
    one row per partition, are summed up and added."""
    parted = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    local = parted.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return local.join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")


def percentiles_by_place(df: DataFrame, value: str, key: str, name: str = "percentile") -> DataFrame:
    """100 * place / (n - 1) rounded to two places, ties broken by the key; a single row
    has 100.  Rows with a null value are left out; none give none."""
    rows = df.where(F.col(value).isNotNull())
    n = rows.count()
    if n <= 1:
        return rows.withColumn(name, F.lit(100.0))
    return numbered(rows, [F.col(value).asc(), F.col(key).asc()], "_row").withColumn(name, F.round(100.0 * (F.col("_row") - 1) / (n - 1), 2)).drop("_row")


def percentiles_by_mean_rank(df: DataFrame, value: str, name: str = "percentile") -> DataFrame:
    """Like percentiles_by_place, but equal values share the mean of their places.
    Only the distinct values are put in order."""
    rows = df.where(F.col(value).isNotNull())
    n = rows.count()
    if n <= 1:
        return rows.withColumn(name, F.lit(100.0))
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    parted = cut(counts.repartitionByRange(F.col(value).asc()).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    sizes = parted.groupBy("_part").agg(F.sum("_n").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.coalesce(F.sum("_n").over(within), F.lit(0)) + (F.col("_n") - 1) / 2
    ranks = parted.join(offsets, "_part").select(value, F.round(100.0 * rank / (n - 1), 2).alias(name))
    return rows.join(ranks, value)
