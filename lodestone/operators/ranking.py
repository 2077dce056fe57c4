"""Filtering, ranking and batching candidate nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import ESSENTIAL
from .numbering import numbered


def contains_any(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p.lower()) for p in patterns], F.lit(False))


def likely(name: Column, include: list[str], exclude: list[str], capital_default: bool = False) -> Column:
    """Whether a name looks like the wanted kind: excluded patterns first, then included
    ones, as parts of the lower-case name.  Null and empty names do not.  With
    ``capital_default`` a name that matches nothing does if it begins with a capital
    and holds no underscore."""
    low = F.lower(name)
    other = (name.rlike(r"^\p{Lu}") & ~name.contains("_")) if capital_default else F.lit(False)
    return F.when(name.isNull() | (name == ""), False).when(contains_any(low, exclude), False).when(contains_any(low, include), True).otherwise(other)


def named(df: DataFrame, name: str = "name", without: str = "") -> DataFrame:
    """Rows with a name, and none that begins with ``without`` (such as ``_`` or ``__``)."""
    some = df.where(F.col(name) != "")
    return some.where(~F.col(name).startswith(without)) if without else some


def with_labels(df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Rows with any of the included labels and none of the excluded ones."""
    if include:
        df = df.where(F.coalesce(F.arrays_overlap("labels", F.array(*map(F.lit, include))), F.lit(False)))
    if exclude:
        df = df.where(~F.coalesce(F.arrays_overlap("labels", F.array(*map(F.lit, exclude))), F.lit(False)))
    return df


def in_communities(df: DataFrame, ids: list[str] | None = None, only_roots: bool = False) -> DataFrame:
    if ids is not None:
        df = df.where(F.col("louvain_community").isin(ids))
    return df.where("node_id = louvain_community") if only_roots else df


def cut_nodes(df: DataFrame) -> DataFrame:
    """The articulation points."""
    return df.where("is_articulation_point")


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; rows whose key is null or blank are dropped.  The
    rows meet as one candidate per partition and key (map-side), never in one group."""
    for k in keys:
        df = df.where(F.col(k).isNotNull() & (F.trim(F.col(k).cast("string")) != ""))
    every = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(*keys).agg(F.min_by(every, F.struct(*order)).alias("r"))
    return best.select("r.*")


def top_ranked(df: DataFrame, top: int | None = None, percentile: float | None = None, least: float | None = None, score: str = "pagerank", key: str = "node_id") -> DataFrame:
    """Rows with at least ``least``, then the ``top`` highest, or those in the upper
    100 - percentile percent, max(1, int(n * (100 - p) / 100)) of them; ties by key."""
    if least is not None:
        df = df.where(F.col(score) >= least)
    order = [F.col(score).desc(), F.col(key).asc()]
    if top is None and percentile is not None:
        n = df.count()
        top = max(1, int(n * (100 - percentile) / 100)) if n else 0
    return df.orderBy(*order) if top is None else df.orderBy(*order).limit(top)


def two_buckets(df: DataFrame, likely_column: str, most: int, score: str = "pagerank", key: str = "node_id") -> DataFrame:
    """At most ``most`` rows: the best ``most // 2`` likely ones, then the best others
    in the slots that are left.  Slots the others leave are not given back."""
    order = [F.col(score).desc(), F.col(key).asc()]
    first = df.where(F.col(likely_column)).orderBy(*order).limit(most // 2)
    rest = df.where(~F.col(likely_column)).orderBy(*order).limit(most)
    both = first.withColumn("_b", F.lit(0)).unionByName(rest.withColumn("_b", F.lit(1)))  # 1.5 * most rows at most
    return both.withColumn("_r", F.row_number().over(Window.orderBy("_b", *order))).where(F.col("_r") <= most).drop("_b", "_r")


def roots_and_best(df: DataFrame, most: int, others: int = 10) -> DataFrame:
    """Community roots and the best ``others`` of the rest, cut to ``most``."""
    order = [F.col("pagerank").desc(), F.col("node_id").asc()]
    roots = df.where("node_id = louvain_community").orderBy(*order).limit(most)
    rest = df.where("louvain_community is null or node_id <> louvain_community").orderBy(*order).limit(others)
    return roots.unionByName(rest).orderBy(*order).limit(most)


def batches(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """The rows with ``batch``: consecutive runs of ``size`` in the order."""
    return numbered(df, order, "_row").withColumn("batch", F.floor((F.col("_row") - 1) / size)).drop("_row")


def community_batches(df: DataFrame, order: list[Column], size: int, community: str = "louvain_community") -> DataFrame:
    """Like batches, with the members of a community side by side: communities in the
    order of their first member, null being one of its own."""
    rows = numbered(df, order, "_row")
    first = rows.groupBy(community).agg(F.min("_row").alias("_first"))
    both = rows.join(first.withColumnRenamed(community, "_c"), F.col(community).eqNullSafe(F.col("_c"))).drop("_c")
    return batches(both, [F.col("_first"), F.col("_row")], size).drop("_first", "_row")


def essential(df: DataFrame, kept: tuple[str, ...] = ESSENTIAL) -> DataFrame:
    """Candidates with pagerank at four places and the kept properties only."""
    return df.withColumn("pagerank", F.round("pagerank", 4)).withColumn("properties", F.map_filter("properties", lambda k, v: k.isin(*kept)))


def with_metrics(df: DataFrame, metrics: DataFrame, key: str = "node_id") -> DataFrame:
    """Left join with the metrics, missing ones being 0, false or null (community)."""
    m = metrics.where(F.col(key).isNotNull())
    out = df.join(m, key, "left")
    zero = {"pagerank": 0.0, "kcore_level": 0, "in_degree": 0, "out_degree": 0, "is_articulation_point": False}
    return out.fillna({k: v for k, v in zero.items() if k in m.columns})
