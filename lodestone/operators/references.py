"""References to records that do not exist (yet, or any more)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import width
from .bitmaps import Bitmap


def references(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """One row per reference: table_name, space, record_id, endpoint, id, at.

    tables: name -> (rows with source_id, target_id and loaded_at, name of the id
    column, name of the space its parents live in).  A record delivered several times
    counts once, with its earliest ``loaded_at`` and the ends of that delivery (at
    equal times the least pair, nulls first).  Null ends are no references.  A record
    whose ``loaded_at`` is null everywhere has a null ``at``: nothing lives then.
    """
    parts = []
    for name, (rows, key, space) in tables.items():
        ends = F.struct(F.col("source_id").alias("source"), F.col("target_id").alias("target"))
        one = rows.groupBy(F.col(key).cast("string").alias("record_id")).agg(
            F.min(F.col("loaded_at").cast("timestamp_ntz")).alias("at"), F.min(F.struct(F.coalesce(F.col("loaded_at").cast("timestamp_ntz"), F.lit("9999-12-31").cast("timestamp_ntz")), ends.alias("ends")))["ends"].alias("ends")
        )
        parts.append(
            one.select(
                F.lit(name).alias("table_name"), F.lit(space).alias("space"), "record_id", "at",
                F.explode(F.create_map(F.lit("source"), F.col("ends.source"), F.lit("target"), F.col("ends.target"))).alias("endpoint", "id"),
            ).where("id is not null")
        )
    return reduce(DataFrame.unionByName, parts)


def lifetimes(spaces: dict[str, list[tuple[DataFrame, str, str | None]]]) -> DataFrame:
    """space, id, born, gone of each parent row.

    spaces: name -> list of (rows with loaded_at, id column, column of the time it went
    or None).  Rows without id or birth are none; equal rows count once; of rows born
    at one moment the one that lives longest is kept, null ``gone`` being for ever.
    """
    parts = []
    for space, tables in spaces.items():
        for rows, key, gone in tables:
            parts.append(
                rows.where(F.col(key).isNotNull() & F.col("loaded_at").isNotNull()).select(
                    F.lit(space).alias("space"), F.col(key).alias("id"), F.col("loaded_at").cast("timestamp_ntz").alias("born"),
                    (F.col(gone) if gone else F.lit(None)).cast("timestamp_ntz").alias("gone"),
                )
            )
    every = reduce(DataFrame.unionByName, parts)
    longest = F.max(F.struct(F.col("gone").isNull().alias("ever"), F.col("gone").alias("gone")))
    return every.groupBy("space", "id", "born").agg(longest["gone"].alias("gone"))


def month_number(t: Column) -> Column:
    return F.year(t) * 12 + F.month(t) - 1


def _month_begin(m: Column) -> Column:
    return F.make_date(F.floor(m / 12).cast("int"), (m % 12 + 1).cast("int"), F.lit(1)).cast("timestamp_ntz")


def _open_keys(group: pd.DataFrame) -> pd.DataFrame:
    """space, id, month of one key range where a key is referred to in a month that it does
    not live through: the range's keys as integers, a bitmap of references and one of
    living keys per month, and what the first has and the second has not."""
    code, keys = pd.factorize(group["id"])
    keys = np.asarray(keys, dtype=object)
    month, first, last = (group[c].to_numpy(dtype=np.float64) for c in ("month", "first", "last"))
    refers, lives = ~np.isnan(month), first <= last
    by_first = np.flatnonzero(lives)[np.argsort(first[lives], kind="stable")]
    by_last = np.flatnonzero(lives)[np.argsort(last[lives], kind="stable")]
    alive = np.zeros(len(keys), dtype=np.int64)  # lives of each key that hold through the month
    begun = ended = 0
    ids, months = [], []
    for m in np.unique(month[refers]):
        to = int(np.searchsorted(first[by_first], m, side="right"))
        np.add.at(alive, code[by_first[begun:to]], 1)
        gone = int(np.searchsorted(last[by_last], m, side="left"))
        np.subtract.at(alive, code[by_last[ended:gone]], 1)
        begun, ended = to, gone
        asked = Bitmap.of(np.unique(code[refers & (month == m)]))
        left = asked.and_not(Bitmap.of(np.flatnonzero(alive > 0))).numbers()
        ids.append(keys[left])
        months.append(np.full(len(left), int(m)))
    if not ids:
        return pd.DataFrame({"space": [], "id": [], "month": []})
    return pd.DataFrame({"space": group["space"].iloc[0], "id": np.concatenate(ids), "month": np.concatenate(months)})


def orphan_references(refs: DataFrame, parents: DataFrame, ranges: int | None = None) -> DataFrame:
    """table_name, record_id, endpoint, at of the references whose parent does not live
    at the moment of the record (born <= at, and not gone or gone > at).

    A hash puts each id into a key range; a range numbers its keys, builds for every
    month a compressed bitmap of the keys that are referred to and one of those that
    live through the whole month, and takes reference AND-NOT parent.  The keys that
    are left are missing, or are born or go within the month; only their references are
    held against the exact times, and only lifetimes that begin or end in that month
    take part, so a key's list there is short.  A key comes to its range once per month
    of references and once per lifetime, however many references it has, and there are
    as many ranges as keep one small.  Hubs: the join back to single references is one
    that adaptive execution splits where skewed.

    A reference with a null time is an orphan.  Empty inputs give no rows.
    """
    spark = refs.sparkSession
    refs = refs.withColumn("month", F.coalesce(month_number(F.col("at")), F.lit(-1)))
    ranges = ranges or width(spark, 4, refs.unionByName(parents, allowMissingColumns=True))
    # the months through which a key lives: from the first that begins after its birth
    # to the last that ends before it goes
    first = month_number(F.col("born")) + F.when(_month_begin(month_number(F.col("born"))) < F.col("born"), 1).otherwise(0)
    last = F.coalesce(month_number(F.col("gone")) - 1, F.lit(2**30))
    none = F.lit(None).cast("int")
    pairs = refs.select("space", "id", "month").distinct().withColumns({"first": none, "last": none})
    living = parents.select("space", "id", none.alias("month"), first.cast("int").alias("first"), last.cast("int").alias("last")).where("first <= last")
    both = pairs.unionByName(living).withColumn("range", F.pmod(F.xxhash64("id"), F.lit(ranges)).cast("int"))
    open_keys = both.groupBy("space", "range").applyInPandas(_open_keys, "space string, id string, month int")

    edge = parents.select("space", "id", "born", "gone", F.explode(F.array_distinct(F.array(month_number(F.col("born")), F.coalesce(month_number(F.col("gone")), month_number(F.col("born")))))).alias("month"))
    lives = (
        open_keys.join(edge, ["space", "id", "month"], "left")
        .groupBy("space", "id", "month")
        .agg(F.collect_set(F.when(F.col("born").isNotNull(), F.struct("born", "gone"))).alias("lives"))
    )
    alive = F.exists("lives", lambda x: (x["born"] <= F.col("at")) & (x["gone"].isNull() | (x["gone"] > F.col("at"))))
    return refs.join(lives, ["space", "id", "month"]).where(~F.coalesce(alive, F.lit(False))).select("table_name", "record_id", "endpoint", "at")


def graph_references(folder_tables) -> tuple[DataFrame, DataFrame]:
    """References and lifetimes of a code graph and its model.  ``folder_tables`` gives
    the table of a name."""
    t = folder_tables
    refs = references({"graph_edges": (t("graph_edges"), "edge_id", "graph"), "relationships": (t("relationships"), "identifier", "model")})
    lives = lifetimes(
        {
            "graph": [(t("file_nodes"), "node_id", "deleted_at"), (t("dependency_nodes"), "node_id", "deleted_at"), (t("technology_nodes"), "node_id", "deleted_at"), (t("repositories"), "node_id", None)],
            "model": [(t("elements"), "identifier", "disabled_at")],
        }
    )
    return refs, lives


def orphan_report(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """table_name, month (its first day), references, orphans, share."""
    gone = orphan_references(refs, parents).groupBy("table_name", F.trunc("at", "month").alias("month")).agg(F.count(F.lit(1)).alias("orphans"))
    every = refs.groupBy("table_name", F.trunc("at", "month").alias("month")).agg(F.count(F.lit(1)).alias("references"))
    same = (every["table_name"] == gone["table_name"]) & every["month"].eqNullSafe(gone["month"])
    n = F.coalesce(gone["orphans"], F.lit(0))
    return every.join(gone, same, "left").select(every["table_name"], every["month"], "references", n.alias("orphans"), (n / F.col("references")).alias("share"))
