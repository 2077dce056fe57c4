"""Records that differ in formatting only, collapsed and counted."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, width

_FORMATTING = re.compile(r"[^\w+#]|_")
#: Ends a part of the canonical text; no part holds it.
_END = "\x1f"

#: Records that one bucket may hold before it is split by further bytes.
BUCKET_ROWS = 50_000
#: Bytes of the canonical text that the levels of the split look at.
LEVELS = (4, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 1024, 4096, 2**14, 2**17, 2**20, 2**24, 2**30)


def plain(text: str) -> str:
    """Text without case and without all but letters, digits, + and #."""
    return _FORMATTING.sub("", text.lower())


class _Number(str):
    """A JSON number as it was written: numbers are compared exactly."""


def _value(v) -> str:
    if v is None:
        return "0"
    if isinstance(v, bool):
        return "b1" if v else "b0"
    if isinstance(v, _Number):
        return f"n{v}"
    if isinstance(v, dict):
        return "{" + "".join(f"{json.dumps(k)}:{_value(v[k])}{_END}" for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + "".join(_value(x) + _END for x in v) + "]"
    return "t" + plain(v)


def canonical_json(text: str | None) -> str:
    """Field order and layout are gone, text values are plain, numbers as written, a
    null field differs from an absent one.  Text that is no JSON stands for itself."""
    if text is None:
        return "0"
    try:
        return _value(json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_Number))
    except (ValueError, RecursionError):
        return "raw" + text


@dataclass(frozen=True)
class Shape:
    """Columns of a table by how they are compared."""

    name: str
    key: str
    exact: tuple[str, ...] = ()
    text: tuple[str, ...] = ()
    #: only case and surrounding blanks are formatting
    trimmed: tuple[str, ...] = ()
    json: tuple[str, ...] = ()


def canonical_records(tables: list[tuple[DataFrame, Shape]]) -> DataFrame:
    """table_name, id, canonical: one text per record, equal for records that differ in
    formatting only.  The text columns come first, so that the first characters differ
    most; null is ``0`` and a value has a mark before it, so null agrees with null only.
    Rows without id are no records."""

    def batches(shape: Shape):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            missing = lambda v: v is None or v != v
            for b in parts:
                columns = [[("0" if missing(v) else "t" + plain(v)) for v in b[c]] for c in shape.text]
                columns += [[("0" if missing(v) else "v" + v.strip().lower()) for v in b[c]] for c in shape.trimmed]
                columns += [[("0" if missing(v) else f"x{v}") for v in b[c]] for c in shape.exact]
                columns += [[canonical_json(None if missing(v) else v) for v in b[c]] for c in shape.json]
                texts = [_END.join(r) for r in zip(*columns)] if len(b) else []
                yield pd.DataFrame({"table_name": shape.name, "id": b[shape.key], "canonical": texts})

        return run

    parts = []
    for rows, shape in tables:
        wanted = list(dict.fromkeys((shape.key, *shape.text, *shape.trimmed, *shape.exact, *shape.json)))
        some = rows.where(F.col(shape.key).isNotNull()).select(*wanted)
        parts.append(some.mapInPandas(batches(shape), "table_name string, id bigint, canonical string"))
    return reduce(DataFrame.unionByName, parts)


class _Trie:
    """Path-compressed trie; a terminal counts the records that end there."""

    __slots__ = ("edges", "terminal")

    def __init__(self):
        self.edges: dict[str, tuple[str, _Trie]] = {}
        self.terminal: list | None = None  # [least id, the ids]

    def add(self, text: str, record: int) -> None:
        node, rest = self, text
        while rest:
            step = node.edges.get(rest[0])
            if step is None:
                leaf = _Trie()
                node.edges[rest[0]] = (rest, leaf)
                node = leaf
                break
            label, below = step
            if rest.startswith(label):
                node, rest = below, rest[len(label) :]
                continue
            n, most = 1, min(len(label), len(rest))
            while n < most and label[n] == rest[n]:
                n += 1
            middle = _Trie()
            middle.edges[label[n]] = (label[n:], below)
            node.edges[rest[0]] = (label[:n], middle)
            node, rest = middle, rest[n:]
        if node.terminal is None:
            node.terminal = [record, {record}]
        else:
            node.terminal[0] = min(node.terminal[0], record)
            node.terminal[1].add(record)

    def terminals(self) -> Iterator[list]:
        todo = [self]
        while todo:
            node = todo.pop()
            if node.terminal is not None:
                yield node.terminal
            todo += [below for _, below in node.edges.values()]


_MEMBERS = "table_name string, kept_id bigint, id bigint, copies bigint"


def _count_bucket(b: pd.DataFrame) -> pd.DataFrame:
    out: list[tuple] = []
    for name, rows in b.groupby("table_name", sort=False):
        trie = _Trie()
        for text, record in zip(rows["canonical"], rows["id"]):
            trie.add(text, record)
        for least, ids in trie.terminals():
            out += [(name, least, i, len(ids)) for i in ids]
    return pd.DataFrame(out, columns=["table_name", "kept_id", "id", "copies"])


def variant_groups(records: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """table_name, kept_id, id, copies of every record: the least id of its group and
    the group's size.

    Radix partitioning: records are counted by the first bytes of their canonical text;
    only buckets with more than ``bucket_rows`` are looked at again, by more bytes,
    until each fits.  There are at most rows / bucket_rows such buckets per
    level, so their table is small by construction; it is joined, never collected.  A
    bucket that cannot be split because its texts end is one group of equal records: it
    is counted with map-side aggregation instead of in one task, however large it is.
    A row that is there twice (same id, equal text) counts once.
    Buckets that fit are spread over tasks, and each task counts in a trie whose
    terminals hold the records.
    """
    spark = records.sparkSession
    rows = cut(records.withColumn("bytes", F.octet_length("canonical")))
    total = rows.count()
    first = lambda n: F.substring(F.encode("canonical", "UTF-8"), 1, n)
    levels = rows.withColumn("level", F.lit(0)).withColumn("bucket", first(LEVELS[0]))
    ended = None
    for k, size in enumerate(LEVELS):
        here = levels.where(F.col("level") == k)
        large = cut(here.groupBy("table_name", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("longest")).where(F.col("n") > bucket_rows))
        if large.isEmpty():
            break
        # a bucket all of whose texts end within the prefix holds equal records only
        done = large.where(F.col("longest") <= size).select("table_name", "bucket", F.lit(True).alias("equal"))
        ended = done.withColumn("level", F.lit(k)) if ended is None else ended.unionByName(done.withColumn("level", F.lit(k)))
        more = large.where(F.col("longest") > size).select("table_name", "bucket", F.lit(True).alias("split"))
        further = LEVELS[min(k + 1, len(LEVELS) - 1)]
        levels = (
            levels.join(more.withColumn("level", F.lit(k)), ["table_name", "bucket", "level"], "left")
            .withColumn("bucket", F.when(F.col("split"), first(further)).otherwise(F.col("bucket")))
            .withColumn("level", F.when(F.col("split"), F.lit(k + 1)).otherwise(F.col("level")))
            .drop("split")
        )
    parts = max(width(spark, 1), -(-total // bucket_rows))
    spread = F.pmod(F.xxhash64("table_name", "level", "bucket"), F.lit(parts))
    if ended is None:
        return levels.groupBy(spread.alias("part")).applyInPandas(_count_bucket, _MEMBERS)
    marked = levels.join(ended, ["table_name", "bucket", "level"], "left")
    fits = marked.where("equal is null").groupBy(spread.alias("part")).applyInPandas(_count_bucket, _MEMBERS)
    equal = marked.where("equal").dropDuplicates(["table_name", "bucket", "level", "id"])
    sizes = equal.groupBy("table_name", "bucket", "level").agg(F.min("id").alias("kept_id"), F.count(F.lit(1)).alias("copies"))
    whole = equal.join(sizes, ["table_name", "bucket", "level"]).select("table_name", "kept_id", "id", "copies")
    return fits.unionByName(whole)


def variant_copies(records: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """table_name, kept_id, copy_id: every record but the least of its group."""
    return variant_groups(records, bucket_rows).where("id <> kept_id").select("table_name", "kept_id", F.col("id").alias("copy_id"))


def collapsed(records: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """table_name, kept_id, copies: one row per group, groups of one included."""
    return variant_groups(records, bucket_rows).where("id = kept_id").select("table_name", "kept_id", "copies")


#: How the two node tables are compared.
DEPENDENCIES = Shape("dependency_nodes", "record_id", ("repository_name",), ("dependency_name", "dependency_category", "ecosystem"), ("version",), ("properties_json",))
TECHNOLOGIES = Shape("technology_nodes", "record_id", ("repository_name",), ("tech_name", "tech_category"), ("version",), ("properties_json",))
