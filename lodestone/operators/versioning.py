"""Tables that change by whole new versions: upserts, soft deletes, configuration."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upserted(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The base with the changes laid over it by key: a non-null changed column wins, new
    keys are added.  Several changes of a key: the greatest row counts."""
    rest = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_new"))
    j = base.join(last, keys, "full")
    return j.select(*keys, *[F.coalesce(F.col("_new")[c], F.col(c)).alias(c) if c in rest else F.col(c) for c in base.columns if c not in keys])


def deleted(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the ids in ``gone`` (node_id) and the edges at them."""
    g = gone.select("node_id").distinct()
    left = nodes.join(g, "node_id", "left_anti")
    e = edges.join(g, F.col("source_id") == g["node_id"], "left_anti").join(g, F.col("target_id") == g["node_id"], "left_anti")
    return left, e


def soft_disabled(elements: DataFrame, gone: DataFrame, reason: str) -> DataFrame:
    """The elements, those named in ``gone`` (identifier) disabled for the reason."""
    g = gone.select("identifier").distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce("_hit", F.lit(False))
    j = elements.join(g, "identifier", "left")
    return j.withColumn("enabled", F.col("enabled") & ~hit).withColumn("disabled_reason", F.when(hit, reason).otherwise(F.col("disabled_reason"))).drop("_hit")


def active_versions(config: DataFrame, key: str) -> DataFrame:
    """The active row of the highest version per key."""
    every = F.struct(*[F.col(c) for c in config.columns])
    return config.where("is_active").groupBy(key).agg(F.max_by(every, F.struct("version", "id")).alias("r")).select("r.*")


def new_version(config: DataFrame, key: str, values: dict) -> DataFrame:
    """The table with a further version of the row ``values[key]``: columns that are not
    given are taken over, the old rows become inactive."""
    old = config.where((F.col(key) == values[key]) & F.col("is_active")).orderBy(F.col("version").desc()).limit(1)
    top = config.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()[0]
    new = old.select(
        *[
            F.lit(top + 1).cast("int").alias("id") if c == "id" else (F.col("version") + 1).cast("int").alias("version") if c == "version" else F.lit(True).alias(c) if c == "is_active"
            else F.coalesce(F.lit(values.get(c)).cast(config.schema[c].dataType), F.col(c)).alias(c)
            for c in config.columns
        ]
    )
    return config.withColumn("is_active", F.col("is_active") & (F.col(key) != values[key])).unionByName(new)


def next_id(df: DataFrame, column: str = "id") -> DataFrame:
    return df.agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("next_id"))


#: Order of the phases of a derivation.  Fixed values.
PHASES = ("enrich", "generate", "refine", "relationship")


def in_phase_order(config: DataFrame, phase: str = "phase") -> DataFrame:
    place = F.coalesce(F.array_position(F.array(*map(F.lit, PHASES)), F.col(phase)), F.lit(0))
    return config.orderBy(F.when(place == 0, len(PHASES) + 1).otherwise(place), "sequence")


def in_order(config: DataFrame, enabled_only: bool = False, active_only: bool = True) -> DataFrame:
    """Configuration rows by sequence, then id: active ones, and enabled ones if asked for."""
    some = config.where("is_active") if active_only else config
    return (some.where("enabled") if enabled_only else some).orderBy("sequence", "id")


def steps(config: DataFrame, key: str, enabled_only: bool = False) -> DataFrame:
    """name, sequence, enabled, has_instruction of the active rows."""
    return in_order(config, enabled_only).select(F.col(key).alias("name"), "sequence", "enabled", (F.coalesce("instruction", F.lit("")) != "").alias("has_instruction"))


def with_step(config: DataFrame, key: str, name: str, enabled: bool) -> DataFrame:
    """The table with the active rows of a step enabled or not."""
    hit = (F.col(key) == name) & F.col("is_active")
    return config.withColumn("enabled", F.when(hit, F.lit(enabled)).otherwise(F.col("enabled")))


def type_added(registry: DataFrame, extension: str, file_type: str, subtype: str | None) -> DataFrame:
    """The registry with a new entry; one that has the extension stays as it is."""
    row = registry.sparkSession.createDataFrame([(extension, file_type, subtype)], "extension string, file_type string, subtype string")
    fresh = row.join(registry.select("extension").distinct(), "extension", "left_anti")
    return registry.unionByName(fresh, allowMissingColumns=True)


def type_changed(registry: DataFrame, extension: str, file_type: str, subtype: str | None) -> DataFrame:
    hit = F.col("extension") == extension
    return registry.withColumn("file_type", F.when(hit, F.lit(file_type)).otherwise(F.col("file_type"))).withColumn("subtype", F.when(hit, F.lit(subtype)).otherwise(F.col("subtype")))


def type_deleted(registry: DataFrame, extension: str) -> DataFrame:
    return registry.where(F.coalesce(F.col("extension") != extension, F.lit(True)))


def registry_facts(registry: DataFrame) -> DataFrame:
    """One row: types, subtypes (different ones), total."""
    return registry.agg(F.countDistinct("file_type").alias("types"), F.countDistinct("subtype").alias("subtypes"), F.count(F.lit(1)).alias("total"))


def setting(settings: DataFrame, key: str, value: str) -> DataFrame:
    """Settings (key, value) with one set anew."""
    row = settings.sparkSession.createDataFrame([(key, value)], "key string, value string")
    return upserted(settings, row, ["key"])


def patterns_set(table: DataFrame, step: str, kind: str, category: str, patterns: list[str]) -> DataFrame:
    """The pattern table with the patterns of (step, type, category) put in or replaced."""
    key = ["step_name", "pattern_type", "pattern_category"]
    row = table.sparkSession.createDataFrame([(step, kind, category, json.dumps(patterns), True)], "step_name string, pattern_type string, pattern_category string, patterns string, is_active boolean")
    return upserted(table.select(*key, "patterns", "is_active"), row, key)


def logged(history: DataFrame, row: dict) -> DataFrame:
    """The history with a further row under the next id."""
    top = next_id(history).first()[0]
    fresh = history.sparkSession.createDataFrame([tuple(top if c == "id" else row.get(c) for c in history.columns)], history.schema)
    return history.unionByName(fresh)


def session_rows(runs: DataFrame) -> DataFrame:
    """session_id, started, finished (null while a run is open), runs, failed, status of
    sessions by their runs (session_id, started_at, completed_at, status)."""
    open_ = F.max(F.col("completed_at").isNull().cast("int"))
    g = runs.groupBy("session_id").agg(F.min("started_at").alias("started"), F.max("completed_at").alias("_end"), open_.alias("_open"), F.count(F.lit(1)).alias("runs"), F.count(F.when(F.col("status") == "failed", 1)).alias("failed"))
    status = F.when(F.col("_open") == 1, "running").when(F.col("failed") > 0, "failed").otherwise("completed")
    return g.select("session_id", "started", F.when(F.col("_open") == 0, F.col("_end")).alias("finished"), "runs", "failed", status.alias("status"))


def migrated(table: DataFrame, schema: str) -> DataFrame:
    """The table with the columns of a schema that it lacks, null, at its end; columns it
    has keep their type, and none is lost."""
    wanted = T.StructType.fromDDL(schema)
    have = set(table.columns)
    return table.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in wanted if f.name not in have])
