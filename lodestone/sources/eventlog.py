"""Object-centric event logs as JSON lines or one JSON document, and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, iso_time

EVENT = "event_id string, activity string, timestamp timestamp, objects map<string,array<string>>, attributes map<string,string>"
#: A line of a log: the same under the names that are written.
LINE = "eid string, activity string, timestamp timestamp, objects map<string,array<string>>, attributes map<string,string>"
LOG = "level int, sequence int, message string, status string, timestamp timestamp, _bad string"


def write_lines(events: DataFrame, path: str) -> None:
    events.withColumnRenamed("event_id", "eid").write.mode("overwrite").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON lines; also fit as a streaming source by the same schema."""
    return spark.read.schema(LINE).option("mode", "DROPMALFORMED").json(path).withColumnRenamed("eid", "event_id")


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """Events of a document that lists them under ``ocel:events``, their objects by kind
    under ``ocel:typedOmap``; events without an id get one of what they hold."""
    inner = "struct<`ocel:eid`:string,`ocel:activity`:string,`ocel:timestamp`:timestamp,`ocel:typedOmap`:map<string,array<string>>,`ocel:vmap`:map<string,string>>"
    doc = spark.read.option("multiLine", True).schema(f"`ocel:events` array<{inner}>").json(path)
    e = doc.select(F.posexplode("ocel:events").alias("pos", "e"))
    own = F.concat_ws("-", F.lit("event"), "pos")
    empty = F.create_map().cast("map<string,array<string>>")
    return e.select(
        F.coalesce(F.col("e.`ocel:eid`"), own).alias("event_id"), F.col("e.`ocel:activity`").alias("activity"), F.col("e.`ocel:timestamp`").alias("timestamp"),
        F.coalesce(F.col("e.`ocel:typedOmap`"), empty).alias("objects"), F.col("e.`ocel:vmap`").alias("attributes"),
    )


def document(events: DataFrame) -> DataFrame:
    """event_id, value: each event in the form in which a document lists it."""
    omap = F.flatten(F.map_values("objects"))
    body = F.struct(
        F.col("event_id").alias("ocel:eid"), F.col("activity").alias("ocel:activity"), iso_time(F.col("timestamp")).alias("ocel:timestamp"), omap.alias("ocel:omap"),
        F.col("attributes").alias("ocel:vmap"), F.col("objects").alias("ocel:typedOmap"),
    )
    return events.select("event_id", F.to_json(body).alias("value"))


def log_header(events: DataFrame) -> DataFrame:
    """One row: version, ordering, object_types, attribute_names (sorted), events.  There
    are as many types and names as a log has kinds of them."""
    kinds = events.select(F.explode_outer(F.map_keys("objects")).alias("k")).agg(F.array_sort(F.collect_set("k")).alias("object_types"))
    counts = events.agg(F.count(F.lit(1)).alias("events"))
    one = lambda df: df.withColumn("one", F.lit(1))
    j = one(kinds).join(one(attribute_names(events).agg(F.array_sort(F.collect_set("name")).alias("attribute_names"))), "one").join(one(counts), "one")
    return j.select(F.lit("2.0").alias("version"), F.lit("timestamp").alias("ordering"), "object_types", "attribute_names", "events")


def attribute_names(events: DataFrame) -> DataFrame:
    """name of every attribute of any event."""
    return events.select(F.explode(F.map_keys("attributes")).alias("name")).distinct()


def document_lines(events: DataFrame) -> DataFrame:
    """part, place, line: the lines of the whole document in the order of part and place:
    the header, the events by time and id, the objects with their kinds."""
    h = log_header(events)
    head = F.struct(*[F.col(c).alias(f"ocel:{n}") for c, n in (("version", "version"), ("ordering", "ordering"), ("object_types", "object-types"), ("attribute_names", "attribute-names"), ("events", "events"))])
    place = F.concat_ws(" ", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "event_id")
    own = document(events).join(events.select("event_id", place.alias("place")), "event_id")
    last = own.agg(F.max("place").alias("last"))
    one = lambda df: df.withColumn("one", F.lit(1))
    listed = one(own).join(one(last), "one").select(F.lit(1).alias("part"), "place", F.concat("value", F.when(F.col("place") == F.col("last"), "").otherwise(",")).alias("line"))
    kinds = object_catalogue(events)
    end = kinds.agg(F.max("object").alias("last"))
    objects = one(kinds).join(one(end), "one").select(
        F.lit(3).alias("part"), F.col("object").alias("place"),
        F.concat(F.regexp_replace(F.to_json(F.create_map("object", F.struct(F.col("kind").alias("ocel:type")))), r"^\{|\}$", ""), F.when(F.col("object") == F.col("last"), "").otherwise(",")).alias("line"),
    )
    fixed = lambda part, text: h.select(F.lit(part).alias("part"), F.lit("").alias("place"), text.alias("line"))
    first = fixed(0, F.concat(F.lit('{"ocel:global-log": '), F.to_json(head), F.lit(', "ocel:events": [')))
    return first.unionByName(listed).unionByName(fixed(2, F.lit('], "ocel:objects": {'))).unionByName(objects).unionByName(fixed(4, F.lit("}}")))


def write_document(events: DataFrame, path: str) -> None:
    """The document as one text file: sorted in parallel, then streamed through one task."""
    document_lines(events).orderBy("part", "place").select("line").coalesce(1).write.mode("overwrite").text(path)


# ---------------------------------------------------------------- events as they arise
def event(activity: str, objects: dict[str, Column], attributes: dict[str, Column], at: Column) -> list[Column]:
    """Columns of one event per row: its id is a hash of what it holds."""
    lists = [x for k, v in objects.items() for x in (F.lit(k), v)]
    values = [x for k, v in attributes.items() for x in (F.lit(k), v.cast("string"))]
    held, said = F.create_map(*lists).cast("map<string,array<string>>"), F.create_map(*values).cast("map<string,string>")
    number = F.substring(F.sha2(F.concat_ws("|", F.lit(activity), at.cast("string"), F.to_json(held), F.to_json(said)), 256), 1, 12)
    return [number.alias("event_id"), F.lit(activity).alias("activity"), at.alias("timestamp"), held.alias("objects"), said.alias("attributes")]


def config_events(results: DataFrame, extraction: bool) -> DataFrame:
    """Events of configuration results (session, run, repository, model, config, at,
    objects, edges, relationships: arrays or null), with what each made."""
    a = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    kind, edge = ("GraphNode", "Edge") if extraction else ("Element", "Relationship")
    objects = {"BenchmarkSession": F.array("session"), "BenchmarkRun": F.array("run"), "Repository": F.array("repository"), "Model": F.array("model"), "Config": F.array("config"), kind: a("objects"), edge: a("edges" if extraction else "relationships")}
    said = {"config_type": F.lit("extraction" if extraction else "derivation"), "config_id": F.col("config"), "objects_created": F.size(a("objects")), "edges_created": F.size(a("edges")), "relationships_created": F.size(a("relationships"))}
    rows = results.select(*event("ExtractConfig" if extraction else "DeriveConfig", objects, said, F.col("at")))
    return rows.withColumn("objects", F.map_filter("objects", lambda k, v: (k != edge) | (F.size(v) > 0)))


def query_events(calls: DataFrame) -> DataFrame:
    """Events of model calls (run, model, config, at, tokens_in, tokens_out, cache_hit, content)."""
    objects = {"BenchmarkRun": F.array("run"), "Model": F.array("model"), "Config": F.when(F.col("config").isNull(), F.array().cast("array<string>")).otherwise(F.array("config"))}
    said = {"config_id": F.col("config"), "tokens_in": F.coalesce("tokens_in", F.lit(0)), "tokens_out": F.coalesce("tokens_out", F.lit(0)), "cache_hit": F.col("cache_hit"), "response_hash": F.when(F.col("content") != "", content_hash(F.col("content")))}
    return calls.select(*event("LLMQuery", objects, said, F.col("at")))


def appended(log: DataFrame, events: DataFrame) -> DataFrame:
    """The log with the events that it does not have yet, by id."""
    return log.unionByName(events.dropDuplicates(["event_id"]).join(log.select("event_id"), "event_id", "left_anti"))


def run_totals(events: DataFrame) -> DataFrame:
    """model, event_id, nodes, edges that each completed run reports; events without a
    model are none, missing counts are 0."""
    done = events.where("activity = 'CompleteRun'").withColumn("model", F.get(F.col("objects")["Model"], 0)).where("model <> ''")
    stat = lambda c: F.coalesce(F.get_json_object(F.col("attributes")["stats"], f"$.extraction.{c}").try_cast("bigint"), F.lit(0))
    return done.select("model", "event_id", stat("nodes_created").alias("nodes"), stat("edges_created").alias("edges"))


# ---------------------------------------------------------------- reading what a log says
def read_run_logs(spark: SparkSession, path: str, level: int | None = None, latest: bool = False) -> DataFrame:
    """Lines of a run log; lines that do not parse are skipped.  With ``latest`` only the
    file of the greatest name counts."""
    rows = spark.read.schema(LOG).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    if latest:
        rows = rows.withColumn("_file", F.input_file_name())
        rows = rows.join(rows.agg(F.max("_file").alias("_file")), "_file").drop("_file")
    rows = rows.where("_bad is null").drop("_bad")
    return rows if level is None else rows.where(F.col("level") == level)


def with_object(events: DataFrame, kind: str, object_id: str | None = None) -> DataFrame:
    """Events that touch an object of the kind (or the one with that id)."""
    held = F.coalesce(F.col("objects")[kind], F.array().cast("array<string>"))
    return events.where(F.size(held) > 0 if object_id is None else F.array_contains(held, object_id))


def of_activity(events: DataFrame, activity: str | None = None, prefix: str | None = None) -> DataFrame:
    """Events of an activity, or of those that begin with a prefix."""
    some = events if activity is None else events.where(F.col("activity") == activity)
    return some if prefix is None else some.where(F.col("activity").startswith(prefix))


def object_catalogue(events: DataFrame) -> DataFrame:
    """object, kind (that of its first event), events."""
    rows = events.select("event_id", "timestamp", F.explode("objects").alias("kind", "ids")).select("event_id", "timestamp", "kind", F.explode("ids").alias("object"))
    return rows.groupBy("object").agg(F.min_by("kind", F.struct("timestamp", "event_id", "kind")).alias("kind"), F.countDistinct("event_id").alias("events"))
