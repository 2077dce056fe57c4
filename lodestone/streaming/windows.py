"""Event-time windows over a stream of events (an extension)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import checkpoint_folder


def window_counts(events: DataFrame, watermark: str = "1 hour", size: str = "1 day") -> DataFrame:
    """begin, event_type, events, value of tumbling windows.  In the modes append and
    update the stream drops events of windows that ended before the watermark."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).groupBy(F.window("ts", size), "event_type")
    return w.agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")).select(F.col("window.start").alias("begin"), "event_type", "events", "value")


def run_once(spark: SparkSession, files: list[str], schema, transform, key: str = "out", mode: str = "complete", per_trigger: int | None = None) -> DataFrame:
    """Reads the files of one folder as a stream, ``per_trigger`` at a time (all at once
    unless given), and gives the rows that the transformation had written when it was
    through: all windows in the mode complete, those that the watermark has closed in
    the mode append.  State and rows go to the checkpoint folder."""
    base = os.path.join(checkpoint_folder(spark), f"stream-{key}-{uuid.uuid4().hex}")
    folder, name = os.path.split(files[0])
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name if len(files) == 1 else "*.parquet")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    keep = "overwrite" if mode == "complete" else "append"
    q = transform(reader.parquet(folder)).writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    q.foreachBatch(lambda df, _: df.write.mode(keep).parquet(f"{base}/rows")).start().awaitTermination()
    return spark.read.parquet(f"{base}/rows")
