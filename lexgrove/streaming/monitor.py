"""Event streams: matching against subscriptions, and windowed analytics over events.

The event log is read once by a checkpointed file stream; a restart continues after the last committed batch
and absorbs repeats by the notification's key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexgrove.operators.monitor import match_events
from lexgrove.sources.shared import exists

EVENT = "event_id long, kind string, act_code string, unit_id string, doc_id string, detected_at timestamp"


def events(spark: SparkSession, folder: str, schema: str = EVENT, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def notify(spark: SparkSession, folder: str, subscriptions: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Adds new notifications to a table as events arrive, until what is there is done.

    A batch overwrites its own partition ``batch=<number>``, so one that is run again after a failure leaves nothing
    twice; keys that other batches hold are left out.
    """

    def write(batch: DataFrame, number: int) -> None:
        found = match_events(batch, subscriptions)
        if exists(spark, target):
            told = spark.read.parquet(target).where(F.col("batch") != number)
            found = found.join(told.select("workspace_id", "event_id"), ["workspace_id", "event_id"], "left_anti")
        found.withColumn("status", F.lit("open")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return events(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, ts: str, keys: list[str], size: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """keys, start, end, n, total: tumbling (or sliding) counts and sums of ``value``; works on streams and tables."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("__ts", late) if stream.isStreaming else timed
    w = F.window("__ts", size, slide) if slide else F.window("__ts", size)
    return timed.groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def sessions(stream: DataFrame, ts: str, keys: list[str], gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """keys, start, end, n of runs of events no further apart than a gap."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("__ts", late) if stream.isStreaming else timed
    return timed.groupBy(*keys, F.session_window("__ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(stream: DataFrame, ts: str, keys: list[str], late: str = "2 days") -> DataFrame:
    """Events once per key within the watermark."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if stream.isStreaming else timed.dropDuplicates(keys)
