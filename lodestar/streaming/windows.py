"""Event-time windows and joins over streams; each function takes a batch or a streaming DataFrame alike."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import work_folder

LATENESS = "10 minutes"


def tumbling(events: DataFrame, size: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """(started, event_type, n) per window and type."""
    return _windowed(events, lateness, F.window("ts", size))


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    return _windowed(events, lateness, F.window("ts", size, step))


def _windowed(events: DataFrame, lateness: str, window) -> DataFrame:
    counted = events.withWatermark("ts", lateness).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("started"), "event_type", "n")


def session_counts(events: DataFrame, gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """(user_id, started, n) per session of a user."""
    found = events.withWatermark("ts", lateness).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("started"), "n")


def interval_join(events: DataFrame, first: str, then: str, within: str = "24 hours", lateness: str = "1 hour") -> DataFrame:
    """(a, b): events of kind `then` up to `within` after one of kind `first` of the same user."""
    a = events.where(F.col("event_type") == first).select(F.col("user_id"), F.col("ts").alias("ts_a"), F.col("event_id").alias("a")).withWatermark("ts_a", lateness)
    b = events.where(F.col("event_type") == then).select(F.col("user_id").alias("user_b"), F.col("ts").alias("ts_b"), F.col("event_id").alias("b")).withWatermark("ts_b", lateness)
    return a.join(b, F.expr(f"user_id = user_b AND ts_b > ts_a AND ts_b <= ts_a + INTERVAL {within}")).select("a", "b")


def first_of_each(events: DataFrame, keys: list[str], lateness: str = LATENESS) -> DataFrame:
    """events without repeats of keys within the watermark."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def drained(stream: DataFrame, mode: str = "append", **conf: str) -> DataFrame:
    """Run a stream over all that its source has now and return what it wrote, as Parquet in the shared folder.

    Append mode adds files batch by batch; complete mode writes each batch's whole result to a folder of its own,
    of which the last counts. No result passes through the driver. conf is set while the stream starts.
    """
    spark, folder = stream.sparkSession, f"{work_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    before = {k: spark.conf.get(k, None) for k in conf}
    last: list[int] = []

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out-{number}")
        last[:] = [number]

    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        writer = writer.format("parquet").option("path", f"{folder}/out") if mode == "append" else writer.foreachBatch(save)
        writer.start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out-{last[0]}") if last else spark.createDataFrame([], stream.schema)
