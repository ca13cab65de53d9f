"""Closed windows of an event stream: append mode under a watermark, with late rows set apart.

Each arrival is routed before any window sees it: rows no newer than the newest time of earlier arrivals
(in milliseconds) less the delay are late and go to a side table, the others to the queue of the windows.
So no row is lost without a trace, and the watermark of the windows, which follows the same rule, drops none
of the queue.  Windows and sessions that the watermark has passed are put out once and leave the state, whose
size depends on the rows of one delay and not on the stream's length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import exists
from . import settings


def _run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str):
    query = stream.writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def deliver(rows: DataFrame, folder: str) -> None:
    """Hand rows (with a timestamp ``ts``) over as one arrival."""
    rows.write.mode("append").parquet(f"{folder}/arrivals")


def route(spark: SparkSession, folder: str, schema: str, delay: str = "1 day"):
    """Deal what has arrived since the last call to the queue and to the late rows.

    A batch writes under its own number, and its newest time last: a repeated batch replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        marks = f"{folder}/marks"
        high = None
        if exists(spark, marks):
            high = spark.read.schema("high timestamp, batch bigint").parquet(marks).where(F.col("batch") < number).agg(F.max("high")).first()[0]
        late = F.lit(False) if high is None else F.coalesce(F.col("ts") <= F.date_trunc("millisecond", F.lit(high)) - F.expr(f"interval {delay}"), F.lit(False))
        batch.where(~late).write.mode("overwrite").parquet(f"{folder}/queue/batch={number}")
        batch.where(late).write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        newest = spark.read.schema(schema).parquet(f"{folder}/queue/batch={number}").agg(F.max("ts").alias("high"))
        newest.write.mode("overwrite").parquet(f"{marks}/batch={number}")

    return _run(spark.readStream.schema(schema).parquet(f"{folder}/arrivals"), each, f"{folder}/routing")


def late(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch bigint").parquet(f"{folder}/late").drop("batch")


def queued(spark: SparkSession, folder: str, schema: str, delay: str = "1 day", once_by: str | None = "event_id") -> DataFrame:
    """The queue as a stream with a watermark; rows that repeat ``once_by`` within the delay count once."""
    stream = spark.readStream.schema(f"{schema}, batch bigint").parquet(f"{folder}/queue").drop("batch").withWatermark("ts", delay)
    return stream.dropDuplicatesWithinWatermark([once_by]) if once_by else stream


def daily(stream: DataFrame) -> DataFrame:
    """Events and the highest value of each day that has ended."""
    by_day = stream.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("events"), F.max("value").alias("highest"))
    return by_day.select(F.col("w.start").cast("date").alias("day"), "events", "highest")


def sliding(stream: DataFrame, length: str, slide: str) -> DataFrame:
    """Events in windows of ``length`` that begin every ``slide``."""
    return stream.groupBy(F.window("ts", length, slide).alias("w")).agg(F.count("*").alias("events")).select(F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "events")


def sessions(stream: DataFrame, gap: str) -> DataFrame:
    """Sessions of each reader that have ended."""
    found = stream.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return found.select("user_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "events")


def close(stream: DataFrame, folder: str, name: str, partitions: int | None = None):
    """Put the windows of ``stream`` that have closed since the last call under ``folder``/``name``; gives the finished query.

    ``partitions``: of the state, chosen for good by the first call (by default as many as shuffles have)."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    with settings(stream.sparkSession, {"spark.sql.shuffle.partitions": str(partitions)} if partitions else {}):
        return _run(stream, each, f"{folder}/{name}-progress")


def closed(spark: SparkSession, stream: DataFrame, folder: str, name: str) -> DataFrame:
    """All windows put out so far."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return spark.read.schema(f"{fields}, batch bigint").parquet(f"{folder}/{name}").drop("batch")
