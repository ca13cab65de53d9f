"""Activity over event streams.  Windows, sessions and watermarks extend the batch reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.bindings import attempts_of


def event_stream(spark: SparkSession, path: str, watermark: str = "1 day") -> DataFrame:
    """Events as a stream with event time (the files' local times count as UTC)."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    raw = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def daily_answers(events: DataFrame) -> DataFrame:
    """Answers and right answers of each day, for update or complete mode."""
    by_day = attempts_of(events).groupBy(F.window("at", "1 day").alias("w"))
    sums = by_day.agg(F.count("*").alias("answered"), F.count_if("correct").alias("correct"))
    return sums.select(F.col("w.start").cast("date").alias("day"), "answered", "correct")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each reader, closed after a pause."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "events")


def run_to_table(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """All that is there now, as files under ``folder``; each batch in complete mode replaces the one before."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(folder if mode == "complete" else f"{folder}/batch={number}")

    query = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{folder}-progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)
