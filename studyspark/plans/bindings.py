"""The driver's tables read as study data: events are attempts and readings, pages are articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attempts_of(events: DataFrame) -> DataFrame:
    """Every event is an attempt at the question named by its type, of the paper named by its user."""
    k = F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("bigint")
    paper = F.col("user_id")
    return events.select(
        paper.alias("paper"), F.col("event_type").alias("question"), F.concat(paper.cast("string"), F.lit("::"), F.col("event_type")).alias("key"),
        F.col("event_id").alias("seq"), F.col("ts").alias("at"), (k % 3 != 0).alias("correct"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts_of(table(spark, sf_dir, "events"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paper was read when its user last viewed something."""
    views = table(spark, sf_dir, "events").where("event_type = 'view'")
    return views.groupBy(F.col("user_id").alias("paper")).agg(F.max_by("ts", "event_id").alias("read_at"), F.max("event_id").alias("seq"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("paper")).distinct().select("paper", F.concat(F.lit("Paper "), F.col("paper").cast("string")).alias("title"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current questions: those tried, and one per paper that nobody has tried."""
    tried = attempts(spark, sf_dir).select("paper", "question").distinct()
    fresh = tried.select("paper").distinct().withColumn("question", F.lit("untried"))
    return tried.unionByName(fresh).withColumn("key", F.concat(F.col("paper").cast("string"), F.lit("::"), F.col("question")))


def today(spark: SparkSession, sf_dir: str):
    """The last day with events (one value; never the clock)."""
    return table(spark, sf_dir, "events").agg(F.max(F.to_date("ts"))).first()[0]
