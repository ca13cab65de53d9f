"""Folders as DataFrames: inbox, library, question files, stored state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html_article import article_text, article_title, page_struct
from ..functions.questions import parse_questions, parse_title, read_notes
from ..functions.text import allowed_file, file_name, file_stem, paper_stem, size_mb, spaced_stem, strip_dot_leaders

HISTORY = "key string, paper string, question string, attempts array<struct<at:timestamp_ntz,correct:boolean>>"


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, stem, modified, size_bytes) of a folder's files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", file_name("path").alias("name"), file_stem("path").alias("stem"), F.col("modificationTime").alias("modified"), F.col("length").alias("size_bytes"))


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def inbox(spark: SparkSession, folder: str) -> DataFrame:
    """Queued files sorted by name, with kind and size; a missing folder is an empty queue."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "name string, stem string, kind string, title string, size_bytes bigint, size_mb double")
    kind = F.when(F.lower("name").endswith(".pdf"), "pdf").otherwise("article")
    return listing(spark, folder).where(allowed_file("name")).select("name", "stem", kind.alias("kind"), spaced_stem("stem").alias("title"), "size_bytes", size_mb("size_bytes").cast("double").alias("size_mb")).orderBy("name")


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Saved web pages as (name, stem, title, text)."""
    pages = spark.read.format("binaryFile").option("pathGlobFilter", "*.{html,htm}").load(folder)
    read = pages.select(file_name("path").alias("name"), file_stem("path").alias("stem"), page_struct(F.col("content").cast("string")).alias("p"))
    text = strip_dot_leaders(article_text("p.raw"))
    return read.withColumn("text", text).select("name", "stem", article_title(F.col("p.title"), F.col("p.meta_title"), F.col("text"), F.col("stem")).alias("title"), "text")


def question_files(spark: SparkSession, folder: str) -> DataFrame:
    """Question files, newest first: (stem, title, added, notes, questions)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_questions.md").load(folder)
    md = F.col("content").cast("string")
    stem = paper_stem("path")
    return files.select(stem.alias("stem"), F.coalesce(parse_title(md), stem).alias("title"), F.col("modificationTime").alias("added"), read_notes(md).alias("notes"), parse_questions(md).alias("questions")).orderBy(F.desc("added"), "stem")


def history(spark: SparkSession, path: str) -> DataFrame:
    """Stored attempts, one JSON object a line; malformed history is an error, never silently empty."""
    return spark.read.schema(HISTORY).option("mode", "FAILFAST").json(path)


def state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Other stored state, one JSON object a line: what cannot be read counts as absent."""
    parsed = F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return spark.read.text(path).select(parsed.alias("s")).where("s._bad is null").select("s.*").drop("_bad")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, message) of a run log; lines of another form are dropped."""
    pattern = r"^\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)\] (.*)$"
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(F.to_timestamp_ntz(F.regexp_extract("value", pattern, 1)).alias("at"), F.regexp_extract("value", pattern, 2).alias("message"))
