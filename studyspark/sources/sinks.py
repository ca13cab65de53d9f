"""Writing back: append-only logs, question files, reader pages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.questions import render_keeping_notes


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh name in the folder that driver and executors share; a local one only where all run on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="studyspark-")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared.rstrip('/')}/study-{spark.sparkContext.applicationId}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{path.toString()}/{tag}-{uuid.uuid4().hex}"


def append_attempts(attempts: DataFrame, path: str) -> None:
    """Attempts are never rewritten, only appended."""
    attempts.select("paper", "question", "key", "seq", "at", "correct").write.mode("append").parquet(path)


def append_reads(reads: DataFrame, path: str) -> None:
    """Marks and unmarks (read_at null) are both appended; the last of a paper counts."""
    reads.select("paper", "seq", "read_at").write.mode("append").parquet(path)


def upsert_questions(new: DataFrame, old: DataFrame) -> DataFrame:
    """Files after a run: ``new`` (stem, title, questions, note) replaces ``old`` (stem, md) of the same
    stem and carries its notes over; other old files stay."""
    kept = old.withColumnsRenamed({"md": "_old"})
    made = new.join(kept, "stem", "left").select("stem", render_keeping_notes("title", "questions", "_old", "note").alias("md"))
    return made.unionByName(old.join(new.select("stem"), "stem", "left_anti"))


def write_files(files: DataFrame, path: str, content: str = "md") -> None:
    """One folder for each stem, written by Spark's commit protocol: readers see whole files or none."""
    files.select("stem", F.col(content).alias("value")).write.mode("overwrite").partitionBy("stem").text(path)


def pdf_only(fetched: DataFrame) -> DataFrame:
    """Fetched bodies that are PDFs by their first four bytes."""
    return fetched.where(F.substring("body", 1, 4) == F.lit(b"%PDF"))
