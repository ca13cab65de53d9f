"""Incremental ingest: new files once, failures set apart, reruns without effect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import allowed_file, file_name, file_stem, fingerprint


def new_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the folder's files with their bytes; the checkpoint remembers which were seen."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(folder)
    return files.where(allowed_file(file_name("path"))).select("path", file_stem("path").alias("stem"), "content")


def ingest(files: DataFrame, read: Callable[[DataFrame], DataFrame], target: str, quarantine: str, checkpoint: str):
    """Run once over what is new.  ``read`` turns (path, stem, content) into (stem, text, error); rows
    with an error go to the quarantine, the others are appended with their fingerprint.

    Each batch writes under its own number, so a repeated batch replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        rows = read(batch).persist()
        good = rows.where("error is null").select("stem", "text", fingerprint("text").alias("fingerprint"))
        good.write.mode("overwrite").parquet(f"{target}/batch={number}")
        rows.where("error is not null").select("stem", "error").write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        rows.unpersist()

    query = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_texts(batch: DataFrame) -> DataFrame:
    """The plain reader: bytes that are UTF-8 text."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return batch.select("stem", text.alias("text"), F.when(text.isNull(), "not UTF-8").alias("error"))
