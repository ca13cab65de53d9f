"""The inbox as a queue: what was read leaves it, what failed stays and comes again.

A run reads the queued files that the ledger does not call done, writes what was read, and adds the outcome
of every file to the ledger, both under the run's number; the run counts from the moment its number is the
ledger's current version.  Then the done files are moved to the library.  If a run breaks before that
moment nothing has happened but files under a number that nobody reads; if it breaks later, the next run
moves what is done and still in the queue without reading it again.

Reading is a Spark job over the files; a move is a rename of one name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import allowed_file, file_name, file_stem, fingerprint
from ..sources import snapshots
from ..sources.files import exists, listing

LEDGER = "name string, status string, why string, tries int, run int"


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """(name, status, why, tries, run) of every file ever tried, by its last run: "done" or "failed"."""
    return snapshots.read(spark, f"{folder}/ledger", LEDGER)


def _queued(spark: SparkSession, inbox: str) -> DataFrame:
    if not exists(spark, inbox):
        return spark.createDataFrame([], "path string, name string")
    return listing(spark, inbox).where(allowed_file("name")).select("path", "name")


def move_done(spark: SparkSession, inbox: str, library: str, folder: str) -> int:
    """Rename the done files that are still in the queue into the library; gives their number.

    A name that the library has already stays in the queue, as nothing there is overwritten."""
    fs, target = snapshots._files(spark, library)
    fs.mkdirs(target)
    done = _queued(spark, inbox).join(ledger(spark, folder).where("status = 'done'").select("name"), "name", "left_semi")
    moved = 0
    for r in done.select("path", "name").toLocalIterator():
        to = snapshots._at(spark, library, r.name)
        moved += not fs.exists(to) and fs.rename(spark._jvm.org.apache.hadoop.fs.Path(r.path), to)
    return moved


def process(spark: SparkSession, inbox: str, library: str, folder: str, read: Callable[[DataFrame], DataFrame]) -> int:
    """One run over the queue; gives its number.  ``read`` turns (name, stem, content) into (name, text, error)."""
    move_done(spark, inbox, library, folder)
    before = ledger(spark, folder)
    queued = _queued(spark, inbox).join(before.where("status = 'done'").select("name"), "name", "left_anti")
    run = snapshots.begin(spark, f"{folder}/ledger")
    files = spark.read.format("binaryFile").load(inbox) if exists(spark, inbox) else spark.createDataFrame([], "path string, content binary")
    wanted = files.select("path", "content").join(queued, "path", "left_semi").select(file_name("path").alias("name"), file_stem("path").alias("stem"), "content")
    read(wanted).select("name", "text", "error").write.mode("overwrite").parquet(f"{folder}/texts/run={run}")
    outcome = spark.read.schema("name string, text string, error string").parquet(f"{folder}/texts/run={run}")
    tried = outcome.select("name", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), F.col("error").alias("why"), F.lit(1).alias("tries"), F.lit(run).alias("run"))
    last = Window.partitionBy("name")
    merged = before.unionByName(tried).withColumn("tries", F.sum("tries").over(last).cast("int")).withColumn("_n", F.row_number().over(last.orderBy(F.desc("run"))))
    merged.where("_n = 1").drop("_n").write.parquet(f"{folder}/ledger/v{run}")
    snapshots.commit(spark, f"{folder}/ledger", run)
    move_done(spark, inbox, library, folder)
    return run


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(name, text, fingerprint) of all done files, of the run that read them."""
    done = ledger(spark, folder).where("status = 'done'").select("name", "run")
    if not exists(spark, f"{folder}/texts"):
        return spark.createDataFrame([], "name string, text string, fingerprint string")
    read = spark.read.schema("name string, text string, error string, run int").parquet(f"{folder}/texts").where("error is null")
    return read.join(done, ["name", "run"], "left_semi").select("name", "text", fingerprint("text").alias("fingerprint"))
