"""Resuming half-finished documents: state knows which sections are finished, whatever run they came from.

A document is offered as a whole (its fingerprint and the number of its sections, the overview being
section 0); of an offer the unfinished sections are to be asked.  A reply finishes one section.  Another
fingerprint is another text: what was finished of the old one goes.  When all sections are finished the
answers are put out together and the document's state goes, as it does when nothing was heard of the
document for the time of expiry.

State is the fingerprint of a document and a map of its finished sections in one value, so it is as large as the
answers of unfinished documents and no larger.  It lies in Spark's state store, committed with
the batch that changed it: a run that dies in a batch repeats that batch on the state before it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import settings

#: kind: "offer" (fingerprint, sections) or "reply" (fingerprint, section, answer); seq: the order within a document.
EVENTS = "document string, run int, seq bigint, kind string, fingerprint string, sections int, section int, answer string"
#: What is stored of a document: the answers of its finished sections.
STATE = "fingerprint string, done array<struct<section:int,answer:string>>"
#: kind: "ask" (section), "kept" (section, a reply that finished it) or "complete" (answers of all sections).
OUTCOMES = "document string, run int, kind string, fingerprint string, section int, answers map<int,string>"


class Sections(StatefulProcessor):
    """Progress of one document at a time; ``expiry_ms``: unheard of for so long, a document starts anew."""

    def __init__(self, expiry_ms: int | None = None):
        self._expiry = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # one value, as each call to the store is a round trip between Python and the JVM
        self._progress = handle.getValueState("progress", STATE, self._expiry)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        stored = self._progress.get()
        fingerprint, done = (stored[0], {x[0]: x[1] for x in stored[1]}) if stored is not None else (None, {})
        changed = False

        def outcome(row, kind, section=None, answers=None):
            return Row(document=row.document, run=row.run, kind=kind, fingerprint=row.fingerprint, section=section, answers=answers)

        for row in sorted(rows, key=lambda r: r.seq):
            if row.kind == "offer":
                if row.fingerprint != fingerprint:
                    fingerprint, done, changed = row.fingerprint, {}, True
                yield from (outcome(row, "ask", i) for i in range(row.sections) if i not in done)
            elif row.fingerprint == fingerprint and row.section not in done:
                done[row.section] = row.answer
                changed = True
                yield outcome(row, "kept", row.section)
            if fingerprint is not None and row.fingerprint == fingerprint and 0 < row.sections <= len(done) and all(i in done for i in range(row.sections)):
                yield outcome(row, "complete", None, done)
                fingerprint, done, changed = None, {}, True
        if fingerprint is not None and changed:
            self._progress.update((fingerprint, list(done.items())))
        elif fingerprint is None and stored is not None:
            self._progress.clear()

    def close(self) -> None:
        pass


def progress(events: DataFrame, expiry_ms: int | None = None) -> DataFrame:
    """Outcomes of a stream of events; an event counts once, in the order of ``seq`` within its batch.

    Replies of another text than the one offered last are ignored, repeated replies too; an offer of no
    sections puts nothing out; events without a document are one document of their own."""
    return events.groupBy("document").transformWithState(Sections(expiry_ms), OUTCOMES, "Append", "None" if expiry_ms is None else "ProcessingTime")


def state_settings(spark: SparkSession, partitions: int | None = None):
    """For queries started inside: the store that keeps state of one's own, and no batches without rows, of
    which the clock would ask for one after the other."""
    own = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    return settings(spark, own | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {}))


def advance(events: DataFrame, folder: str, expiry_ms: int | None = None, partitions: int | None = None) -> DataFrame:
    """Append events to the folder's queue, run over all that is new there, and give all outcomes so far.

    May be broken off anywhere and called again: the queue, the state and the outcomes go on from the last
    finished batch, and a repeated batch replaces its own outcomes.  ``partitions``: of the state, chosen for
    good by the first call (by default as many as shuffles have)."""
    spark = events.sparkSession
    names = [c.strip().split(" ")[0] for c in EVENTS.split(",")]
    events.select(*names).write.mode("append").parquet(f"{folder}/queue")
    stream = progress(spark.readStream.schema(EVENTS).parquet(f"{folder}/queue"), expiry_ms)

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/outcomes/batch={number}")

    with state_settings(spark, partitions):
        query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
    return outcomes(spark, folder)


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{OUTCOMES}, batch bigint").parquet(f"{folder}/outcomes").drop("batch")


def to_ask(outcome: DataFrame, run: int) -> DataFrame:
    """(document, fingerprint, section) that a run has to ask."""
    return outcome.where((F.col("run") == run) & (F.col("kind") == "ask")).select("document", "fingerprint", "section")
