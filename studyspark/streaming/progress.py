"""The progress of streaming runs as a log that other sessions can read while they last.

A listener on the driver appends one small file for each event, so a reader sees whole lines only, and a driver
that is lost leaves what was done until then.  ``inbox.run_progress`` reads the lines.
"""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from ..sources import snapshots
from ..sources.files import exists

LINES = "run string, line_no int, line string, rows bigint"


class ProgressLog(StreamingQueryListener):
    """Logs the query that starts under ``name``, as run ``run``: its start, each batch that read rows, its end.

    ``total``: how many batches are expected.  Used as a context: the queries inside are listened to, and on leaving
    the last event has been written (or ``patience`` seconds have gone)."""

    def __init__(self, spark: SparkSession, folder: str, name: str, run: str, total: int, patience: float = 30.0) -> None:
        self._spark, self._folder, self._name, self._run, self._total, self._patience = spark, folder, name, run, total, patience
        self._id: str | None = None
        self._lines = 0
        self._last_batch = -1
        self._ended = threading.Event()

    def _put(self, line: str, rows: int | None = None) -> None:
        self._lines += 1
        body = json.dumps({"run": self._run, "line_no": self._lines, "line": line, "rows": rows})
        fs, root = snapshots._files(self._spark, self._folder)
        hidden = snapshots._at(self._spark, self._folder, f".{self._run}-{self._lines:06d}.json")
        out = fs.create(hidden, True)
        out.write(body.encode())
        out.close()
        fs.rename(hidden, snapshots._at(self._spark, self._folder, f"{self._run}-{self._lines:06d}.json"))

    def onQueryStarted(self, event) -> None:  # noqa: N802 - the listener's names
        if event.name == self._name:
            self._id = str(event.id)
            self._put(f"Processing {self._name}.html...")

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if str(p.id) == self._id and p.numInputRows and p.batchId > self._last_batch:
            self._last_batch = p.batchId
            self._put(f"section {p.batchId + 1}/{self._total}", p.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if str(event.id) == self._id:
            self._put("Done." if event.exception is None else "ERROR " + event.exception.splitlines()[0])
            self._ended.set()

    def __enter__(self) -> ProgressLog:
        self._spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self._ended.wait(self._patience)
        self._spark.streams.removeListener(self)


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """(run, line_no, line, rows) logged so far."""
    if not exists(spark, folder):
        return spark.createDataFrame([], LINES)
    return spark.read.schema(LINES).json(folder)
