"""Arrow batches that Python workers can hold, however long the texts in them are."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows of a batch and its bytes, whichever comes first; Spark's own defaults are 10,000 rows of any size.
MAX_ROWS, MAX_BYTES = 2000, 4 << 20


def bounded(spark: SparkSession) -> None:
    """Lower the session's limits of Arrow batches to these; lower ones stay."""
    for name, most in (("maxRecordsPerBatch", MAX_ROWS), ("maxBytesPerBatch", MAX_BYTES)):
        now = str(spark.conf.get(f"spark.sql.execution.arrow.{name}")).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
