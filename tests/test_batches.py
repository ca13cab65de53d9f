import pyarrow as pa
from pyspark.sql import functions as F

from studyspark.functions.batches import bounded


def test_batches_are_bounded_in_rows_and_bytes(spark):
    bounded(spark)
    long = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("t"))
    short = spark.range(0, 5000, 1, 1).select(F.lit("x").alias("t"))
    count = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    for df, most in ((long, 600), (short, 2000)):
        rows = [r.n for r in df.mapInArrow(count, "n bigint").collect()]
        assert sum(rows) == df.count() and max(rows) <= most
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    bounded(spark)  # a lower limit stays
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "100"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
