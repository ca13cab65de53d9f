"""The log of streaming runs: whole lines in order, failures, other queries left out."""

import pytest

from studyspark.streaming.progress import ProgressLog, lines


def logged(spark, folder):
    return [(r.run, r.line_no, r.line, r.rows) for r in lines(spark, folder).orderBy("run", "line_no").collect()]


def start(spark, root, name, each):
    stream = spark.readStream.schema("n bigint").parquet(f"{root}/in")
    return stream.writeStream.queryName(name).foreachBatch(each).option("checkpointLocation", f"{root}/{name}").trigger(availableNow=True).start()


def test_runs_and_failure(spark, tmp_path):
    root, log = str(tmp_path), str(tmp_path / "log")
    assert logged(spark, log) == []
    spark.range(7).selectExpr("id AS n").coalesce(1).write.parquet(f"{root}/in")
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/out/batch={n}")

    with ProgressLog(spark, log, "mine", "1", 2):
        start(spark, root, "other", keep).awaitTermination()
        start(spark, root, "mine", keep).awaitTermination()
    first = [("1", 1, "Processing mine.html...", None), ("1", 2, "section 1/2", 7), ("1", 3, "Done.", None)]
    assert logged(spark, log) == first

    def broken(batch, n):
        raise RuntimeError("boom")

    spark.range(3).selectExpr("id AS n").coalesce(1).write.mode("append").parquet(f"{root}/in")
    with ProgressLog(spark, log, "mine", "2", 2), pytest.raises(Exception, match="boom"):
        start(spark, root, "mine", broken).awaitTermination()
    got = logged(spark, log)
    assert got[:3] == first and [x[:2] for x in got[3:]] == [("2", 1), ("2", 2)] and got[4][2].startswith("ERROR")

    with ProgressLog(spark, log, "mine", "3", 2):  # the broken batch comes again
        start(spark, root, "mine", keep).awaitTermination()
    assert logged(spark, log)[5:] == [("3", 1, "Processing mine.html...", None), ("3", 2, "section 2/2", 3), ("3", 3, "Done.", None)]
