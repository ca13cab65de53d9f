import re

import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__ as entry
from studyspark.llm import decontaminate

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, documents):
    docs, seen = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == documents.columns and dict(out.dtypes) == dict(documents.dtypes)
        assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
        seen.append((name, out.count()))
        docs = out
    assert [n for n, _ in seen] == ["quality", "near_dedup", "substring_dedup", "decontaminate"]
    assert documents.count() > seen[0][1] > seen[1][1] >= seen[2][1] > seen[3][1] > 0
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.overlaps(docs, benchmark).count() == 0
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = spark.createDataFrame(docs.select("doc_id").collect(), "doc_id bigint").join(labels, "doc_id")
    assert kept.where("quality = 0").count() <= 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    whole = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert whole.where("n <> t").count() == 0 and whole.count() == docs.count()
    docs.unpersist()


def test_run_is_the_stages(spark, documents):
    run = corpus_pipeline.run(spark, SF)
    assert run.columns == "doc_id start length ids_crc32 doc_tokens sequence_id offset".split() and run.count() > 0


def test_stages_on_nothing(spark, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_all_ten_are_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(bool(re.match(rf"op{n}_", q)) for q in names) == 1
    assert "pipeline" in names and {"op1_topk_mtree", "op8_warc"} <= set(entry.oracle_sql())
