"""The queries over whole texts, on small fixtures that differ only behind the openings."""

import pytest
from pyspark.sql import functions as F

from studyspark.plans.queries import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    docs = [(1, "a" * 300 + "b" * 300 + "c" * 300, "de", "s"), (2, " " * 12 + "z" * 40, "en", "s"), (3, "   ", "fr", "t")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    turns = [(1, n, "user", f"The same long opening of more than forty letters, then {n // 2}.") for n in range(5)]
    spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


def test_sections_hold_whole_thirds(spark, folder):
    text = {r.doc_id: r.text for r in QUERIES["q47_tail_sections"](spark, folder).collect()}[1]
    assert (text.count("a" * 300), text.count("b" * 3), text.count("c" * 300)) == (1, 0, 1)


def test_answers_and_evidence_are_whole_turns(spark, folder):
    rows = QUERIES["q48_question_files"](spark, folder).orderBy("pos").collect()
    assert [r.answer for r in rows] == [f"Since The same long opening of more than forty letters, then {n // 2}." for n in range(5)]
    assert sorted(r.place for r in QUERIES["q52_distinct_evidence"](spark, folder).collect()) == [0, 2, 4]


def test_pages_are_whole_texts(spark, folder):
    text = {r.source: r.text for r in QUERIES["q54_page_assembly"](spark, folder).collect()}
    assert "a" * 300 + "b" * 300 + "c" * 300 in text["s"] and "z" * 40 in text["s"] and text["t"] == ""
    counted = {r.source: r.skipped for r in QUERIES["q55_page_counters"](spark, folder).select("source", F.col("skipped")).collect()}
    assert counted == {"s": 0, "t": 1}
