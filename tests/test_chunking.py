import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunks_by_loop import carried, chunk
from studyspark.functions.chunking import chunk_array, chunks, framing_text

PARAGRAPHS = [f"{i:03d} " + "x" * 95 for i in range(100)]


def test_short_empty_blank():
    assert chunk("a\n\nb\n\nc") == ["a\n\nb\n\nc"]
    assert chunk("") == []
    assert chunk("a\n\n\n\n  \n\nb") == ["a\n\nb"]


@pytest.mark.parametrize("overlap", [200, 250])
def test_bound_order_overlap(overlap):
    out = chunk("\n\n".join(PARAGRAPHS), 1000, overlap)
    assert all(len(c) <= 1000 for c in out)
    seen = []
    for c in out:
        seen += [p for p in c.split("\n\n") if p in PARAGRAPHS and p not in seen]
    assert seen == PARAGRAPHS
    for a, b in zip(out, out[1:], strict=False):
        shared = next(n for n in range(overlap, -1, -1) if a[len(a) - n :] == b[:n])
        assert 0 < shared <= overlap


def test_zero_overlap_loses_nothing():
    text = "\n\n".join(PARAGRAPHS[:30])
    assert "\n\n".join(chunk(text, 1000, 0)) == text


def test_oversized_paragraph_keeps_words():
    words = [f"word{i}" for i in range(3000)]
    out = chunk(" ".join(words), 4000, 500)
    assert len(out) > 1 and {w for c in out for w in c.split()} == set(words)


@pytest.mark.parametrize("overlap", [-1, 500, 900])
def test_bad_overlap(overlap, spark):
    with pytest.raises(ValueError):
        chunk("a", 1000, overlap)
    with pytest.raises(ValueError):
        chunks(spark.createDataFrame([(1, "a")], "doc_id int, text string"), size=1000, overlap=overlap)


def test_headings_pack_by_section():
    body = "\n\n".join(f"## S{i}\n" + "y" * 295 for i in range(3))
    out = chunk("Intro here\n\n" + body, 700, 100)
    assert out[0].startswith("Intro here") and "## S0" in out[0] and all(len(c) <= 700 for c in out)
    assert sum(c.count("## S") for c in out) == 3


def test_long_section_is_split():
    text = "## A\nshort\n\n## B\nshort\n\n## C\n" + "\n\n".join(PARAGRAPHS[:20])
    out = chunk(text, 900, 100)
    assert len(out) > 2 and all(len(c) <= 900 for c in out) and out[0] == "## A\nshort\n\n## B\nshort"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n", max_size=600), st.integers(20, 120), st.integers(0, 9))
def test_properties(text, size, overlap):
    out = chunk(text, size, overlap)
    assert all(0 < len(c) <= size for c in out)
    letters = "".join(text.split())
    if not overlap:
        assert "".join("".join(out).split()) == letters
    for a, b in zip(out, out[1:], strict=False):
        assert b.startswith(carried(a, overlap)) or not carried(a, overlap)


def test_table_form(spark):
    docs = spark.createDataFrame([(1, "a\n\nb"), (2, None), (3, ""), (1, "c")], "doc_id int, text string").withColumn("chunk", F.lit("clash"))
    got = sorted(map(tuple, chunks(docs).collect()))
    assert got == [(1, 0, "a\n\nb"), (1, 0, "c")]


def test_fold_equals_loop(spark):
    rng = random.Random(5)
    bits = ["a", "bb ", " ", "\n", "\n\n", "\n## H\n", "## ", "word\u00a0", "\u00e9\U0001f600", "x" * 30, "\r\n", "\t", "\x1f", "  \n  "]
    texts = ["".join(rng.choices(bits, k=rng.randrange(150))) for _ in range(400)]
    texts += ["", " " * 300, "x" * 500, "a b " * 2000, "## A\ns\n\n## B\n" + "y " * 100 + "\n## C\nt\n## D\n" + "z" * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    for size, overlap in ((20, 0), (40, 9), (100, 30)):
        got = docs.select("n", chunk_array("text", size, overlap).alias("c")).collect()
        for r in got:
            assert r.c == chunk(texts[r.n], size, overlap), (texts[r.n], size, overlap)


def test_no_python_worker(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    plan = chunks(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_framing(spark):
    parts = spark.createDataFrame([(["x", "ABSTRACT one", "y", "our Discussion", "z"],), (["x", "y", "z"],), (["only"],), ([],)], "c array<string>")
    got = [r.x for r in parts.select(framing_text(F.col("c")).alias("x")).collect()]
    assert got == ["ABSTRACT one\n\n[...]\n\nour Discussion", "x\n\n[...]\n\nz", "only", None]
