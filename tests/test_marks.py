"""Quotes marked on pages: spans against the raw items, the order of attempts, and edge cases."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from studyspark.operators.marks import gaps, letters, page_marks, place

PAGES = "doc_id int, page int, items array<string>"
QUOTES = "doc_id int, quote_id int, quote string, page int"


def marked(spark, pages, quotes):
    rows = page_marks(spark.createDataFrame(pages, PAGES), spark.createDataFrame(quotes, QUOTES)).collect()
    return {(r.doc_id, r.quote_id): (r.level, r.page, [tuple(s) for s in r.spans]) for r in rows}


def test_levels_and_spans(spark):
    pages = [
        (1, 1, ["The heart pumps", "blood through the bo-", "dy. It never rests at all."]),
        (1, 2, ["A second page, on which", None, "the heart pumps twice as fast."]),
        (2, 1, ["İstanbul ΟΔΟΣ", "ﬁn"]),
    ]
    quotes = [
        (1, 1, "PUMPS blood through the body", 2),  # over two borders, one of them within a word
        (1, 2, "Nothing like this stands here at all. The heart pumps twice as fast.", None),
        (1, 3, "blood through the body. It never rests at, they say so", None),
        (1, 4, "nowhere to be found", 9),
        (1, 5, "nowhere to be found", None),
        (1, 6, None, 1),
        (1, 7, "!?", None),
        (2, 1, "istanbul οδοσ", None),
        (3, 1, "a document without pages", 1),
    ]
    assert marked(spark, pages, quotes) == {
        (1, 1): ("whole", 1, [(0, 10, 15), (1, 0, 21), (2, 0, 2)]),
        (1, 2): ("sentence", 2, [(2, 0, 29)]),
        (1, 3): ("opening", 1, [(1, 0, 21), (2, 0, 21)]),
        (1, 4): ("page", 2, []),
        (1, 5): ("none", None, []),
        (1, 6): ("page", 1, []),
        (1, 7): ("none", None, []),
        (2, 1): ("whole", 1, [(0, 0, 13)]),
        (3, 1): ("none", None, []),
    }


def test_first_page_of_best_piece(spark):
    pages = [(1, 1, ["Five words are in here."]), (1, 2, ["x Five words are in here. And the rest too."]), (1, 3, ["Five words are in here. And the rest too."])]
    assert marked(spark, pages, [(1, 1, "Five words are in here. And the rest too.", None)])[1, 1][:2] == ("whole", 2)
    assert marked(spark, pages, [(1, 1, "Five words are in here. But this is not there.", None)])[1, 1][:2] == ("sentence", 1)


def test_empty_tables(spark):
    assert marked(spark, [], [(1, 1, "a b", 1)]) == {(1, 1): ("none", None, [])}
    assert marked(spark, [(1, 1, ["a"])], []) == {}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="aBé1\U0001f600 .\n-", min_size=1, max_size=30), min_size=1, max_size=8))
def test_places(spark, texts):
    """The k-th letter's place, by counting."""
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", letters("t").alias("n"), gaps("t").alias("g"))
    for r in rows.select("t", "n", F.transform(F.sequence(F.lit(1), F.length("n")), lambda k: place(F.col("g"), k)).alias("at")).where("n <> ''").collect():
        assert r.at == [i for i, c in enumerate(r.t) if re.match(r"[^\W_]", c)]
        assert r.n == "".join(r.t[i].lower() for i in r.at)


def test_long_page_and_many_marks(spark):
    items = [f"word{i} and more" for i in range(3000)]
    quote = "word2998 and more word2999 and more"
    assert marked(spark, [(1, 1, items)], [(1, 1, quote, None)])[1, 1] == ("whole", 1, [(2998, 0, 17), (2999, 0, 17)])
