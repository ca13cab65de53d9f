"""Where quotes are marked on the pages of a document, as raw spans of the pages' text items.

What a reader extracts and what a page shows rarely agree on every character, so both are compared by letters and
digits alone, and a quote that is not there whole is looked for in pieces: its sentences, then its opening words.
The gaps between the letters of a page lead back to its raw characters; they are taken only of the pages that a mark
stands on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ColumnOrName, col

#: Fixed values.
SENTENCE_WORDS = 5
OPENING_WORDS = 8

_LETTER = r"[\p{L}\p{N}]"
#: What ends an item in the text of a page.
_END = "\n"


def letters(text: ColumnOrName) -> Column:
    """Lower-case letters and digits of a text, one character for each."""
    return F.regexp_replace(F.translate(F.lower(col(text)), "ς", "σ"), r"[^\p{L}\p{N}]", "")


def gaps(text: ColumnOrName) -> Column:
    """What stands before, between and after the letters and digits of a text."""
    return F.split(F.regexp_replace(col(text), _LETTER, "a"), "a")


def place(between: Column, k: Column) -> Column:
    """Where in its text (from 0) the k-th (from 1) character of ``letters`` stands: after k gaps and k - 1 letters."""
    return F.length(F.array_join(F.slice(between, F.lit(1), k), "")) + k - 1


def attempts(quote: ColumnOrName) -> Column:
    """array<struct<level, letters>> to look for, best first: the whole quote, its sentences of five words or more,
    its first eight words; pieces without a letter are left out."""
    q = F.trim(F.regexp_replace(F.coalesce(col(quote), F.lit("")), r"(?U)\s+", " "))
    sentences = F.filter(F.split(q, r"(?<=[.!?]) "), lambda s: F.size(F.split(s, " ")) >= SENTENCE_WORDS)
    opening = F.array_join(F.slice(F.split(q, " "), 1, OPENING_WORDS), " ")
    piece = lambda level, x: F.struct(F.lit(level).alias("level"), letters(x).alias("letters"))
    every = F.concat(F.array(piece("whole", q)), F.transform(sentences, lambda s: piece("sentence", s)), F.array(piece("opening", opening)))
    return F.filter(every, lambda a: a["letters"] != "")


def page_text(items: ColumnOrName) -> Column:
    return F.array_join(F.transform(col(items), lambda x: F.coalesce(x, F.lit(""))), _END)


def _starts(items: Column) -> Column:
    """Where each item begins in the text of its page."""
    add = lambda s, x: F.struct(F.concat(s["starts"], F.array(s["next"])).alias("starts"), (s["next"] + F.coalesce(F.length(x), F.lit(0)) + len(_END)).alias("next"))
    return F.aggregate(items, F.struct(F.lit([]).cast("array<int>").alias("starts"), F.lit(0).alias("next")), add, lambda s: s["starts"])


def _spans(items: Column, starts: Column, begin: Column, end: Column) -> Column:
    """The characters from ``begin`` to before ``end`` of a page, item by item."""
    part = lambda x, i: F.struct(
        i.alias("item"), F.greatest(begin - F.get(starts, i), F.lit(0)).alias("begin"),
        F.least(end - F.get(starts, i), F.coalesce(F.length(x), F.lit(0))).alias("end"),
    )
    return F.filter(F.transform(items, part), lambda s: s["begin"] < s["end"])


def page_marks(pages: DataFrame, quotes: DataFrame) -> DataFrame:
    """(doc_id, quote_id, level, page, spans) of every quote.

    ``pages``: doc_id, page (from 1), items (array of strings), one row a page; ``quotes``: doc_id, quote_id, quote,
    page (where it should stand, or null), one row for each doc_id and quote_id.  The best piece that some page holds
    is marked at its first place on the first such page: level "whole", "sentence" or "opening", and spans
    array<struct<item, begin, end>>, from 0 and without the end.  Else the level is "page", with the expected page, the
    last one at most, or "none" where that is null or the document has no pages; then there are no spans.  A null quote
    and one without letters are not found; null items are empty."""
    asked = quotes.select("doc_id", "quote_id", F.col("page").alias("expected"), attempts("quote").alias("tries"))
    read = pages.select("doc_id", "page", letters(page_text("items")).alias("norm"))
    which = F.get(F.filter(F.transform("tries", lambda a, i: F.when(F.contains(F.col("norm"), a["letters"]), i)), lambda i: i.isNotNull()), F.lit(0))
    tried = asked.join(read, "doc_id", "left").select("doc_id", "quote_id", "expected", "tries", "page", which.alias("which"))
    best = tried.groupBy("doc_id", "quote_id").agg(
        F.min(F.when(F.col("which").isNotNull(), F.struct("which", "page"))).alias("best"),
        F.max("page").alias("last"), F.first("expected").alias("expected"), F.first("tries").alias("tries"),
    )
    found = best.where("best is not null").select("doc_id", "quote_id", "best.page", F.get("tries", F.col("best.which")).alias("a"))
    placed = pages.select("doc_id", "page", F.transform("items", lambda x: F.coalesce(x, F.lit(""))).alias("items")).join(found, ["doc_id", "page"])
    first = F.instr(letters(page_text("items")), F.col("a.letters"))
    rows = placed.select("doc_id", "quote_id", "page", "a", "items", first.alias("first"), gaps(page_text("items")).alias("gaps"), _starts(F.col("items")).alias("starts"))
    begin, end = place(F.col("gaps"), F.col("first")), place(F.col("gaps"), F.col("first") + F.length("a.letters") - 1) + 1
    rows = rows.select("*", F.explode(F.array(F.struct(begin.alias("begin"), end.alias("end")))).alias("at"))
    marked = rows.select("doc_id", "quote_id", F.col("a.level").alias("level"), "page", _spans(F.col("items"), F.col("starts"), F.col("at.begin"), F.col("at.end")).alias("spans"))
    goes = F.when(F.col("last").isNotNull(), F.least("expected", "last"))
    goes = F.when(F.col("expected").isNotNull(), goes)
    nothing = F.array().cast("array<struct<item:int,begin:int,end:int>>")
    other = best.where("best is null").select("doc_id", "quote_id", F.when(goes.isNotNull(), "page").otherwise("none").alias("level"), goes.alias("page"), nothing.alias("spans"))
    return marked.unionByName(other)
