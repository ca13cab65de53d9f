"""Quotes in texts: tolerant matching, page location, loose highlighting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnOrName, col, normalized

#: Fixed values.
MIN_QUOTE_CHARS = 25
PAGE_HEAD_CHARS = 40
PAGE_MARKER = r"(?m)^--- Page (\d+) ---$"


def needed(n: ColumnOrName) -> Column:
    """Length of the contiguous block that proves a quote of n characters: four fifths, rounded up."""
    return F.floor((col(n) * 4 + 4) / 5).cast("int")


def windows(quote: ColumnOrName) -> Column:
    """All blocks of the needed length; a text holds the quote if it holds one of them."""
    q = col(quote)
    k = needed(F.length(q))
    return F.transform(F.sequence(F.lit(1), F.length(q) - k + 1), lambda i: F.substring(q, i, k))


def grams(quote: ColumnOrName) -> Column:
    """Short pieces of which every window holds one whole: half a window, laid so far apart
    that none can slip between them.  A text without any of them cannot match."""
    q = col(quote)
    k = needed(F.length(q))
    g = F.greatest(F.floor(k / 2).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(1), F.length(q) - g + 1, k - g + 1), lambda i: F.substring(q, i, g))


def quote_in_text(quote: ColumnOrName, text: ColumnOrName, min_chars: int = MIN_QUOTE_CHARS) -> Column:
    """Whether a normalised text holds a normalised quote: verbatim, or a contiguous four fifths of it."""
    q, t = col(quote), col(text)
    tolerant = F.exists(grams(q), lambda w: F.contains(t, w)) & F.exists(windows(q), lambda w: F.contains(t, w))
    return F.when(q.isNull() | t.isNull() | (F.length(q) < min_chars), False).when(F.contains(t, q), True).otherwise(tolerant)


def page_index(text: ColumnOrName, nfkc: bool = False) -> Column:
    """array<struct<page, norm>> of a text with page markers; what stands before the first is ignored."""
    numbers = F.regexp_extract_all(col(text), F.lit(PAGE_MARKER), F.lit(1))
    bodies = F.split(col(text), PAGE_MARKER)
    return F.transform(numbers, lambda n, i: F.struct(n.cast("int").alias("page"), normalized(F.get(bodies, i + 1), nfkc).alias("norm")))


def find_page(quote: ColumnOrName, pages: ColumnOrName) -> Column:
    """First page that holds the head of a normalised quote; null for an empty quote or none."""
    head = F.substring(col(quote), 1, PAGE_HEAD_CHARS)
    return F.when(head != "", F.get(F.filter(col(pages), lambda p: F.contains(p["norm"], head)), F.lit(0))["page"])


def loose_words(text: ColumnOrName) -> Column:
    return F.regexp_extract_all(col(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def loose_pattern(words: Column) -> Column:
    """Matches the words whatever stands between them (words have no regex characters)."""
    return F.concat(F.lit("(?iu)"), F.array_join(words, r"[^\p{L}\p{N}]+"))


def highlight_level(quote: ColumnOrName, text: ColumnOrName) -> Column:
    """How a quote can be marked in a text: "whole", else a "sentence" of five words or more,
    else its ten "opening" words (of more than ten), else "none"."""
    q, t = col(quote), col(text)
    found = lambda w: F.regexp_like(t, loose_pattern(w))
    every = loose_words(q)
    sentences = F.filter(F.transform(F.split(q, r"(?<=[.!?])\s+"), loose_words), lambda w: F.size(w) >= 5)
    return (
        F.when(F.size(every) == 0, "none").when(found(every), "whole")
        .when(F.exists(sentences, found), "sentence")
        .when((F.size(every) > 10) & found(F.slice(every, 1, 10)), "opening").otherwise("none")
    )
