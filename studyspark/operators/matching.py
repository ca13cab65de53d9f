"""Which quotes stand in which texts, over whole tables.

A window test for every pair of a quote and a text is a nested loop.  A match holds some window of its
quote whole, four fifths of it in one run.  Texts are cut into consecutive blocks; wherever a window of four
blocks' length or more lies, it covers three consecutive blocks whole.  So texts give a hash of every three
consecutive blocks, quotes of every place where three blocks could begin, and both meet by an equi-join: a run
of blocks at one shift is one key, and no single block that many texts share makes a candidate.

Quotes are put into classes by the length of their windows, each with blocks about as long as its windows
allow.  What meets agrees in three eighths of a window at least, three quarters of the class's shortest, where
blocks of one fixed width would meet in any stock phrase of that width.  Candidates are then verified, and
only there the windows of a quote exist.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quotes import MIN_QUOTE_CHARS, needed, quote_in_text

#: The shortest window: four fifths of the shortest quote.
SHORTEST = (MIN_QUOTE_CHARS * 4 + 4) // 5
#: So many consecutive blocks make a key.
RUN = 3


def window_class(quote: Column) -> Column:
    """The number c of a quote's class: its windows are SHORTEST * 2 ** c characters long at least, and shorter than twice that."""
    return F.floor(F.log2(needed(F.length(quote)) / SHORTEST) + 1e-9).cast("int")


def block(c: int) -> int:
    """The width of a class's blocks: each of its windows is four of them long at least."""
    return (SHORTEST << c) // 4


def _run(c: int, of: Callable[[int], Column]) -> Column:
    """The hash of three consecutive blocks; the class is hashed too, so classes do not meet."""
    return F.xxhash64(F.lit(c), *(of(k) for k in range(RUN)))


def _of_text(text: Column, c: int) -> Column:
    """Hashes of every run of blocks of a text; null where it has none."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{{block(c)}}}"), F.lit(0))
    runs = lambda b: F.transform(F.sequence(F.lit(0), F.size(b) - RUN), lambda i: _run(c, lambda k: F.get(b, i + k)))
    return F.get(F.transform(F.array(blocks), lambda b: F.when(F.size(b) >= RUN, F.array_distinct(runs(b)))), F.lit(0))


def _of_quote(quote: Column, c: int) -> Column:
    """Hashes of the runs that begin at each of a quote's characters."""
    width = block(c)
    places = F.sequence(F.lit(1), F.length(quote) - RUN * width + 1)
    return F.array_distinct(F.transform(places, lambda i: _run(c, lambda k: F.substring(quote, i + k * width, F.lit(width)))))


def candidates(texts: DataFrame, quotes: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, item_id) pairs that share a run; ``texts``: doc_id, norm; ``quotes``: item_id, quote, both normalised.

    The quotes' hashes are broadcast if their counted number keeps them under ``most_bytes``, else both sides shuffle."""
    asked = quotes.where(F.length("quote") >= MIN_QUOTE_CHARS).withColumn("c", window_class(F.col("quote")))
    classes = sorted(r.c for r in asked.select("c").distinct().collect())  # as many as the longest quote has doublings
    keys, runs = None, []
    for c in classes:
        own = asked.where(F.col("c") == c).select("item_id", F.explode(_of_quote(F.col("quote"), c)).alias("h"))
        keys = own if keys is None else keys.unionByName(own)
        runs.append(_of_text(F.col("norm"), c))
    if keys is None:
        return texts.select("doc_id").limit(0).join(quotes.select("item_id").limit(0))
    found = texts.select("doc_id", F.explode(F.flatten(F.array_compact(F.array(*runs)))).alias("h"))
    if keys.limit(most_bytes // 64 + 1).count() <= most_bytes // 64 and asked.agg(F.max(F.octet_length(F.col("item_id").cast("string")))).first()[0] in range(33):
        keys = F.broadcast(keys)
    return found.join(keys, "h").select("doc_id", "item_id").distinct()


def quote_pairs(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """(doc_id, item_id) pairs; ``texts``: doc_id, norm; ``quotes``: item_id, quote, both normalised.

    Null texts and quotes, and quotes under the least length, match nothing; repeated rows of a side give
    repeated pairs."""
    pairs = candidates(texts, quotes)
    return pairs.join(quotes, "item_id").join(texts, "doc_id").where(quote_in_text("quote", "norm")).select("doc_id", "item_id")
