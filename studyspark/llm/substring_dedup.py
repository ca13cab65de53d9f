"""Substring deduplication by hashing units of lines.

A text is cut into pieces: lines, and within lines at white space after a comma or
punctuation that ends a sentence or a table cell, so that a passage is found wherever it
stands in a line.  A unit is a piece with at least ``min_words`` words, or a shorter one
together with those after it until there are enough; so passages of short sentences are
found as well, whatever stands before them.  A unit is normalised (lower case, white
space collapsed, punctuation at its ends dropped) and its 128-bit digest grouped
globally.  The earliest occurrence (smallest id, then position) is left alone; all others
are removed, overlapping ones as one span.  Offsets are code points of the original text.

What stays: units overlap, so a piece of an earliest occurrence may go as part of another
unit, which then has an earlier occurrence still.  Following these places back ends at one
that is not removed, so every removed piece stands, word for word, in an earlier place
that is kept; neighbouring pieces may be kept in different documents.

What is missed: a passage in a line without any such punctuation, glued to other words;
its first or last words up to the next piece; repeated pieces under ``min_words`` words
whose following text differs; text without spaces, where a run between two marks counts
as one word.

Units travel as digests and offsets.  A unit that stands earlier in its own document
is marked where it is made; the group of a digest keeps the smallest rank of a
document, combined before the shuffle; flagged units are found by a hash join on the
repeated digests (unique) that Spark may split where a digest is hot.  Overlapping spans of
a document are merged by a window over its own spans.  No group is ever collected:
only one document's own spans are.

Edge cases: a null text stays null and has no units; repeated rows (same id, same
text) are one document: the same spans are removed from each; a null id ranks after
all others; equal ids with different texts rank by a hash of the text; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, build_side, in_arrow, removed, written

#: White space with a line feed, or after any character that is no letter, digit, quote, hyphen, colon, semicolon or opening bracket.
_CUT = re.compile(r"\s*\n\s*|(?<=[^\w\s;:'\"’“”()\-–])[ \t]+")
_EDGE = ".,;:!?…|*#%&$\"'’“”()[]<>=+~-–"


def pieces(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-cased words) of the pieces; end includes the white space that follows."""
    out, start = [], 0
    for end in [*(m.end() for m in _CUT.finditer(text)), len(text)]:
        if words := text[start:end].lower().split():
            out.append((start, end, words))
        start = end
    return out


def units(text: str, min_words: int = 8) -> list[tuple[int, int, str]]:
    """(start, end, normalised) of what is compared, one for each piece that has enough words by itself
    or with those after it."""
    own = pieces(text)
    out = []
    for i, (begin, end, joined) in enumerate(own):
        j = i
        while len(joined) < min_words and j + 1 < len(own):
            j += 1
            _, end, more = own[j]
            joined = joined + more
        if len(joined) >= min_words:
            out.append((begin, end, " ".join(joined).strip(_EDGE)))
    return out


def duplicate_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 8) -> DataFrame:
    """(id, k, spans): for each document (its id, and a hash of id and text) with removed units, their sorted (start, end)."""
    picked = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(id_col, text_col).alias("k"), F.col(text_col).alias("text")).where("text is not null")

    def run(batches):
        from xxhash import xxh3_128_intdigest

        mask = (1 << 64) - 1
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for b in batches:
            hi, lo, again, row, span = [], [], [], [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                seen = set()
                for s, e, u in units(text, min_words):
                    h = xxh3_128_intdigest(u.encode("utf-8", "surrogatepass"))
                    hi.append(signed(h >> 64))
                    lo.append(signed(h & mask))
                    again.append(h in seen)
                    seen.add(h)
                    row.append(i)
                    span.append(s << 32 | e)
            row = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), b.column(0).take(row), b.column(1).take(row), pa.array(again, pa.bool_()), pa.array(span, pa.int64())],
                names=["hi", "lo", "id", "k", "again", "span"],
            )

    found = written(in_arrow(picked, run, "hi bigint, lo bigint, id bigint, k bigint, again boolean, span bigint"), "units", codec="zstd")
    # one number that orders documents by id (null last), then by 62 bits of k; of fixed width: a hash aggregation, no sort
    low = F.lit((1 << 62) - 1)
    rank = (F.coalesce(F.col("id").cast("decimal(20,0)"), F.lit(Decimal(1 << 63))) * F.lit(Decimal(1 << 62)) + F.col("k").bitwiseAND(low).cast("decimal(20,0)")).cast("decimal(38,0)")
    repeated = found.groupBy("hi", "lo").agg(F.min(rank).alias("rank"), F.count("*").alias("n")).where("n > 1")
    # written, so that the join is one of plain shuffles, which can be split where a digest is hot;
    # it needs only the low bits of the first document's rank to tell it from another
    first = written(repeated.select("hi", "lo", F.pmod("rank", F.lit(Decimal(1 << 62))).cast("bigint").alias("first")), "repeated")
    later = found.join(build_side(first), ["hi", "lo"]).where((F.col("k").bitwiseAND(low) != F.col("first")) | F.col("again"))
    later = later.select("id", "k", F.shiftright("span", 32).cast("int").alias("start"), F.col("span").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("end"))
    own = Window.partitionBy("id", "k").orderBy("start", "end")
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    joined = later.withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int")).withColumn("n", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    merged = joined.groupBy("id", "k", "n").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = written(merged.groupBy("id", "k").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")), "spans")
    removed(found, first)
    return spans


def _beside(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """``docs`` with one more column: what goes from each text, or null; and the column's name."""
    own, key, name = apart(docs, "_id", "_k", "_spans")
    keys = spans.withColumnsRenamed({"id": own, "k": key, "spans": name})
    same = (docs[id_col].cast("bigint").eqNullSafe(keys[own])) & (F.xxhash64(docs[id_col], docs[text_col]) == keys[key])
    return docs.join(build_side(keys), same, "left").drop(own, key), name


def without(text: Column, spans: Column) -> Column:
    """The text without the (start, end) spans: what stands between the ends of one and the start of the next."""
    edges = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), spans)
    parts = F.transform(edges, lambda x, i: F.substring(text, x["end"] + 1, F.coalesce(F.get(spans, i)["start"], F.length(text)) - x["end"]))
    return F.when(spans.isNull(), text).otherwise(F.array_join(parts, ""))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 8) -> DataFrame:
    """(id, text without repeated units, spans: removed (start, end) of the original, n_removed: spans, removed_chars), one row per row."""
    spans = duplicate_spans(docs, id_col=id_col, text_col=text_col, min_words=min_words)
    joined, name = _beside(docs.select(id_col, text_col), spans, id_col, text_col)
    joined = joined.withColumnRenamed(name, "spans")
    kept = without(F.col(text_col), F.col("spans"))
    gone = F.coalesce(F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"]), F.lit(0).cast("bigint"))
    return joined.select(id_col, kept.alias(text_col), "spans", F.coalesce(F.size("spans"), F.lit(0)).alias("n_removed"), gone.alias("removed_chars"))


def cleaned(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars", min_words: int = 8) -> DataFrame:
    """The rows and columns of ``docs`` with repeated units removed from the text; ``count_col``, if there, is its new length.

    Texts of which nothing is left are dropped, unless they were empty before."""
    joined, name = _beside(docs, duplicate_spans(docs, id_col=id_col, text_col=text_col, min_words=min_words), id_col, text_col)
    (cut,) = apart(docs, "_cut")
    text = without(F.col(text_col), F.col(name))
    out = joined.select(*(text.alias(text_col) if c == text_col else F.col(c) for c in docs.columns), F.col(name).isNotNull().alias(cut))
    out = out.where(~F.col(cut) | (F.length(F.trim(text_col)) > 0)).drop(cut)
    if count_col in docs.columns:
        out = out.withColumn(count_col, F.length(text_col).cast(dict(docs.dtypes)[count_col]))
    return out.select(*docs.columns)
