"""Reading order of two-column pages from word boxes.

``words``: doc_id, page, x0, x1, top, bottom, text; ``pages``: doc_id, page, width, height.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import drop_glyph_ids

#: Fixed values, in points.
HALF_GUTTER = 4
BAND_GAP = 4
WORD_GAP = 1.5
LEAST_ROWS = 10
SHARE = 0.25


def _dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds _deal, a hash of the keys, and deals rows by it over a fixed number of tasks: adaptive execution would put
    boxes, which compress well, into few tasks, each of which then sorts and holds its share unpacked.

    Whatever groups by _deal and the keys needs no other shuffle, even where the optimizer knows a key as a constant."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.withColumn("_deal", F.xxhash64(*keys)).repartition(tasks, "_deal")


def words_from_chars(chars: DataFrame) -> DataFrame:
    """Words of upright characters (doc_id, page, top, bottom, x0, x1, c, upright): a gap wider than
    the tolerance, or a new row, begins one."""
    row = Window.partitionBy("doc_id", "page", "top").orderBy("x0")
    gap = F.col("x0") - F.lag("x1").over(row) > WORD_GAP
    marked = chars.where("upright").withColumn("_new", F.coalesce(gap, F.lit(True)).cast("int"))
    numbered = marked.withColumn("_w", F.sum("_new").over(row))
    return numbered.groupBy("doc_id", "page", "top", "_w").agg(
        F.max("bottom").alias("bottom"), F.min("x0").alias("x0"), F.max("x1").alias("x1"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "c"))), lambda s: s["c"]), "").alias("text"),
    ).drop("_w")


def gutters(words: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, gutter) of pages with two columns.

    A gutter is the first x near the middle whose strip the fewest rows cross, if they
    are few and both sides hold enough rows.  What counts at x changes only where a row
    begins or ends to cross it, or to have words left or right of it: these changes are
    events, summed from left to right, a few for each row whatever the width."""
    keys = ["doc_id", "page"]
    lo, hi = F.floor(F.col("width") * 0.4).cast("int"), F.floor(F.col("width") * 0.6).cast("int")
    rows = words.join(pages.select(*keys, lo.alias("lo"), hi.alias("hi")), keys).withColumn("row", F.bround("top").cast("long"))
    # whole numbers x with x0 < x + HALF_GUTTER and x1 > x - HALF_GUTTER, within lo and hi
    first = F.greatest(F.floor(F.col("x0") - HALF_GUTTER).cast("int") + 1, F.col("lo"))
    last = F.least(F.ceil(F.col("x1") + HALF_GUTTER).cast("int") - 1, F.col("hi"))
    crossed = rows.select(*keys, "row", "lo", "hi", first.alias("first"), last.alias("last")).where("first <= last")
    runs = merge_intervals(crossed, [*keys, "row", "lo", "hi"], "first", "last", gap=0)
    change = lambda x, c, l, r: F.struct(x.cast("int").alias("x"), F.lit(c).alias("c"), F.lit(l).alias("l"), F.lit(r).alias("r"))
    crossing = runs.select(*keys, "lo", "hi", F.inline(F.array(change(F.col("top"), 1, 0, 0), change(F.col("bottom") + 1, -1, 0, 0))))
    sides = rows.groupBy(*keys, "row", "lo", "hi").agg(F.min("x1").alias("left"), F.max("x0").alias("right"))
    begins = F.greatest(F.ceil("left").cast("int"), F.col("lo"))  # words end at or before x
    ends = F.greatest(F.floor("right").cast("int") + 1, F.col("lo"))  # no word begins at or behind x any more
    beside = sides.select(*keys, "lo", "hi", F.inline(F.array(change(begins, 0, 1, 0), change(F.col("lo"), 0, 0, 1), change(ends, 0, 0, -1))))
    events = crossing.unionByName(beside).where("x <= hi").groupBy(*keys, "x").agg(*(F.sum(k).alias(k) for k in "clr"))
    so_far = Window.partitionBy(*keys).orderBy("x")
    by_x = events.select(*keys, "x", *(F.sum(k).over(so_far).alias(k) for k in "clr"))
    best = by_x.groupBy(*keys).agg(F.min(F.struct("c", "x", "l", "r")).alias("b")).select(*keys, "b.*")
    enough = (F.col("rows") >= LEAST_ROWS) & (F.col("c") <= SHARE * F.col("rows")) & (F.least("l", "r") >= SHARE * F.col("rows"))
    return best.join(sides.groupBy(*keys).agg(F.count("*").alias("rows")), keys).where(enough).select(*keys, F.col("x").alias("gutter"))


def merge_intervals(rows: DataFrame, keys: list[str], top: str = "top", bottom: str = "bottom", gap: float = BAND_GAP) -> DataFrame:
    """Intervals merged where one begins at most ``gap`` after all before it end: (keys, band, top, bottom)."""
    order = Window.partitionBy("_deal", *keys).orderBy(top, bottom)
    before = F.max(bottom).over(order.rowsBetween(Window.unboundedPreceding, -1))
    started = _dealt(rows, keys).withColumn("_new", F.coalesce(F.col(top) > before + gap, F.lit(True)).cast("int"))
    banded = started.withColumn("band", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return banded.groupBy("_deal", *keys, "band").agg(F.min(top).alias("top"), F.max(bottom).alias("bottom")).drop("_deal")


def regions(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Reading regions of two-column pages: (doc_id, page, place, x0, top, x1, bottom), read by place.

    Between full-width bands the left column comes before the right one, then the band."""
    keys = ["doc_id", "page"]
    two = gutters(words, pages).join(pages.select(*keys, "width", "height"), keys)
    across = words.join(two.select(*keys, "gutter"), keys).where("x0 < gutter and gutter < x1")
    bands = merge_intervals(across, keys).select(*keys, "top", "bottom")
    ends = two.select(*keys, F.col("height").cast("double").alias("top"), F.col("height").cast("double").alias("bottom"))
    order = Window.partitionBy(*keys).orderBy("top", "bottom")
    stacked = bands.unionByName(ends).withColumn("y", F.coalesce(F.lag("bottom").over(order), F.lit(0.0))).withColumn("n", F.row_number().over(order)).join(two, keys)
    box = lambda i, x0, t, x1, b: F.struct((F.col("n") * 3 + i).alias("place"), x0.cast("double").alias("x0"), F.col(t).alias("top"), x1.cast("double").alias("x1"), F.col(b).alias("bottom"))
    left, gut, right = F.lit(0.0), F.col("gutter"), F.col("width")
    return stacked.select(*keys, F.inline(F.array(box(0, left, "y", gut, "top"), box(1, gut, "y", right, "top"), box(2, left, "top", right, "bottom"))))


def in_regions(words: DataFrame, areas: DataFrame) -> DataFrame:
    """Each word with the one region that holds its centre (half-open): a range join within a page."""
    keys = ["doc_id", "page"]
    cx, cy = (words["x0"] + words["x1"]) / 2, (words["top"] + words["bottom"]) / 2
    inside = (cx >= areas["x0"]) & (cx < areas["x1"]) & (cy >= areas["top"]) & (cy < areas["bottom"])
    same = [words[k] == areas[k] for k in keys]
    return words.join(areas, [*same, inside]).select(words["*"], areas["place"])


def page_text(words: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, text) in reading order, without the marks of unreadable glyphs; pages without two
    columns read row by row."""
    keys = ["doc_id", "page"]
    placed = in_regions(words, regions(words, pages)).select(*keys, "place", F.bround("top").alias("row"), "x0", "text")
    whole = words.join(placed.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit(0).alias("place"), F.bround("top").alias("row"), "x0", "text")
    lines = placed.unionByName(whole).groupBy(*keys, "place", "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda s: s["text"]), " ").alias("line"))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "row", "line"))), lambda s: s["line"]), "\n").alias("text")).withColumn("text", drop_glyph_ids("text"))


def page_counters(pages: DataFrame) -> DataFrame:
    """Per document: pages read by the second reader, by OCR, and skipped as empty."""
    return pages.groupBy("doc_id").agg(F.count_if("fallback").alias("fallback"), F.count_if("ocr").alias("ocr"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("skipped"))


def assemble(pages: DataFrame) -> DataFrame:
    """One text per document with a marker line before each page; empty if no page has text."""
    part = F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), F.coalesce("text", F.lit("")))
    any_text = F.bool_or(F.trim(F.coalesce("text", F.lit(""))) != "")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", part.alias("t")))), lambda s: s["t"]), "\n\n")
    return pages.groupBy("doc_id").agg(F.when(any_text, joined).otherwise("").alias("text"))
