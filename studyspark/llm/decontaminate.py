"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts become lower-cased words (runs of letters, marks and digits).  Fixed masks
choose some of ``span`` neighbouring words and ignore the others; the hashes of the
chosen words of all positions of training texts meet those of the benchmark's items.
A hit proposes an alignment (document position minus item position).  Around each
proposed alignment words are compared one by one: it is verified when some ``window``
neighbouring words (the whole item, if it is shorter) agree in at least ``share`` of
their places, so substituted words are tolerated.

The two default masks are chosen so that every 13 words with at most two
substitutions hold a hit.  Shorter items tolerate only as many substitutions as their
length still promises a hit for (found by enumeration), so no overlap that would be
verified is missed.  Inserted or lost words split an overlap into alignments that are
verified each on their own.

Items with fewer words than the masks span have no seed.  They are found whole and
without substitutions, by the hash of all their words beside those of all runs of that
many words, wherever they stand (``min_words``: the least number of words of an item that
takes part).

The benchmark's hashes are broadcast when their counted number is under
``broadcast_rows``, else joined by shuffle; the same holds for the proposed
alignments when they meet the texts again, and for the items' words, whose bytes are
counted as well.

Edge cases: null and empty texts on either side have no words and match nothing;
repeated rows of a document or item are reported once; of equally good alignments of a
document and an item the first counts; ids may be null (reported as null); very long
texts are one row of words each, and only texts with a hit are read again, once for each item,
whatever the number of their hits (a text of one repeated word has as many alignments as words:
each costs one walk over the item); an empty
table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, written

#: Weight 6, span 8.  Any 13 words with two substitutions keep one of them free.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))


def tolerated(masks, length: int, share: float) -> int:
    """How many of ``length`` words may differ: 1 - share of them, if any such choice leaves some mask free."""
    places = [frozenset(s + i for i in m) for m in masks for s in range(length - max(m))]
    most = int(length * (1 - share) + 1e-9)
    while most > 0 and not all(any(p.isdisjoint(bad) for p in places) for bad in combinations(range(length), most)):
        most -= 1
    return most


def words(text: Column | str) -> Column:
    """Lower-cased runs of letters, marks and digits."""
    c = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")


def _hashed(df: DataFrame, keep: list[str], masks) -> DataFrame:
    """(keep..., at: position, seed): for each mask the hash of the chosen words at every position.

    Shifted slices zipped side by side give each position its ``span`` words as plain columns, so the
    hashing itself is generated code and not an interpreted lambda."""
    span = max(max(m) for m in masks) + 1
    near = [F.slice("w", i + 1, F.greatest(F.size("w") - span + 1, F.lit(0))).alias(f"w{i}") for i in range(span)]
    rows = df.select(*keep, words("text").alias("w")).select(*keep, F.posexplode(F.arrays_zip(*near)).alias("at", "z"))
    # the number of the mask is hashed too: different masks never meet
    seeds = [F.xxhash64(F.lit(n), *(F.col("z")[f"w{o}"] for o in m)) for n, m in enumerate(masks)]
    return rows.select(*keep, "at", F.explode(F.array(*seeds)).alias("seed"))


def _runs(df: DataFrame, keep: list[str], lengths: list[int]) -> DataFrame:
    """(keep..., at, n, seed): the hash of every run of n words, for each n of ``lengths``."""
    near = [F.slice("w", i + 1, F.greatest(F.size("w") - i, F.lit(0))).alias(f"w{i}") for i in range(max(lengths))]
    rows = df.select(*keep, words("text").alias("w")).select(*keep, F.posexplode(F.arrays_zip(*near)).alias("at", "z"))
    word = lambda i: F.col("z")[f"w{i}"]  # noqa: E731  null behind the last word
    runs = F.array(*(F.when(word(n - 1).isNotNull(), F.struct(F.lit(n).alias("n"), F.xxhash64(F.lit(-n), *map(word, range(n))).alias("seed"))) for n in lengths))
    return rows.select(*keep, "at", F.explode(runs).alias("r")).where("r is not null").select(*keep, "at", "r.n", "r.seed")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast only behind a count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _verified(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    masks=MASKS,
    window: int = 13,
    share: float = 0.8,
    min_words: int = 1,
    broadcast_rows: int = 500_000,
    broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """The best verified alignment of each document and item: (id, k: hash of a document's id and text, item, item_words, n_matched, best_window, shift)."""
    span = max(max(m) for m in masks) + 1
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("k", F.xxhash64("id", "text"))
    bench = items.select(F.col(item_id_col).alias("item"), F.col(item_text_col).alias("text")).distinct()
    seeds = written(_hashed(bench, ["item"], masks).withColumnRenamed("at", "item_at"), "seeds")
    found = _hashed(texts, ["id", "k"], masks).join(_small(seeds, broadcast_rows), "seed")
    hits = found.select("id", "k", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    sized = bench.withColumn("size", F.size(words("text"))).where((F.col("size") >= max(min_words, 1)) & (F.col("size") < span))
    lengths = sorted(r.size for r in sized.select("size").distinct().collect())  # fewer than the span
    if lengths:
        whole = written(_runs(sized, ["item", "size"], lengths).where("at = 0 and n = size").select("item", "seed"), "short")
        short = _runs(texts, ["id", "k"], lengths).join(_small(whole, broadcast_rows), "seed")
        hits = hits.unionByName(short.groupBy("id", "k", "item").agg(F.min("at").alias("shift")))
    # one row for a document and an item, with all shifts: the document's words stand beside them once
    hits = written(hits.groupBy("id", "k", "item").agg(F.collect_list("shift").alias("shifts")), "hits")
    found = hits.withColumnsRenamed({"id": "hit_id", "k": "hit_k"})
    if hits.agg(F.coalesce(F.sum(F.size("shifts") + 10), F.lit(0))).first()[0] <= 1_000_000:  # numbers, and ten for the keys
        found = F.broadcast(found)
    aligned = texts.join(found, (F.col("k") == F.col("hit_k")) & F.col("id").eqNullSafe(F.col("hit_id"))).drop("hit_id", "hit_k").withColumnRenamed("text", "doc_text")
    own = bench.select(F.col("item").alias("own"), words("text").alias("iw"))
    if bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] <= broadcast_bytes:
        own = _small(own, 10_000)
    pairs = aligned.join(own, F.col("item").eqNullSafe(F.col("own")))
    needed = F.array(*(F.lit(n - tolerated(masks, n, share)) for n in range(1, window + 1)))
    length = F.least(F.lit(window), F.size("iw"))
    best = F.get(F.transform(F.array(words("doc_text")), lambda dw: _best(dw, F.col("shifts"), F.col("iw"), length, F.element_at(needed, length))), F.lit(0))
    scored = pairs.select("id", "k", "item", F.size("iw").alias("item_words"), best.alias("best")).where("best is not null")
    return scored.select("id", "k", "item", "item_words", "best.n_matched", "best.best_window", (-F.col("best.back")).alias("shift"))


def _best(doc: Column, shifts: Column, item: Column, length: Column, needed: Column) -> Column:
    """The best verified alignment of an item's words in a document's: agreeing words, those of the best window, least shift.

    Each alignment is one walk over the item's words, with the sum of the window that ends there."""

    def agrees(shift: Column, i: Column) -> Column:
        return F.when(F.get(doc, shift + i) == F.get(item, i), 1).otherwise(0)

    def scored(shift: Column) -> Column:
        def walked(s: Column, i: Column) -> Column:
            now = agrees(shift, i)
            run = s["run"] + now - F.when(i >= length, agrees(shift, i - length)).otherwise(0)
            return F.struct((s["n_matched"] + now).alias("n_matched"), F.when(i >= length - 1, F.greatest(s["best_window"], run)).otherwise(s["best_window"]).alias("best_window"), run.alias("run"))

        start = F.struct(F.lit(0).alias("n_matched"), F.lit(0).alias("best_window"), F.lit(0).alias("run"))
        return F.aggregate(F.sequence(F.lit(0), F.size(item) - 1), start, walked, lambda s: F.struct(s["n_matched"], s["best_window"], (-shift).alias("back")))

    return F.array_max(F.filter(F.transform(shifts, scored), lambda s: s["best_window"] >= needed))


def overlaps(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", item_id_col: str = "item_id", **options) -> DataFrame:
    """Verified overlaps, one row per id and item: (id, item id, doc_start, n_matched, item_words, best_window).

    ``doc_start``: the word of the document where the item's first word would stand;
    ``n_matched``: agreeing words of that alignment; ``best_window``: of the best window."""
    kept = _verified(docs, items, id_col=id_col, item_id_col=item_id_col, **options)
    top = kept.groupBy("id", "item").agg(F.max(F.struct("n_matched", "best_window", (-F.col("shift")).alias("back"), "item_words")).alias("t"))
    return top.select(F.col("id").alias(id_col), F.col("item").alias(item_id_col), (-F.col("t.back")).cast("bigint").alias("doc_start"), F.col("t.n_matched"), F.col("t.item_words"), F.col("t.best_window"))


def clean(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, without documents that overlap an item.

    A document is an id and a text: other texts of its id, or other texts without an id, stay."""
    key, own = apart(docs, "_bad", "_bad_id")
    bad = _verified(docs, items, id_col=id_col, text_col=text_col, **options).select(F.col("id").alias(own), F.col("k").alias(key)).distinct()
    same = (F.xxhash64(docs[id_col], docs[text_col]) == bad[key]) & docs[id_col].eqNullSafe(bad[own])
    return docs.join(bad, same, "left_anti")
