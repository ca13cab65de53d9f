"""Target-distribution importance resampling over hashed word runs.

Identical texts are collapsed by grouping full texts; a text's hashed features are taken once
and counted as often as the text occurs.  A bucket's gain is the logarithm of its smoothed share
in the target over that in the corpus; a text's weight is the mean gain of its features.
Weights are joined back to the documents by the text's SHA-256, and only then does each document
get noise of its own.  The highest scores are drawn.

The ranks are given without one task that sees all: scores are integers, a histogram of them
(some ten thousands at every size, as gains are logarithms) says where the cut lies, and what
stands above it is sorted by ranges and numbered by the ranges' sizes.

Edge cases: a null text is empty and has no feature: weight 0; a null id counts as the text ''
in the noise; repeated rows are documents of their own, and where all ends the same any of them
may be the drawn one; equal scores go to the smaller id; very long texts are one list of words;
an empty target or corpus leaves the smoothing alone; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, in_arrow, table, written

#: A-Z in lower case; digits, a-z and all bytes beyond ASCII stay, anything else ends a word.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def hashed_features(texts: DataFrame, *, longest: int, buckets: int) -> DataFrame:
    """(key, copies, n_words, n_features, features) of (key, copies, text): the sorted buckets of all word runs
    of 1 to ``longest`` words, as little-endian 32-bit numbers."""

    def run(batches):
        for b in batches:
            n_words, found = [], []
            for text in as_bytes(b.column(2)):
                words = text.translate(_WORDS).split()
                hashes = list(map(crc32, words))
                for n in range(2, longest + 1):
                    hashes.extend(crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1))
                n_words.append(len(words))
                found.append(np.sort((np.array(hashes, np.uint32) % buckets).astype("<u4")))
            sizes = pa.array([len(x) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_words, pa.int64()), sizes, pa.array([x.tobytes() for x in found], pa.binary())], names=["key", "copies", "n_words", "n_features", "features"])

    return in_arrow(texts.select("key", "copies", "text"), run, "key binary, copies bigint, n_words bigint, n_features bigint, features binary")


def collapsed(texts: DataFrame) -> DataFrame:
    """(key, copies, text) of a one-column table: each text once, with its SHA-256 and how often it occurs."""
    (column,) = texts.columns
    grouped = texts.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    return grouped.select(F.unhex(F.sha2("text", 256)).alias("key"), "copies", "text")


def bucket_counts(features: DataFrame, buckets: int) -> list[int]:
    """Occurrences in each bucket, copies included; a task hands on one number a bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            copies, lists = b.column(0).to_numpy(), [np.frombuffer(x, "<u4") for x in b.column(1).to_pylist()]
            if lists:
                np.add.at(total, np.concatenate(lists), np.repeat(copies, [len(x) for x in lists]))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(total[full], pa.int64())], names=["bucket", "n"])

    found = in_arrow(features.select("copies", "features"), run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for r in found.collect():
        out[r.bucket] = r.n
    return out


def gains(target: list[int], corpus: list[int]) -> list[int]:
    """A thousand times the logarithm of the ratio of smoothed shares, floored, of every bucket."""
    n, all_target, all_corpus = len(corpus), sum(target), sum(corpus)
    return [math.floor(1000 * math.log((t + 1) * (all_corpus + n) / ((s + 1) * (all_target + n)))) for t, s in zip(target, corpus, strict=True)]


def weighted(features: DataFrame, gain: list[int]) -> DataFrame:
    """(key, n_words, n_features, weight) of every text: the floored mean gain of its features, 0 without any."""

    def run(batches):
        of = np.array(gain, np.int64)
        for b in batches:
            sums = [int(of[np.frombuffer(x, "<u4")].sum()) for x in b.column(3).to_pylist()]
            mean = [s // n if n else 0 for s, n in zip(sums, b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(mean, pa.int64())], names=["key", "n_words", "n_features", "weight"])

    return in_arrow(features.select("key", "n_words", "n_features", "features"), run, "key binary, n_words bigint, n_features bigint, weight bigint")


def ranked(scored: DataFrame, wanted: int) -> DataFrame:
    """``scored`` (id, score, eligible, ...) with ``rank``: 1 to ``wanted`` by score descending and id, else null."""
    levels = sorted(((r.score, r["count"]) for r in scored.where("eligible").groupBy("score").count().collect()), reverse=True)
    seen, cut = 0, None
    for score, n in levels:
        if seen >= wanted:
            break
        seen, cut = seen + n, score
    none = F.lit(None).cast("bigint").alias("rank")
    if cut is None or wanted <= 0:
        return scored.select("*", none)
    above = F.col("eligible") & (F.col("score") >= cut)
    # the last key only splits rows that are the same in both others
    order = [F.desc("score"), F.asc("id"), F.asc("_apart")]
    spread = scored.where(above).withColumn("_apart", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(spread.drop("_apart").withColumn("_place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_place", 33)
    sizes = sorted((r.part, r["count"]) for r in placed.groupBy(part.alias("part")).count().collect())  # a row for each partition
    before, rows = 0, []
    for p, n in sizes:
        rows.append((p, before))
        before += n
    offsets = scored.sparkSession.createDataFrame(rows, "part bigint, before bigint")
    rank = F.col("before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = placed.join(F.broadcast(offsets), part == F.col("part")).select(*scored.columns, F.when(rank <= wanted, rank).alias("rank"))
    return scored.where(~above).select("*", none).unionByName(drawn)


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """(id, n_features, weight, score, rank) of every document; the drawn ones have a rank."""
    corpus = written(hashed_features(collapsed(docs.select(text_col)), longest=longest, buckets=buckets), "features", "zstd")
    aims = hashed_features(collapsed(target.select(target_col)), longest=longest, buckets=buckets)
    texts = weighted(corpus, gains(bucket_counts(aims, buckets), bucket_counts(corpus, buckets)))
    keyed = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)).alias("key"))
    uniform = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(F.log(-F.log((uniform + 0.5) / 4294967296.0)) * -1000)
    scored = keyed.join(texts, "key").select("id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("eligible"))
    scored = written(scored, "scored")
    wanted = percent * scored.where("eligible").count() // 100
    return ranked(scored, wanted).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def noise_of(doc_id, seed: int = 2024) -> int:
    """The noise of one document, for tests."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def op12_importance(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 by its table, which is made from the polynomial; every distinct word is hashed once.
SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b::BIGINT], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents
), b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS w FROM benchmark
), o AS (SELECT rowid AS r, doc_id, len(w) AS n FROM (SELECT row_number() OVER () AS rowid, * FROM d)),
e AS (SELECT rowid AS r, unnest(w) AS w FROM (SELECT row_number() OVER () AS rowid, * FROM d)),
words AS (SELECT DISTINCT w FROM (SELECT w FROM e UNION ALL SELECT w FROM b)), hashed AS (
  SELECT w, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::BIGINT, 2))::BIGINT)),
    lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 10000 AS bucket
  FROM words, crc
), s AS (SELECT bucket, count(*) AS s FROM e JOIN hashed USING (w) GROUP BY ALL), t AS (SELECT bucket, count(*) AS t FROM b JOIN hashed USING (w) GROUP BY ALL),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
), weight AS (
  SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM e JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY r
), scored AS (
  SELECT r, doc_id, n::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM o LEFT JOIN weight USING (r)
), drawn AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM drawn) // 100 THEN rank END AS rank
FROM scored LEFT JOIN drawn USING (r)
"""
