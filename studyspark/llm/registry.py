"""The thin ``opN_<name>`` queries over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, importance, lm_scoring, packing, quality_crf, simhash_dedup, source_audit, substring_dedup, token_counts, topk_mtree, toxicity, warc
from .common import table


def tokenizer_path(name: str) -> str:
    """The public vocabulary files are installed beside the libraries, never copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op1_topk_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    def finite(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    v = F.col("embedding").cast("array<double>")
    sound = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).where(F.col("v").isNotNull() & F.forall("v", finite))
    scaled = sound.select("vec_id", F.transform("v", lambda x: F.floor(x * 64)).alias("vector"))
    return topk_mtree.top_k(scaled, scaled.where(F.col("vec_id") % 20 == 0), k=20)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), modulus=5, held=0, threshold=0.5)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_removed", "removed_chars", "spans", "text")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), modulus=7, held=2)


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), modulus=4, held=2, threshold=0.7)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archived(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, bits=4)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_mtree": op1_topk_mtree,
    "op2_toxicity": op2_toxicity,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_packing": op5_packing,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_quality_crf": op7_quality_crf,
    "op8_warc": op8_warc,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_source_audit": source_audit.op11_source_audit,
    "op12_importance": importance.op12_importance,
    "op13_byte_bpe": byte_bpe.op13_byte_bpe,
}

#: Base32 by hand: five hex digits are four characters of the alphabet.
_OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS sha FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY sha) AS first_id FROM d
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(sha, (1 + 5 * (i // 4))::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM f
"""

_OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_NEEDED = [n - decontaminate.tolerated(decontaminate.MASKS, n, 0.8) for n in range(1, 14)]
_CHOSEN = " UNION ALL ".join(
    f"SELECT id, pos, {n} AS mask, {' || chr(1) || '.join(f'w[pos + {o + 1}]' for o in m)} AS seed FROM {{0}}" for n, m in enumerate(decontaminate.MASKS)
)
_OP10_SQL = f"""
WITH dw AS (
  SELECT doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents
), iw AS (
  SELECT DISTINCT item_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark
), dp AS (SELECT id, w, unnest(range(len(w) - 7)) AS pos FROM dw), ip AS (SELECT id, w, unnest(range(len(w) - 7)) AS pos FROM iw),
ds AS ({_CHOSEN.format("dp")}), si AS ({_CHOSEN.format("ip")}), hits AS (
  SELECT DISTINCT ds.id AS doc_id, si.id AS item_id, ds.pos - si.pos AS shift FROM ds JOIN si USING (mask, seed)
  UNION ALL
  SELECT doc_id, item_id, min(pos) FROM (
    SELECT dw.id AS doc_id, iw.id AS item_id, dw.w AS dws, iw.w AS iws, unnest(range(len(dw.w) - len(iw.w) + 1)) AS pos FROM iw JOIN dw ON len(iw.w) BETWEEN 1 AND 7 AND len(dw.w) >= len(iw.w)
  ) WHERE dws[pos + 1 : pos + len(iws)] = iws GROUP BY ALL
), same AS (
  SELECT doc_id, item_id, shift, len(iw.w) AS n,
    list_transform(range(len(iw.w)), lambda k: CASE WHEN shift + k >= 0 AND dw.w[shift + k + 1] = iw.w[k + 1] THEN 1 ELSE 0 END) AS s
  FROM hits JOIN dw ON dw.id = doc_id JOIN iw ON iw.id = item_id
), scored AS (
  SELECT doc_id, item_id, shift, n, list_sum(s)::INT AS n_matched, least(13, n) AS l,
    list_max(list_transform(range(n - least(13, n) + 1), lambda b: list_sum(s[b + 1 : b + least(13, n)])))::INT AS best_window
  FROM same
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_matched DESC, best_window DESC, shift) AS k FROM scored WHERE best_window >= {_NEEDED}[l]
)
SELECT doc_id, item_id, shift::BIGINT AS doc_start, n_matched, n::INT AS item_words, best_window FROM best WHERE k = 1
"""

ORACLE_SQL: dict[str, str] = {"op10_decontaminate": _OP10_SQL, "op1_topk_mtree": _OP1_SQL, "op8_warc": _OP8_SQL, "op11_source_audit": source_audit.SQL, "op12_importance": importance.SQL}
