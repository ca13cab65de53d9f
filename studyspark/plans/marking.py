"""Quotes marked on pages, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.marks import OPENING_WORDS, SENTENCE_WORDS, page_marks
from .bindings import table
from .oracle_chunks import _SPACE
from .queries import query

PAGE = 1000


@query
def q96_page_marks(spark, d):
    """Documents as pages of a thousand characters, with items that end at commas and line ends.  One quote of each: a
    passage with dashes, a passage after a strange sentence, eight words before strange ones, or strange words only."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    page = F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))).alias("n", "t")
    pages = docs.select("doc_id", page).select("doc_id", (F.col("n") + 1).alias("page"), F.split("t", "[,\n]").alias("items"))
    kind, passage = F.col("doc_id") % 4, lambda at, n: F.substring("text", at, n)
    words = F.split(F.trim(F.regexp_replace(passage(301, 200), r"(?U)\s+", " ")), " ")
    quote = (
        F.when(kind == 0, F.replace(passage(1101, 150), F.lit(" "), F.lit(" - ")))
        .when(kind == 1, F.concat(F.lit("Nowhere zzqx at all zzqx. "), passage(201, 300)))
        .when(kind == 2, F.concat(F.array_join(F.slice(words, 1, 8), " "), F.lit(" zzqx zzqx zzqx")))
        .otherwise("zzqx and zzqy only")
    )
    expected = F.when(F.col("doc_id") % 8 != 7, F.col("doc_id") % 5 + 1).cast("int")
    quotes = docs.select("doc_id", F.lit(1).alias("quote_id"), quote.alias("quote"), expected.alias("page"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["item"], s["begin"], s["end"])), " ")
    return page_marks(pages, quotes).select("doc_id", "level", "page", spans.alias("spans"))


def _letters(x: str) -> str:
    return rf"regexp_replace(replace(lower({x}), 'ς', 'σ'), '[^\p{{L}}\p{{N}}]', '', 'g')"


SQL = {
    "q96_page_marks": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), page AS (
  SELECT doc_id, page, replace(substr(text, (page - 1) * {PAGE} + 1, {PAGE}), ',', chr(10)) AS t
  FROM (SELECT *, unnest(range(1, (length(text) + {PAGE} - 1) // {PAGE} + 1))::INT AS page FROM d)
), quoted AS (
  SELECT doc_id, CASE WHEN doc_id % 8 <> 7 THEN doc_id % 5 + 1 END AS expected, trim(regexp_replace(CASE doc_id % 4 WHEN 0 THEN replace(substr(text, 1101, 150), ' ', ' - ')
    WHEN 1 THEN 'Nowhere zzqx at all zzqx. ' || substr(text, 201, 300)
    WHEN 2 THEN array_to_string(string_split(trim(regexp_replace(substr(text, 301, 200), '[{_SPACE}]+', ' ', 'g')), ' ')[1:8], ' ') || ' zzqx zzqx zzqx'
    ELSE 'zzqx and zzqy only' END, '[{_SPACE}]+', ' ', 'g')) AS q FROM d
), piece AS MATERIALIZED (
  SELECT doc_id, 0 AS k, 'whole' AS level, {_letters("q")} AS a FROM quoted
  UNION ALL SELECT doc_id, k, 'sentence', {_letters("s")} FROM (
    SELECT doc_id, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS s FROM (SELECT doc_id, string_split(regexp_replace(q, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) AS l FROM quoted)
  ) WHERE len(string_split(s, ' ')) >= {SENTENCE_WORDS}
  UNION ALL SELECT doc_id, 1000000, 'opening', {_letters(f"array_to_string(string_split(q, ' ')[1:{OPENING_WORDS}], ' ')")} FROM quoted
), norm AS MATERIALIZED (SELECT *, {_letters("t")} AS n FROM page), best AS MATERIALIZED (
  SELECT doc_id, level, page, t, instr(n, a) AS pos, length(a) AS chars FROM norm JOIN piece USING (doc_id) WHERE a <> '' AND contains(n, a)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k, page) = 1
), letter AS (
  SELECT *, list_filter(range(1, length(t) + 1), lambda i: regexp_matches(substr(t, i, 1), '[\p{{L}}\p{{N}}]')) AS places FROM best
), raw AS (SELECT *, places[pos] - 1 AS b, places[pos + chars - 1] AS e, string_split(t, chr(10)) AS items FROM letter), item AS (
  SELECT doc_id, b, e, i, length(items[i]) AS chars, coalesce(sum(length(items[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT *, unnest(range(1, len(items) + 1)) AS i FROM raw)
), span AS (
  SELECT doc_id, string_agg((i - 1) || ':' || greatest(b - start, 0)::BIGINT || ':' || least(e - start, chars)::BIGINT, ' ' ORDER BY i) AS spans
  FROM item WHERE greatest(b - start, 0) < least(e - start, chars) GROUP BY 1
), size AS (SELECT doc_id, max(page) AS pages FROM page GROUP BY 1)
SELECT q.doc_id, CASE WHEN b.level IS NOT NULL THEN b.level WHEN q.expected IS NOT NULL AND l.pages IS NOT NULL THEN 'page' ELSE 'none' END AS level,
  coalesce(b.page, CASE WHEN q.expected IS NOT NULL AND l.pages IS NOT NULL THEN least(q.expected, l.pages) END)::INT AS page, coalesce(s.spans, '') AS spans
FROM quoted q LEFT JOIN best b USING (doc_id) LEFT JOIN span s USING (doc_id) LEFT JOIN size l USING (doc_id)""",
}
