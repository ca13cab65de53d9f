"""DuckDB SQL of chunking: sections, paragraphs and their cuts as rows, packing as a recursion over a text's parts."""

from __future__ import annotations

from ..functions.chunking import ELISION, FRAMING_WORDS

#: White space of a text, for a character class.
_SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _left_off(x: str) -> str:
    return f"regexp_replace({x}, '^[{_SPACE}]+', '')"


def _right_off(x: str) -> str:
    return f"regexp_replace({x}, '[{_SPACE}]+$', '')"


def _after(mark: str, n: int) -> str:
    return f"WHEN instr(tail, {mark}) > 0 THEN {_left_off(f'substr(tail, instr(tail, {mark}) + {n})')}"


def chunks(size: int, overlap: int) -> str:
    """The WITH clause that ends in chunks(doc_id, chunk_no, chunk)."""
    limit, lf = size - overlap - 2, "chr(10)"
    cut = f"coalesce(nullif(length(regexp_extract(left(rest, {limit}), '(?s)^(.+)\\n', 1)), 0), nullif(length(regexp_extract(left(rest, {limit}), '(?s)^(.+) ', 1)), 0), {limit})"
    return rf"""WITH RECURSIVE whole AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS t, string_split(regexp_replace({lf} || coalesce(text, ''), '\n(## [^\n])', chr(1) || '\1', 'g'), chr(1)) AS w FROM documents
), listed AS (
  SELECT doc_id, len(w) > 3 AS led, CASE WHEN len(w) > 3 THEN list_filter(list_transform(w, lambda s: {_left_off(_right_off('s'))}), lambda s: s <> '') ELSE [t] END AS l FROM whole
), section AS MATERIALIZED (
  SELECT doc_id, led, i, l[i] AS s, led AND length(l[i]) <= {size} AS small FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM listed)
), paragraph AS (
  SELECT doc_id, i, j, q[j] AS p FROM (SELECT *, unnest(range(1, len(q) + 1)) AS j FROM (SELECT *, string_split(s, {lf} || {lf}) AS q FROM section WHERE NOT small))
), cut AS (
  SELECT doc_id, i, j, 0 AS k, '' AS piece, p AS rest FROM paragraph WHERE regexp_matches(p, '[^{_SPACE}]')
  UNION ALL
  SELECT doc_id, i, j, k + 1, CASE WHEN length(rest) <= {limit} THEN rest ELSE {_right_off('left(rest, m)')} END, CASE WHEN length(rest) <= {limit} THEN '' ELSE {_left_off('substr(rest, m + 1)')} END
  FROM (SELECT *, {cut} AS m FROM cut WHERE rest <> '')
), part AS MATERIALIZED (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j, k) AS n, piece, led AND (lag(i) OVER (PARTITION BY doc_id ORDER BY i, j, k) IS DISTINCT FROM i) AND (NOT small OR NOT coalesce(before, false)) AS fresh, NOT small AS lead
  FROM (
    SELECT c.doc_id, i, j, k, piece, led, small, before FROM cut c JOIN (SELECT doc_id, i, led, small, lag(small) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM section) USING (doc_id, i) WHERE regexp_matches(piece, '[^{_SPACE}]')
    UNION ALL
    SELECT doc_id, i, 0, 0, s, led, small, lag(small) OVER (PARTITION BY doc_id ORDER BY i) FROM section QUALIFY small
  )
), pack AS (
  SELECT DISTINCT doc_id, 0::BIGINT AS n, NULL::VARCHAR AS done, '' AS now FROM part
  UNION ALL
  SELECT doc_id, n, done, CASE WHEN opened = '' THEN piece ELSE opened || {lf} || {lf} || piece END
  FROM (
    SELECT *, CASE WHEN NOT is_full THEN now WHEN fresh OR NOT lead THEN '' WHEN length(now) <= {overlap} THEN now
      {_after(f'{lf} || {lf}', 2)} {_after(lf, 1)} {_after("' '", 1)} ELSE tail END AS opened, CASE WHEN is_full THEN now END AS done
    FROM (
      SELECT p.doc_id, t.n, p.now, t.piece, t.fresh, t.lead, right(p.now, {overlap}) AS tail, p.now <> '' AND (t.fresh OR length(p.now) + 2 + length(t.piece) > {size}) AS is_full
      FROM pack p JOIN part t ON t.doc_id = p.doc_id AND t.n = p.n + 1
    )
  )
), chunks AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n, last) - 1)::INT AS chunk_no, chunk FROM (
    SELECT doc_id, n, false AS last, done AS chunk FROM pack WHERE done IS NOT NULL
    UNION ALL (SELECT doc_id, n, true, now FROM pack QUALIFY n = max(n) OVER (PARTITION BY doc_id) AND now <> '')
  )
)"""


_FRAMING = "list_filter(c, lambda x: " + " OR ".join(f"contains(lower(left(x, 400)), '{w}')" for w in FRAMING_WORDS) + ")"
_ELISION = "replace('" + ELISION.replace("\n", "|") + "', '|', chr(10))"

SQL = {
    "q22_chunks_small": f"{chunks(1000, 100)} SELECT * FROM chunks",
    "q23_framing_chunks": f"""{chunks(1000, 100)}, listed_chunks AS (SELECT doc_id, list(chunk ORDER BY chunk_no) AS c FROM chunks GROUP BY 1),
used AS (SELECT doc_id, len({_FRAMING}) AS n_framing, CASE WHEN len({_FRAMING}) > 0 THEN {_FRAMING} ELSE c END AS u FROM listed_chunks)
SELECT doc_id, n_framing::INT AS n_framing, left(CASE WHEN len(u) > 1 THEN u[1] || {_ELISION} || u[-1] ELSE u[1] END, 12000) AS framing FROM used""",
}
