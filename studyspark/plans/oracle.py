"""DuckDB SQL for the registered queries, written from the semantics and not from the plans."""

from __future__ import annotations

_ATTEMPTS = """
attempts AS (
  SELECT user_id AS paper, event_type AS question, user_id::VARCHAR || '::' || event_type AS key,
         event_id AS seq, ts AS "at", regexp_extract(props, '"k":\\s*(\\d+)', 1)::BIGINT % 3 <> 0 AS correct
  FROM events
), latest AS (
  SELECT key, any_value(paper) AS paper, any_value(question) AS question, min(seq) AS first_seq,
         arg_max(correct, seq) AS correct, arg_max("at", seq) AS last_at, count(*) AS attempts,
         count(*) FILTER (WHERE NOT correct) AS misses
  FROM attempts GROUP BY key
), now AS (SELECT max(ts)::DATE AS today FROM events)"""

_DAYS = (
    _ATTEMPTS
    + """, reads AS (
  SELECT user_id AS paper, arg_max(ts, event_id) AS read_at, max(event_id) AS seq FROM events WHERE event_type = 'view' GROUP BY 1
), read_days AS (
  SELECT read_at::DATE AS day, string_agg('Paper ' || paper, '; ' ORDER BY seq) AS read, count(*) AS n_read FROM reads GROUP BY 1
), answer_days AS (
  SELECT "at"::DATE AS day, count(*) AS answered, count(*) FILTER (WHERE correct) AS correct FROM attempts GROUP BY 1
), days AS (
  SELECT day, coalesce(read, '') AS read, coalesce(n_read, 0) AS n_read, coalesce(answered, 0) AS answered, coalesce(correct, 0) AS correct
  FROM read_days FULL JOIN answer_days USING (day)
)"""
)

_SHELF = (
    _DAYS
    + """, questions AS (
  SELECT DISTINCT paper, question, key FROM attempts
  UNION ALL SELECT DISTINCT paper, 'untried', paper::VARCHAR || '::untried' FROM attempts
), counts AS (
  SELECT q.paper, count(*) AS total, count(l.key) AS seen, count(*) FILTER (WHERE l.correct) AS correct,
         count(*) FILTER (WHERE NOT l.correct) AS review, max(l.last_at) AS last_studied
  FROM questions q LEFT JOIN latest l USING (key) GROUP BY 1
), shelf AS (
  SELECT c.*, 'Paper ' || c.paper AS title, r.read_at,
    CASE WHEN review > 0 THEN review || ' to review' WHEN read_at IS NOT NULL THEN 'Read'
         WHEN seen > 0 THEN correct || '/' || seen || ' right' ELSE 'Unread' END AS status,
    CASE WHEN paper % 2 = 0 THEN 'pdf' WHEN paper % 3 = 0 THEN 'article' END AS reader_kind
  FROM counts c LEFT JOIN reads r USING (paper)
)"""
)

_LEVEL = "CASE WHEN n_read * 2 + (answered > 0)::INT = 0 THEN 0 WHEN n_read * 2 + (answered > 0)::INT <= 1 THEN 1 WHEN n_read * 2 + (answered > 0)::INT <= 3 THEN 2 WHEN n_read * 2 + (answered > 0)::INT <= 6 THEN 3 ELSE 4 END"

_NORM = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def _norm(x: str) -> str:
    return _NORM.format(x)


_PAIRS = f"""
d AS (SELECT doc_id, {_norm('text')} AS norm FROM documents),
q AS (SELECT item_id, {_norm('text')} AS quote, length({_norm('text')}) AS n FROM benchmark),
pairs AS (
  SELECT doc_id, item_id FROM d, q
  WHERE n >= 25 AND (contains(norm, quote) OR len(list_filter(range(1, n - (4 * n + 4) // 5 + 2), lambda i: contains(norm, substr(quote, i, (4 * n + 4) // 5)))) > 0)
)"""

_NAMES = """
names AS (
  SELECT doc_id AS seq, 'doc' || doc_id || CASE lang WHEN 'en' THEN '.PDF' WHEN 'fr' THEN '.html' WHEN 'de' THEN '.htm' ELSE '.txt' END AS name FROM documents
)"""

_CANDIDATES = """
c AS (
  SELECT conv_id AS doc_id, turn::INT AS cand_id,
         ['evidence', 'evidence', 'overview', 'approach', 'critique', 'odd'][length(text) % 6 + 1] AS type
  FROM conversations
)"""

_WORDS = """
boxes AS (
  SELECT l_suppkey AS page, CASE WHEN l_partkey % 7 = 0 THEN 250.0 WHEN l_quantity <= 25 THEN l_quantity * 10 ELSE l_quantity * 10 + 60 END::DOUBLE AS x0,
         (l_partkey % 60) * 12.5::DOUBLE AS top, 'w' || l_orderkey || '_' || l_linenumber AS text
  FROM lineitem
), words AS (
  SELECT b.page, x0, x0 + CASE WHEN x0 = 250 THEN 100 ELSE 20 END AS x1, top, top + 10 AS bottom, text, round_even(top, 0)::BIGINT AS r
  FROM boxes b JOIN supplier ON page = s_suppkey
), by_row AS (
  SELECT page, x, r, bool_or(x0 < x + 4 AND x1 > x - 4) AS c, bool_or(x1 <= x) AS l, bool_or(x0 >= x) AS rr
  FROM words, range(244, 368) t(x) GROUP BY ALL
), by_x AS (
  SELECT page, x, count(*) AS n, count(*) FILTER (WHERE c) AS crossing, count(*) FILTER (WHERE l) AS lefts, count(*) FILTER (WHERE rr) AS rights
  FROM by_row GROUP BY ALL
), best AS (
  SELECT *, row_number() OVER (PARTITION BY page ORDER BY crossing, x) AS k FROM by_x
), gutters AS (
  SELECT page, x::INT AS gutter FROM best
  WHERE k = 1 AND n >= 10 AND crossing <= 0.25 * n AND least(lefts, rights) >= 0.25 * n
)"""

SQL: dict[str, str] = {
    "q01_attempts_flat": f"WITH {_ATTEMPTS} SELECT * FROM attempts",
    "q02_latest_attempt": f"WITH {_ATTEMPTS} SELECT key, correct, last_at, attempts, misses FROM latest",
    "q03_review_pile": f"WITH {_ATTEMPTS} SELECT key, paper, question, last_at, first_seq FROM latest WHERE NOT correct",
    "q04_needs_review_flags": f"""WITH {_SHELF}
SELECT q.key, coalesce(l.attempts, 0) AS attempts, coalesce(NOT l.correct, false) AS needs_review, l.last_at AS last_seen FROM questions q LEFT JOIN latest l USING (key)""",
    "q05_daily_rollup": f"WITH {_DAYS} SELECT day, answered, correct FROM answer_days",
    "q06_reading_days": f"WITH {_DAYS} SELECT day, read, answered, correct FROM days, now WHERE day >= today - 182",
    "q07_sticking_points": f"WITH {_ATTEMPTS} SELECT question, 'Paper ' || paper AS paper, misses FROM latest WHERE NOT correct ORDER BY misses DESC, question, 'Paper ' || paper LIMIT 8",
    "q08_overall_stats": f"""WITH {_ATTEMPTS}, a AS (SELECT count(*) AS answered, count(*) FILTER (WHERE correct) AS correct FROM attempts)
SELECT answered, correct, (SELECT count(*) FROM latest WHERE NOT correct) AS review_pile, CASE WHEN answered > 0 THEN floor(correct * 100 / answered + 0.5) ELSE 0 END::INT AS accuracy FROM a""",
    "q09_paper_counts": f"WITH {_SHELF} SELECT * FROM counts",
    "q10_suggest_paper": f"""WITH {_SHELF}, t AS (
  SELECT *, CASE WHEN total > 0 AND seen = 0 THEN 0 WHEN total = 0 AND read_at IS NULL THEN 1 WHEN total > 0 THEN 2 ELSE 3 END AS tier FROM shelf
) SELECT paper, tier FROM t ORDER BY tier, CASE WHEN tier < 2 THEN md5(paper || '7') END NULLS FIRST, last_studied NULLS FIRST, paper LIMIT 1""",
    "q97_suggest_another": f"""WITH {_SHELF}, t AS (
  SELECT *, CASE WHEN total > 0 AND seen = 0 THEN 0 WHEN total = 0 AND read_at IS NULL THEN 1 WHEN total > 0 THEN 2 ELSE 3 END AS tier FROM shelf
) SELECT paper, tier FROM t ORDER BY tier, CASE WHEN tier < 2 THEN md5(paper || '7') END NULLS FIRST, last_studied NULLS FIRST, paper LIMIT 1 OFFSET 1""",
    "q11_streak_length": f"""WITH {_DAYS}, active AS (
  SELECT day, day - row_number() OVER (ORDER BY day)::INT AS island FROM (SELECT DISTINCT day FROM days WHERE n_read > 0 OR answered > 0)
), runs AS (SELECT island, count(*) AS n, max(day) AS last FROM active GROUP BY 1)
SELECT coalesce(arg_max(n, last), 0) AS streak FROM runs, now WHERE last >= today - 1""",
    "q12_calendar_heatmap": f"""WITH {_DAYS}, span AS (
  SELECT unnest(generate_series(today - 181 - extract(dow FROM today - 181)::INT, today, INTERVAL 1 DAY))::DATE AS day FROM now
), c AS (
  SELECT day, coalesce(n_read, 0)::INT AS n_read, coalesce(answered, 0) AS answered FROM span LEFT JOIN days USING (day)
) SELECT day, n_read, answered, {_LEVEL} AS level, CASE WHEN day < today THEN 'past' WHEN day = today THEN 'today' ELSE 'future' END AS "when" FROM c, now""",
    "q13_status_tags": f"WITH {_SHELF} SELECT paper, status, reader_kind FROM shelf",
    "q14_last_ten_days": f"""WITH {_DAYS}, t AS (SELECT day, answered, correct FROM days, now WHERE answered > 0 AND day >= today - 182 ORDER BY day DESC LIMIT 10)
SELECT *, greatest(1, max(answered) OVER ()) AS scale FROM t""",
    "q15_question_keys": f"SELECT conv_id, turn, conv_id || '::' || substr(sha1({_norm('text')}), 1, 12) AS key FROM conversations",
    "q16_normalized_text": f"SELECT doc_id, {_norm('text')} AS norm FROM documents",
    "q17_needs_ocr_docs": "SELECT doc_id, length(regexp_replace(text, '[\\s\\p{Z}\\x{85}]+', '', 'g')) < 25 AS needs_ocr FROM documents",
    "q18_dot_leaders_stripped": "SELECT doc_id, regexp_replace('Contents . . . . . ' || doc_id || ' .....' || chr(10) || text, '[ \\t]*(?:\\.[ \\t]*){4,}', ' ', 'g') AS text FROM documents",
    "q19_benchmark_quote_match": f"WITH {_PAIRS} SELECT * FROM pairs",
    "q20_quote_pages": f"""WITH h AS (SELECT doc_id, text, length(text) // 2 AS half FROM documents), p AS (
  SELECT doc_id, {_norm('substr(text, 1, half)')} AS p3, {_norm('substr(text, half + 1)')} AS p4, substr({_norm('substr(text, half + 1, 90)')}, 1, 40) AS head FROM h
) SELECT doc_id, CASE WHEN head = '' THEN NULL WHEN contains(p3, head) THEN 3 WHEN contains(p4, head) THEN 4 END::INT AS page FROM p""",
    "q21_doc_fingerprint_dups": "SELECT substr(sha1(text), 1, 16) AS fingerprint, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
    "q26_canonical_sources": r"""WITH u AS (
  SELECT page_id, url FROM pages
  UNION ALL SELECT page_id, 'https://www.biorxiv.org/content/10.1101/' || page_id || 'v1.full.pdf' FROM pages
  UNION ALL SELECT page_id, 'https://arxiv.org/abs/2401.' || page_id FROM pages
  UNION ALL SELECT page_id, 'https://arxiv.org/pdf/2401.' || page_id || '.pdf' FROM pages
  UNION ALL SELECT page_id, 'https://example.org/a/' || page_id || '?q=1' FROM pages
)
SELECT page_id, url,
  CASE WHEN contains(url, '//www.biorxiv.org/') THEN regexp_replace(url, '\.full\.pdf$', '.full')
       WHEN contains(url, '//arxiv.org/') THEN 'https://arxiv.org/html/2401.' || page_id ELSE url END AS text_url,
  CASE WHEN contains(url, '//www.biorxiv.org/') THEN url WHEN contains(url, '//arxiv.org/') THEN 'https://arxiv.org/pdf/2401.' || page_id END AS pdf_url
FROM u""",
    "q27_qa_pairs": """WITH n AS (
  SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations
) SELECT conv_id, turn, text AS question, answer FROM n WHERE role = 'user' AND next = 'assistant'""",
    "q28_level_selection": f"""WITH {_CANDIDATES}, r AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cand_id) AS rank, row_number() OVER (PARTITION BY doc_id, type ORDER BY cand_id) AS nth FROM c
), p AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (type <> 'odd' AND nth <= 1) DESC, rank) <= 4 AS picked FROM r
) SELECT doc_id, cand_id, picked, row_number() OVER (PARTITION BY doc_id ORDER BY picked DESC,
    CASE WHEN picked THEN CASE type WHEN 'overview' THEN 0 WHEN 'approach' THEN 1 WHEN 'evidence' THEN 2 WHEN 'critique' THEN 3 ELSE 4 END END, rank)::INT AS place FROM p""",
    "q29_verification_rules": """WITH d AS (
  SELECT doc_id, doc_id % 10 AS k, length(regexp_replace(lower(substr(coalesce(text, ''), 101, 60)), '[^\\p{L}\\p{N}]', '', 'g')) >= 25 AS one,
    length(regexp_replace(lower(substr(coalesce(text, ''), 201, 60)), '[^\\p{L}\\p{N}]', '', 'g')) >= 25 AS two FROM documents
), q AS (SELECT *, k NOT IN (0, 3, 4) AND one AS own, (k = 0 AND one) OR (k = 3 AND two) AS blind FROM d), w AS (
  SELECT *, CASE WHEN k IN (5, 6) THEN 'not answerab' WHEN NOT own AND NOT blind THEN 'no quote fou' WHEN k = 7 THEN 'false premis' WHEN k = 8 THEN 'answer not s'
    WHEN k = 2 THEN 'disagree: r' WHEN k = 9 THEN 'None: r' END AS fail FROM q
) SELECT doc_id, fail IS NULL AS passed, CASE WHEN fail IS NULL AND NOT own THEN 'two paths' ELSE 'the answer' END AS answer, coalesce(fail, CASE WHEN k = 3 THEN 'partial: r' ELSE 'agree: r' END) AS why FROM w""",
    "q30_gutter_detection": f"WITH {_WORDS} SELECT * FROM gutters",
    "q31_band_merge": """WITH i AS (SELECT l_suppkey, l_partkey * 5::DOUBLE AS top, l_partkey * 5 + l_quantity AS bottom FROM lineitem), b AS (
  SELECT *, max(bottom) OVER (PARTITION BY l_suppkey ORDER BY top, bottom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i
), n AS (
  SELECT *, sum(CASE WHEN before IS NULL OR top > before + 4 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY top, bottom ROWS UNBOUNDED PRECEDING)::BIGINT AS band FROM b
) SELECT l_suppkey, band, min(top) AS top, max(bottom) AS bottom FROM n GROUP BY ALL""",
    "q32_inbox_antijoin": f"""WITH {_NAMES}, s AS (SELECT name, regexp_replace(name, '\\.[^.]+$', '') AS stem FROM names WHERE regexp_matches(name, '(?i)\\.(pdf|html|htm)$'))
SELECT name, stem FROM s WHERE stem NOT IN (SELECT 'doc' || doc_id FROM labels WHERE doc_id IS NOT NULL)""",
    "q33_library_search": f"WITH {_SHELF} SELECT paper, title, review FROM shelf WHERE contains(lower(title), 'paper 1') AND review > 0",
    "q34_log_progress": """WITH l AS (
  SELECT user_id AS run, event_id AS line_no,
    CASE event_type WHEN 'view' THEN 'paper' WHEN 'click' THEN 'dropped' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'section' END AS kind FROM events
), p AS (SELECT *, sum((kind IS NOT DISTINCT FROM 'paper')::INT) OVER (PARTITION BY run ORDER BY line_no)::BIGINT AS paper_no FROM l)
SELECT run, line_no, kind, paper_no, sum((kind IS NOT DISTINCT FROM 'dropped')::INT) OVER (PARTITION BY run, paper_no ORDER BY line_no)::BIGINT AS dropped,
  sum((kind IS NOT DISTINCT FROM 'done')::INT) OVER (PARTITION BY run ORDER BY line_no)::BIGINT AS done, CASE kind WHEN 'section' THEN 0.3 WHEN 'done' THEN 1.0 END::DOUBLE AS fraction FROM p""",
    "q35_loose_highlight": f"""WITH {_PAIRS}, w AS (
  SELECT p.doc_id, p.item_id, d2.text, b.text AS quote, regexp_extract_all(b.text, '[\\p{{L}}\\p{{N}}]+') AS words,
    list_filter(list_transform(string_split_regex(regexp_replace(b.text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_extract_all(s, '[\\p{{L}}\\p{{N}}]+')), lambda s: len(s) >= 5) AS sentences
  FROM pairs p JOIN documents d2 USING (doc_id) JOIN benchmark b USING (item_id)
) SELECT doc_id, item_id, CASE WHEN len(words) = 0 THEN 'none' WHEN regexp_matches(text, '(?i)' || array_to_string(words, '[^\\p{{L}}\\p{{N}}]+')) THEN 'whole'
    WHEN len(list_filter(sentences, lambda s: regexp_matches(text, '(?i)' || array_to_string(s, '[^\\p{{L}}\\p{{N}}]+')))) > 0 THEN 'sentence'
    WHEN len(words) > 10 AND regexp_matches(text, '(?i)' || array_to_string(words[1:10], '[^\\p{{L}}\\p{{N}}]+')) THEN 'opening' ELSE 'none' END AS level FROM w""",
    "q36_week_totals": f"""WITH {_DAYS}, span AS (SELECT unnest(generate_series(date_trunc('week', today), date_trunc('week', today) + INTERVAL 6 DAY, INTERVAL 1 DAY))::DATE AS day FROM now)
SELECT sum(coalesce(n_read, 0))::BIGINT AS reads, sum(coalesce(answered, 0))::BIGINT AS answered, count(*) FILTER (WHERE day > today) AS to_come FROM span LEFT JOIN days USING (day), now""",
    "q37_review_items": f"WITH {_ATTEMPTS} SELECT key, paper, question, last_at FROM latest WHERE NOT correct AND question <> 'click'",
    "q38_marked_reads": """WITH m AS (SELECT user_id AS paper, arg_max(event_type, event_id) AS t, arg_max(ts, event_id) AS read_at FROM events WHERE event_type IN ('view', 'click') GROUP BY 1)
SELECT paper, read_at FROM m WHERE t = 'view'""",
    "q39_recent_four": f"WITH {_SHELF} SELECT paper, title, last_studied FROM shelf WHERE last_studied IS NOT NULL ORDER BY paper DESC LIMIT 4",
    "q40_library_totals": f"WITH {_SHELF} SELECT count(*) AS papers, count(*) FILTER (WHERE seen > 0) AS papers_studied, sum(total)::BIGINT AS questions, count(read_at) AS papers_read FROM shelf",
    "q41_model_list": """WITH s AS (SELECT 'model' || n_nationkey AS name FROM nation), i AS (SELECT DISTINCT 'model' || (s_nationkey + 5) AS name FROM supplier)
SELECT coalesce(s.name, i.name) AS name, s.name IS NOT NULL AS suggested, i.name IS NOT NULL AS installed FROM s FULL JOIN i ON s.name = i.name""",
    "q42_previews": """SELECT doc_id, CASE WHEN length(text) <= 300 THEN text
  WHEN contains(substr(text, 1, 300), ' ') THEN regexp_extract(substr(text, 1, 300), '(?s)^(.*) [^ ]*$', 1) || '…' ELSE substr(text, 1, 300) || '…' END AS preview FROM documents""",
    "q43_clean_quotes": "SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS quote FROM benchmark",
    "q45_url_gates": """SELECT doc_id, lang = 'en' AS is_web, CASE WHEN length(text) < 1000 THEN 'needs_render' WHEN length(text) < 6000 AND length(text) % 2 = 0 THEN 'use_pdf' ELSE 'keep' END AS action FROM documents""",
    "q46_reader_pages": """WITH e AS (SELECT item_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS body FROM benchmark)
SELECT item_id, '<!doctype html><html><head><meta charset="utf-8"><title>A &amp; &quot;B&quot;</title></head><body><h1>A &amp; &quot;B&quot;</h1><p><a href="https://example.org/?a=1&amp;b=2">https://example.org/?a=1&amp;b=2</a></p><h2>Part &lt;one&gt;</h2><p>' || body || '</p></body></html>' AS html FROM e""",
    "q47_tail_sections": """WITH f AS (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM documents)
SELECT doc_id, '## Intro' || chr(10) || chr(10) || substr(text, 1, length(text) // 3) || chr(10) || chr(10) || '## Appendix A' || chr(10) || chr(10) || substr(text, 2 * (length(text) // 3) + 1) AS text FROM f""",
    "q48_question_files": """WITH r AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line FROM conversations)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS pos, ['overview', 'approach', 'evidence', 'critique', ''][turn % 5 + 1] AS type,
  'Why ' || turn AS question, trim('Since ' || line) AS answer, CASE WHEN turn % 2 = 0 THEN 'e' || turn ELSE '' END AS evidence,
  CASE WHEN turn % 4 = 0 THEN turn + 1 END::INT AS page FROM r""",
    "q49_notes_and_titles": """SELECT doc_id, 'new ' || lang AS notes, source AS title,
  (length('# Study Questions: ' || source) + 2 + length('## Q1') + 1 + length('A?') + 2 + length('**Answer:** b') + 2 + length('## Notes') + 1 + length('new ' || lang) + 1)::INT AS n FROM documents""",
    "q50_model_replies": "SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant') THEN 1 ELSE 0 END::INT AS n, CASE WHEN role IN ('user', 'assistant') THEN 'overview' END AS type, CASE WHEN role IN ('user', 'assistant') THEN 'why ' || turn END AS question FROM conversations",
    "q51_rank_candidates": f"""WITH {_CANDIDATES}, m AS (SELECT doc_id, max(cand_id) AS m FROM c GROUP BY 1), p AS (
  SELECT c.*, CASE WHEN c.doc_id % 5 = 0 THEN cand_id WHEN cand_id = m THEN 0 WHEN cand_id = 0 THEN 1 WHEN cand_id = 1 THEN 4 END AS pos FROM c JOIN m USING (doc_id)
) SELECT doc_id, cand_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INT AS rank FROM p WHERE pos IS NOT NULL""",
    "q52_distinct_evidence": f"""WITH p AS (SELECT conv_id AS doc_id, turn AS place, {_norm('text')} AS e FROM conversations WHERE role <> 'system'), f AS (
  SELECT doc_id, e, min(place) AS place FROM p GROUP BY ALL
), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS n FROM f) SELECT doc_id, place FROM k WHERE n <= 3""",
    "q53_words_in_regions": f"""WITH {_WORDS}, two AS (SELECT w.*, gutter FROM words w JOIN gutters g USING (page)), across AS (
  SELECT DISTINCT page, top, bottom FROM two WHERE x0 < gutter AND gutter < x1
), marked AS (
  SELECT *, max(bottom) OVER (PARTITION BY page ORDER BY top, bottom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM across
), numbered AS (
  SELECT *, sum(CASE WHEN before IS NULL OR top > before + 4 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY top, bottom ROWS UNBOUNDED PRECEDING) AS band FROM marked
), bands AS (
  SELECT page, min(top) AS top, max(bottom) AS bottom FROM numbered GROUP BY page, band
  UNION ALL SELECT page, 800.0, 800.0 FROM gutters
), stacked AS (
  SELECT b.*, gutter, coalesce(lag(bottom) OVER (PARTITION BY page ORDER BY top, bottom), 0) AS y, row_number() OVER (PARTITION BY page ORDER BY top, bottom) AS n FROM bands b JOIN gutters USING (page)
), areas AS (
  SELECT page, n * 3 AS place, 0 AS ax0, y AS ay0, gutter AS ax1, top AS ay1 FROM stacked
  UNION ALL SELECT page, n * 3 + 1, gutter, y, 612, top FROM stacked
  UNION ALL SELECT page, n * 3 + 2, 0, top, 612, bottom FROM stacked
) SELECT w.page, w.text, place::INT AS place FROM words w JOIN areas a ON w.page = a.page AND (x0 + x1) / 2 >= ax0 AND (x0 + x1) / 2 < ax1 AND (top + bottom) / 2 >= ay0 AND (top + bottom) / 2 < ay1""",
    "q54_page_assembly": """WITH p AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)
SELECT conv_id AS doc_id, CASE WHEN bool_or(trim(t) <> '') THEN string_agg('--- Page ' || turn || ' ---' || chr(10) || t, chr(10) || chr(10) ORDER BY turn) ELSE '' END AS text FROM p GROUP BY 1""",
    "q55_page_counters": """SELECT source, count(*) FILTER (WHERE lang = 'de') AS fallback, count(*) FILTER (WHERE length(regexp_replace(text, '[\\s\\p{Z}\\x{85}]+', '', 'g')) < 25) AS ocr,
  count(*) FILTER (WHERE trim(coalesce(text, '')) = '') AS skipped FROM documents GROUP BY 1""",
    "q56_words_from_chars": """WITH c AS (
  SELECT l_orderkey::DOUBLE AS top, l_linenumber * 6.0::DOUBLE + CASE WHEN l_linenumber > 3 THEN 2 ELSE 0 END AS x0, substr(l_returnflag, 1, 1) AS c FROM lineitem WHERE l_partkey % 7 <> 0
), g AS (
  SELECT *, CASE WHEN x0 - lag(x0 + 6) OVER o > 1.5 OR lag(x0) OVER o IS NULL THEN 1 ELSE 0 END AS fresh FROM c WINDOW o AS (PARTITION BY top ORDER BY x0)
), n AS (SELECT *, sum(fresh) OVER (PARTITION BY top ORDER BY x0) AS w FROM g)
SELECT top, min(x0) AS x0, max(x0 + 6) AS x1, string_agg(c, '' ORDER BY x0, c) AS text FROM n GROUP BY top, w""",
    "q57_add_papers": f"""WITH {_NAMES}, o AS (SELECT name, seq * 2 AS seq, true AS f FROM names UNION ALL SELECT name, seq * 2 + 1, seq % 2 = 0 FROM names), r AS (
  SELECT *, regexp_matches(name, '(?i)\\.pdf$') AND f AS ok FROM o
), n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ok DESC, seq) AS k FROM r)
SELECT seq, name, CASE WHEN NOT ok THEN 'not a PDF' WHEN name IN (SELECT name FROM names WHERE seq % 3 = 0) THEN 'already in the inbox'
  WHEN name IN (SELECT 'doc' || doc_id || '.PDF' FROM labels WHERE doc_id IS NOT NULL) THEN 'already processed' WHEN k > 1 THEN 'already in the inbox' END AS why FROM n""",
    "q58_removable_names": f"""WITH {_NAMES} SELECT CASE seq % 4 WHEN 1 THEN '../' || name WHEN 2 THEN '/tmp/' || name ELSE name END AS name, regexp_matches(name, '(?i)\\.(pdf|html|htm)$') AND seq % 4 NOT IN (1, 2) AS ok FROM names""",
    "q59_distinct_jobs": "SELECT user_id || '-' || event_type AS key, min(event_id) AS seq FROM events GROUP BY 1",
    "q60_setting_values": "SELECT event_id, event_id::INT AS ac, NULL::INT AS dc FROM events",
    "q61_small_scalars": """SELECT o_orderkey, greatest(0.1, floor(o_orderkey * 12345 / 1e5 + 0.5) / 10)::DOUBLE AS mb,
  CASE WHEN o_orderkey % 7 > 0 THEN floor((o_orderkey % 100) * 100 / (o_orderkey % 7) + 0.5) ELSE 0 END::INT AS pct,
  (o_orderkey % 3) || ' paper' || CASE WHEN o_orderkey % 3 = 1 THEN '' ELSE 's' END AS label, '&lt;' || o_orderstatus || '&amp;&gt;' AS safe FROM orders""",
    "x1_stream_daily": f"WITH {_DAYS} SELECT day, answered, correct FROM answer_days",
    "x2_stream_sessions": """WITH g AS (
  SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events
), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS events FROM s GROUP BY user_id, n""",
}

_PAGED = """paged AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page,
    CASE WHEN turn % 4 = 1 THEN '!' ELSE '' END || CASE WHEN turn % 3 = 2 THEN '' ELSE translate(coalesce(text, ''), chr(12) || chr(13), '  ') END AS p
  FROM conversations
)"""
_FILE_NAMES = """n AS (
  SELECT doc_id, lang = 'en' AS pdf, 'doc' || doc_id || '.pdf' AS name, doc_id IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AS done FROM documents
)"""

SQL |= {
    "q70_attempts_appended": f"""WITH {_ATTEMPTS} SELECT paper, question, key, seq, "at", correct FROM attempts""",
    "q71_reads_appended": "SELECT user_id AS paper, arg_max(ts, event_id) AS read_at FROM events WHERE event_type = 'view' AND user_id % 3 <> 0 GROUP BY 1",
    "q72_question_upsert": """SELECT 'item' || item_id AS stem, CASE WHEN item_id % 2 = 0 THEN 'note of item' || item_id ELSE '' END AS notes,
  CASE WHEN item_id % 3 > 0 THEN 'New?' ELSE 'Old?' END AS question, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS answer FROM benchmark WHERE item_id % 2 = 0 OR item_id % 3 > 0""",
    "q73_files_written": "SELECT 'item' || item_id AS stem, text FROM benchmark",
    "q74_history_read": f"""WITH {_ATTEMPTS} SELECT key, paper::VARCHAR AS paper, question, "at", correct FROM attempts""",
    "q75_state_lines": "SELECT item_id, length(text)::INT AS n FROM benchmark WHERE item_id % 5 <> 0",
    "q76_log_lines": """SELECT date_trunc('second', ts) AS "at", event_type || ' ' || event_id AS message FROM events WHERE event_type <> 'click'""",
    "q77_pending_only": f"WITH {_FILE_NAMES} SELECT 'named' AS run, name FROM n WHERE pdf AND NOT done AND doc_id % 3 = 0 UNION ALL SELECT 'all', name FROM n WHERE pdf AND NOT done",
    "q78_shelved": f"WITH {_FILE_NAMES} SELECT DISTINCT 'doc' || doc_id AS stem FROM n WHERE NOT done",
    "q79_pasted_texts": """SELECT CASE WHEN doc_id % 2 = 0 THEN 'Text ' || doc_id ELSE 'Pasted article' END AS title, count(*) AS n, count(*) AS headed
FROM documents WHERE length(trim(text)) >= 500 GROUP BY 1""",
    "q80_pdf_magic": "SELECT page_id, (octet_length(encode(coalesce(html, ''))) + 9)::INT AS n_bytes FROM pages WHERE page_id % 3 = 0",
    "q81_fetch_retry": """SELECT url, [200, 404, 503, NULL][length(url) % 4 + 1]::INT AS status, CASE WHEN length(url) % 4 = 0 THEN url END AS body,
  [NULL, 'status 404', 'status 503', 'no route'][length(url) % 4 + 1] AS error FROM pages WHERE url IS NOT NULL""",
    "q82_models_installed": """WITH w AS (SELECT event_id, user_id, CASE WHEN user_id % 7 = 0 THEN 'big' WHEN user_id % 2 = 0 THEN 'm1' ELSE 'big:32b' END AS w FROM events)
SELECT event_id, CASE WHEN user_id % 5 <> 0 THEN w = 'big:32b' OR (w = 'm1' AND user_id % 3 = 1) END AS ok FROM w""",
    "q83_model_errors": """WITH m AS (
  SELECT [404, 500, 200][event_id % 3 + 1]::INT AS status, ['Model not found', 'timed out while loading', 'the reply would repeat', 'boom', 'timed out'][event_id % 5 + 1] AS message FROM events
) SELECT status, message, count(*) AS n, CASE WHEN status = 404 OR message LIKE '%not found%' THEN 'missing' WHEN message LIKE '%timed out%' AND message LIKE '%load%' THEN 'loading'
  WHEN message LIKE '%repeat%' THEN 'looped' WHEN status = 500 THEN 'crashed' ELSE 'other' END AS kind FROM m GROUP BY 1, 2""",
    "q84_page_reading": f"""WITH {_PAGED}, s AS (
  SELECT *, p[1] = '!' AS broken, length(regexp_replace(p, '[\\s\\p{{Z}}\\x{{85}}]+', '', 'g')) < 25 AS sparse FROM paged WHERE conv_id % 6 <> 5
) SELECT conv_id AS doc_id, page::INT AS page, CASE WHEN sparse AND page % 2 = 1 THEN 'read from the picture' ELSE p END AS text, broken AS fallback, sparse AND page % 2 = 1 AS ocr, false AS skipped,
  nullif(concat_ws('; ', CASE WHEN broken THEN 'RuntimeError' END, CASE WHEN sparse AND page % 2 = 0 THEN 'OCR: no picture' END), '') AS error FROM s
UNION ALL SELECT DISTINCT conv_id, 1, '', false, false, false, 'ValueError: not a PDF' FROM paged WHERE conv_id % 6 = 5""",
    "q85_page_counts": "SELECT conv_id AS doc_id, CASE WHEN conv_id % 6 <> 5 THEN count(*) END::INT AS pages, CASE WHEN conv_id % 6 = 5 THEN 'ValueError: not a PDF' END AS error FROM conversations GROUP BY conv_id",
    "q86_assembled_files": f"""WITH {_PAGED} SELECT conv_id AS doc_id, CASE WHEN conv_id % 6 <> 5 AND bool_or(trim(p) <> '')
  THEN string_agg('--- Page ' || page || ' ---' || chr(10) || p, chr(10) || chr(10) ORDER BY page) ELSE '' END AS text FROM paged GROUP BY conv_id""",
    "q87_replies_by_id": "SELECT conv_id, (turn % 3)::INT AS id, arg_max(text, turn) AS answer FROM conversations GROUP BY 1, 2",
    "q88_checks_ok": """WITH c AS (SELECT l_orderkey AS setup, 'c' || l_linenumber AS name, l_linenumber <> 7 AND l_partkey % 4 <> 0 AS ok FROM lineitem)
SELECT setup, bool_and(ok) AS ok, coalesce(string_agg(name, ', ' ORDER BY name) FILTER (WHERE NOT ok), '') AS failed FROM c GROUP BY 1""",
    "q89_graded_answers": """SELECT item_id AS id, CASE WHEN item_id % 3 = 0 THEN 'correct' ELSE 'partly' END AS verdict,
  CASE WHEN item_id % 3 = 0 THEN 'you said it' ELSE 'you missed it' END AS feedback, NULL::VARCHAR AS error FROM benchmark""",
    "q90_titles_found": f"""WITH l AS (SELECT item_id, text, split_part(trim(text), chr(10), 1) AS line FROM benchmark)
SELECT item_id AS doc_id, trim(regexp_replace(CASE WHEN item_id % 3 = 0 THEN substr(text, 1, 60) WHEN length({_norm('line')}) >= 8 THEN line END, '\\s+', ' ', 'g')) AS title FROM l""",
}

from .marking import SQL as _MARKS  # noqa: E402
from .oracle_chunks import SQL as _CHUNKS  # noqa: E402
from .streams import SQL as _STREAMS  # noqa: E402 - beside its queries

SQL |= _CHUNKS | _MARKS | _STREAMS
