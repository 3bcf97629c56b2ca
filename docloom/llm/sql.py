"""SQL for the queries that SQL can express over the whole tables. The others are tested against brute force in tests/llm."""

_KEYS = r"""
lines AS (
  SELECT DISTINCT book_id, page_number, line_no, lower(regexp_replace(line, '[^\p{L}]+', '', 'g')) AS k
  FROM (SELECT book_id, page_number, unnest(string_split(full_content, chr(10))) AS line,
               unnest(range(0, len(string_split(full_content, chr(10))))) AS line_no
        FROM (SELECT DISTINCT book_id, page_number, full_content FROM page WHERE full_content IS NOT NULL))),
totals AS (SELECT book_id, count(DISTINCT page_number) AS total FROM page WHERE full_content IS NOT NULL GROUP BY book_id),
keys AS (
  SELECT book_id, k FROM lines JOIN totals USING (book_id) WHERE length(k) >= 3
  GROUP BY book_id, k HAVING count(DISTINCT page_number) >= 5 AND count(DISTINCT page_number) >= 0.15 * max(total))
"""

SQL = {
    "p2_found": r"""
SELECT DISTINCT chunk_id FROM chunk
WHERE length(regexp_replace(regexp_replace(content, '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '')) > 1500
""",
    "p6_found": f"""
WITH {_KEYS}
SELECT DISTINCT book_id, page_number, CAST(line_no AS INTEGER) AS line_no FROM lines JOIN keys USING (book_id, k)
""",
    "p6_pages": rf"""
WITH {_KEYS},
full_lines AS (SELECT book_id, page_number, unnest(string_split(full_content, chr(10))) AS line, unnest(range(0, len(string_split(full_content, chr(10))))) AS line_no
  FROM (SELECT DISTINCT book_id, page_number, full_content FROM page WHERE full_content IS NOT NULL)),
marked AS (SELECT f.*, keys.k FROM full_lines f LEFT JOIN keys ON keys.book_id = f.book_id AND keys.k = lower(regexp_replace(line, '[^\p{{L}}]+', '', 'g')))
SELECT book_id, page_number, coalesce(string_agg(CASE WHEN k IS NULL THEN line END, chr(10) ORDER BY line_no), '') AS clean_text, count(k) AS n_removed FROM marked GROUP BY book_id, page_number
""",
    "p6_documents": r"""
WITH d AS (SELECT source, text, CAST(fetched_at AS DATE) AS day FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
l AS (SELECT DISTINCT source, text, lower(regexp_replace(line, '[^\p{L}]+', '', 'g')) AS line FROM (SELECT DISTINCT source, text, unnest(string_split(text, chr(10))) AS line FROM d)),
t AS (SELECT source, count(DISTINCT text) AS total FROM d GROUP BY source),
f AS (SELECT source, line, count(DISTINCT text) AS n FROM l WHERE length(line) >= 3 GROUP BY ALL),
c AS (SELECT f.*, total FROM f JOIN t USING (source) WHERE n >= 3 AND n >= 0.005 * total),
y AS (SELECT source, line, count(DISTINCT day) AS n_dates FROM c JOIN l USING (source, line) JOIN d USING (source, text) GROUP BY ALL)
SELECT source, line, n, n_dates, CAST(total AS BIGINT) AS total FROM c JOIN y USING (source, line) WHERE n_dates >= 2
""",
    "p8_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_item WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS s FROM d WHERE len(w) >= 12)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS s FROM i WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
""",
}
