"""SQL of the graph that several queries read."""

from __future__ import annotations

from docloom.operators import graph as G

from .documents import SENTENCES

MENTIONS = f"""{SENTENCES},
ms AS (SELECT chunk_id, book_id, coalesce(section_path[len(section_path)], '') AS section, pos, unnest(list_filter(regexp_extract_all(sentence, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '{G.ENTITY_PATTERN}'))) AS name FROM sq WHERE length(sentence) >= {G.LEAST_SENTENCE})"""
HIERARCHY = """hp AS (SELECT DISTINCT book_id, chunk_seq, section_path[1:3] AS path FROM chunk WHERE len(section_path) > 0),
hx AS (SELECT book_id, chunk_seq, path, unnest(range(0, len(path))) AS depth FROM hp),
hn AS (SELECT book_id, ['Chapter', 'Section', 'Subsection'][depth + 1] AS label, path[depth + 1] AS name, min(chunk_seq) AS first_seq FROM hx GROUP BY ALL)"""
