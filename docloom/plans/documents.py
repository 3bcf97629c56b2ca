"""Queries of the document model: lines, pages, sections, chunks, tables, propositions; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import chunking as C
from docloom.operators import propositions as P
from docloom.operators import tables as T
from docloom.session import read
from docloom.sources.corpus import markdown_lines


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown_lines(read(spark, sf_dir, "chunk"))


def lines_page_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of every line."""
    return C.with_page(_lines(spark, sf_dir)).select("book_id", "chunk_seq", "pos", "page")


def page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every page."""
    return C.pages_of(_lines(spark, sf_dir)).select("book_id", "page", "content")


def section_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with their level, title, pages and cleaned content."""
    return C.sections_of(_lines(spark, sf_dir)).select("book_id", "section_id", "level", "title", "start_page", "end_page", "content", "n_lines")


def section_breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of every section."""
    return C.section_paths(C.sections_of(_lines(spark, sf_dir))).select("book_id", "section_id", F.array_join("path", " > ").alias("path"))


def text_table_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of text and tables of every section."""
    return C.runs_of(C.sections_of(_lines(spark, sf_dir)))


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their numbers, ids and parents."""
    out = C.chunks_of(_lines(spark, sf_dir))
    return out.select("chunk_id", "book_id", "chunk_index", F.array_join("path", ">>").alias("path"), "type", "content", "parent_id", "start_page", "end_page")


def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by kind and book: markers, headers by level, table lines, separators."""
    rows = _lines(spark, sf_dir)
    kind = (
        F.when(X.page_marker("line").isNotNull(), "marker")
        .when(X.header_level("line").isNotNull(), F.concat(F.lit("header"), X.header_level("line").cast("string")))
        .when(X.is_separator_row("line"), "separator")
        .when(X.is_table_line("line"), "table")
        .otherwise("text")
    )
    return rows.groupBy("book_id", kind.alias("kind")).agg(F.count("*").alias("n_lines"))


def parse_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of every table chunk by header."""
    out = T.parsed_tables(read(spark, sf_dir, "chunk"))
    return out.select("chunk_id", F.posexplode("rows").alias("row_index", "cells"), "headers").select("chunk_id", "row_index", F.posexplode("headers").alias("col_index", "header"), "cells").select(
        "chunk_id", "row_index", "col_index", "header", F.coalesce(F.get("cells", F.col("col_index")), F.lit("")).alias("cell")
    )


def linearize_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table chunk as one text."""
    return T.linearized(T.parsed_tables(read(spark, sf_dir, "chunk"))).select("chunk_id", "linearized")


def row_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table row as a sentence."""
    return T.row_sentences(T.parsed_tables(read(spark, sf_dir, "chunk")))


def table_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table as a bullet list."""
    return T.bullets(T.parsed_tables(read(spark, sf_dir, "chunk"))).select("chunk_id", "bullets")


def pipe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table as an aligned Markdown table."""
    return T.pipe_tables(T.parsed_tables(read(spark, sf_dir, "chunk"))).select("chunk_id", "markdown")


def table_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables by pattern: spec or generic."""
    return T.parsed_tables(read(spark, sf_dir, "chunk")).groupBy("pattern").agg(F.count("*").alias("n_tables"))


def table_page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table chunks that cover each page."""
    return T.tables_of_pages(read(spark, sf_dir, "page"), read(spark, sf_dir, "chunk"))


def table_header_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each table chunk and each page it covers, the first table on the page whose headers match its own."""
    return T.header_matches(T.parsed_tables(read(spark, sf_dir, "chunk")))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of the text chunks by the reference model's rule."""
    return P.chunk_sentences(read(spark, sf_dir, "chunk")).select("chunk_id", "pos", "sentence")


def quality_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences kept and dropped by book."""
    rows = P.chunk_sentences(read(spark, sf_dir, "chunk")).withColumn("keep", X.is_quality_sentence("sentence"))
    return rows.groupBy("book_id").agg(F.count_if("keep").alias("n_kept"), F.count_if(~F.col("keep")).alias("n_dropped"))


def propositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered propositions of text and tables with their ids."""
    return P.propositions(read(spark, sf_dir, "chunk")).select("proposition_id", "book_id", "prop_index", "parent_chunk_id", "source_type", "text", F.coalesce("page", F.lit(0)).alias("page"))


def counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by type and propositions by source type."""
    chunks = read(spark, sf_dir, "chunk").groupBy(F.lit("chunk").alias("kind"), F.col("type")).agg(F.count("*").alias("n"))
    props = read(spark, sf_dir, "proposition").groupBy(F.lit("proposition").alias("kind"), F.col("source_type").alias("type")).agg(F.count("*").alias("n"))
    return chunks.unionByName(props)


def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text by which each chunk is embedded."""
    chunk = read(spark, sf_dir, "chunk").select("chunk_id", "type", "content", "linearized_text").distinct()
    text = F.when(F.col("type") == "text", X.strip("content")).otherwise(F.coalesce(F.nullif(X.strip("linearized_text"), F.lit("")), X.strip("content")))
    return chunk.select("chunk_id", text.alias("text")).where(F.length("text") >= 20)


QUERIES = {
    f.__name__: f
    for f in (
        lines_page_counter, page_split, section_sessions, section_breadcrumbs, text_table_runs, chunk_ids, line_kinds, parse_tables, linearize_tables, row_sentences, table_bullets, pipe_tables,
        table_patterns, table_page_lookup, table_header_match, sentences, quality_sentences, propositions, counts_by_type, embedding_texts,
    )
}

MARKER = r"^##\s*---\s*PAGE\s+([0-9]+)\s*---"
LINES = r"""
cc AS (SELECT DISTINCT book_id, chunk_seq, section_path, page_range.start AS start, content FROM chunk),
raw AS (
  SELECT book_id, chunk_seq, unnest(range(0, len(a))) AS pos, unnest(a) AS line FROM (
    SELECT book_id, chunk_seq, list_concat(list_concat(
      CASE WHEN start IS NULL THEN []::VARCHAR[] ELSE ['## --- PAGE ' || start || ' ---'] END,
      CASE WHEN coalesce(len(section_path), 0) < 1 THEN []::VARCHAR[] ELSE [repeat('#', least(3, len(section_path))::INT) || ' ' || section_path[len(section_path)]] END),
      CASE WHEN content IS NULL THEN []::VARCHAR[] ELSE string_split(content, chr(10)) END) AS a FROM cc)
  UNION ALL SELECT DISTINCT book_id, -1, 0, '# Text Extraction: ' || book_id FROM chunk),
lines AS (
  SELECT *, TRY_CAST(nullif(regexp_extract(line, '^##\s*---\s*PAGE\s+([0-9]+)\s*---', 1), '') AS INT) AS marker,
    CASE WHEN regexp_matches(line, '^(#{1,3})\s+(\S.*)$') AND NOT regexp_matches(line, '^##\s*---\s*PAGE\s+([0-9]+)\s*---') THEN length(regexp_extract(line, '^(#{1,3})\s+(\S.*)$', 1)) END AS lvl
  FROM raw),
paged AS (SELECT *, coalesce(last_value(marker IGNORE NULLS) OVER o, 1) AS page, sum((lvl IS NOT NULL)::INT) OVER o AS section_id, sum((marker IS NOT NULL)::INT) OVER o AS run
  FROM lines WINDOW o AS (PARTITION BY book_id ORDER BY chunk_seq, pos ROWS UNBOUNDED PRECEDING))
"""
_STRIP = lambda x: rf"regexp_replace(regexp_replace({x}, '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '')"
SECTIONS = (
    LINES
    + r""",
sec AS (
  SELECT book_id, section_id, coalesce(max(lvl), 0) AS level,
    coalesce(max(CASE WHEN lvl IS NOT NULL THEN """
    + _STRIP(r"regexp_extract(line, '^(#{1,3})\s+(\S.*)$', 2)")
    + r""" END), '[Preamble]') AS title,
    coalesce(max(CASE WHEN lvl IS NOT NULL THEN page END), 1) AS start_page,
    max(CASE WHEN lvl IS NULL THEN TRY_CAST(nullif(regexp_extract(line, '##\s*---\s*PAGE\s+([0-9]+)\s*---', 1), '') AS INT) END) AS last_page,
    coalesce(string_agg(CASE WHEN lvl IS NULL THEN line END, chr(10) ORDER BY chunk_seq, pos), '') AS rawtext, count(*) FILTER (lvl IS NULL) AS n_lines
  FROM paged GROUP BY book_id, section_id),
sections AS (
  SELECT book_id, section_id, level, title, start_page, coalesce(last_page, start_page) AS end_page, n_lines,
    """
    + _STRIP(r"regexp_replace(regexp_replace(regexp_replace(rawtext, '##\s*---\s*PAGE\s+([0-9]+)\s*---', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '\.{3,}', ' ', 'g')")
    + r""" AS content FROM sec)
"""
)
PATHS = (
    "RECURSIVE "
    + SECTIONS
    + r""",
heads AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY section_id) AS n FROM sections WHERE level > 0),
walk AS (
  SELECT book_id, section_id, n, [title] AS path FROM heads WHERE n = 1
  UNION ALL SELECT h.book_id, h.section_id, h.n, list_append(w.path[1:h.level - 1], h.title) FROM walk w JOIN heads h ON h.book_id = w.book_id AND h.n = w.n + 1),
paths AS (SELECT s.*, coalesce(w.path, ['[Preamble]']) AS path FROM sections s LEFT JOIN walk w USING (book_id, section_id))
"""
)
RUNS = r""",
sl AS (SELECT book_id, section_id, unnest(range(0, len(string_split(content, chr(10))))) AS pos, unnest(string_split(content, chr(10))) AS line FROM sections WHERE content <> ''),
st AS (SELECT *, (starts_with(""" + _STRIP("line") + r""", '|') OR length(line) - length(replace(line, '|', '')) >= 2) AS is_table FROM sl),
sc AS (SELECT *, coalesce((is_table <> lag(is_table) OVER w)::INT, 1) AS ch FROM st WINDOW w AS (PARTITION BY book_id, section_id ORDER BY pos)),
sr AS (SELECT *, sum(ch) OVER (PARTITION BY book_id, section_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS r FROM sc),
sb AS (SELECT book_id, section_id, r, any_value(is_table) AS is_table, count(*) AS n_lines, """ + _STRIP("string_agg(line, chr(10) ORDER BY pos)") + r""" AS content FROM sr GROUP BY book_id, section_id, r),
runs AS (SELECT book_id, section_id, row_number() OVER (PARTITION BY book_id, section_id ORDER BY r) - 1 AS run, CASE WHEN is_table AND n_lines >= 2 THEN 'table' ELSE 'text' END AS type, n_lines, content FROM sb WHERE content <> '')
"""


def _uuid5(key: str) -> str:
    digest = f"sha1(unhex('{X.DNS_NAMESPACE}') || encode({key}))"
    return (
        f"substr({digest}, 1, 8) || '-' || substr({digest}, 9, 4) || '-5' || substr({digest}, 14, 3) || '-' || "
        f"translate(substr({digest}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({digest}, 18, 3) || '-' || substr({digest}, 21, 12)"
    )


# Tables: the parsed form of every table chunk.
PARSED = (
    r"""
tc AS (SELECT DISTINCT chunk_id, book_id, chunk_seq, section_path, page_range, content FROM chunk WHERE type = 'table'),
tl AS (SELECT chunk_id, unnest(range(0, len(string_split(content, chr(10))))) AS pos, """
    + _STRIP("unnest(string_split(content, chr(10)))")
    + r""" AS line FROM tc),
tk AS (SELECT chunk_id, pos, list_transform(string_split(regexp_replace(regexp_replace(line, '^\|', ''), '\|$', ''), '|'), lambda x: """
    + _STRIP("x")
    + r""") AS cells FROM tl WHERE line <> '' AND NOT regexp_matches(line, '^[|\-][|\-:\s]*$')),
tn AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) AS n FROM tk),
th AS (SELECT chunk_id, list_filter(cells, lambda x: x <> '') AS headers FROM tn WHERE n = 1),
trows AS (SELECT tn.chunk_id, row_number() OVER (PARTITION BY tn.chunk_id ORDER BY tn.n) - 1 AS row_index, headers,
    list_transform(range(1, len(headers) + 1), lambda i: coalesce(cells[i], '')) AS cells
  FROM tn JOIN th USING (chunk_id) WHERE n > 1 AND len(list_filter(list_transform(range(1, len(headers) + 1), lambda i: coalesce(cells[i], '')), lambda x: x <> '')) > 0),
lower_h AS (SELECT *, list_transform(headers, lambda x: lower(x)) AS lh FROM trows),
picked AS (SELECT l.chunk_id, l.row_index, l.headers, l.cells, tc.book_id, tc.chunk_seq, tc.section_path, tc.page_range,
    len(list_filter(lh, lambda x: list_contains(SUBJ, x) OR list_contains(PROPS, x))) > 0 AND len(list_filter(lh, lambda x: list_contains(VALS, x))) > 0 AS is_spec,
    coalesce(cells[list_position(lh, list_filter(lh, lambda x: list_contains(SUBJ, x) OR list_contains(PROPS, x))[1])], '') AS p_param,
    coalesce(cells[list_position(lh, list_filter(lh, lambda x: list_contains(VALS, x))[1])], '') AS p_value,
    coalesce(cells[list_position(lh, list_filter(lh, lambda x: list_contains(UNITS, x))[1])], '') AS p_unit,
    coalesce(section_path[len(section_path)], '') AS sect
  FROM lower_h l JOIN tc USING (chunk_id)),
rsent AS (SELECT *, array_to_string(list_transform(list_filter(list_zip(headers, cells), lambda z: z[2] <> ''), lambda z: z[1] || ': ' || z[2]), ' | ') || '.' AS generic FROM picked),
sent AS (SELECT *, CASE WHEN is_spec AND p_param <> '' AND p_value <> '' THEN
    CASE WHEN sect = '' OR contains(lower(p_param), lower(sect)) THEN '' ELSE sect || ' ' END || p_param || ' is ' || p_value || CASE WHEN p_unit = '' THEN '' ELSE ' ' || p_unit END || '.' ELSE generic END AS sentence FROM rsent)
"""
)
_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"
for _name, _words in (("SUBJ", T.SUBJECT_HEADERS), ("PROPS", T.PROPERTY_HEADERS), ("VALS", T.VALUE_HEADERS), ("UNITS", T.UNIT_HEADERS)):
    PARSED = PARSED.replace(_name, _list(_words))

TABLE_TEXT = r""",
lin AS (SELECT tc.chunk_id, coalesce(CASE WHEN coalesce(len(any_value(tc.section_path)), 0) > 0 THEN 'Section: ' || array_to_string(any_value(tc.section_path), ' > ') || '. ' ELSE '' END || string_agg(generic, ' ' ORDER BY row_index), '') AS linearized
  FROM tc LEFT JOIN rsent USING (chunk_id) GROUP BY tc.chunk_id)
"""
SENTENCES = r"""
sx AS (SELECT chunk_id, book_id, chunk_seq, section_path, page_range.start AS page, string_split(regexp_replace(content, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS a
  FROM (SELECT DISTINCT chunk_id, book_id, chunk_seq, section_path, page_range, content FROM chunk WHERE type = 'text' AND content IS NOT NULL)),
sp AS (SELECT chunk_id, book_id, chunk_seq, section_path, page, unnest(range(0, len(a))) AS pos, """ + _STRIP("unnest(a)") + r""" AS sentence FROM sx),
sq AS (SELECT *, length(sentence) >= 30 AND len(regexp_split_to_array(sentence, '[\s\p{Z}]+')) >= 8 """ + "".join(f" AND NOT regexp_matches(sentence, '{p}')" for p in X.NOISE) + r""" AS keep FROM sp WHERE sentence <> '')
"""

MESSAGES = """ar AS (SELECT DISTINCT ask_id, chat_id, question, full_text, asked_at, saved_at FROM ask_log),
mm AS (SELECT chat_id, asked_at AS created_at, ask_id * 2 AS message_id, 'user' AS role, question AS content FROM ar WHERE question IS NOT NULL
  UNION ALL SELECT chat_id, asked_at, ask_id * 2 + 1, 'assistant', full_text FROM ar WHERE full_text IS NOT NULL),
pm AS (SELECT *, n0 - n AS seq FROM (SELECT *, max(n) OVER (PARTITION BY chat_id) AS n0 FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY created_at DESC, message_id DESC) AS n FROM mm) WHERE n <= 10))"""
PIPE_TABLES = """WITH
        e AS (SELECT chunk_id, row_index, list_transform(headers, lambda x: replace(x, '|', '\\|')) AS headers, list_transform(cells, lambda x: replace(x, '|', '\\|')) AS cells FROM trows),
        w AS (SELECT chunk_id, i, max(greatest(length(headers[i]), length(cells[i]))) AS w FROM (SELECT chunk_id, headers, cells, unnest(range(1, len(headers) + 1)) AS i FROM e) GROUP BY ALL),
        ww AS (SELECT chunk_id, list(w ORDER BY i) AS ws FROM w GROUP BY chunk_id),
        r AS (SELECT chunk_id, row_index, headers, ws, '| ' || array_to_string(list_transform(range(1, len(ws) + 1), lambda i: rpad(cells[i], ws[i]::INT, ' ')), ' | ') || ' |' AS line FROM e JOIN ww USING (chunk_id))
        SELECT chunk_id, any_value('| ' || array_to_string(list_transform(range(1, len(ws) + 1), lambda i: rpad(headers[i], ws[i]::INT, ' ')), ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(ws, lambda x: repeat('-', x::INT)), ' | ') || ' |') || chr(10) || string_agg(line, chr(10) ORDER BY row_index) AS markdown FROM r GROUP BY chunk_id"""

SQL = {
    "lines_page_counter": f"WITH {LINES} SELECT book_id, chunk_seq, pos::INT AS pos, page FROM paged",
    "page_split": f"""WITH {LINES}, runs AS (SELECT book_id, run, coalesce(max(marker), 0) AS page, {_STRIP("coalesce(string_agg(CASE WHEN marker IS NULL THEN line END, chr(10) ORDER BY chunk_seq, pos), '')")} AS content FROM paged GROUP BY book_id, run)
        SELECT book_id, page, arg_max(content, run) AS content FROM runs WHERE content <> '' GROUP BY book_id, page""",
    "section_sessions": f"WITH {SECTIONS} SELECT book_id, section_id::BIGINT AS section_id, level::INT AS level, title, start_page, end_page, content, n_lines FROM sections",
    "section_breadcrumbs": f"WITH {PATHS} SELECT book_id, section_id::BIGINT AS section_id, array_to_string(path, ' > ') AS path FROM paths",
    "text_table_runs": f"WITH {SECTIONS}{RUNS} SELECT book_id, section_id::BIGINT AS section_id, run::INT AS run, type, n_lines, content FROM runs",
    "chunk_ids": f"""WITH {PATHS}{RUNS},
        em AS (SELECT *, row_number() OVER (PARTITION BY book_id, section_id ORDER BY run) AS rnk FROM runs WHERE length(content) >= 20),
        cn AS (SELECT book_id, section_id, count(*) AS n FROM em GROUP BY ALL),
        nb AS (SELECT p.*, sum(coalesce(n, 0) + 1) OVER (PARTITION BY book_id ORDER BY section_id ROWS UNBOUNDED PRECEDING) - coalesce(n, 0) - 1 AS first FROM paths p LEFT JOIN cn USING (book_id, section_id)),
        k AS (SELECT e.*, nb.path, nb.level, nb.start_page, nb.end_page, (first + rnk)::BIGINT AS chunk_index, first::BIGINT AS first FROM em e JOIN nb USING (book_id, section_id))
        SELECT {_uuid5("book_id || '::' || array_to_string(list_concat(path, [type, run::VARCHAR]), '>>') || '::' || chunk_index")} AS chunk_id, book_id, chunk_index, array_to_string(path, '>>') AS path, type, content,
        CASE WHEN level > 0 THEN {_uuid5("book_id || '::' || array_to_string(path, '>>') || '::' || first")} END AS parent_id, start_page, end_page FROM k""",
    "line_kinds": rf"""WITH {LINES} SELECT book_id, CASE WHEN marker IS NOT NULL THEN 'marker' WHEN lvl IS NOT NULL THEN 'header' || lvl WHEN regexp_matches({_STRIP("line")}, '^[|\-][|\-:\s]*$') THEN 'separator'
        WHEN starts_with({_STRIP("line")}, '|') OR length(line) - length(replace(line, '|', '')) >= 2 THEN 'table' ELSE 'text' END AS kind, count(*) AS n_lines FROM lines GROUP BY ALL""",
    "parse_tables": f"WITH {PARSED} SELECT chunk_id, row_index::INT AS row_index, unnest(range(0, len(headers)))::INT AS col_index, unnest(headers) AS header, unnest(cells) AS cell FROM trows",
    "linearize_tables": f"WITH {PARSED}{TABLE_TEXT} SELECT chunk_id, linearized FROM lin",
    "row_sentences": f"WITH {PARSED} SELECT chunk_id, row_index::INT AS row_index, sentence FROM sent",
    "table_bullets": f"""WITH {PARSED} SELECT tc.chunk_id, CASE WHEN coalesce(any_value(tc.section_path[len(tc.section_path)]), '') = '' THEN '[TABLE]:' ELSE '[TABLE — ' || any_value(tc.section_path[len(tc.section_path)]) || ']:' END || coalesce(chr(10) || string_agg('- ' ||
        CASE WHEN is_spec AND p_param <> '' AND p_value <> '' THEN p_param || ': ' || p_value || CASE WHEN p_unit = '' THEN '' ELSE ' ' || p_unit END ELSE array_to_string(list_transform(list_filter(list_zip(headers, cells), lambda z: z[2] <> ''), lambda z: z[1] || ': ' || z[2]), ' | ') END, chr(10) ORDER BY row_index), '') AS bullets
        FROM tc LEFT JOIN rsent USING (chunk_id) GROUP BY tc.chunk_id""",
    "pipe_tables": f"WITH {PARSED} SELECT * FROM ({PIPE_TABLES})",
    "table_patterns": f"""WITH {PARSED}, p AS (SELECT tc.chunk_id, coalesce(bool_or(len(list_filter(list_transform(headers, lambda x: lower(x)), lambda x: list_contains({_list(T.SUBJECT_HEADERS + " " + T.PROPERTY_HEADERS)}, x))) > 0 AND len(list_filter(list_transform(headers, lambda x: lower(x)), lambda x: list_contains({_list(T.VALUE_HEADERS)}, x))) > 0), false) AS s FROM tc LEFT JOIN th USING (chunk_id) GROUP BY tc.chunk_id)
        SELECT CASE WHEN s THEN 'spec' ELSE 'generic' END AS pattern, count(*) AS n_tables FROM p GROUP BY ALL""",
    "table_page_lookup": """SELECT DISTINCT p.book_id, p.page_number, c.chunk_id FROM page p JOIN chunk c ON c.book_id = p.book_id AND c.type = 'table' AND p.page_number BETWEEN c.page_range.start AND c.page_range.end""",
    "table_header_match": f"""WITH {PARSED}, h AS (SELECT tc.chunk_id, tc.book_id, tc.chunk_seq, tc.page_range, list_transform(headers, lambda x: lower(regexp_replace(x, '\\s+', ' ', 'g'))) AS hs FROM tc JOIN th USING (chunk_id) WHERE tc.page_range.start IS NOT NULL AND len(headers) > 0),
        pg AS (SELECT chunk_id, book_id, chunk_seq, hs, unnest(range(page_range.start, page_range.end + 1)) AS page FROM h)
        SELECT a.chunk_id, a.page::INT AS page, arg_min(b.chunk_id, b.chunk_seq) AS match_id FROM pg a JOIN pg b ON a.book_id = b.book_id AND a.page = b.page AND a.chunk_id <> b.chunk_id
        WHERE len(list_filter(a.hs, lambda x: list_contains(b.hs, x))) >= greatest(1, floor(0.6 * least(len(a.hs), len(b.hs)))) GROUP BY a.chunk_id, a.page""",
    "sentences": f"WITH {SENTENCES} SELECT chunk_id, pos::INT AS pos, sentence FROM sq",
    "quality_sentences": f"WITH {SENTENCES} SELECT book_id, count(*) FILTER (keep) AS n_kept, count(*) FILTER (NOT keep) AS n_dropped FROM sq GROUP BY book_id",
    "propositions": f"""WITH {SENTENCES}, {PARSED}{TABLE_TEXT},
        allp AS (
          SELECT chunk_id, book_id, chunk_seq, page, 0 AS kind, pos::BIGINT AS pos, 'text' AS source_type, sentence AS text FROM sq WHERE keep
          UNION ALL SELECT chunk_id, book_id, chunk_seq, page_range.start, 1, row_index, 'table_row', sentence FROM sent WHERE length(sentence) >= 10
          UNION ALL SELECT tc.chunk_id, tc.book_id, tc.chunk_seq, tc.page_range.start, 2, 0, 'table_full', linearized FROM lin JOIN tc USING (chunk_id) WHERE length(linearized) > 30),
        num AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chunk_seq, kind, pos) - 1 AS i FROM allp)
        SELECT {_uuid5("book_id || '::prop::' || chunk_id || '::' || i")} AS proposition_id, book_id, i AS prop_index, chunk_id AS parent_chunk_id, source_type, text, coalesce(page, 0) AS page FROM num""",
    "counts_by_type": "SELECT 'chunk' AS kind, type, count(*) AS n FROM chunk GROUP BY ALL UNION ALL SELECT 'proposition', source_type, count(*) FROM proposition GROUP BY ALL",
    "embedding_texts": f"""SELECT * FROM (SELECT chunk_id, CASE WHEN type = 'text' THEN {_STRIP("content")} ELSE coalesce(nullif({_STRIP("linearized_text")}, ''), {_STRIP("content")}) END AS text FROM (SELECT DISTINCT chunk_id, type, content, linearized_text FROM chunk)) WHERE length(text) >= 20""",
}
