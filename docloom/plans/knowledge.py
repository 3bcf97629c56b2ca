"""Queries of the graph, reports, conversations, sinks, jobs and events; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import graph as G
from docloom.operators import jobs as J
from docloom.operators import propositions as P
from docloom.operators import reports as R
from docloom.operators.retrieval import question_terms, routed_questions
from docloom.plans import config as K
from docloom.session import read
from docloom.sources.formats import duplicate_keys, split_units
from docloom.streaming import events as E

from .documents import MESSAGES, _STRIP
from .graph_sql import HIERARCHY, MENTIONS
from .retrieval import QUESTIONS, SECTIONS_OF, SPECS_OF


def _mentions(spark, sf_dir):
    chunk = read(spark, sf_dir, "chunk")
    section = chunk.select("chunk_id", F.coalesce(F.try_element_at("section_path", F.lit(-1)), F.lit("")).alias("section")).distinct()
    return G.entity_mentions(P.chunk_sentences(chunk).join(section, "chunk_id"))


def spec_extract(spark, sf_dir):
    """Quantities in the propositions' texts."""
    return G.spec_mentions(read(spark, sf_dir, "proposition").select("proposition_id", "text").distinct(), "proposition_id", "text")


def spec_upsert(spark, sf_dir):
    """Specification nodes."""
    return G.spec_nodes(read(spark, sf_dir, "spec"))


def spec_lookup(spark, sf_dir):
    """Specifications whose subject holds a term of a stated question or lies in one, within its books."""
    questions = routed_questions(read(spark, sf_dir, "ask_log"))
    return G.spec_lookup(question_terms(questions), read(spark, sf_dir, "spec")).select("query_id", "book_id", "subject", "unit", "raw")


def term_sections(spark, sf_dir):
    """Sections that mention an entity of a stated question."""
    questions = routed_questions(read(spark, sf_dir, "ask_log"), min(K.EVERY, K.EVERY_LOOKUP))
    return G.sections_of_terms(question_terms(questions), entity_sections(spark, sf_dir))


def recognised_entities(spark, sf_dir):
    """What the stand-in for a recognition model finds in the propositions."""
    rows = read(spark, sf_dir, "proposition").select("proposition_id", "text").distinct().where(F.col("text").isNotNull())
    return G.recognised(rows, "proposition_id", "text").select("proposition_id", "name", "label")


def entity_mentions(spark, sf_dir):
    """Entities with their mentions and sections."""
    return G.entities(_mentions(spark, sf_dir))


def cooccurrence(spark, sf_dir):
    """Pairs of entities in one sentence."""
    return G.cooccurrence(_mentions(spark, sf_dir)).withColumn("sections", F.array_join("sections", "|"))


def section_hierarchy(spark, sf_dir):
    """Chapter, section and subsection edges."""
    return G.hierarchy(read(spark, sf_dir, "chunk"))[1]


def next_section(spark, sf_dir):
    """Consecutive sections."""
    return G.next_sections(G.hierarchy(read(spark, sf_dir, "chunk"))[0])


def entity_sections(spark, sf_dir):
    """Entities with their section nodes."""
    return G.entity_sections(_mentions(spark, sf_dir), G.hierarchy(read(spark, sf_dir, "chunk"))[0])


def table_parents(spark, sf_dir):
    """Tables with their parent nodes."""
    chunk = read(spark, sf_dir, "chunk")
    return G.table_parents(chunk, G.hierarchy(chunk)[0])


def coverage_report(spark, sf_dir):
    """Coverage of each book."""
    return R.coverage(read(spark, sf_dir, "chunk"))


def page_counts(spark, sf_dir):
    """Pages of each book."""
    return R.page_counts(read(spark, sf_dir, "chunk"))


def batch_units(spark, sf_dir):
    """Work units of 200 propositions."""
    return R.batch_units(read(spark, sf_dir, "proposition"), "proposition_id", "book_id", 200)


def extraction_units(spark, sf_dir):
    """Extraction units of ten pages."""
    totals = read(spark, sf_dir, "page").groupBy("book_id").agg(F.count_distinct("page_number").cast("int").alias("total_pages"))
    return split_units(totals)


def label_topk(spark, sf_dir):
    """The 30 most frequent labels of what is recognised in the propositions."""
    return G.label_dictionary(recognised_entities(spark, sf_dir))


def timing_stats(spark, sf_dir):
    """Events by type as calls with their durations."""
    return R.timing(read(spark, sf_dir, "events"), "event_type", "value")


def prior_messages(spark, sf_dir):
    """The last ten messages of each chat."""
    return R.prior_messages(R.messages(read(spark, sf_dir, "ask_log"))).select("chat_id", "message_id", "role", "seq", "content")


def history_block(spark, sf_dir):
    """The history of each chat as text."""
    return R.history_blocks(R.prior_messages(R.messages(read(spark, sf_dir, "ask_log"))))


def chat_search_snippets(spark, sf_dir):
    """Messages that hold a text."""
    return R.search_snippets(R.messages(read(spark, sf_dir, "ask_log")), "pressure regulator")


def library_view(spark, sf_dir):
    """Books with title, pages, chunks and propositions."""
    chunk, props = read(spark, sf_dir, "chunk"), read(spark, sf_dir, "proposition")
    chunks = chunk.groupBy("book_id").agg(F.count_distinct("chunk_id").alias("n_chunks"))
    facts = props.groupBy("book_id").agg(F.count_distinct("proposition_id").alias("n_propositions"))
    joined = R.page_counts(chunk).join(chunks, "book_id").join(facts, "book_id", "left")
    return joined.select("book_id", X.title_of("book_id").alias("title"), "n_pages", "n_chunks", F.coalesce("n_propositions", F.lit(0)).alias("n_propositions"))


def message_counters(spark, sf_dir):
    """Messages of each chat and its last activity."""
    return R.messages(read(spark, sf_dir, "ask_log")).groupBy("chat_id").agg(F.count("*").alias("n_messages"), F.max("created_at").cast("string").alias("updated_at"))


def idempotent_upsert(spark, sf_dir):
    """Specs loaded twice, the second time in other order: one row per key."""
    spec = read(spark, sf_dir, "spec").select("spec_id", "book_id", "subject")
    return R.upsert(spec, spec.orderBy(F.desc("spec_id")), ["spec_id"], F.col("book_id"))


def delete_book(spark, sf_dir):
    """Propositions by book without one book and its rows."""
    props = read(spark, sf_dir, "proposition")
    gone = props.where("book_id = 'orbital_plant_manual'")
    return R.without(props, "book_id", gone).groupBy("book_id").agg(F.count("*").alias("n"))


def collection_counts(spark, sf_dir):
    """Points of both collections."""
    props = read(spark, sf_dir, "proposition").select(F.col("proposition_id").alias("id"), F.lit("propositions").alias("collection"))
    chunks = read(spark, sf_dir, "chunk").select(F.col("chunk_id").alias("id"), F.lit("sections").alias("collection"))
    return props.unionByName(chunks).groupBy("collection").agg(F.count_distinct("id").alias("n_points"))


def key_check(spark, sf_dir):
    """Chunk ids that occur more than once."""
    return duplicate_keys(read(spark, sf_dir, "chunk"), ["chunk_id"])


def _states(spark, sf_dir):
    return J.job_states(J.job_events(read(spark, sf_dir, "events")))


def job_fsm(spark, sf_dir):
    """The final state of every job."""
    return _states(spark, sf_dir).select("job_id", "status", "attempts", "n_events", "n_ignored", "n_expired")


def job_progress(spark, sf_dir):
    """Progress by book."""
    return J.progress(_states(spark, sf_dir))


def worker_liveness(spark, sf_dir):
    """Workers with their last event."""
    return J.liveness(read(spark, sf_dir, "events"))


def progress_latest(spark, sf_dir):
    """The last event of each job."""
    rows = read(spark, sf_dir, "events")
    return rows.groupBy(F.col("user_id").alias("job_id")).agg(F.max_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id")).alias("_l")).select("job_id", F.col("_l.event_type").alias("status"), F.col("_l.event_id").alias("event_id"))


def events_tumbling(spark, sf_dir):
    """Events by hour and type."""
    return E.windowed(read(spark, sf_dir, "events")).withColumn("window_start", F.col("window_start").cast("string"))


def events_sliding(spark, sf_dir):
    """Events by windows of one hour every half hour."""
    return E.windowed(read(spark, sf_dir, "events"), "1 hour", "30 minutes").withColumn("window_start", F.col("window_start").cast("string"))


def events_sessions(spark, sf_dir):
    """Sessions of each user."""
    rows = E.sessions(read(spark, sf_dir, "events"))
    return rows.select("user_id", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "n")


def stream_dedup(spark, sf_dir):
    """Events by type, each once."""
    rows = read(spark, sf_dir, "events")
    return E.deduplicated(rows.unionByName(rows)).groupBy("event_type").agg(F.count("*").alias("n"))


def job_rollup(spark, sf_dir):
    """Events by type and user group with totals."""
    rows = read(spark, sf_dir, "events").withColumn("worker_group", (F.col("user_id") % 10).cast("string"))
    return rows.rollup("event_type", "worker_group").agg(F.count("*").alias("n")).select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce("worker_group", F.lit("all")).alias("worker_group"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        spec_extract, spec_upsert, spec_lookup, term_sections, recognised_entities, entity_mentions, cooccurrence, section_hierarchy, next_section, entity_sections, table_parents, coverage_report, page_counts, batch_units, extraction_units, label_topk,
        timing_stats, prior_messages, history_block, chat_search_snippets, library_view, message_counters, idempotent_upsert, delete_book, collection_counts, key_check, job_fsm, job_progress, worker_liveness,
        progress_latest, events_tumbling, events_sliding, events_sessions, stream_dedup, job_rollup,
    )
}

PAGES = """pc AS (SELECT book_id, CASE WHEN count(DISTINCT page) > 0 THEN count(DISTINCT page) ELSE count(DISTINCT chunk_id) END AS n_pages FROM (
  SELECT book_id, chunk_id, unnest(CASE WHEN page_range.start IS NULL THEN [NULL] ELSE range(page_range.start, coalesce(page_range."end", page_range.start) + 1) END) AS page FROM (SELECT DISTINCT chunk_id, book_id, page_range FROM chunk)) GROUP BY book_id)"""
_kept = lambda c: f"arg_max({c}, spec_id) FILTER ({c} IS NOT NULL)"
_recognise = lambda label, pattern: f"SELECT proposition_id, '{label}' AS label, unnest(regexp_extract_all(text, '{pattern}', 1)) AS raw FROM (SELECT DISTINCT proposition_id, text FROM proposition WHERE text IS NOT NULL)"
RECOGNISED = f"""rec0 AS ({_recognise("Quantity", G.QUANTITY_PATTERN)} UNION ALL {_recognise("Code", G.CODE_PATTERN)} UNION ALL {_recognise("Entity", G.NAME_PATTERN)}),
rec AS (SELECT proposition_id, label, lower({_STRIP("regexp_replace(raw, '[\\s\\p{Z}]+', ' ', 'g')")}) AS name FROM rec0)"""
FSM = f"""WITH RECURSIVE ev AS (SELECT user_id AS job_id, epoch_us(ts) / 1e6 AS moment, event_id, event_type AS event, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
fs AS (
  SELECT DISTINCT job_id, 0::BIGINT AS n, 'PENDING' AS status, 0 AS attempts, 0::DOUBLE AS deadline, 0::BIGINT AS n_ignored, 0::BIGINT AS n_expired FROM ev
  UNION ALL
  SELECT job_id, n, CASE WHEN s1 IN ('COMPLETED', 'FAILED') THEN s1 WHEN event = 'view' AND s1 = 'PENDING' THEN 'PROCESSING' WHEN event = 'purchase' AND s1 = 'PROCESSING' THEN 'COMPLETED'
      WHEN event = 'error' AND s1 = 'PROCESSING' THEN CASE WHEN a1 + 1 >= {J.ATTEMPTS} THEN 'FAILED' ELSE 'PENDING' END WHEN event = 'signup' THEN 'PENDING' ELSE s1 END,
    CASE WHEN s1 IN ('COMPLETED', 'FAILED') THEN a1 WHEN event = 'error' AND s1 = 'PROCESSING' THEN a1 + 1 WHEN event = 'signup' THEN 0 ELSE a1 END,
    CASE WHEN (event = 'view' AND s1 = 'PENDING') OR (event = 'click' AND s1 = 'PROCESSING') THEN moment + {J.LEASE} ELSE deadline END,
    n_ignored + CASE WHEN s1 IN ('COMPLETED', 'FAILED') THEN 1 WHEN event = 'view' AND s1 = 'PENDING' THEN 0 WHEN event IN ('click', 'purchase', 'error') AND s1 = 'PROCESSING' THEN 0 WHEN event = 'signup' THEN 0 ELSE 1 END,
    n_expired + x
  FROM (SELECT e.job_id, e.n, e.moment, e.event, f.deadline, f.n_ignored, f.n_expired, (f.status = 'PROCESSING' AND e.moment > f.deadline)::INT AS x,
      f.attempts + (f.status = 'PROCESSING' AND e.moment > f.deadline)::INT AS a1,
      CASE WHEN f.status = 'PROCESSING' AND e.moment > f.deadline THEN CASE WHEN f.attempts + 1 >= {J.ATTEMPTS} THEN 'FAILED' ELSE 'PENDING' END ELSE f.status END AS s1
    FROM fs f JOIN ev e ON e.job_id = f.job_id AND e.n = f.n + 1)),
states AS (SELECT job_id, arg_max(status, n) AS status, arg_max(attempts, n) AS attempts, max(n) AS n_events, arg_max(n_ignored, n) AS n_ignored, arg_max(n_expired, n) AS n_expired FROM fs GROUP BY job_id)"""

_found = lambda g: f"regexp_extract_all(text, '(?i){G.SPEC_PATTERN}', {g})"
SQL = {
    "spec_extract": f"""WITH a AS (SELECT proposition_id, {_found(1)} AS s, {_found(2)} AS v, {_found(3)} AS u FROM (SELECT DISTINCT proposition_id, text FROM proposition)),
        m AS (SELECT proposition_id, unnest(range(0, len(s)))::INT AS pos, lower(regexp_replace(regexp_replace(regexp_replace({_STRIP("unnest(s)")}, '\\s+', ' ', 'g'), '^[ \\-:/,.]+', ''), '[ \\-:/,.]+$', '')) AS subject, unnest(v) AS value_text, lower(unnest(u)) AS unit FROM a)
        SELECT proposition_id, min(pos) AS pos, subject, value_text, TRY_CAST(replace(value_text, ',', '') AS DOUBLE) AS value, unit FROM m WHERE length(subject) >= 3 AND NOT regexp_matches(subject, '^[0-9]') AND TRY_CAST(replace(value_text, ',', '') AS DOUBLE) IS NOT NULL
        AND subject NOT IN ({", ".join(f"'{w}'" for w in G.IGNORED_SUBJECTS.split())}) GROUP BY proposition_id, subject, value_text, unit""",
    "message_counters": f"WITH {MESSAGES} SELECT chat_id, count(*) AS n_messages, max(created_at)::VARCHAR AS updated_at FROM mm GROUP BY chat_id",
    "spec_upsert": f"SELECT book_id, subject, unit, {_kept('value')} AS value, {_kept('raw')} AS raw, arg_min(section, spec_id) FILTER (section IS NOT NULL) AS section, count(*) AS n_seen FROM (SELECT DISTINCT spec_id, book_id, subject, lower(coalesce(unit, '')) AS unit, value, raw, section FROM spec) GROUP BY ALL",
    "spec_lookup": f"""WITH {QUESTIONS}, {SPECS_OF} SELECT query_id, book_id, subject, unit, raw FROM specs""",
    "term_sections": f"""WITH {QUESTIONS}, {SECTIONS_OF} SELECT query_id, section FROM gs""".replace("ask_id % 100 = 0", f"ask_id % {K.EVERY_LOOKUP} = 0"),
    "recognised_entities": f"""WITH {RECOGNISED} SELECT DISTINCT proposition_id, name, label FROM rec""",
    "entity_mentions": f"WITH {MENTIONS} SELECT book_id, name, count(*) AS n_mentions, count(DISTINCT section) AS n_sections FROM ms GROUP BY ALL",
    "cooccurrence": f"""WITH {MENTIONS}, d AS (SELECT DISTINCT chunk_id, book_id, section, pos, name FROM ms),
        p AS (SELECT x.book_id, x.name AS a, y.name AS b, x.section FROM d x JOIN d y ON x.chunk_id = y.chunk_id AND x.pos = y.pos AND x.name < y.name)
        SELECT book_id, a, b, count(*) AS n, array_to_string(list_sort(list(DISTINCT section))[1:20], '|') AS sections FROM p GROUP BY book_id, a, b""",
    "section_hierarchy": f"WITH {HIERARCHY} SELECT DISTINCT book_id, ['HAS_CHAPTER', 'HAS_SECTION', 'HAS_SUBSECTION'][depth + 1] AS type, CASE WHEN depth = 0 THEN book_id ELSE path[depth] END AS src, path[depth + 1] AS dst FROM hx",
    "next_section": f"WITH {HIERARCHY} SELECT * FROM (SELECT book_id, name AS src, lead(name) OVER (PARTITION BY book_id ORDER BY first_seq, name) AS dst FROM hn WHERE label = 'Section') WHERE dst IS NOT NULL",
    "entity_sections": f"""WITH {MENTIONS}, {HIERARCHY} SELECT m.book_id, m.name, m.section, coalesce(s.label, u.label) AS label FROM (SELECT DISTINCT book_id, name, section FROM ms) m
        LEFT JOIN hn s ON s.book_id = m.book_id AND s.name = m.section AND s.label = 'Section' LEFT JOIN hn u ON u.book_id = m.book_id AND u.name = m.section AND u.label = 'Subsection' WHERE coalesce(s.label, u.label) IS NOT NULL""",
    "table_parents": f"""WITH {HIERARCHY} SELECT DISTINCT chunk_id, c.book_id, n.name AS parent FROM (SELECT DISTINCT chunk_id, book_id, CASE WHEN len(section_path) >= 2 THEN section_path[len(section_path) - 1] ELSE section_path[len(section_path)] END AS p FROM chunk WHERE type = 'table' AND len(section_path) > 0) c
        JOIN hn n ON n.book_id = c.book_id AND n.name = c.p AND n.label IN ('Section', 'Subsection')""",
    "coverage_report": f"""WITH w AS (SELECT book_id, page_range.start AS page, CASE WHEN {_STRIP("coalesce(content, '')")} = '' THEN 0 ELSE len(regexp_split_to_array({_STRIP("coalesce(content, '')")}, '[\\s\\p{{Z}}]+')) END AS w FROM (SELECT DISTINCT chunk_id, book_id, page_range, content FROM chunk) WHERE page_range.start IS NOT NULL),
        p AS (SELECT book_id, page, sum(w)::BIGINT AS w, count(*) AS n FROM w GROUP BY ALL)
        SELECT book_id, count(*) AS pages, count(*) FILTER (w >= 50) AS good, count(*) FILTER (w < 50 AND w >= 10) AS short, count(*) FILTER (w < 10) AS blank, sum(n)::BIGINT AS chunks, count(*) FILTER (n > 1) AS multi_chunk_pages,
        round_even(sum(w) / sum(n), 1) AS words_per_chunk, round_even(count(*) FILTER (w >= 50) / count(*) * 100, 1) AS coverage FROM p GROUP BY book_id""",
    "page_counts": f"WITH {PAGES} SELECT * FROM pc",
    "batch_units": "WITH c AS (SELECT book_id, count(DISTINCT proposition_id)::INT AS n FROM proposition GROUP BY ALL), u AS (SELECT book_id, n AS t, unnest(range(0, n, 200))::INT AS start FROM c) SELECT book_id, start, least(200, t - start)::INT AS n FROM u",
    "extraction_units": "WITH c AS (SELECT book_id, count(DISTINCT page_number)::INT AS n FROM page GROUP BY ALL), u AS (SELECT book_id, n, unnest(range(0, n, 10))::INT AS start_offset FROM c) SELECT book_id, (start_offset // 10)::INT AS chunk_idx, start_offset, least(10, n - start_offset)::INT AS page_count FROM u",
    "label_topk": f"WITH {RECOGNISED} SELECT label, count(*) AS n FROM (SELECT DISTINCT proposition_id, name, label FROM rec) GROUP BY label ORDER BY n DESC, label LIMIT 30",
    "timing_stats": "SELECT *, row_number() OVER (ORDER BY total DESC, event_type)::INT AS place FROM (SELECT event_type, count(*) AS calls, round(sum(value), 4) AS total, round(avg(value), 6) AS average FROM events GROUP BY ALL)",
    "prior_messages": f"WITH {MESSAGES} SELECT chat_id, message_id, role, seq::INT AS seq, content FROM pm",
    "history_block": f"WITH {MESSAGES} SELECT chat_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || content, chr(10) || chr(10) ORDER BY seq) AS block FROM pm GROUP BY chat_id",
    "chat_search_snippets": f"""WITH {MESSAGES}, l AS (SELECT *, strpos(lower(content), 'pressure regulator') AS place FROM mm), b AS (SELECT *, greatest(place - 40, 1) AS s, least(place + 18 + 80 - 1, length(content)) AS e FROM l WHERE place > 0)
        SELECT chat_id, message_id, CASE WHEN s > 1 THEN '...' ELSE '' END || substr(content, s, e - s + 1) || CASE WHEN e < length(content) THEN '...' ELSE '' END AS snippet FROM b""",
    "library_view": f"""WITH {PAGES}, t AS (SELECT book_id, string_agg(upper(w[1]) || lower(w[2:]), ' ' ORDER BY i) AS title FROM (SELECT book_id, unnest(string_split(translate(book_id, '_-', '  '), ' ')) AS w, unnest(range(1, len(string_split(translate(book_id, '_-', '  '), ' ')) + 1)) AS i FROM pc) GROUP BY book_id)
        SELECT book_id, title, n_pages, (SELECT count(DISTINCT chunk_id) FROM chunk c WHERE c.book_id = pc.book_id) AS n_chunks, (SELECT count(DISTINCT proposition_id) FROM proposition p WHERE p.book_id = pc.book_id) AS n_propositions FROM pc JOIN t USING (book_id)""",
    "idempotent_upsert": "SELECT DISTINCT spec_id, book_id, subject FROM spec",
    "delete_book": "SELECT book_id, count(*) AS n FROM proposition WHERE book_id <> 'orbital_plant_manual' GROUP BY ALL",
    "collection_counts": "SELECT 'propositions' AS collection, count(DISTINCT proposition_id) AS n_points FROM proposition UNION ALL SELECT 'sections', count(DISTINCT chunk_id) FROM chunk",
    "key_check": "SELECT chunk_id, count(*) AS n FROM chunk GROUP BY ALL HAVING count(*) > 1",
    "job_fsm": f"{FSM} SELECT * FROM states",
    "job_progress": f"{FSM} SELECT *, CASE WHEN failed > 0 THEN 'failed' WHEN completed = total THEN 'completed' ELSE 'running' END AS status, floor(completed / greatest(total, 1) * 100)::BIGINT AS percent FROM (SELECT job_id % 10 AS book, count(*) AS total, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed FROM states GROUP BY ALL)",
    "worker_liveness": "WITH s AS (SELECT user_id AS worker_id, epoch_us(max(ts)) / 1e6 AS last_seen FROM events WHERE user_id IS NOT NULL GROUP BY ALL) SELECT worker_id, round(last_seen, 3) AS last_seen, ((SELECT max(last_seen) FROM s) - last_seen) <= 60 AS online FROM s",
    "progress_latest": "SELECT user_id AS job_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS status, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id FROM events GROUP BY ALL",
    "events_tumbling": "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "events_sliding": "WITH w AS (SELECT *, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS s FROM events) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL",
    "events_sessions": "WITH g AS (SELECT user_id, ts, (coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w, 1800000001) > 1800000000)::INT AS b FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) + 1800000000 AS session_end, count(*) AS n FROM s GROUP BY user_id, k",
    "stream_dedup": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY ALL",
    "job_rollup": "SELECT coalesce(event_type, 'all') AS event_type, coalesce(g, 'all') AS worker_group, count(*) AS n FROM (SELECT event_type, (user_id % 10)::VARCHAR AS g FROM events) GROUP BY ROLLUP (event_type, g)",
}
