"""Queries of the job service, of page tables, of sinks and of small tools; with their SQL. The event table stands for jobs, workers and logs: a user is a unit or worker."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import models
from docloom.functions import segments as G
from docloom.functions import text as X
from docloom.operators import chunking as C
from docloom.operators import graph
from docloom.operators import lexical as L
from docloom.operators import pagetext as P
from docloom.operators import reports as R
from docloom.operators import service as S
from docloom.operators import tables as T
from docloom.operators import vectors as V
from docloom.operators.retrieval import search
from docloom.plans import config as K
from docloom.session import read
from docloom.sources import formats
from docloom.sources.corpus import markdown_lines

from .documents import LINES, PARSED, _STRIP
from .graph_sql import HIERARCHY, MENTIONS
from .retrieval import BOTH, Stages, _bm25

def _kind():
    """The kind of unit that a user stands for."""
    return F.get(F.array(F.lit("extraction"), F.lit("vectors"), F.lit("graph")), (F.col("user_id") % 3).cast("int"))


def _events(spark, sf_dir):
    rows = read(spark, sf_dir, "events").where("user_id is not null and ts is not null")
    return rows.select("event_id", "user_id", "event_type", "value", "props", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))


def _units(spark, sf_dir):
    """A unit per user, in the state that its last event tells."""
    last = S.latest(_events(spark, sf_dir).select("user_id", "event_id", "event_type", "at"), ["user_id"], ["at", "event_id"])
    status = F.when(F.col("event_type") == "purchase", "COMPLETED").when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "view", "PROCESSING").otherwise("PENDING")
    return last.select("user_id", (F.col("user_id") % 100).alias("book_id"), _kind().alias("kind"), status.alias("status"), "at")


def _pages(spark, sf_dir):
    return C.pages_of(markdown_lines(read(spark, sf_dir, "chunk")))


def page_tables(spark, sf_dir):
    """The tables inside the pages of the Markdown with their headings and lists."""
    return P.page_tables(_pages(spark, sf_dir), ["book_id", "page"]).select("book_id", "page", "start_line", "end_line", F.array_join("headers", "|").alias("headers"), "label", "bullets")


def page_contents(spark, sf_dir):
    """The pages of the Markdown with lists in place of tables."""
    return P.page_contents(_pages(spark, sf_dir), T.parsed_tables(read(spark, sf_dir, "chunk")))


def unit_barriers(spark, sf_dir):
    """Books whose units are all done."""
    return S.barriers(_units(spark, sf_dir)).withColumn("cleanup_at", F.round("cleanup_at", 3))


def active_units(spark, sf_dir):
    """Active units by kind and book, with totals."""
    return S.active_by_kind(_units(spark, sf_dir))


def worker_waits(spark, sf_dir):
    """Which requests for a unit wait for workers of higher priority."""
    units = _units(spark, sf_dir)
    asks = _events(spark, sf_dir).where("event_type = 'view'")
    rank = F.least(F.floor(F.col("user_id") / 3), F.lit(10))
    requests = asks.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("worker"), _kind().alias("kind"), rank.alias("rank"), "at")
    workers = units.select("kind", F.col("user_id").alias("worker"), F.floor(F.col("user_id") / 3).alias("rank"), F.col("at").alias("last_seen"), (F.col("status") == "PROCESSING").alias("busy")).where("rank < 10")
    pending = units.where("status = 'PENDING'").groupBy("kind").agg((F.count("*") % 4).alias("n_pending"))
    return S.must_wait(requests, workers, pending).select("request_id", "wait")


def stages_left(spark, sf_dir):
    """The stages that each book still has to run when it is resumed."""
    books = read(spark, sf_dir, "page").select("book_id").distinct()
    wanted = books.select("book_id", F.explode(F.array(*map(F.lit, ("chunks", "propositions", "graph", "answers")))).alias("stage"))
    done = [read(spark, sf_dir, t).select("book_id", F.lit(stage).alias("stage"), F.lit("done").alias("status")).distinct() for t, stage in (("chunk", "chunks"), ("proposition", "propositions"), ("spec", "graph"))]
    return S.stages_to_run(wanted, done[0].unionByName(done[1]).unionByName(done[2]))


def replayed_results(spark, sf_dir):
    """Cached results after their replay, by what became of them."""
    rows = _events(spark, sf_dir)
    cache = rows.select(F.col("event_id").alias("job_id"), F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 2)).otherwise(F.col("props")).alias("payload"))
    answers = rows.where("event_id % 5 <> 0").select(F.col("event_id").alias("job_id"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("http_status"))
    return S.replayed(cache, answers).groupBy("action").agg(F.count("*").alias("n"))


def batch_rollup(spark, sf_dir):
    """Batches of ten chapters of propositions, summed up for each book."""
    rows = read(spark, sf_dir, "proposition").select("proposition_id", "book_id", "prop_seq", "source_type").distinct()
    batches = rows.groupBy("book_id", F.floor(F.col("prop_seq") / 200).alias("batch")).agg(F.count("*").alias("n_points"), F.count_if(F.col("source_type") == "text").alias("n_text"))
    return S.batch_rollup(batches, "book_id", ["n_points", "n_text"])


def phase_progress(spark, sf_dir):
    """The percentage of each book in its second phase."""
    rows = _units(spark, sf_dir).groupBy("book_id").agg((F.count_if(F.col("status") == "COMPLETED") * 100.0 / F.count("*")).alias("q"), (F.count_if(F.col("status") == "FAILED") * 100.0 / F.count("*")).alias("g"))
    return rows.select("book_id", S.phase_percent(F.col("q"), F.col("g")).alias("percent"))


def upload_problems(spark, sf_dir):
    """Uploads by what is wrong with them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "title")
    uploads = docs.select(F.when(F.col("doc_id") % 4 == 0, F.concat("source", F.lit("-"), "doc_id")).when(F.col("doc_id") % 4 == 1, F.col("title")).otherwise(F.col("source")).alias("book_id"), F.concat(F.coalesce("title", F.lit("x")), F.when(F.col("doc_id") % 3 == 0, ".txt").otherwise(".PDF")).alias("file_name"))
    library = docs.where("doc_id % 40 = 2").select(F.col("source").alias("book_id"))
    jobs = docs.where("doc_id % 40 = 3").select(F.col("source").alias("book_id"), F.lit("running").alias("status"))
    return S.validated(uploads, library, jobs).groupBy("problem").agg(F.count("*").alias("n"))


def missing_parents(spark, sf_dir):
    """Chunks to which no proposition belongs."""
    held = read(spark, sf_dir, "proposition").where("parent_chunk_id is not null").select(F.col("parent_chunk_id").alias("chunk_id"))
    return S.missing(read(spark, sf_dir, "chunk"), held, ["chunk_id"])


def worker_log_tail(spark, sf_dir):
    """The last 50 lines of each worker's log."""
    logs = _events(spark, sf_dir).select((F.col("user_id") % 10).alias("worker_id"), F.col("at").alias("ts"), F.concat_ws(" ", "event_type", "event_id").alias("line"))
    return S.last_lines(logs, 50).select("worker_id", "line", "place")


def resolved_paths(spark, sf_dir):
    """The files of books whose names are spelled otherwise."""
    books = read(spark, sf_dir, "chunk").groupBy("book_id").agg(F.min("book_title").alias("title")).withColumn("stored_path", F.lit(None).cast("string"))
    n = F.length("book_id") % 3
    file = F.when(n == 0, F.replace("book_id", F.lit("_"), F.lit("-"))).when(n == 1, F.upper("book_id")).otherwise(F.concat(F.lit("x"), F.col("book_id")))
    return S.resolved_paths(books, books.select(F.concat(F.lit("raw/"), file, F.lit(".pdf")).alias("path")))


def folder_signatures(spark, sf_dir):
    """The signature of each folder of files."""
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("folder"), F.length("props").alias("length"), F.col("ts").cast("timestamp").alias("modified"))
    return S.signature(rows)


def coerced_ids(spark, sf_dir):
    """Book ids, some of them within objects."""
    rows = read(spark, sf_dir, "ask_log").select("ask_id", F.posexplode("book_ids").alias("n", "b")).distinct()
    inner = F.concat(F.lit('{"title": "'), "b", F.lit('"}'))
    value = F.when(F.col("n") == 0, F.col("b")).when(F.col("n") == 1, inner).otherwise(F.concat(F.lit('{"id": "", "book_id": '), inner, F.lit("}")))
    return rows.select("ask_id", S.book_id_of(value).alias("book_id")).distinct()


def cited_books(spark, sf_dir):
    """The books of cited titles."""
    library = read(spark, sf_dir, "chunk").where("book_title is not null").select("book_id", F.col("book_title").alias("title")).distinct()
    citations = read(spark, sf_dir, "chunk").select(F.col("chunk_id").alias("citation_id"), F.when(F.col("chunk_seq") % 2 == 0, F.upper("book_title")).otherwise(F.col("book_id")).alias("title")).distinct()
    return S.cited_books(citations, library)


def clean_answers(spark, sf_dir):
    """Answers without citations, and whether they share a long word with their question's first ones."""
    rows = read(spark, sf_dir, "ask_log").where("full_text is not null and question is not null").select("ask_id", "question", "full_text").distinct()
    cited = F.concat("full_text", F.lit(" [Book: b | Page: 1-2]"))
    return rows.select("ask_id", S.without_citations(cited).alias("answer"), S.highlighted(F.col("full_text"), F.col("question")).alias("highlighted"))


def newest_state(spark, sf_dir):
    """The last event of each user as its state: later loads win, loading twice changes nothing."""
    rows = _events(spark, sf_dir).select("user_id", "event_id", "event_type", "at")
    return R.upsert(rows.where("event_id % 2 = 0"), rows.unionByName(rows), ["user_id"], F.struct("at", "event_id")).select("user_id", "event_id", "event_type")


def document_updates(spark, sf_dir):
    """Documents after updates: the last purchase set, the clicks counted."""
    rows = _events(spark, sf_dir).select("user_id", "event_id", "at", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("last_purchase"), F.when(F.col("event_type") == "click", 1).otherwise(0).cast("long").alias("n_clicks"))
    return S.applied(rows, ["user_id"], ["at", "event_id"], ["last_purchase"], ["n_clicks"])


def _mentions(spark, sf_dir):
    from .knowledge import _mentions as mentions

    return mentions(spark, sf_dir)


def cooccurrence_twice(spark, sf_dir):
    """Co-occurrences loaded twice into a graph that adds them up."""
    once = graph.cooccurrence(_mentions(spark, sf_dir))
    return graph.accumulated(once, once).withColumn("sections", F.array_join("sections", "|"))


def entity_types(spark, sf_dir):
    """Entity nodes with their merged type."""
    spec = read(spark, sf_dir, "spec").select("spec_id", "book_id", "subject").distinct()
    return graph.entity_nodes(_mentions(spark, sf_dir).withColumn("label", F.lit("Entity")), spec)


def table_nodes(spark, sf_dir):
    """Table nodes and their rows, by table."""
    nodes = graph.table_nodes(read(spark, sf_dir, "chunk"))
    rows = graph.table_row_nodes(read(spark, sf_dir, "table_row")).groupBy("book_id", F.regexp_replace("id", "_row_[0-9]+$", "").alias("id")).agg(F.count("*").alias("n_row_nodes"), F.count("value").alias("n_values"))
    return nodes.join(rows, ["book_id", "id"], "left")


def prop_vector_topk(spark, sf_dir):
    """The nearest propositions of each stated question, over all books, by the vectors of the stand-in model, as many as its limit."""
    s = Stages(spark, sf_dir)
    props = s.props.select("proposition_id", "text", "book_id")
    asked = models.embedded(s.questions.select("query_id", "question"), "question", prefix=models.QUERY_PREFIX)
    found = V.vector_topk(models.embedded(props, "text"), asked, max(m[0] for m in K.MODES.values()), key="proposition_id")
    limited = found.join(s.questions.select("query_id", "prop_limit"), "query_id").where(F.col("rank") <= F.col("prop_limit"))
    return limited.select("query_id", "proposition_id", "score", "rank")


def graph_report(spark, sf_dir):
    """The counters of a load: mentions, entities, specifications, paths."""
    mentions, chunk = _mentions(spark, sf_dir), read(spark, sf_dir, "chunk")
    counts = mentions.agg(F.count("*").alias("mentions"), F.count_distinct("book_id", "name").alias("entities"))
    paths = chunk.agg(F.count_distinct("book_id", F.array_join("section_path", ">>")).alias("section_paths"))
    specs = graph.spec_nodes(read(spark, sf_dir, "spec")).agg(F.count("*").alias("specs"))
    return counts.select("mentions", "entities", specs.scalar().alias("specs"), paths.scalar().alias("section_paths"))


def multi_chunk_pages(spark, sf_dir):
    """Pages on which several chunks start."""
    rows = read(spark, sf_dir, "chunk").where("page_range.start is not null").select("chunk_id", "book_id", F.col("page_range.start").alias("page")).distinct()
    return rows.groupBy("book_id", "page").agg(F.count("*").alias("n_chunks")).where("n_chunks > 1")


def chunk_log(spark, sf_dir):
    """The log of chunks in the form that the coverage report of the model reads."""
    return formats.chunk_log(read(spark, sf_dir, "chunk")).select("page_number", "text", "chunk_id", "chunk_type", F.array_join("section_path", " > ").alias("section_path"), "book_id")


def vector_payloads(spark, sf_dir):
    """The payloads of both collections with their point ids."""
    props, sections = formats.payloads(read(spark, sf_dir, "proposition"), read(spark, sf_dir, "chunk"))
    shape = lambda df, name: df.select(F.lit(name).alias("collection"), "point_id", "key", "book_id", "page", "text")
    return shape(props, "propositions").unionByName(shape(sections, "sections"))


def entity_windows(spark, sf_dir):
    """The windows that a recognition model reads."""
    rows = read(spark, sf_dir, "chunk").where("type = 'text' and content is not null").select("chunk_id", "content").distinct()
    return rows.select("chunk_id", F.posexplode(G.windows("content", 500)).alias("n", "window"))


def chunk_segments(spark, sf_dir):
    """The segments of the text chunks."""
    rows = read(spark, sf_dir, "chunk").where("type = 'text' and content is not null").select("chunk_id", "content").distinct()
    return rows.select("chunk_id", F.posexplode(G.segments(X.strip("content"), K.SEGMENT_WORDS)).alias("n", "segment"))


def overlapping_windows(spark, sf_dir):
    """Overlapping windows of 100 words over the text chunks."""
    rows = read(spark, sf_dir, "chunk").where("type = 'text' and content is not null").select("chunk_id", "content").distinct()
    return rows.select("chunk_id", F.posexplode(G.overlapping("content", 100)).alias("n", "window"))


def hybrid_topk(spark, sf_dir):
    """Parents of proposition hits and twice as many BM25 hits, fused and cut to the limit."""
    s = Stages(spark, sf_dir)
    parents = L.top_per(s.parents(), "query_id", [F.desc("child_score"), F.asc("chunk_id")], 1 << 30)
    pool = search(s.texts, "chunk_id", s.questions.withColumn("pool", F.col("sect_limit") * K.HYBRID_POOL), "pool", s.repeated_chunks)
    limits = s.questions.select("query_id", "sect_limit")
    fused = L.fuse(pool, parents, "query_id", "chunk_id", K.RRF_K).join(limits, "query_id")
    return L.top_per(fused, "query_id", [F.desc("rrf_score"), F.asc("chunk_id")], F.col("sect_limit")).select("query_id", "chunk_id", "rrf_score", "rank")


def recent_chats(spark, sf_dir):
    """The ten chats with the newest questions."""
    rows = read(spark, sf_dir, "ask_log").groupBy("chat_id").agg(F.max("asked_at").cast("string").alias("updated_at"))
    return rows.orderBy(F.desc("updated_at"), "chat_id").limit(10)


def removed_book(spark, sf_dir):
    """Rows left in every collection after a book was deleted."""
    gone = read(spark, sf_dir, "chunk").where("book_id = 'orbital_plant_manual'").select("book_id").distinct()
    parts = [R.without(read(spark, sf_dir, t), "book_id", gone).groupBy(F.lit(t).alias("collection")).agg(F.count("*").alias("n")) for t in ("chunk", "proposition", "page", "spec", "table_row")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])


def page_fallback(spark, sf_dir):
    """The text of every page: that of the page table, else of the chunks that cover it."""
    return formats.page_texts(read(spark, sf_dir, "page"), read(spark, sf_dir, "chunk"))


QUERIES = {
    f.__name__: f
    for f in (
        page_tables, page_contents, unit_barriers, active_units, worker_waits, stages_left, replayed_results, batch_rollup, phase_progress, upload_problems, missing_parents, worker_log_tail, resolved_paths,
        folder_signatures, coerced_ids, cited_books, clean_answers, newest_state, document_updates, cooccurrence_twice, entity_types, table_nodes, prop_vector_topk, graph_report, multi_chunk_pages, chunk_log, vector_payloads, entity_windows,
        chunk_segments, overlapping_windows, hybrid_topk, recent_chats, removed_book, page_fallback,
    )
}

_EV = "ev AS (SELECT *, epoch_us(ts) / 1e6 AS moment FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"
_UNITS = f"""{_EV}, un0 AS (SELECT user_id, arg_max(event_type, (moment, event_id)) AS e, max(moment) AS moment FROM ev GROUP BY user_id),
units AS (SELECT user_id, user_id % 100 AS book_id, ['extraction', 'vectors', 'graph'][(user_id % 3)::INT + 1] AS kind, CASE e WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'PROCESSING' ELSE 'PENDING' END AS status, moment FROM un0)"""
_names = lambda words: "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"
_at = lambda names, words: f"list_position({names}, list_filter({names}, lambda x: list_contains({_names(words)}, x))[1])"
_PAGES = f"""{LINES}, pr0 AS (SELECT book_id, run, coalesce(max(marker), 0) AS page, {_STRIP("coalesce(string_agg(CASE WHEN marker IS NULL THEN line END, chr(10) ORDER BY chunk_seq, pos), '')")} AS content FROM paged GROUP BY book_id, run),
pp AS (SELECT book_id, page, arg_max(content, run) AS content FROM pr0 WHERE content <> '' GROUP BY book_id, page)"""


def _bullets(headers: str, rows: str, label: str) -> str:
    """A list made from the arrays of headers and rows."""
    names = f"list_transform({headers}, lambda x: lower(x))"
    p, v, u = (_at(names, w) for w in (P.PARAMETER_HEADERS, P.VALUE_HEADERS, P.UNIT_HEADERS))
    cell = lambda i: f"coalesce(r[{i}], '')"
    whole = f"array_to_string(list_filter(list_transform(range(1, len({headers}) + 1), lambda i: CASE WHEN coalesce(r[i], '') <> '' THEN {headers}[i] || ': ' || r[i] END), lambda x: x IS NOT NULL), ' | ')"
    item = f"CASE WHEN {cell(p)} <> '' AND {cell(v)} <> '' THEN {cell(p)} || ': ' || {cell(v)} || CASE WHEN {cell(u)} <> '' THEN ' ' || {cell(u)} ELSE '' END ELSE {whole} END"
    items = f"list_filter(list_transform({rows}, lambda r: {item}), lambda x: x <> '')"
    head = f"CASE WHEN coalesce({label}, '') = '' THEN '[TABLE]:' ELSE '[TABLE — ' || {label} || ']:' END"
    return f"CASE WHEN len({items}) > 0 THEN {head} || chr(10) || array_to_string(list_transform({items}, lambda x: '  - ' || x), chr(10)) ELSE '' END"


_FOUND = f"""{_PAGES},
pl AS (SELECT book_id, page, unnest(range(0, len(string_split(content, chr(10)))))::INT AS line_no, unnest(string_split(content, chr(10))) AS line FROM pp),
pt AS (SELECT *, starts_with({_STRIP("line")}, '|') OR length(line) - length(replace(line, '|', '')) >= 2 AS is_table FROM pl),
ph0 AS (SELECT *, coalesce((is_table <> lag(is_table) OVER w)::INT, 1) AS ch, CASE WHEN NOT is_table AND regexp_matches({_STRIP("line")}, '^(#{{1,3}})\\s+(\\S.*)$') AND NOT regexp_matches({_STRIP("line")}, '^##\\s*---\\s*PAGE\\s+([0-9]+)\\s*---') THEN {_STRIP(f"regexp_extract({_STRIP('line')}, '^(#{{1,3}})\\s+(\\S.*)$', 2)")} END AS heading
  FROM pt WINDOW w AS (PARTITION BY book_id, page ORDER BY line_no)),
pu AS (SELECT *, sum(ch) OVER w AS run, last_value(heading IGNORE NULLS) OVER w AS label FROM ph0 WINDOW w AS (PARTITION BY book_id, page ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
pg0 AS (SELECT book_id, page, run, min(line_no) AS start_line, max(line_no) AS end_line, min(label) AS label, list(line ORDER BY line_no) AS l, bool_or(is_table) AS t FROM pu GROUP BY ALL),
pc0 AS (SELECT *, list_filter(list_transform(list_filter(l, lambda x: NOT regexp_matches({_STRIP("x")}, '^[|\\-][|\\-:\\s]*$')), lambda x: list_filter(list_transform(string_split(regexp_replace(regexp_replace({_STRIP("x")}, '^\\|', ''), '\\|$', ''), '|'), lambda y: {_STRIP("y")}), lambda y: y <> '')), lambda c: len(c) > 0) AS c,
  list_filter(list_transform(string_split(regexp_replace(regexp_replace({_STRIP("l[1]")}, '^\\|', ''), '\\|$', ''), '|'), lambda y: {_STRIP("y")}), lambda y: y <> '') AS headers FROM pg0 WHERE t AND len(l) >= 2),
pf AS (SELECT book_id, page, start_line, end_line, headers, label, array_to_string(l, chr(10)) AS raw, coalesce({_bullets("coalesce(c[1], [])", "c[2:]", "label")}, '') AS bullets FROM pc0)"""
_last = "string_split(acc, chr(1))[-1]"
_words = lambda x: rf"CASE WHEN {_STRIP(x)} = '' THEN 0 ELSE len(regexp_split_to_array({_STRIP(x)}, '[\s\p{{Z}}]+')) END"
_loose = rf"list_filter(list_transform(string_split(regexp_replace({_STRIP('content')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {_STRIP('x')}), lambda x: x <> '')"
_texts = "FROM (SELECT DISTINCT chunk_id, content FROM chunk WHERE type = 'text' AND content IS NOT NULL)"
_slug = lambda x: f"lower(regexp_replace(regexp_replace(trim({x}), '[^A-Za-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'))"
_uuid = lambda key: __import__("docloom.plans.documents", fromlist=["_uuid5"])._uuid5(key)

SQL = {
    "page_tables": f"WITH {_FOUND} SELECT book_id, page, start_line, end_line, array_to_string(headers, '|') AS headers, label, bullets FROM pf",
    "page_contents": f"""WITH {_FOUND}, {PARSED},
        kt AS (SELECT tc.chunk_id, tc.book_id, tc.chunk_seq, unnest(range(tc.page_range.start, greatest(tc.page_range.start, coalesce(tc.page_range."end", tc.page_range.start)) + 1)) AS page, th.headers AS h, list_transform(th.headers, lambda x: lower(regexp_replace(x, '\\s+', ' ', 'g'))) AS names,
          (SELECT list(cells ORDER BY row_index) FROM trows WHERE trows.chunk_id = tc.chunk_id) AS rws FROM tc JOIN th USING (chunk_id) WHERE tc.page_range.start IS NOT NULL AND len(th.headers) > 0),
        km AS (SELECT pf.book_id, pf.page, start_line, arg_min({{'h': h, 'r': coalesce(rws, []), 'l': label}}, (chunk_seq, kt.chunk_id)) AS m FROM pf JOIN kt ON pf.book_id = kt.book_id AND pf.page = kt.page
          WHERE len(list_filter(list_transform(headers, lambda x: lower(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: list_contains(names, x))) >= greatest(1, floor(0.6 * least(len(headers), len(names)))) GROUP BY ALL),
        kb AS (SELECT book_id, page, start_line, {_bullets("m.h", "m.r", "m.l")} AS better FROM km),
        kx AS (SELECT p.book_id, p.page, p.start_line, CASE WHEN p.t AND len(p.l) >= 2 THEN coalesce(nullif(better, ''), nullif(bullets, ''), raw) ELSE array_to_string(p.l, chr(10)) END AS part FROM pg0 p LEFT JOIN pf USING (book_id, page, start_line) LEFT JOIN kb USING (book_id, page, start_line))
        SELECT book_id, page, {_STRIP("regexp_replace(regexp_replace(" + _STRIP("string_agg(part, chr(10) ORDER BY start_line)") + ", '##\\s*---\\s*PAGE\\s+([0-9]+)\\s*---', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS content FROM kx GROUP BY book_id, page""",
    "unit_barriers": f"WITH {_UNITS} SELECT book_id, count(*) AS total, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status IN ('COMPLETED', 'FAILED')) = count(*) AS finished, round(CASE WHEN count(*) FILTER (status IN ('COMPLETED', 'FAILED')) = count(*) THEN max(moment) FILTER (status IN ('COMPLETED', 'FAILED')) + {S.CLEANUP} END, 3) AS cleanup_at FROM units GROUP BY book_id",
    "active_units": f"WITH {_UNITS} SELECT coalesce(kind, 'all') AS kind, coalesce(book_id::VARCHAR, 'all') AS book, count(*) AS n_active FROM units WHERE status IN ('PENDING', 'PROCESSING') GROUP BY ROLLUP (kind, book_id)",
    "worker_waits": f"""WITH {_UNITS}, w AS (SELECT kind, user_id // 3 AS r, moment, status = 'PROCESSING' AS busy FROM units WHERE user_id // 3 < 10), p AS (SELECT kind, count(*) % 4 AS n FROM units WHERE status = 'PENDING' GROUP BY kind),
        q AS (SELECT event_id, ['extraction', 'vectors', 'graph'][(user_id % 3)::INT + 1] AS kind, least(user_id // 3, 10) AS r, moment FROM ev WHERE event_type = 'view'),
        c AS (SELECT q.event_id, q.kind, count(*) FILTER (w.r < q.r AND q.moment - w.moment <= {S.GRACE} AND NOT w.busy) AS idle FROM q LEFT JOIN w ON w.kind = q.kind GROUP BY ALL)
        SELECT event_id AS request_id, idle > 0 AND coalesce(n, 0) <= idle AS wait FROM c LEFT JOIN p USING (kind)""",
    "stages_left": "WITH w AS (SELECT DISTINCT book_id, unnest(['chunks', 'propositions', 'graph', 'answers']) AS stage FROM page) SELECT * FROM w EXCEPT (SELECT book_id, 'chunks' FROM chunk UNION SELECT book_id, 'propositions' FROM proposition UNION SELECT book_id, 'graph' FROM spec)",
    "replayed_results": f"WITH {_EV} SELECT CASE WHEN event_id % 7 = 0 THEN 'skipped' WHEN event_id % 5 <> 0 AND event_type <> 'error' THEN 'cleared' ELSE 'kept' END AS action, count(*) AS n FROM ev GROUP BY 1",
    "batch_rollup": "WITH p AS (SELECT DISTINCT proposition_id, book_id, prop_seq, source_type FROM proposition) SELECT book_id, count(DISTINCT prop_seq // 200) AS n_batches, count(*) AS n_points, count(*) FILTER (source_type = 'text') AS n_text FROM p GROUP BY book_id",
    "phase_progress": f"WITH {_UNITS} SELECT book_id, least({S.PHASE_BASE} + floor((count(*) FILTER (status = 'COMPLETED') * 100.0 / count(*) + count(*) FILTER (status = 'FAILED') * 100.0 / count(*)) / 2 * {S.PHASE_SHARE})::INT, {S.PHASE_CAP}) AS percent FROM units GROUP BY book_id",
    "upload_problems": """WITH u AS (SELECT CASE doc_id % 4 WHEN 0 THEN source || '-' || doc_id WHEN 1 THEN title ELSE source END AS b, doc_id % 3 = 0 AS txt FROM documents), l AS (SELECT DISTINCT source FROM documents WHERE doc_id % 40 = 2), j AS (SELECT DISTINCT source FROM documents WHERE doc_id % 40 = 3)
        SELECT CASE WHEN NOT coalesce(regexp_matches(b, '^[A-Za-z0-9_\\-]+$'), false) THEN 'bad_id' WHEN txt THEN 'no_pdf' WHEN b IN (SELECT source FROM l) THEN 'duplicate' WHEN b IN (SELECT source FROM j) THEN 'active_job' END AS problem, count(*) AS n FROM u GROUP BY 1""",
    "missing_parents": "SELECT DISTINCT chunk_id FROM chunk WHERE chunk_id NOT IN (SELECT parent_chunk_id FROM proposition WHERE parent_chunk_id IS NOT NULL)",
    "worker_log_tail": f"WITH {_EV} SELECT * FROM (SELECT user_id % 10 AS worker_id, event_type || ' ' || event_id AS line, row_number() OVER (PARTITION BY user_id % 10 ORDER BY moment DESC, event_type || ' ' || event_id DESC)::INT AS place FROM ev) WHERE place <= 50",
    "resolved_paths": f"""WITH b AS (SELECT book_id, coalesce(min(book_title), '') AS title FROM chunk GROUP BY book_id), f AS (SELECT CASE length(book_id) % 3 WHEN 0 THEN replace(book_id, '_', '-') WHEN 1 THEN upper(book_id) ELSE 'x' || book_id END AS name FROM b),
        n AS (SELECT book_id, unnest([book_id, {_slug("book_id")}, replace(book_id, '-', '_'), replace(book_id, '_', '-'), title, {_slug("title")}]) AS name FROM b),
        h AS (SELECT book_id, 1 AS k, f.name FROM n JOIN f ON f.name = n.name WHERE n.name <> '' UNION ALL SELECT book_id, 2, f.name FROM n JOIN f ON {_slug("f.name")} = {_slug("n.name")} WHERE n.name <> '' AND {_slug("f.name")} <> '')
        SELECT book_id, 'raw/' || arg_min(name, (k, 'raw/' || name || '.pdf')) || '.pdf' AS path FROM h GROUP BY book_id""",
    "folder_signatures": "SELECT event_type AS folder, count(*) || '-' || sum(length(props)) || '-' || max(floor(epoch_us(ts) / 1e6)::BIGINT) AS signature FROM events GROUP BY event_type",
    "coerced_ids": "SELECT DISTINCT ask_id, trim(b) AS book_id FROM (SELECT ask_id, unnest(book_ids) AS b FROM ask_log)",
    "cited_books": "WITH l AS (SELECT lower(book_title) AS k, min(book_id) AS b FROM chunk WHERE book_title IS NOT NULL GROUP BY 1), c AS (SELECT DISTINCT chunk_id, CASE WHEN chunk_seq % 2 = 0 THEN upper(book_title) ELSE book_id END AS t FROM chunk) SELECT chunk_id AS citation_id, coalesce(b, t) AS book_id FROM c LEFT JOIN l ON k = lower(t)",
    "clean_answers": "SELECT ask_id, trim(regexp_replace(full_text, '\\s+$', '')) AS answer, coalesce(len(list_filter(list_filter(regexp_split_to_array(lower(question), '\\s+'), lambda w: length(w) > 4)[1:15], lambda w: contains(lower(full_text), w))) > 0, false) AS highlighted FROM (SELECT DISTINCT ask_id, question, full_text FROM ask_log WHERE full_text IS NOT NULL AND question IS NOT NULL)",
    "newest_state": f"WITH {_EV} SELECT user_id, arg_max(event_id, (moment, event_id)) AS event_id, arg_max(event_type, (moment, event_id)) AS event_type FROM ev GROUP BY user_id",
    "document_updates": f"WITH {_EV} SELECT user_id, arg_max(event_id, (moment, event_id)) FILTER (event_type = 'purchase') AS last_purchase, count(*) FILTER (event_type = 'click') AS n_clicks FROM ev GROUP BY user_id",
    "cooccurrence_twice": f"""WITH {MENTIONS}, d AS (SELECT DISTINCT chunk_id, book_id, section, pos, name FROM ms), p AS (SELECT x.book_id, x.name AS a, y.name AS b, x.section FROM d x JOIN d y ON x.chunk_id = y.chunk_id AND x.pos = y.pos AND x.name < y.name)
        SELECT book_id, a, b, 2 * count(*) AS n, array_to_string(list_sort(list(DISTINCT section))[1:20], '|') AS sections FROM p GROUP BY book_id, a, b""",
    "entity_types": f"WITH {MENTIONS}, u AS (SELECT book_id, lower(name) AS name, 'Entity' AS type, 0 AS o FROM ms UNION ALL SELECT book_id, lower(subject), 'equipment', 1 FROM (SELECT DISTINCT spec_id, book_id, subject FROM spec WHERE subject IS NOT NULL)) SELECT book_id, name, arg_min(type, o) AS type, count(*) AS n FROM u GROUP BY book_id, name",
    "table_nodes": """WITH t AS (SELECT DISTINCT book_id, chunk_id, chunk_seq, section_path, headers, coalesce(len("rows"), 0) AS n FROM chunk WHERE type = 'table'), r AS (SELECT book_id, regexp_replace(id, '_row_[0-9]+$', '') AS id, count(DISTINCT id) AS n_row_nodes, count(DISTINCT id) FILTER (value IS NOT NULL) AS n_values FROM table_row GROUP BY ALL)
        SELECT t.book_id, t.chunk_id AS id, CASE WHEN coalesce(section_path[len(section_path)], '') = '' THEN 'Table' ELSE 'Table: ' || section_path[len(section_path)] END AS title, array_to_string(headers, '|') AS headers, n::INT AS row_count, coalesce(section_path[len(section_path)], '') AS section, n_row_nodes, n_values
        FROM t LEFT JOIN r ON r.book_id = t.book_id AND r.id = t.chunk_id""",
    "graph_report": f"WITH {MENTIONS} SELECT count(*) AS mentions, count(DISTINCT (book_id, name)) AS entities, (SELECT count(DISTINCT (book_id, subject, lower(coalesce(unit, '')))) FROM spec) AS specs, (SELECT count(DISTINCT (book_id, array_to_string(section_path, '>>'))) FROM chunk WHERE section_path IS NOT NULL) AS section_paths FROM ms",
    "multi_chunk_pages": "SELECT book_id, page_range.start AS page, count(DISTINCT chunk_id) AS n_chunks FROM chunk WHERE page_range.start IS NOT NULL GROUP BY ALL HAVING count(DISTINCT chunk_id) > 1",
    "chunk_log": "SELECT coalesce(page_range.start, 0) AS page_number, CASE WHEN type = 'text' THEN coalesce(content, '') ELSE coalesce(nullif(linearized_text, ''), content, '') END AS text, chunk_id, type AS chunk_type, coalesce(array_to_string(section_path, ' > '), '') AS section_path, book_id FROM (SELECT DISTINCT chunk_id, book_id, page_range, type, content, linearized_text, section_path FROM chunk)",
    "vector_payloads": f"""WITH p AS (SELECT DISTINCT proposition_id, book_id, page, text FROM proposition), c AS (SELECT DISTINCT chunk_id, book_id, page_range, type, content, linearized_text FROM chunk),
        t AS (SELECT *, CASE WHEN type = 'text' THEN {_STRIP("content")} ELSE coalesce(nullif({_STRIP("linearized_text")}, ''), {_STRIP("content")}) END AS x FROM c)
        SELECT 'propositions' AS collection, {_uuid("'prop::' || proposition_id")} AS point_id, proposition_id AS key, book_id, coalesce(page, 0) AS page, text FROM p WHERE text IS NOT NULL UNION ALL SELECT 'sections', {_uuid("'section::' || chunk_id")}, chunk_id, book_id, coalesce(page_range.start, 0), x FROM t WHERE length(x) >= 20""",
    "entity_windows": f"""WITH s AS (SELECT chunk_id, list_reduce(list_concat([''], string_split(regexp_replace({_STRIP("replace(content, chr(10), ' ')")}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))), lambda acc, s: CASE WHEN length(s) > 500 THEN
          acc || chr(1) || array_to_string(list_filter(list_transform(range(0, length(s), 500), lambda i: substr(s, i + 1, 500)), lambda x: length(x) > 10), chr(1)) || chr(1) WHEN length({_last}) + length(s) < 500 THEN acc || ' ' || s ELSE acc || chr(1) || s END) AS a {_texts}),
        w AS (SELECT chunk_id, list_filter(list_transform(string_split(a, chr(1)), lambda x: {_STRIP("x")}), lambda x: length(x) >= 5) AS ws FROM s) SELECT chunk_id, unnest(range(0, len(ws)))::INT AS n, unnest(ws) AS "window" FROM w""",
    "chunk_segments": f"""WITH s AS (SELECT chunk_id, {_loose} AS p {_texts}), r AS (SELECT chunk_id, string_split(list_reduce(p, lambda acc, x: CASE WHEN {_words(_last)} + {_words("x")} <= {K.SEGMENT_WORDS} THEN acc || ' ' || x ELSE acc || chr(1) || x END), chr(1)) AS ps FROM s WHERE len(p) > 0)
        SELECT chunk_id, unnest(range(0, len(ps)))::INT AS n, unnest(ps) AS segment FROM r""",
    "hybrid_topk": BOTH.rstrip().rstrip(",") + "," + _bm25("wide_h", "chunks", "chunk_id", "content", "2 * sect_limit") + f""", wp AS (SELECT w.query_id, chunk_id, rank FROM wide_h w JOIN questions USING (query_id) WHERE rank <= 2 * sect_limit), fu AS (SELECT query_id, chunk_id, round(1 / ({K.RRF_K} + coalesce(d.rank, 1000000)) + 1 / ({K.RRF_K} + coalesce(p.rank, 1000000)), 6) AS rrf_score FROM wp d FULL JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY child_score DESC, chunk_id) AS rank FROM parents) p USING (query_id, chunk_id))
        SELECT query_id, chunk_id, rrf_score, rank FROM (SELECT query_id, chunk_id, rrf_score, sect_limit, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id)::INT AS rank FROM fu JOIN questions USING (query_id)) WHERE rank <= sect_limit""",
    "recent_chats": "SELECT chat_id, max(asked_at)::VARCHAR AS updated_at FROM ask_log GROUP BY chat_id ORDER BY updated_at DESC, chat_id LIMIT 10",
    "removed_book": " UNION ALL ".join(f"SELECT '{t}' AS collection, count(*) AS n FROM {t} WHERE book_id <> 'orbital_plant_manual'" for t in ("chunk", "proposition", "page", "spec", "table_row")),
    "page_fallback": f"""WITH p AS (SELECT book_id, page_number AS page, min(full_content) AS t FROM page GROUP BY ALL), c0 AS (SELECT DISTINCT chunk_id, book_id, chunk_seq, page_range, content FROM chunk WHERE page_range.start IS NOT NULL AND content IS NOT NULL),
        c1 AS (SELECT book_id, chunk_seq, chunk_id, content, unnest(range(page_range.start, greatest(page_range.start, coalesce(page_range."end", page_range.start)) + 1)) AS page FROM c0), c AS (SELECT book_id, page, string_agg(content, chr(10) || chr(10) ORDER BY chunk_seq, chunk_id) AS t FROM c1 GROUP BY ALL)
        SELECT book_id, page::INT AS page, coalesce(nullif(p.t, ''), c.t) AS text, CASE WHEN nullif(p.t, '') IS NOT NULL THEN 'metadata' ELSE 'chunks' END AS origin FROM p FULL JOIN c USING (book_id, page) WHERE coalesce(nullif(p.t, ''), c.t) IS NOT NULL""",
}
