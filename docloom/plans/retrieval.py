"""Queries of retrieval: search, fusion, stages, context; with their SQL. Questions are those of ask_log whose id is divisible by 100."""

from __future__ import annotations

from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import graph as G
from docloom.operators import context as C
from docloom.operators import lexical as L
from docloom.operators import propositions as P
from docloom.operators import reports
from docloom.operators import retrieval as R
from docloom.operators import vectors as V
from docloom.plans import config as K
from docloom.session import broadcast_checked, cut, distinct_rows, read, release, repeated_keys

from .documents import MESSAGES, PARSED, PIPE_TABLES
from .graph_sql import HIERARCHY, MENTIONS


class Stages:
    """The stages over one data folder, each built when it is asked for. What several stages read is cut once."""

    def __init__(self, spark: SparkSession, sf_dir: str, every: int | None = None):
        self.read = partial(read, spark, sf_dir)
        self.questions = R.routed_questions(self.read("ask_log"), every)
        self._kept: dict = {}

    @cached_property
    def repeated_chunks(self) -> DataFrame:
        return repeated_keys(self.read("chunk"), "chunk_id")

    @cached_property
    def repeated_props(self) -> DataFrame:
        return repeated_keys(self.read("proposition"), "proposition_id")

    @cached_property
    def chunks(self) -> DataFrame:
        rows = self.read("chunk").select("chunk_id", "book_id", "chunk_seq", "section_path", "page_range", "type", "content", "linearized_text")
        return distinct_rows(rows, "chunk_id", self.repeated_chunks)

    @cached_property
    def texts(self) -> DataFrame:
        return self.chunks.select("chunk_id", "book_id", F.col("content").alias("text")).where(F.col("content").isNotNull())

    @cached_property
    def props(self) -> DataFrame:
        rows = self.read("proposition").select("proposition_id", "text", "parent_chunk_id", "section_path", "page", "book_id")
        return distinct_rows(rows, "proposition_id", self.repeated_props).where(F.col("text").isNotNull())

    def kept(self, name: str, build) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = cut(build())
            release(self._kept[name].sparkSession)  # the exchanges of a stage aren't read again
        return self._kept[name]

    def _hits(self, name: str, questions: DataFrame) -> DataFrame:
        def build():
            hits = R.search(self.props.select("proposition_id", "book_id", "text"), "proposition_id", questions, "prop_limit", self.repeated_props)
            return broadcast_checked(cut(hits)).join(self.props.select("proposition_id", "parent_chunk_id", "section_path", "book_id"), "proposition_id")

        return self.kept(name, build)

    def _wide(self, name: str, questions: DataFrame) -> DataFrame:
        wider = questions.withColumn("wide", F.col("sect_limit") + K.MIN_PARENTS * K.SUPPLEMENT)
        return self.kept(name, lambda: R.search(self.texts, "chunk_id", wider, "wide", self.repeated_chunks))

    def _direct(self, wide: DataFrame, questions: DataFrame) -> DataFrame:
        return wide.join(questions.select("query_id", "sect_limit"), "query_id").where(F.col("rank") <= F.col("sect_limit")).select("query_id", "chunk_id", "score", "rank")

    def _merged(self, name: str, hits: DataFrame, wide: DataFrame, questions: DataFrame) -> DataFrame:
        """Kept in steps: as one plan, which reads the chunks in each of its parts, it takes some 200 MB more of the driver (0.7 GB of tables)."""
        parents = self.kept(f"parents{name}", lambda: R.parents_of(hits, self.chunks))
        orphans = self.kept(f"orphans{name}", lambda: R.orphan_parents(hits, self.chunks))
        direct = R.supplemented(self._direct(wide, questions), wide, parents, questions)
        return self.kept(f"merged{name}", lambda: R.with_text(R.merged(parents, orphans, direct), self.chunks))

    def prop_hits(self) -> DataFrame:
        return self._hits("props", self.questions)

    def direct(self) -> DataFrame:
        return self._direct(self._wide("wide", self.questions), self.questions)

    def parents(self) -> DataFrame:
        return R.parents_of(self.prop_hits(), self.chunks)

    def entity_sections(self) -> DataFrame:
        def build():
            chunk = self.read("chunk")
            mentions = G.entity_mentions(P.section_sentences(chunk, self.repeated_chunks))
            return G.entity_sections(mentions, G.hierarchy(chunk)[0])

        return self.kept("entity_sections", build)

    def flagged(self, merged: DataFrame, questions: DataFrame) -> DataFrame:
        return R.from_graph(merged, self.chunks, questions, self.entity_sections())

    def candidates(self) -> DataFrame:
        def build():
            return self.flagged(self._merged("", self.prop_hits(), self._wide("wide", self.questions), self.questions), self.questions)

        return self.kept("candidates", build)

    def ranked(self) -> DataFrame:
        return self.kept("ranked", lambda: R.reranked(self.candidates(), self.chunks, self.questions))

    def ranked_chunks(self) -> DataFrame:
        """The chunks of the ranked candidates: few, and their texts are read by several stages."""

        def build():
            keys = broadcast_checked(cut(self.ranked().select("chunk_id").distinct()))
            return self.chunks.join(keys, "chunk_id", "left_semi")

        return self.kept("ranked_chunks", build)

    def adaptive(self, threshold: float = K.ADAPTIVE_STANDIN) -> DataFrame:
        """The ranking after the second pass: failing questions are searched again with wider limits, merged with what was found, and reranked from a wider pool."""
        failing = cut(R.needs_second_pass(self.ranked(), self.questions, threshold))
        wider = cut(R.widened(self.questions, failing))
        again = self._merged("_again", self._hits("props_again", wider), self._wide("wide_again", wider), wider)
        first = self.candidates().join(wider.select("query_id"), "query_id", "left_semi")
        both = self.flagged(R.second_pass(first, again), wider)
        reranked = R.reranked(both, self.chunks, wider, factor=K.ADAPTIVE_FACTOR)
        kept = self.ranked().join(failing.select("query_id"), "query_id", "left_anti")
        return kept.withColumn("pass", F.lit(1)).unionByName(reranked.withColumn("pass", F.lit(2)))

    def expanded(self) -> DataFrame:
        return self.kept("expanded", lambda: C.expansions(self.ranked(), self.ranked_chunks(), self.questions, self.read("page")))

    def pages(self) -> DataFrame:
        return self.kept("pages", lambda: C.trimmed(self.expanded(), self.read("page")))

    def specs(self) -> DataFrame:
        return self.kept("specs", lambda: C.specs_block(G.spec_lookup(R.question_terms(self.questions), self.read("spec"))))

    def items(self) -> DataFrame:
        return self.kept("items", lambda: C.items_of(self.ranked(), self.pages(), self.ranked_chunks(), self.questions))

    def packed(self, priority: bool = False) -> DataFrame:
        return self.kept(f"packed_{priority}", lambda: C.pack(self.items(), self.questions, self.specs(), priority))


def classify_questions(spark, sf_dir):
    """The class of every question."""
    rows = read(spark, sf_dir, "ask_log").select("ask_id", "question").distinct()
    return rows.select("ask_id", X.classify_question("question").alias("query_class"))


def route_limits(spark, sf_dir):
    """The limits of the stated questions."""
    return R.routed_questions(read(spark, sf_dir, "ask_log")).select("query_id", "mode", "query_class", "prop_limit", "sect_limit", "top_n", "max_chars", "history_pairs", "boost", "page_range", "cross_book")


def bm25_stats(spark, sf_dir):
    """Document frequency and idf of every term of the chunks."""
    s = Stages(spark, sf_dir)
    return L.term_statistics(s.texts, "chunk_id", "text").select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, sf_dir):
    """The best chunks of each question."""
    return Stages(spark, sf_dir).direct()


def prop_topk(spark, sf_dir):
    """The best propositions of each question."""
    return Stages(spark, sf_dir).prop_hits().select("query_id", "proposition_id", "score", "rank")


def _vectors(spark, sf_dir):
    points = read(spark, sf_dir, "embeddings")
    return points, points.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def vector_topk(spark, sf_dir):
    """The nearest points of the stated query vectors."""
    points, queries = _vectors(spark, sf_dir)
    return V.vector_topk(points, queries, 20)


def two_stage_topk(spark, sf_dir):
    """The nearest points, rescored by late interaction."""
    points, queries = _vectors(spark, sf_dir)
    return V.two_stage(points, queries, 10)


def mmr_select(spark, sf_dir):
    """A diverse choice of the nearest points."""
    points, queries = _vectors(spark, sf_dir)
    hits = V.vector_topk(points, queries, 20).select("query_id", "vec_id", "score").join(points.select("vec_id", "embedding"), "vec_id")
    return V.mmr(hits, 5)


def rrf_fuse(spark, sf_dir):
    """Direct hits and parents of proposition hits, fused by their ranks."""
    s = Stages(spark, sf_dir)
    parents = L.top_per(s.parents(), "query_id", [F.desc("child_score"), F.asc("chunk_id")], 1 << 30)
    fused = L.fuse(s.direct(), parents, "query_id", "chunk_id", K.RRF_K)
    return fused.select("query_id", "chunk_id", "rrf_score")


def small_to_big(spark, sf_dir):
    """The chunks that proposition hits belong to, with the best child's score."""
    return Stages(spark, sf_dir).parents()


def orphan_fallback(spark, sf_dir):
    """The chunks found by the path of hits without a parent."""
    s = Stages(spark, sf_dir)
    return R.orphan_parents(s.prop_hits(), s.chunks)


def merge_candidates(spark, sf_dir):
    """All candidates with where they come from."""
    return Stages(spark, sf_dir).candidates().select("query_id", "chunk_id", "direct_score", "child_score", "from_direct", "from_graph")


def rerank_boost(spark, sf_dir):
    """The ranked candidates."""
    return Stages(spark, sf_dir).ranked().select("query_id", "chunk_id", "rerank_score", "rank")


def adaptive_second_pass(spark, sf_dir):
    """The questions that need a second pass at a threshold that some miss."""
    s = Stages(spark, sf_dir)
    return R.needs_second_pass(s.ranked(), s.questions, threshold=K.ADAPTIVE_STANDIN)


def adaptive_ranked(spark, sf_dir):
    """The ranked candidates after the second pass of the questions below the threshold; `pass` tells which pass ranked them."""
    return Stages(spark, sf_dir).adaptive().select("query_id", "chunk_id", "rerank_score", "rank", "pass")


def page_expansion(spark, sf_dir):
    """The pages around the first two chunks."""
    return Stages(spark, sf_dir).expanded().select("query_id", "chunk_id", "rank", "book_id", "page", "relation")


def page_trim(spark, sf_dir):
    """The pages that stay within the cap."""
    return Stages(spark, sf_dir).pages().select("query_id", "book_id", "page", "relation")


def specs_block(spark, sf_dir):
    """The block of specifications of each question."""
    return Stages(spark, sf_dir).specs()


def context_items(spark, sf_dir):
    """The blocks from which contexts are packed."""
    return Stages(spark, sf_dir).items().select("query_id", "item_id", "kind", "score", "text")


def pack_greedy(spark, sf_dir):
    """The context by value for its length."""
    return Stages(spark, sf_dir).packed()


def pack_priority(spark, sf_dir):
    """The context by kind: specifications, pages, tables, texts."""
    return Stages(spark, sf_dir).packed(priority=True)


def context_text(spark, sf_dir):
    """The context of each question as text."""
    s = Stages(spark, sf_dir)
    return C.context_text(s.packed(), s.items(), s.specs())


def user_message(spark, sf_dir):
    """The prompt of each question with its context and the conversation before it, by chat."""
    s = Stages(spark, sf_dir)
    chats = s.read("ask_log").select(F.col("ask_id").alias("query_id"), "chat_id").distinct()
    history = reports.history_blocks(reports.prior_messages(reports.messages(s.read("ask_log")))).join(chats, "chat_id")
    return C.user_messages(s.questions, C.context_text(s.packed(), s.items(), s.specs()), history)


def prompt_text(spark, sf_dir):
    """Conversations as one text with the roles."""
    return C.flattened(reports.prior_messages(reports.messages(read(spark, sf_dir, "ask_log"))))


def sources_report(spark, sf_dir):
    """The sources of each answer, and the pages in its context beside them."""
    s = Stages(spark, sf_dir)
    report = C.sources(s.ranked(), s.pages(), s.packed(), s.ranked_chunks())
    return C.every_source(report, C.page_sources(s.pages(), s.packed(), s.ranked(), s.ranked_chunks()))


def section_tree(spark, sf_dir):
    """The headings around the first two chunks."""
    s = Stages(spark, sf_dir, min(K.EVERY, K.EVERY_LOOKUP))
    return C.hierarchy_block(s.pages(), s.read("page"))


def score_distribution(spark, sf_dir):
    """Least, median and greatest score and the boosted candidates of each question."""
    rows = Stages(spark, sf_dir).ranked()
    boosted = F.col("child_score").isNotNull() | (F.col("from_direct") & F.col("from_graph"))
    return rows.groupBy("query_id").agg(
        F.min("rerank_score").alias("least"), F.round(F.percentile("rerank_score", 0.5), 6).alias("median"), F.max("rerank_score").alias("most"), F.count_if(boosted).alias("n_boosted")
    )


QUERIES = {
    f.__name__: f
    for f in (
        classify_questions, route_limits, bm25_stats, bm25_topk, prop_topk, vector_topk, two_stage_topk, mmr_select, rrf_fuse, small_to_big, orphan_fallback, merge_candidates, rerank_boost,
        adaptive_second_pass, adaptive_ranked, page_expansion, page_trim, specs_block, context_items, pack_greedy, pack_priority, context_text, user_message, prompt_text, sources_report, section_tree,
        score_distribution,
    )
}


def _class(column: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(coalesce({column}, ''), '(?i){p}') THEN '{n}'" for n, p in X.QUESTION_CLASSES)
    return f"CASE {whens} ELSE 'general' END"


def _tokens(column: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({column}, '')), '[^\p{{L}}\p{{M}}\p{{N}}_\s-]', ' ', 'g'), '\s+'), lambda t: length(t) >= 2)"


_routes = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).lower() for v in row) + ")" for row in K.route_rows())
QUESTIONS = f"""
routes(mode, query_class, prop_limit, sect_limit, top_n, max_chars, history_pairs, boost, page_range, cross_book) AS (VALUES {_routes}),
qs AS (SELECT DISTINCT ask_id AS query_id, question, book_ids, CASE WHEN lower(trim(coalesce(mode, ''))) IN ('fast', 'balanced', 'deep') THEN lower(trim(mode)) ELSE 'balanced' END AS mode,
  {_class("question")} AS query_class FROM ask_log WHERE ask_id % 100 = 0 AND question IS NOT NULL),
questions AS (SELECT * FROM qs JOIN routes USING (mode, query_class)),
qterms AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_tokens("question")}) AS term FROM questions) GROUP BY ALL),
chunks AS (SELECT DISTINCT chunk_id, book_id, chunk_seq, section_path, page_range, type, content, linearized_text FROM chunk),
props AS (SELECT DISTINCT proposition_id, text, parent_chunk_id, section_path, page, book_id FROM proposition WHERE text IS NOT NULL)
"""


IN_BOOKS = lambda book: f"(cross_book OR coalesce(len(book_ids) = 0, true) OR coalesce(list_contains(book_ids, {book}), false))"
SECTIONS_OF = f"""{MENTIONS}, {HIERARCHY},
es AS (SELECT DISTINCT m.book_id, lower(m.name) AS name, m.section FROM (SELECT DISTINCT book_id, name, section FROM ms) m JOIN hn ON hn.book_id = m.book_id AND hn.name = m.section AND hn.label IN ('Section', 'Subsection')),
gt AS (SELECT DISTINCT query_id, term, book_ids, cross_book FROM qterms JOIN questions USING (query_id) WHERE length(term) >= 3),
gn AS (SELECT term, name FROM (SELECT DISTINCT term FROM gt) t JOIN (SELECT DISTINCT name FROM es) e ON term = name OR (length(term) >= 4 AND (contains(name, term) OR contains(term, name)))),
gs AS (SELECT query_id, section FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY section) AS n FROM (SELECT DISTINCT query_id, section FROM gt JOIN gn USING (term) JOIN es USING (name) WHERE {IN_BOOKS("es.book_id")})) WHERE n <= {G.GRAPH_LIMIT})"""
_kept = lambda c: f"arg_max({c}, spec_id) FILTER ({c} IS NOT NULL)"
SPECS_OF = f"""sn AS (SELECT book_id, subject, lower(subject) AS name, unit, {_kept('value')} AS value, {_kept('raw')} AS raw, arg_min(section, spec_id) FILTER (section IS NOT NULL) AS section
  FROM (SELECT DISTINCT spec_id, book_id, subject, lower(coalesce(unit, '')) AS unit, value, raw, section FROM spec WHERE subject IS NOT NULL) GROUP BY ALL HAVING {_kept('raw')} IS NOT NULL),
st AS (SELECT DISTINCT query_id, term, book_ids, cross_book FROM qterms JOIN questions USING (query_id) WHERE length(term) >= 3),
sm AS (SELECT DISTINCT query_id, sn.book_id, sn.name FROM st JOIN (SELECT DISTINCT book_id, name FROM sn WHERE name <> '') sn ON (contains(name, term) OR contains(term, name)) AND {IN_BOOKS("sn.book_id")}),
specs AS (SELECT query_id, book_id, subject, unit, value, raw, section, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY book_id, subject, unit) AS n FROM sm JOIN sn USING (book_id, name)) WHERE n <= {G.GRAPH_LIMIT})"""


def _bm25(name: str, table: str, key: str, text: str, limit: str, questions: str = "questions") -> str:
    return f"""
{name}_t AS (SELECT {key}, len(t) AS dl, t FROM (SELECT {key}, {_tokens(text)} AS t FROM {table} WHERE {text} IS NOT NULL)),
{name}_p AS (SELECT {key}, dl, term, count(*) AS tf FROM (SELECT {key}, dl, unnest(t) AS term FROM {name}_t) GROUP BY ALL),
{name}_n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {name}_t),
{name}_d AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM {name}_p, {name}_n GROUP BY term),
{name}_i AS (SELECT term, df, CASE WHEN raw < 0 THEN {L.EPSILON} * (SELECT avg(raw) FROM {name}_d) ELSE raw END AS idf FROM {name}_d),
{name}_s AS (SELECT query_id, {key}, round(sum(idf * tf * {L.K1 + 1} / (tf + {L.K1} * ({1 - L.B} + {L.B} * dl / avgdl)) * qtf), 6) AS score FROM {name}_p JOIN {name}_i USING (term) JOIN qterms USING (term), {name}_n GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT query_id, {key}, score, {limit} AS lim, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS rank
  FROM {name}_s JOIN {table} USING ({key}) JOIN {questions} USING (query_id) WHERE score > 0 AND {IN_BOOKS(table + ".book_id")}) WHERE rank <= lim)
"""


def _merge(s: str, questions: str) -> str:
    """The stages from the two searches to the merged candidates, for a pass."""
    return f"""
direct{s} AS (SELECT w.query_id, chunk_id, score, rank FROM wide{s} w JOIN {questions} USING (query_id) WHERE rank <= sect_limit),
hits{s} AS (SELECT f.query_id, f.score, p.* FROM ph{s} f JOIN props p USING (proposition_id)),
parents{s} AS (SELECT query_id, parent_chunk_id AS chunk_id, max(score) AS child_score, count(*) AS n_children FROM hits{s} WHERE parent_chunk_id IN (SELECT chunk_id FROM chunks) GROUP BY ALL),
orphans{s} AS (SELECT DISTINCT query_id, c.chunk_id FROM (SELECT * FROM hits{s} WHERE section_path IS NOT NULL AND (parent_chunk_id IS NULL OR parent_chunk_id NOT IN (SELECT chunk_id FROM chunks))) h
  JOIN chunks c ON c.book_id = h.book_id AND array_to_string(c.section_path, ' > ') = array_to_string(h.section_path, ' > ')),
need{s} AS (SELECT query_id, sect_limit, coalesce(n, 0) AS n FROM {questions} LEFT JOIN (SELECT query_id, count(*) AS n FROM parents{s} GROUP BY ALL) USING (query_id) WHERE coalesce(n, 0) < {K.MIN_PARENTS}),
dsup{s} AS (SELECT * FROM direct{s} UNION ALL SELECT w.query_id, w.chunk_id, w.score, w.rank FROM wide{s} w JOIN need{s} USING (query_id) WHERE rank <= sect_limit + ({K.MIN_PARENTS} - n) * {K.SUPPLEMENT} AND rank > sect_limit),
un{s} AS (SELECT query_id, chunk_id, NULL::DOUBLE AS direct_score, child_score, false AS from_direct FROM parents{s} UNION ALL SELECT query_id, chunk_id, NULL, NULL, false FROM orphans{s}
  UNION ALL SELECT query_id, chunk_id, score, NULL, true FROM dsup{s}),
mg{s} AS (SELECT query_id, chunk_id, max(direct_score) AS direct_score, max(child_score) AS child_score, bool_or(from_direct) AS from_direct FROM un{s} JOIN chunks USING (chunk_id) WHERE length(trim(content)) > 0 GROUP BY ALL)"""


def _rank(s: str, merged: str, questions: str, factor: int = 1) -> str:
    """The flag of the graph, the pool, the scores and the ranks, for a pass."""
    return f"""
cand{s} AS (SELECT m.*, coalesce(list_has_any(c.section_path, g.names), false) AS from_graph FROM {merged} m JOIN chunks c USING (chunk_id) LEFT JOIN (SELECT query_id, list(section) AS names FROM gs GROUP BY query_id) g USING (query_id)),
pool{s} AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(direct_score, 0) DESC, chunk_id) AS pn, top_n AS tn FROM cand{s} c JOIN {questions} USING (query_id)) WHERE pn <= {factor} * tn),
scored{s} AS (SELECT p.* EXCLUDE (pn, tn), top_n, round(CASE WHEN len({_tokens("question")}) > 0 THEN len(list_intersect(list_distinct({_tokens("question")}), list_distinct({_tokens("content")}))) / len(list_distinct({_tokens("question")})) ELSE 0 END
  + CASE WHEN from_direct AND from_graph THEN {K.BOOST_BOTH} * boost ELSE 0 END + coalesce(child_score, 0) * {K.BOOST_CHILD} * boost, 6) AS rerank_score FROM pool{s} p JOIN {questions} USING (query_id) JOIN chunks USING (chunk_id)),
ranked{s} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS rank FROM scored{s}) WHERE rank <= top_n)"""


PROPS = "WITH " + QUESTIONS + "," + _bm25("ph", "props", "proposition_id", "text", "prop_limit")
_WIDE = f"sect_limit + {K.MIN_PARENTS * K.SUPPLEMENT}"
BOTH = (
    PROPS
    + ","
    + _bm25("wide", "chunks", "chunk_id", "content", _WIDE)
    + f""",
{SECTIONS_OF},
{_merge("", "questions")},
{_rank("", "mg", "questions")},
pg AS (SELECT book_id, page_number AS page, min(full_content) AS text FROM page WHERE full_content IS NOT NULL GROUP BY ALL),
ex0 AS (SELECT r.query_id, r.chunk_id, r.rank, c.book_id, c.page_range.start AS s, CASE WHEN r.rank = 1 AND c.page_range.start > 0 THEN q.page_range ELSE 0 END AS reach
  FROM ranked r JOIN chunks c USING (chunk_id) JOIN questions q USING (query_id) WHERE r.rank <= 2 AND c.page_range.start IS NOT NULL),
ex1 AS (SELECT *, unnest(range(s - reach, s + reach + 1)) AS page FROM ex0),
ex AS (SELECT query_id, book_id, page, arg_min(chunk_id, rank) AS chunk_id, min(rank) AS rank, arg_min(page - s, rank) AS distance, arg_min(s, rank) AS s FROM ex1 WHERE (book_id, page) IN (SELECT (book_id, page) FROM pg) GROUP BY ALL),
exr AS (SELECT *, CASE WHEN s = 0 THEN 'fallback' WHEN rank = 2 THEN 'single' WHEN distance = 0 THEN 'main' WHEN distance < 0 THEN 'prev' ELSE 'next' END AS relation FROM ex),
"""
)
AGAIN = f"""
failing AS (SELECT query_id FROM questions LEFT JOIN ranked USING (query_id) GROUP BY query_id HAVING coalesce(max(rerank_score), 0) < {K.ADAPTIVE_STANDIN}),
questions_2 AS (SELECT * REPLACE (prop_limit * {K.ADAPTIVE_FACTOR} AS prop_limit, sect_limit * {K.ADAPTIVE_FACTOR} AS sect_limit) FROM questions WHERE query_id IN (SELECT query_id FROM failing)),
{_bm25("ph_2", "props", "proposition_id", "text", "prop_limit", "questions_2")},
{_bm25("wide_2", "chunks", "chunk_id", "content", _WIDE, "questions_2")},
{_merge("_2", "questions_2")},
mg_3 AS (SELECT query_id, chunk_id, max(direct_score) AS direct_score, max(child_score) AS child_score, bool_or(from_direct) AS from_direct FROM (SELECT * FROM mg_2 UNION ALL SELECT * FROM mg WHERE query_id IN (SELECT query_id FROM failing)) GROUP BY ALL),
{_rank("_2", "mg_3", "questions_2", K.ADAPTIVE_FACTOR)}"""
_label = "'[Book: ' || book_id || CASE WHEN coalesce(array_to_string(section_path, ' > '), '') <> '' THEN ' | § ' || array_to_string(section_path, ' > ') ELSE '' END || ' | Page: ' || coalesce(page_range.start, 0) || '-' || coalesce(page_range.\"end\", 0) || ']'"
_strip = lambda x: rf"regexp_replace(regexp_replace({x}, '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '')"
_wc = lambda x: rf"CASE WHEN {_strip(x)} = '' THEN 0 ELSE len(regexp_split_to_array({_strip(x)}, '[\s\p{{Z}}]+')) END"
PARSED_, ALIGNED_ = PARSED.strip(), PIPE_TABLES
# Dropping pages: a page goes while what is left with it is over the cap; pages are taken from the farthest, of two the one before first.
PAGES = (
    BOTH.replace("WITH ", "WITH RECURSIVE ", 1)
    + f"""
tr AS (SELECT e.*, length(pg.text) AS size, pg.text, row_number() OVER (PARTITION BY query_id ORDER BY (e.rank <> 1), -abs(distance), distance, page) AS n, sum(CASE WHEN e.rank = 1 THEN length(pg.text) END) OVER (PARTITION BY query_id) AS total FROM exr e JOIN pg USING (book_id, page)),
wk AS (SELECT query_id, 0::BIGINT AS n, max(total)::BIGINT AS total, false AS gone FROM tr WHERE rank = 1 GROUP BY query_id
  UNION ALL SELECT t.query_id, t.n, CASE WHEN w.total > {K.PAGE_CAP} AND t.distance <> 0 THEN w.total - t.size ELSE w.total END, w.total > {K.PAGE_CAP} AND t.distance <> 0 FROM wk w JOIN tr t ON t.query_id = w.query_id AND t.n = w.n + 1 AND t.rank = 1),
pages AS (SELECT t.* FROM tr t LEFT JOIN wk ON wk.query_id = t.query_id AND wk.n = t.n WHERE NOT coalesce(wk.gone, false)),
own AS (SELECT * FROM ranked r WHERE (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM pages)),
{PARSED_},
lb AS (SELECT c.*, {_label} AS label FROM chunks c WHERE chunk_id IN (SELECT chunk_id FROM own)),
al AS ({ALIGNED_}),
tb AS (SELECT lb.chunk_id, CASE WHEN markdown IS NOT NULL THEN 'Specification Data: ' || label || ':' || chr(10) || markdown WHEN length({_strip("coalesce(linearized_text, '')")}) > {K.LEAST_LINEAR} THEN 'Specification Data: ' || label || ':' || chr(10) || {_strip("linearized_text")}
  WHEN {_strip("coalesce(content, '')")} <> '' THEN 'Data: ' || label || ':' || chr(10) || {_strip("content")} END AS block FROM lb LEFT JOIN al USING (chunk_id) WHERE type = 'table'),
xs AS (SELECT o.query_id, o.chunk_id, label, {_strip("coalesce(content, '')")} AS t, list_distinct(regexp_split_to_array(lower(question), '\\s+')) AS asked FROM own o JOIN lb USING (chunk_id) JOIN questions USING (query_id) WHERE type <> 'table'),
xg AS (SELECT *, CASE WHEN {_wc("t")} <= {K.LONG_WORDS} THEN [t] ELSE string_split(list_reduce(list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_strip("x")}), lambda x: x <> ''),
  lambda acc, x: CASE WHEN {_wc("string_split(acc, chr(1))[-1]")} + {_wc("x")} <= {K.SEGMENT_WORDS} THEN acc || ' ' || x ELSE acc || chr(1) || x END), chr(1)) END AS parts FROM xs WHERE t <> ''),
xu AS (SELECT query_id, chunk_id, label, asked, unnest(parts) AS part, unnest(range(0, len(parts))) AS place FROM xg),
xb AS (SELECT query_id, chunk_id, any_value(label) || chr(10) || arg_min(part, (-len(list_intersect(asked, list_distinct(regexp_split_to_array(lower(part), '\\s+')))), place)) AS block FROM xu GROUP BY ALL),
items AS (SELECT * FROM (
  SELECT p.query_id, 'p:' || book_id || ':' || page AS item_id, 'page' AS kind, coalesce(r.rerank_score, 0) AS score, p.rank * 10000000 + p.page AS place, p.text FROM pages p LEFT JOIN ranked r USING (query_id, chunk_id)
  UNION ALL SELECT o.query_id, 'c:' || chunk_id, 'table', o.rerank_score, 0, block FROM own o JOIN tb USING (chunk_id)
  UNION ALL SELECT o.query_id, 'c:' || o.chunk_id, 'chunk', o.rerank_score, 0, block FROM own o JOIN xb USING (query_id, chunk_id)) WHERE length(trim(text)) > 0),
{SPECS_OF},
ss AS (SELECT * FROM specs WHERE n <= {K.SPECS_SHOWN} AND trim(subject) <> '' AND trim(raw) <> ''),
sf AS (SELECT query_id, arg_min({{'s': trim(subject), 'r': trim(raw), 'x': trim(coalesce(section, ''))}}, n) AS f, min(n) AS n FROM ss GROUP BY query_id, lower(trim(subject)), lower(trim(raw))),
sb AS (SELECT query_id, '{K.SPECS_BANNER}' || chr(10) || string_agg('  - ' || array_to_string(list_transform(string_split(f.s, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ': ' || f.r || CASE WHEN f.x <> '' THEN ' [' || f.x || ']' ELSE '' END, chr(10) ORDER BY n)
  || chr(10) || repeat('=', 56) AS block FROM sf GROUP BY query_id),
"""
)


def _pack(order: str, priority: bool = False) -> str:
    chunk = 0 if priority else K.CHUNK_TRIM
    return f"""
od AS (SELECT i.*, length(text) AS size, max_chars, row_number() OVER (PARTITION BY query_id ORDER BY {order}, item_id) AS n FROM items i JOIN questions USING (query_id)),
pk AS (SELECT query_id, 0::BIGINT AS n, coalesce(length(block), 0)::BIGINT AS total, CASE WHEN block IS NOT NULL THEN 'specs' END AS item_id, CASE WHEN block IS NOT NULL THEN 'specs' END AS kind, coalesce(length(block), 0)::BIGINT AS used, false AS stopped FROM questions LEFT JOIN sb USING (query_id)
  UNION ALL SELECT o.query_id, o.n, p.total + u.used, o.item_id, o.kind, u.used, p.stopped OR ({str(priority).lower()} AND o.kind = 'page' AND u.used = 0) FROM pk p JOIN od o ON o.query_id = p.query_id AND o.n = p.n + 1,
  LATERAL (SELECT (CASE WHEN o.max_chars - p.total <= 0 OR (o.kind = 'page' AND p.stopped) THEN 0 WHEN o.size <= o.max_chars - p.total THEN o.size WHEN o.max_chars - p.total > CASE o.kind WHEN 'page' THEN {K.PAGE_TRIM} WHEN 'chunk' THEN {chunk} ELSE 1073741824 END THEN o.max_chars - p.total ELSE 0 END)::BIGINT AS used) u),
packed AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY n) - 1)::INT AS seq, item_id, kind, used::INT AS used FROM pk WHERE used > 0)
"""


_GREEDY = _pack("round(score / length(text), 12) DESC")
_PRIORITY = _pack("CASE kind WHEN 'page' THEN 0 WHEN 'table' THEN 1 ELSE 2 END, place, score DESC", True)
_CONTEXT = """, tx AS (SELECT query_id, item_id, text FROM items UNION ALL SELECT query_id, 'specs', block FROM sb),
ctx AS (SELECT query_id, string_agg(substr(text, 1, used), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY seq) AS context FROM packed JOIN tx USING (query_id, item_id) GROUP BY query_id)
"""
_plain = _strip(rf"regexp_replace({_strip('content')}, '^#+\s*', '')")
_end = lambda body, cte: body.rstrip().rstrip(",") + cte
_similar = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"
_near = lambda k: f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, {_similar} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)) WHERE rank <= {k}"
_dots = lambda q, d: f"list_inner_product(CAST({q} AS DOUBLE[]), CAST({d} AS DOUBLE[]))"
_parts = lambda q: " + ".join("greatest(" + ", ".join(_dots(f"q.embedding[{i * 16 + 1}:{i * 16 + 16}]", f"d.embedding[{j * 16 + 1}:{j * 16 + 16}]") for j in range(4)) + ")" for i in range(4))



def _mmr(k: int) -> str:
    """Greedy picks, one step after the other."""
    sim = "list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[]))"
    steps = [f"WITH n AS ({_near(20)}), c0 AS (SELECT n.query_id, n.vec_id, n.score, e.embedding FROM n JOIN embeddings e USING (vec_id))", "k1 AS (SELECT query_id, arg_max(vec_id, (round(0.7 * score, 9), -vec_id)) AS vec_id, 1 AS pick FROM c0 GROUP BY query_id)"]
    for i in range(2, k + 1):
        picked = " UNION ALL ".join(f"SELECT query_id, vec_id FROM k{j}" for j in range(1, i))
        steps.append(f"q{i} AS (SELECT b.query_id, e.embedding FROM ({picked}) b JOIN embeddings e USING (vec_id))")
        steps.append(f"v{i} AS (SELECT c.query_id, c.vec_id, round({K.MMR_WEIGHT} * any_value(c.score) - (1 - {K.MMR_WEIGHT}) * max({sim}), 9) AS v, any_value(c.score) AS s FROM c0 c JOIN q{i} p USING (query_id) WHERE (c.query_id, c.vec_id) NOT IN (SELECT (query_id, vec_id) FROM ({picked})) GROUP BY ALL)")
        steps.append(f"k{i} AS (SELECT query_id, arg_max(vec_id, (v, s, -vec_id)) AS vec_id, {i} AS pick FROM v{i} GROUP BY query_id)")
    return ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT * FROM k{j}" for j in range(1, k + 1))


SQL = {
    "classify_questions": f"SELECT ask_id, {_class('question')} AS query_class FROM (SELECT DISTINCT ask_id, question FROM ask_log)",
    "route_limits": f"WITH {QUESTIONS} SELECT query_id, mode, query_class, prop_limit, sect_limit, top_n, max_chars, history_pairs, CAST(boost AS DOUBLE) AS boost, page_range, cross_book FROM questions",
    "bm25_stats": _end(BOTH, " SELECT term, df, round(idf, 6) AS idf FROM wide_i"),
    "bm25_topk": _end(BOTH, " SELECT query_id, chunk_id, score, rank::INT AS rank FROM direct"),
    "prop_topk": _end(PROPS, " SELECT query_id, proposition_id, score, rank::INT AS rank FROM ph"),
    "vector_topk": f"SELECT query_id, vec_id, score, rank::INT AS rank FROM ({_near(20)})",
    "two_stage_topk": f"WITH f AS ({_near(30)}), s AS (SELECT f.query_id, f.vec_id, round({_parts('')}, 5) AS score FROM f JOIN embeddings q ON q.vec_id = f.query_id JOIN embeddings d ON d.vec_id = f.vec_id) "
    "SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 10",
    "mmr_select": _mmr(5),
    "rrf_fuse": _end(BOTH, f" SELECT query_id, chunk_id, round(1 / ({K.RRF_K} + coalesce(d.rank, 1000000)) + 1 / ({K.RRF_K} + coalesce(p.rank, 1000000)), 6) AS rrf_score FROM direct d FULL JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY child_score DESC, chunk_id) AS rank FROM parents) p USING (query_id, chunk_id)"),
    "small_to_big": _end(BOTH, " SELECT * FROM parents"),
    "orphan_fallback": _end(BOTH, " SELECT * FROM orphans"),
    "merge_candidates": _end(BOTH, " SELECT * FROM cand"),
    "rerank_boost": _end(BOTH, " SELECT query_id, chunk_id, rerank_score, rank::INT AS rank FROM ranked"),
    "adaptive_second_pass": _end(BOTH, f" SELECT * FROM (SELECT query_id, coalesce(max(rerank_score), 0) AS top_score FROM questions LEFT JOIN ranked USING (query_id) GROUP BY query_id) WHERE top_score < {K.ADAPTIVE_STANDIN}"),
    "adaptive_ranked": BOTH + AGAIN + " SELECT query_id, chunk_id, rerank_score, rank::INT AS rank, 1 AS pass FROM ranked WHERE query_id NOT IN (SELECT query_id FROM failing) UNION ALL SELECT query_id, chunk_id, rerank_score, rank::INT, 2 FROM ranked_2",
    "page_expansion": _end(BOTH, " SELECT query_id, chunk_id, rank::INT AS rank, book_id, page::INT AS page, relation FROM exr"),
    "page_trim": _end(PAGES, " SELECT query_id, book_id, page::INT AS page, relation FROM pages"),
    "specs_block": _end(PAGES, " SELECT query_id, block FROM sb"),
    "context_items": _end(PAGES, " SELECT query_id, item_id, kind, score, text FROM items"),
    "pack_greedy": PAGES + _GREEDY + " SELECT * FROM packed",
    "pack_priority": PAGES + _PRIORITY + " SELECT * FROM packed",
    "context_text": PAGES + _GREEDY + _CONTEXT + " SELECT query_id, context, length(context)::INT AS total_chars FROM ctx",
    "user_message": PAGES + _GREEDY + _CONTEXT + f""", {MESSAGES}, hb AS (SELECT chat_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || content, chr(10) || chr(10) ORDER BY seq) AS block FROM pm GROUP BY chat_id),
      hq AS (SELECT DISTINCT ask_id AS query_id, block FROM ask_log JOIN hb USING (chat_id))
      SELECT q.query_id, CASE WHEN {_strip("coalesce(block, '')")} <> '' THEN 'Conversation so far:' || chr(10) || {_strip("block")} || chr(10) || chr(10) ELSE '' END || 'Context from knowledge base:' || chr(10) || coalesce(context, '') || chr(10) || chr(10)
        || CASE WHEN {_strip("coalesce(block, '')")} <> '' THEN 'Current question: ' ELSE 'Question: ' END || question || chr(10) || chr(10) || '{K.REMINDER.strip().replace("'", "''")}' || chr(10) || 'Answer:' AS message
      FROM questions q LEFT JOIN ctx USING (query_id) LEFT JOIN hq USING (query_id)""",
    "prompt_text": f"WITH {MESSAGES} SELECT chat_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || content, chr(10) || chr(10) ORDER BY seq) || chr(10) || chr(10) || 'Assistant:' AS prompt FROM pm GROUP BY chat_id",
    "sources_report": PAGES + _GREEDY + f""", up AS (SELECT p.* FROM pages p JOIN packed k ON k.query_id = p.query_id AND k.item_id = 'p:' || p.book_id || ':' || p.page)
      SELECT r.query_id, r.rank::INT AS rank, r.chunk_id, {_label} AS label, CASE WHEN length({_plain}) > 200 THEN substr({_plain}, 1, 200) || '...' ELSE {_plain} END AS excerpt, rerank_score,
      CASE WHEN (r.query_id, 'c:' || r.chunk_id) IN (SELECT (query_id, item_id) FROM packed) THEN 'chunk' WHEN (r.query_id, r.chunk_id) IN (SELECT (query_id, chunk_id) FROM up) THEN 'page' ELSE 'none' END AS included_via,
      'chunk' AS kind, NULL AS book_id, NULL::INT AS page, NULL AS relation FROM ranked r JOIN chunks USING (chunk_id)
      UNION ALL SELECT query_id, NULL, chunk_id, NULL, NULL, NULL, NULL, 'page', book_id, page::INT, relation FROM up
      WHERE (query_id, book_id, page) NOT IN (SELECT (r.query_id, c.book_id, c.page_range.start) FROM ranked r JOIN chunks c USING (chunk_id) WHERE c.page_range.start IS NOT NULL)""",
    "section_tree": _end(PAGES, f""", zp AS (SELECT book_id, page_number AS page, min({{'a': sections, 'b': full_content}}) AS m FROM page GROUP BY ALL),
      zs AS (SELECT DISTINCT p.query_id, p.book_id, p.page, z.m.a AS sections, {_strip("coalesce(z.m.b, '')")} AS t FROM pages p JOIN zp z USING (book_id, page) WHERE len(z.m.a) > 0),
      zt AS (SELECT *, CASE WHEN t = '' THEN '[Page ' || page || ']' ELSE substr({_strip("string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1)), chr(1))[1]")}, 1, 200) END AS shown FROM zs),
      zx AS (SELECT query_id, book_id, page, sections, shown, unnest(range(0, len(sections))) AS depth FROM zt),
      zf AS (SELECT query_id, book_id, array_to_string(sections[1:depth + 1], ' > ') AS path, min({{'page': page, 'depth': depth, 'h': sections[depth + 1], 'leaf': depth = len(sections) - 1, 'shown': shown}}) AS f FROM zx GROUP BY ALL),
      zl AS (SELECT *, repeat('  ', f.depth::INT + 1) AS i FROM zf),
      zb AS (SELECT query_id, book_id, '**' || book_id || '**' || chr(10) || string_agg(CASE WHEN f.leaf THEN i || '- **' || f.h || '**' || chr(10) || i || '  → ' || f.shown ELSE i || '- ' || f.h END, chr(10) ORDER BY f.page, f.depth, path) AS part FROM zl GROUP BY query_id, book_id)
      SELECT query_id, '## Document Structure' || chr(10) || chr(10) || string_agg(part, chr(10) || chr(10) ORDER BY book_id) AS block FROM zb GROUP BY query_id""").replace("ask_id % 100 = 0", f"ask_id % {K.EVERY_LOOKUP} = 0"),
    "score_distribution": _end(BOTH, " SELECT query_id, min(rerank_score) AS least, round(quantile_cont(rerank_score, 0.5), 6) AS median, max(rerank_score) AS most, count(*) FILTER (child_score IS NOT NULL OR (from_direct AND from_graph)) AS n_boosted FROM ranked GROUP BY query_id"),
}
