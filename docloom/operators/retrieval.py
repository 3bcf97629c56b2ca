"""The stages of retrieval over a table of questions at once: routing, small-to-big, orphans, supplement, merging, boosts, second pass.

Every stage is a join or an aggregation on (query_id, chunk_id) or a top-k per query; hits per query are bounded by the routed limits, so stages after the
search are small beside the tables. Score scales are mixed as in the model that this follows: parents found only through propositions have no direct
score. Missing parents, paths and pages are null and match nothing; an empty table of questions gives empty results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import bm25_tokens, classify_question
from docloom.operators.graph import in_books, sections_of_terms
from docloom.operators.lexical import bm25_best, top_per
from docloom.plans import config as K
from docloom.session import broadcast_checked, cut, repeated_keys


def routed_questions(ask_log: DataFrame, every: int | None = None) -> DataFrame:
    """The stated set of questions (ask_id divisible by `every`) with mode, class and limits; an unknown mode is balanced."""
    every = every or K.EVERY
    rows = ask_log.where((F.col("ask_id") % every == 0) & F.col("question").isNotNull()).select(F.col("ask_id").alias("query_id"), "question", "book_ids", "mode").distinct()
    mode = F.lower(F.trim(F.coalesce("mode", F.lit(""))))
    rows = rows.withColumn("mode", F.when(mode.isin(*K.MODES), mode).otherwise(K.DEFAULT_MODE)).withColumn("query_class", classify_question("question"))
    schema = "mode string, query_class string, prop_limit int, sect_limit int, top_n int, max_chars int, history_pairs int, boost double, page_range int, cross_book boolean"
    routes = F.broadcast(rows.sparkSession.createDataFrame(K.route_rows(), schema))  # 15 rows
    return rows.join(routes, ["mode", "query_class"])


def search(docs: DataFrame, key: str, questions: DataFrame, limit: str, repeated: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score, rank): the best documents (key, book_id, text) of each question within its books. `repeated` are the keys that may stand in more than one row, if they are known."""
    found = bm25_best(docs, key, "text", questions, limit, repeated_keys(docs, key) if repeated is None else repeated)
    books = found.join(questions.select("query_id", "book_ids", "cross_book", F.col(limit).alias("_k")), "query_id")
    return top_per(books.where(in_books(F.col("book_id"))), "query_id", [F.desc("score"), F.asc(key)], F.col("_k")).select("query_id", key, "score", "rank")


def parents_of(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Small to big: (query_id, chunk_id, child_score, n_children) of the chunks that hits belong to."""
    rows = hits.join(chunks.select(F.col("chunk_id").alias("parent_chunk_id")), "parent_chunk_id", "left_semi")
    return rows.groupBy("query_id", F.col("parent_chunk_id").alias("chunk_id")).agg(F.max("score").alias("child_score"), F.count("*").alias("n_children"))


def orphan_parents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id): for hits without a parent among the chunks, the chunks of the same book and path."""
    orphans = hits.join(chunks.select(F.col("chunk_id").alias("parent_chunk_id")), "parent_chunk_id", "left_anti")
    keyed = orphans.where(F.col("section_path").isNotNull()).select("query_id", "book_id", F.array_join("section_path", " > ").alias("path")).distinct()
    return keyed.join(chunks.select("chunk_id", "book_id", F.array_join("section_path", " > ").alias("path")), ["book_id", "path"]).select("query_id", "chunk_id").distinct()


def supplemented(direct: DataFrame, wider: DataFrame, parents: DataFrame, questions: DataFrame) -> DataFrame:
    """Direct hits, and for questions with too few parents the further hits of a wider search: (limit + 5 for each parent missing)."""
    have = parents.groupBy("query_id").agg(F.count("*").alias("_n"))
    need = questions.select("query_id", "sect_limit").join(have, "query_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0))).where(F.col("_n") < K.MIN_PARENTS)
    more = wider.join(need.withColumn("_k", F.col("sect_limit") + (K.MIN_PARENTS - F.col("_n")) * K.SUPPLEMENT), "query_id").where(F.col("rank") <= F.col("_k"))
    more = more.select(*direct.columns).join(direct.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return direct.unionByName(more)


def merged(parents: DataFrame, orphans: DataFrame, direct: DataFrame) -> DataFrame:
    """(query_id, chunk_id, direct_score, child_score, from_direct): all candidates, once each."""
    none = F.lit(None).cast("double")
    rows = parents.select("query_id", "chunk_id", none.alias("direct_score"), "child_score", F.lit(False).alias("from_direct"))
    rows = rows.unionByName(orphans.select("query_id", "chunk_id", none.alias("direct_score"), none.alias("child_score"), F.lit(False).alias("from_direct")))
    rows = rows.unionByName(direct.select("query_id", "chunk_id", F.col("score").alias("direct_score"), none.alias("child_score"), F.lit(True).alias("from_direct")))
    return rows.groupBy("query_id", "chunk_id").agg(F.max("direct_score").alias("direct_score"), F.max("child_score").alias("child_score"), F.bool_or("from_direct").alias("from_direct"))


def question_terms(questions: DataFrame, least: int = 3) -> DataFrame:
    """(query_id, term, book_ids, cross_book): the distinct tokens of each question that may name an entity."""
    rows = questions.select("query_id", "book_ids", "cross_book", F.explode(F.array_distinct(bm25_tokens("question"))).alias("term"))
    return rows.where(F.length("term") >= least)


def from_graph(candidates: DataFrame, chunks: DataFrame, questions: DataFrame, entity_section: DataFrame) -> DataFrame:
    """Candidates with `from_graph`: an element of the chunk's path is a section that mentions an entity of the question."""
    names = cut(sections_of_terms(question_terms(questions), entity_section))  # small, and a large plan by itself
    paths = candidates.select("query_id", "chunk_id").join(chunks.select("chunk_id", F.explode("section_path").alias("section")), "chunk_id")
    flagged = paths.join(names, ["query_id", "section"], "left_semi").select("query_id", "chunk_id").distinct().withColumn("from_graph", F.lit(True))
    return candidates.join(flagged, ["query_id", "chunk_id"], "left").withColumn("from_graph", F.coalesce("from_graph", F.lit(False)))


def with_text(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """The candidates whose chunk has a text."""
    return candidates.join(chunks.where(F.length(F.trim("content")) > 0).select("chunk_id"), "chunk_id", "left_semi")


def reranked(candidates: DataFrame, chunks: DataFrame, questions: DataFrame, floor: float = K.RERANK_FLOOR, scorer=None, factor: int = 1) -> DataFrame:
    """Candidates with `rerank_score` and `rank`. The pool is first cut to `factor` times the final number by the direct score, in which those found only through propositions
    have none and go first. A candidate's relevance, by default the share of the question's terms that its chunk holds, gets the boosts for
    candidates of both sources and for the best child's score; those below the `floor` are left out unless it is 0.

    `scorer` takes (query_id, chunk_id, question, content) and gives (query_id, chunk_id, relevance); where it gives none the direct score
    stands in, without the boost for the child."""
    limits = questions.select("query_id", "top_n", "boost", "question")
    pool = top_per(candidates.join(limits, "query_id"), "query_id", [F.desc(F.coalesce("direct_score", F.lit(0.0))), F.asc("chunk_id")], F.col("top_n") * factor, rank="_pool").drop("_pool")
    rows = broadcast_checked(cut(pool)).join(chunks.select("chunk_id", "content"), "chunk_id")  # so that the texts of all chunks aren't shuffled
    if scorer is None:
        q, d = F.array_distinct(bm25_tokens("question")), F.array_distinct(bm25_tokens("content"))
        rows = rows.withColumn("_q", q).withColumn("relevance", F.when(F.size("_q") > 0, F.size(F.array_intersect("_q", d)) / F.size("_q")).otherwise(0.0)).drop("_q")
    else:
        rows = rows.join(scorer(rows.select("query_id", "chunk_id", "question", "content")), ["query_id", "chunk_id"], "left")
    failed = F.col("relevance").isNull()
    both = F.when(F.col("from_direct") & F.col("from_graph"), K.BOOST_BOTH * F.col("boost")).otherwise(0.0)
    child = F.when(failed, 0.0).otherwise(F.coalesce(F.col("child_score"), F.lit(0.0)) * K.BOOST_CHILD * F.col("boost"))
    rows = rows.withColumn("rerank_score", F.round(F.coalesce("relevance", "direct_score", F.lit(0.0)) + both + child, 6)).drop("relevance", "boost", "question", "content")
    kept = rows.where(F.col("rerank_score") >= floor) if floor > 0 else rows
    return top_per(kept, "query_id", [F.desc("rerank_score"), F.asc("chunk_id")], F.col("top_n")).drop("top_n")


def needs_second_pass(ranked: DataFrame, questions: DataFrame, threshold: float = K.ADAPTIVE_THRESHOLD) -> DataFrame:
    """(query_id, top_score): questions without candidates or whose best score is below the threshold."""
    best = ranked.groupBy("query_id").agg(F.max("rerank_score").alias("_best"))
    rows = questions.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("_best", F.lit(0.0)).alias("top_score"))
    return rows.where(F.col("top_score") < threshold)


def widened(questions: DataFrame, failing: DataFrame) -> DataFrame:
    """The failing questions with the limits of their second search."""
    rows = questions.join(failing.select("query_id").distinct(), "query_id", "left_semi")
    return rows.withColumns({c: F.col(c) * K.ADAPTIVE_FACTOR for c in ("prop_limit", "sect_limit")})


def second_pass(first: DataFrame, again: DataFrame) -> DataFrame:
    """The merged candidates of both searches, once each: those of the second that the first already has keep the better scores."""
    rows = first.select(*again.columns).unionByName(again)
    return rows.groupBy("query_id", "chunk_id").agg(F.max("direct_score").alias("direct_score"), F.max("child_score").alias("child_score"), F.bool_or("from_direct").alias("from_direct"))
