"""From ranked chunks to a context and the prompt around it: neighbouring pages, blocks, budgets, packing, sources.

Page ranges are exploded and joined by (book, page). Packing is a fold over the items of one question in the order of their value; a question has at most
a few dozen items by its limits. Items without text are left out; ties are ordered by the item's id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import segments as S
from docloom.functions.text import citation, excerpt, strip
from docloom.operators import tables as T
from docloom.plans import config as K
from docloom.session import broadcast_checked, cut


def expansions(ranked: DataFrame, chunks: DataFrame, questions: DataFrame, page: DataFrame) -> DataFrame:
    """(query_id, chunk_id, rank, book_id, page, relation): the pages around the first chunk's page, and the second's page unless it is
    among them. Relations: main, prev, next, single, and fallback for page 0, which has no neighbours. Pages that don't exist are left out."""
    top = ranked.where("rank <= 2").select("query_id", "chunk_id", "rank").join(chunks.select("chunk_id", "book_id", F.col("page_range.start").alias("_start")), "chunk_id").where(F.col("_start").isNotNull())
    top = top.join(questions.select("query_id", "page_range"), "query_id")
    reach = F.when((F.col("rank") == 1) & (F.col("_start") > 0), F.col("page_range")).otherwise(0)
    rows = top.select("query_id", "chunk_id", "rank", "book_id", "_start", F.explode(F.sequence(F.col("_start") - reach, F.col("_start") + reach)).alias("page"))
    relation = F.when(F.col("_start") == 0, "fallback").when(F.col("rank") == 2, "single").when(F.col("page") == F.col("_start"), "main").when(F.col("page") < F.col("_start"), "prev").otherwise("next")
    rows = rows.withColumn("relation", relation).withColumn("_offset", F.col("page") - F.col("_start"))
    exists = page.where(F.col("full_content").isNotNull()).select("book_id", F.col("page_number").alias("page")).distinct()
    rows = rows.join(exists, ["book_id", "page"])
    first = rows.groupBy("query_id", "book_id", "page").agg(F.min(F.struct("rank", "chunk_id", "relation", "_offset")).alias("_e"))
    return first.select("query_id", F.col("_e.chunk_id").alias("chunk_id"), F.col("_e.rank").alias("rank"), "book_id", "page", F.col("_e.relation").alias("relation"), F.col("_e._offset").alias("distance"))


def trimmed(expanded: DataFrame, page: DataFrame, cap: int = K.PAGE_CAP) -> DataFrame:
    """Expansions within the cap: of the first chunk's pages the farthest are dropped first (of two the one before), never the main page."""
    wanted = broadcast_checked(cut(expanded.select("book_id", "page").distinct()))
    own = page.where(F.col("full_content").isNotNull()).withColumn("page", F.col("page_number")).join(wanted, ["book_id", "page"], "left_semi")  # the texts of other pages aren't grouped
    texts = own.groupBy("book_id", "page").agg(F.min("full_content").alias("text"))
    rows = expanded.join(texts, ["book_id", "page"])
    items = F.sort_array(F.collect_list(F.struct((-F.abs("distance")).alias("near"), "distance", F.col("page"), F.length("text").alias("size"))))
    grouped = rows.where("rank = 1").groupBy("query_id").agg(items.alias("_i"), F.sum(F.length("text")).alias("_total"))
    dropped = F.aggregate(
        "_i",
        F.struct(F.col("_total").cast("long").alias("total"), F.array().cast("array<int>").alias("out")),
        lambda acc, x: F.when((acc["total"] > cap) & (x["distance"] != 0), F.struct((acc["total"] - x["size"]).alias("total"), F.array_append(acc["out"], x["page"]).alias("out"))).otherwise(acc),
    )["out"]
    out = rows.join(grouped.select("query_id", dropped.alias("_dropped")), "query_id", "left")
    return out.where((F.col("rank") != 1) | ~F.coalesce(F.array_contains("_dropped", F.col("page")), F.lit(False))).drop("_dropped")


def table_blocks(chunks: DataFrame) -> DataFrame:
    """(chunk_id, block) of table chunks (with headers, rows, linearized_text): the aligned table, else the linear text if it is long enough, else the raw
    text, each under its citation; null without any."""
    label = citation("book_id", "section_path", F.coalesce("page_range.start", F.lit(0)), F.coalesce("page_range.end", F.lit(0)))
    label = F.regexp_replace(label, r"\[Book: ([^|\]]*) \| Page", r"[Book: $1 | Page")
    rows = chunks.where("type = 'table'")
    aligned = T.pipe_tables(T.parsed_tables(rows)).select("chunk_id", F.col("markdown").alias("_aligned"))
    rows = rows.join(aligned, "chunk_id", "left")
    linear, raw = strip(F.coalesce("linearized_text", F.lit(""))), strip(F.coalesce("content", F.lit("")))
    under = lambda head, text: F.concat(F.lit(head), label, F.lit(":\n"), text)
    block = F.when(F.col("_aligned").isNotNull(), under("Specification Data: ", F.col("_aligned"))).when(F.length(linear) > K.LEAST_LINEAR, under("Specification Data: ", linear)).when(raw != "", under("Data: ", raw))
    return rows.select("chunk_id", block.alias("block"))


def text_blocks(ranked: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, chunk_id, block) of ranked text chunks: the text under its citation; of a long one the segment that shares most words with the
    question, the first of those that share as many."""
    label = citation("book_id", "section_path", F.coalesce("page_range.start", F.lit(0)), F.coalesce("page_range.end", F.lit(0)))
    rows = ranked.select("query_id", "chunk_id").join(chunks.where("type <> 'table'"), "chunk_id").join(questions.select("query_id", "question"), "query_id")
    # Written, so that a filter on the block isn't made a condition of the joins, which can't evaluate its lambda functions over columns of both sides.
    rows = cut(rows.select("query_id", "chunk_id", "book_id", "section_path", "page_range", "content", "question"))
    text = strip(F.coalesce("content", F.lit("")))
    best = F.when(S.word_count(text) <= K.LONG_WORDS, text).otherwise(S.best_segment(S.segments(text, K.SEGMENT_WORDS), F.col("question")))
    return rows.select("query_id", "chunk_id", F.when(text != "", F.concat(label, F.lit("\n"), best)).alias("block"))


def specs_block(specs: DataFrame) -> DataFrame:
    """(query_id, block): the first 30 specifications of each question (query_id, subject, raw, section, in the order of book, subject, unit) as a list, each
    subject and text once."""
    order = F.struct("book_id", "subject", "unit")
    first = specs.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.trim("subject").alias("subject"), F.trim("raw").alias("raw"), F.trim(F.coalesce("section", F.lit(""))).alias("section")))), 1, K.SPECS_SHOWN).alias("_s"))
    rows = first.select("query_id", F.posexplode("_s").alias("n", "_x")).where("_x.subject <> '' and _x.raw <> ''")
    once = rows.groupBy("query_id", F.lower("_x.subject").alias("_k"), F.lower("_x.raw").alias("_r")).agg(F.min(F.struct("n", "_x")).alias("_f"))
    x = F.col("_f._x")
    line = F.concat(F.lit("  - "), F.initcap(x["subject"]), F.lit(": "), x["raw"], F.when(x["section"] != "", F.concat(F.lit(" ["), x["section"], F.lit("]"))).otherwise(""))
    lines = once.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.col("_f.n").alias("n"), line.alias("line")))).alias("_l"))
    return lines.select("query_id", F.concat(F.lit(K.SPECS_BANNER + "\n"), F.array_join(F.transform("_l", lambda l: l["line"]), "\n"), F.lit("\n" + "=" * 56)).alias("block"))  # noqa: E741


def items_of(ranked: DataFrame, pages: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, item_id, kind, score, place, text): pages with the score of the chunk they come from and their place in the order of reading, and the blocks of
    the chunks that no page stands for."""
    p = pages.join(ranked.select("query_id", "chunk_id", "rerank_score"), ["query_id", "chunk_id"], "left")
    place = F.col("rank").cast("long") * 10_000_000 + F.col("page")
    p = p.select("query_id", F.concat(F.lit("p:"), "book_id", F.lit(":"), F.col("page").cast("string")).alias("item_id"), F.lit("page").alias("kind"), F.coalesce("rerank_score", F.lit(0.0)).alias("score"), place.alias("place"), "text")
    rest = ranked.join(pages.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_anti")
    own = rest.join(chunks.select("chunk_id"), "chunk_id", "left_semi").select("query_id", "chunk_id", "rerank_score")
    tables = own.join(table_blocks(chunks.join(own.select("chunk_id").distinct(), "chunk_id", "left_semi")), "chunk_id").withColumn("kind", F.lit("table"))
    texts = own.join(text_blocks(own, chunks, questions), ["query_id", "chunk_id"]).withColumn("kind", F.lit("chunk"))
    both = tables.unionByName(texts.select(*tables.columns))
    c = both.select("query_id", F.concat(F.lit("c:"), "chunk_id").alias("item_id"), "kind", F.col("rerank_score").alias("score"), F.lit(0).cast("long").alias("place"), F.col("block").alias("text"))
    return p.unionByName(c).where(F.length(F.trim("text")) > 0)


def pack(items: DataFrame, questions: DataFrame, specs: DataFrame | None = None, priority: bool = False) -> DataFrame:
    """(query_id, seq, item_id, kind, used): items until the budget is full, after the block of specifications where there is one.

    In the order of score by length: a table goes in whole or not; a page is cut if more than 500 characters are left, a chunk if more than 200; what doesn't fit is
    skipped. By priority: pages as they are read, up to the first that doesn't fit and can't be cut; then tables by score; then texts by
    score, the last cut to what is left."""
    kind = F.when(F.col("kind") == "page", 0).when(F.col("kind") == "table", 1).otherwise(2)
    if priority:
        order = F.struct(kind.alias("a"), F.col("place").alias("b"), (-F.col("score")).alias("c"))
    else:
        order = F.struct(F.lit(0).alias("a"), F.lit(0).cast("long").alias("b"), (-F.round(F.col("score") / F.length("text"), 12)).alias("c"))
    each = F.struct(order.alias("order"), "item_id", "kind", F.length("text").alias("size"))
    rows = items.groupBy("query_id").agg(F.sort_array(F.collect_list(each)).alias("_i"))
    rows = questions.select("query_id", "max_chars").join(rows, "query_id", "left")
    if specs is None:
        rows = rows.withColumn("_specs", F.lit(0))
    else:
        rows = rows.join(specs.select("query_id", F.length("block").alias("_specs")), "query_id", "left").withColumn("_specs", F.coalesce("_specs", F.lit(0)))
    least = lambda kind: F.when(kind == "page", K.PAGE_TRIM).when(kind == "table", 1 << 30).otherwise(0 if priority else K.CHUNK_TRIM)

    def step(acc: Column, x: Column) -> Column:
        left = F.col("max_chars") - acc["total"]
        fits, is_page = x["size"] <= left, x["kind"] == "page"
        used = F.when((left <= 0) | (is_page & acc["stopped"]), 0).when(fits, x["size"]).when(left > least(x["kind"]), left).otherwise(0)
        entry = F.struct(x["item_id"].alias("item_id"), x["kind"].alias("kind"), used.cast("int").alias("used"))
        stopped = acc["stopped"] | (F.lit(priority) & is_page & (used == 0))
        out = F.when(used > 0, F.array_append(acc["out"], entry)).otherwise(acc["out"])
        return F.struct((acc["total"] + used).cast("int").alias("total"), stopped.alias("stopped"), out.alias("out"))

    shape = "array<struct<item_id:string,kind:string,used:int>>"
    specs_entry = F.array(F.struct(F.lit("specs").alias("item_id"), F.lit("specs").alias("kind"), F.col("_specs").cast("int").alias("used"))).cast(shape)
    start = F.struct(F.col("_specs").cast("int").alias("total"), F.lit(False).alias("stopped"), F.when(F.col("_specs") > 0, specs_entry).otherwise(F.array().cast(shape)).alias("out"))
    none = F.array().cast("array<struct<order:struct<a:int,b:bigint,c:double>,item_id:string,kind:string,size:int>>")
    packed = rows.withColumn("_i", F.coalesce("_i", none)).select("query_id", F.aggregate("_i", start, step)["out"].alias("_o"))
    return packed.select("query_id", F.posexplode("_o").alias("seq", "_x")).select("query_id", "seq", "_x.item_id", "_x.kind", "_x.used")


def context_text(packed: DataFrame, items: DataFrame, specs: DataFrame) -> DataFrame:
    """(query_id, context, total_chars): the packed parts, cut to what was used of each, with separators between."""
    texts = items.select("query_id", "item_id", "text").unionByName(specs.select("query_id", F.lit("specs").alias("item_id"), F.col("block").alias("text")))
    rows = packed.join(texts, ["query_id", "item_id"]).select("query_id", "seq", F.substr("text", F.lit(1), F.col("used")).alias("part"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("seq", "part"))), lambda x: x["part"])
    out = rows.groupBy("query_id").agg(F.array_join(parts, K.SEPARATOR).alias("context"))
    return out.withColumn("total_chars", F.length("context"))


def user_messages(questions: DataFrame, contexts: DataFrame, history: DataFrame) -> DataFrame:
    """(query_id, message): context and question in the form of the prompt, after the conversation so far where there is one. `history` is (query_id, block)."""
    rows = questions.select("query_id", "question").join(contexts.select("query_id", "context"), "query_id", "left").join(history.select("query_id", F.col("block").alias("_h")), "query_id", "left")
    said, context, question = strip(F.coalesce("_h", F.lit(""))), F.coalesce("context", F.lit("")), F.coalesce("question", F.lit(""))
    body = lambda word: F.concat(F.lit("Context from knowledge base:\n"), context, F.lit(f"\n\n{word}: "), question, F.lit(K.REMINDER + "\nAnswer:"))
    with_history = F.concat(F.lit("Conversation so far:\n"), said, F.lit("\n\n"), body("Current question"))
    return rows.select("query_id", F.when(said != "", with_history).otherwise(body("Question")).alias("message"))


def flattened(turns: DataFrame) -> DataFrame:
    """(chat_id, prompt): messages (chat_id, seq, role, content) as one text with the roles before them, for models that take no list."""
    line = F.concat(F.initcap("role"), F.lit(": "), "content")
    return turns.groupBy("chat_id").agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "\n\n"), F.lit("\n\nAssistant:")).alias("prompt"))


def sources(ranked: DataFrame, pages: DataFrame, packed: DataFrame, chunks: DataFrame) -> DataFrame:
    """The report on the ranked chunks: label, excerpt, and through what each is in the context."""
    used = packed.select("query_id", "item_id")
    by_chunk = used.where(F.startswith("item_id", F.lit("c:"))).select("query_id", F.substring("item_id", 3, 200).alias("chunk_id"), F.lit("chunk").alias("_c"))
    page_item = F.concat(F.lit("p:"), "book_id", F.lit(":"), F.col("page").cast("string"))
    by_page = pages.withColumn("item_id", page_item).join(used, ["query_id", "item_id"], "left_semi").select("query_id", "chunk_id", F.lit("page").alias("_p")).distinct()
    rows = ranked.join(by_chunk, ["query_id", "chunk_id"], "left").join(by_page, ["query_id", "chunk_id"], "left").join(chunks, "chunk_id")
    return rows.select(
        "query_id", "rank", "chunk_id", citation("book_id", "section_path", F.coalesce("page_range.start", F.lit(0)), F.coalesce("page_range.end", F.lit(0))).alias("label"),
        excerpt("content").alias("excerpt"), "rerank_score", F.coalesce("_c", "_p", F.lit("none")).alias("included_via"),
    )


def page_sources(pages: DataFrame, packed: DataFrame, ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, book_id, page, chunk_id, relation): the pages in the context that aren't sources by themselves: no ranked chunk of the book starts on them."""
    item = F.concat(F.lit("p:"), "book_id", F.lit(":"), F.col("page").cast("string"))
    used = pages.withColumn("item_id", item).join(packed.select("query_id", "item_id"), ["query_id", "item_id"], "left_semi")
    starts = ranked.select("query_id", "chunk_id").join(chunks.select("chunk_id", "book_id", F.col("page_range.start").alias("page")), "chunk_id").select("query_id", "book_id", "page").distinct()
    return used.join(starts, ["query_id", "book_id", "page"], "left_anti").select("query_id", "book_id", "page", "chunk_id", "relation")


def every_source(report: DataFrame, pages: DataFrame) -> DataFrame:
    """The report on chunks and the pages that come on top, `kind` telling which."""
    return report.withColumn("kind", F.lit("chunk")).unionByName(pages.withColumn("kind", F.lit("page")), allowMissingColumns=True)


def hierarchy_block(pages: DataFrame, page: DataFrame) -> DataFrame:
    """(query_id, block): the headings of the expanded pages as a tree, each path once where it first stands; the last heading of a page is bold, with the
    page's first sentence below. Questions without a heading have no row."""
    heads = page.groupBy("book_id", F.col("page_number").alias("page")).agg(F.min(F.struct("sections", "full_content")).alias("_p")).select("book_id", "page", "_p.sections", "_p.full_content")
    rows = pages.select("query_id", "book_id", "page").distinct().join(heads, ["book_id", "page"])
    first = S.first_sentence(F.coalesce("full_content", F.lit("")))
    shown = F.when(first == "", F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit("]"))).otherwise(first)
    rows = rows.withColumn("_shown", shown).select("query_id", "book_id", "page", "sections", "_shown", F.posexplode("sections").alias("depth", "heading"))
    rows = rows.withColumn("path", F.array_join(F.slice("sections", F.lit(1), F.col("depth") + 1), " > ")).withColumn("_leaf", F.col("depth") == F.size("sections") - 1)
    once = rows.groupBy("query_id", "book_id", "path").agg(F.min(F.struct("page", "depth", "heading", "_leaf", "_shown")).alias("_f"))
    f, indent = F.col("_f"), F.repeat(F.lit("  "), F.col("_f.depth") + 1)
    leaf = F.concat(indent, F.lit("- **"), f["heading"], F.lit("**\n"), indent, F.lit("  → "), f["_shown"])
    line = F.when(f["_leaf"], leaf).otherwise(F.concat(indent, F.lit("- "), f["heading"]))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(f["page"].alias("page"), f["depth"].alias("depth"), "path", line.alias("line")))), lambda x: x["line"]), "\n")
    books = once.groupBy("query_id", "book_id").agg(F.concat(F.lit("**"), "book_id", F.lit("**\n"), lines).alias("part"))
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("book_id", "part"))), lambda x: x["part"]), "\n\n")
    return books.groupBy("query_id").agg(F.concat(F.lit("## Document Structure\n\n"), parts).alias("block"))
