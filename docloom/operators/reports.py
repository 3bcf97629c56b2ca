"""Reports and conversations: coverage, counts, batches, catalogue, messages, timing. Empty tables give empty reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as X

# Words by which a page counts as good or short.
GOOD_WORDS, SHORT_WORDS = 50, 10


def coverage(chunk: DataFrame) -> DataFrame:
    """(book_id, pages, good, short, blank, chunks, multi_chunk_pages, words_per_chunk, coverage): words by the page on which a chunk starts."""
    rows = chunk.where("page_range.start is not null").select("chunk_id", "book_id", F.col("page_range.start").alias("page"), "content").distinct()
    plain = X.strip(F.coalesce("content", F.lit("")))
    words = F.when(plain == "", 0).otherwise(F.size(F.split(plain, r"[\s\p{Z}]+")))
    pages = rows.select("book_id", "page", words.alias("w")).groupBy("book_id", "page").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    out = pages.groupBy("book_id").agg(
        F.count("*").alias("pages"), F.count_if(F.col("w") >= GOOD_WORDS).alias("good"), F.count_if((F.col("w") < GOOD_WORDS) & (F.col("w") >= SHORT_WORDS)).alias("short"),
        F.count_if(F.col("w") < SHORT_WORDS).alias("blank"), F.sum("n").alias("chunks"), F.count_if(F.col("n") > 1).alias("multi_chunk_pages"), F.sum("w").alias("_w"),
    )
    return out.withColumn("words_per_chunk", F.bround(F.col("_w") / F.col("chunks"), 1)).withColumn("coverage", F.bround(F.col("good") / F.col("pages") * 100, 1)).drop("_w")


def page_counts(chunk: DataFrame) -> DataFrame:
    """(book_id, n_pages): distinct pages over the chunks' ranges, else the number of chunks."""
    rows = chunk.select("chunk_id", "book_id", "page_range").distinct()
    pages = F.explode_outer(F.sequence("page_range.start", F.greatest("page_range.start", F.coalesce("page_range.end", "page_range.start"))))
    ranges = rows.select("book_id", "chunk_id", pages.alias("page"))
    counted = ranges.groupBy("book_id").agg(F.count_distinct("page").alias("_p"), F.count_distinct("chunk_id").alias("_c"))
    return counted.select("book_id", F.when(F.col("_p") > 0, F.col("_p")).otherwise(F.col("_c")).alias("n_pages"))


def batch_units(items: DataFrame, key: str, group: str, size: int) -> DataFrame:
    """(group, start, n): the work units of a fixed size into which each group's items are cut."""
    counts = items.select(group, key).distinct().groupBy(group).agg(F.count("*").cast("int").alias("_n"))
    return counts.select(group, "_n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(size))).alias("start")).select(group, "start", F.least(F.lit(size), F.col("_n") - F.col("start")).alias("n"))


def messages(ask_log: DataFrame) -> DataFrame:
    """(chat_id, created_at, message_id, role, content): a question and its answer are two messages."""
    rows = ask_log.select("ask_id", "chat_id", "question", "full_text", "asked_at", "saved_at").distinct()
    asked = rows.select("chat_id", F.col("asked_at").alias("created_at"), (F.col("ask_id") * 2).alias("message_id"), F.lit("user").alias("role"), F.col("question").alias("content"))
    said = rows.select("chat_id", F.col("asked_at").alias("created_at"), (F.col("ask_id") * 2 + 1).alias("message_id"), F.lit("assistant").alias("role"), F.col("full_text").alias("content"))
    return asked.unionByName(said).where(F.col("content").isNotNull())


def prior_messages(rows: DataFrame, pairs: int = 5) -> DataFrame:
    """The last 2 x pairs messages of each chat with `seq`, oldest first; the newest are found by a limit per group."""
    newest = Window.partitionBy("chat_id").orderBy(F.desc("created_at"), F.desc("message_id"))
    kept = rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= 2 * pairs)
    last = kept.groupBy("chat_id").agg(F.max("_n").alias("_last"))
    return kept.join(last, "chat_id").withColumn("seq", F.col("_last") - F.col("_n")).drop("_n", "_last")


def history_blocks(rows: DataFrame) -> DataFrame:
    """(chat_id, block): messages as `User: ...` and `Assistant: ...` with empty lines between."""
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), "content")
    return rows.groupBy("chat_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("block"))


def search_snippets(rows: DataFrame, needle: str) -> DataFrame:
    """(chat_id, message_id, snippet) of the messages that hold a text in any letter case."""
    return rows.withColumn("snippet", X.snippet("content", F.lit(needle))).where(F.col("snippet").isNotNull()).select("chat_id", "message_id", "snippet")


def timing(events: DataFrame, name: str, value: str) -> DataFrame:
    """(name, calls, total, average), the greatest total first by rank."""
    rows = events.groupBy(name).agg(F.count("*").alias("calls"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 6).alias("average"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), name)))


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], version: Column) -> DataFrame:
    """The last version of each key: of a key's rows one is kept, the newest; loading the same rows again changes nothing."""
    both = existing.unionByName(incoming).withColumn("_version", version)
    columns = [c for c in existing.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*columns), "_version").alias("_r")).select(*key, "_r.*")


def without(df: DataFrame, key: str, removed: DataFrame) -> DataFrame:
    """The rows whose key isn't among those removed."""
    return df.join(removed.select(key).distinct(), key, "left_anti")
