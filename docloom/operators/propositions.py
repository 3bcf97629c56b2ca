"""Propositions: sentences of text chunks that pass the quality filter, sentences of table rows, whole tables.

Numbers run over a book in the order of its chunks; they are counted in blocks of chunks (functions.blocks), not in one window per book."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions.blocks import running_sum
from docloom.operators import tables as T
from docloom.session import cut
from docloom.sources.corpus import BLOCK_CHUNKS

MIN_ROW, MIN_TABLE = 10, 30


def chunk_sentences(chunk: DataFrame) -> DataFrame:
    """(chunk_id, book_id, chunk_seq, page, pos, sentence) of every distinct text chunk; a null content has none."""
    rows = chunk.where("type = 'text' and content is not null").select("chunk_id", "book_id", "chunk_seq", F.col("page_range.start").alias("page"), "content").distinct()
    return _sentences(rows, "chunk_id", "book_id", "chunk_seq", "page")


def section_sentences(chunk: DataFrame, repeated: DataFrame) -> DataFrame:
    """(chunk_id, book_id, section, pos, sentence) of every distinct text chunk, with the last heading of each row of its id. `repeated` holds the ids that may stand in more than one row; no
    other row is shuffled."""
    section = F.coalesce(F.try_element_at("section_path", F.lit(-1)), F.lit("")).alias("section")
    keys = ["chunk_id", "book_id", "section"]
    single = chunk.where(F.col("chunk_id").isNotNull() & F.expr("type = 'text' and content is not null")).join(repeated, "chunk_id", "left_anti").select("chunk_id", "book_id", section, "content")
    several = chunk.join(repeated, "chunk_id", "left_semi")
    shared = chunk_sentences(several).join(several.select("chunk_id", section).distinct(), "chunk_id").select(*keys, "pos", "sentence")
    return _sentences(single, *keys).unionByName(shared)


def _sentences(rows: DataFrame, *keys: str) -> DataFrame:
    rows = rows.select(*keys, F.posexplode(X.sentences("content")).alias("pos", "_s"))
    return rows.select(*keys, "pos", X.strip("_s").alias("sentence")).where(F.col("sentence") != "")


def propositions(chunk: DataFrame) -> DataFrame:
    """(proposition_id, book_id, prop_index, parent_chunk_id, source_type, text, page)."""
    kept = chunk_sentences(chunk).where(X.is_quality_sentence("sentence"))
    texts = kept.select("chunk_id", "book_id", "chunk_seq", "page", F.lit(0).alias("kind"), "pos", F.lit("text").alias("source_type"), F.col("sentence").alias("text"))
    parsed = T.parsed_tables(chunk)
    keys = parsed.select("chunk_id", "book_id", "chunk_seq", F.col("page_range.start").alias("page"))
    rows = T.row_sentences(parsed).where(F.length("sentence") >= MIN_ROW).join(keys, "chunk_id")
    rows = rows.select("chunk_id", "book_id", "chunk_seq", "page", F.lit(1).alias("kind"), F.col("row_index").alias("pos"), F.lit("table_row").alias("source_type"), F.col("sentence").alias("text"))
    whole = T.linearized(parsed).where(F.length("linearized") > MIN_TABLE)
    whole = whole.select("chunk_id", "book_id", "chunk_seq", F.col("page_range.start").alias("page"), F.lit(2).alias("kind"), F.lit(0).alias("pos"), F.lit("table_full").alias("source_type"), F.col("linearized").alias("text"))
    every = texts.unionByName(rows).unionByName(whole)
    every = every.withColumn("block", F.floor(F.col("chunk_seq") / BLOCK_CHUNKS)).withColumn("seq", F.struct("chunk_seq", "kind", "pos"))
    # Numbering reads it twice: the sentences are split, filtered and written once.
    numbered = running_sum(cut(every), ["book_id"], "block", "seq", F.lit(1), "_n").withColumn("prop_index", F.col("_n") - 1)
    key = F.concat_ws("::", "book_id", F.lit("prop"), "chunk_id", F.col("prop_index").cast("string"))
    return numbered.select(X.uuid5(key).alias("proposition_id"), "book_id", "prop_index", F.col("chunk_id").alias("parent_chunk_id"), "source_type", "text", "page")
