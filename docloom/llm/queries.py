"""The queries of the problems tagged llm, each over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import read

from .leaks import leaks
from .pairs import pair_defects
from .pieces import pieces
from .repeated_lines import line_report, repeated_lines, without_repeated_lines
from .scans import repaired, scan_defects
from .sentences import sentence_rows, sentence_units
from .tokens import encode_corpus
from .truncation import truncation, truncation_rates


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every defective pair of ask_log with its defect; the models are fitted on labelled rows of documents."""
    return pair_defects(read(spark, sf_dir, "ask_log"), "ask_id", "question", "full_text", read(spark, sf_dir, "documents"))


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by defect."""
    return p1_found(spark, sf_dir).groupBy("defect").agg(F.count("*").alias("n_pairs"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that the splitting operator cuts into pieces."""
    return pieces(read(spark, sf_dir, "chunk"), "chunk_id", "content").select("chunk_id").distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized chunk with its section path and page range."""
    return pieces(read(spark, sf_dir, "chunk"), "chunk_id", "content", carry=["section_path", "page_range"])


def _sentence_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    propositions = read(spark, sf_dir, "proposition").where("source_type = 'text'")
    chunks = read(spark, sf_dir, "chunk").where("type = 'text' and not ocr")
    return propositions.select(F.lit("proposition").alias("src"), F.col("proposition_id").alias("rec_id"), "text").unionByName(
        chunks.select(F.lit("chunk").alias("src"), F.col("chunk_id").alias("rec_id"), F.col("content").alias("text"))
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of each sentence of propositions and chunks."""
    return sentence_rows(_sentence_sources(spark, sf_dir), ["src", "rec_id"], "text")


def p4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences themselves."""
    return sentence_units(_sentence_sources(spark, sf_dir), ["src", "rec_id"], "text")


def _scan_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = read(spark, sf_dir, "page")
    number = F.col("page_number")
    pages = page.select(
        F.lit("page").alias("src"), F.concat_ws("#", "book_id", number.cast("string")).alias("rec_id"), F.col("book_id").alias("book"), number.alias("page"), number.alias("last_page"), "ocr", F.col("full_content").alias("text")
    )
    chunk = read(spark, sf_dir, "chunk").where("type = 'text'")
    chunks = chunk.select(
        F.lit("chunk").alias("src"), F.col("chunk_id").alias("rec_id"), F.col("book_id").alias("book"), F.col("page_range.start").alias("page"), F.col("page_range.end").alias("last_page"), "ocr", F.col("content").alias("text")
    )
    return pages.unionByName(chunks)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The defective lines of scanned pages and chunks."""
    return scan_defects(_scan_sources(spark, sf_dir))


def p5_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanned pages and chunks as continuous paragraphs."""
    return repaired(_scan_sources(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated lines of each book's pages."""
    return repeated_lines(read(spark, sf_dir, "page"), "book_id", "page_number", "full_content")


def p6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page without them."""
    return without_repeated_lines(read(spark, sf_dir, "page"), "book_id", "page_number", "full_content")


def p6_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that stand in many different texts of one source, on several days: copies of a text, whenever they were fetched, count once."""
    return line_report(read(spark, sf_dir, "documents"), "source", "doc_id", "text", over="clusters", date="fetched_at", min_docs=3, min_share=0.005, min_dates=2)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return encode_corpus(read(spark, sf_dir, "documents"), "doc_id", "text")


def p8_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and item that share an n-gram, with the score of their alignment."""
    out = leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_item"), "doc_id", "item_id", "text")
    return out.withColumn("similarity", F.round("similarity", 6))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold at least 12 consecutive words of an item."""
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_item"), "doc_id", "item_id", "text", run=12).where("longest_run >= 12").select("doc_id", "item_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that were cut off."""
    return truncation(read(spark, sf_dir, "documents"), "doc_id", "source", "text").where("truncated").select("doc_id").distinct()


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of cut texts of each source."""
    return truncation_rates(read(spark, sf_dir, "documents"), "doc_id", "source", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_rates, p2_found, p2_pieces, p4_found, p4_sentences, p5_found, p5_text, p6_found, p6_pages, p6_documents, p7_ids, p8_found, p8_alignments, p9_found, p9_rates)
}
