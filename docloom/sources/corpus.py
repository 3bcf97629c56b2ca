"""The Markdown corpus of a data folder: one line table per book, as the extraction of its pages would give it.

Each distinct chunk gives a page marker (if its page is known), a header with the last element of its path, and the lines of its
content; every book begins with a title line. Lines are ordered by (chunk_seq, pos); `block` groups consecutive chunks for
running state. Null contents have no lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive chunks of a book in one block.
BLOCK_CHUNKS = 64


def markdown_lines(chunk: DataFrame) -> DataFrame:
    """(book_id, chunk_seq, pos, seq, block, line)."""
    rows = chunk.select("book_id", "chunk_seq", "section_path", F.col("page_range.start").alias("start"), "content").distinct()
    none = F.array().cast("array<string>")
    marker = F.when(F.col("start").isNull(), none).otherwise(F.array(F.concat(F.lit("## --- PAGE "), F.col("start").cast("string"), F.lit(" ---"))))
    level = F.least(F.lit(3), F.greatest(F.lit(1), F.size("section_path")))
    header = F.when(F.coalesce(F.size("section_path"), F.lit(0)) < 1, none).otherwise(F.array(F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.element_at("section_path", -1))))
    body = F.when(F.col("content").isNull(), none).otherwise(F.split("content", "\n"))
    lines = rows.select("book_id", "chunk_seq", F.posexplode(F.concat(marker, header, body)).alias("pos", "line"))
    titles = chunk.select("book_id").distinct().select("book_id", F.lit(-1).alias("chunk_seq"), F.lit(0).alias("pos"), F.concat(F.lit("# Text Extraction: "), F.col("book_id")).alias("line"))
    lines = lines.unionByName(titles)
    seq = F.shiftleft((F.col("chunk_seq") + 1).cast("long"), 32) + F.col("pos")
    return lines.select("book_id", "chunk_seq", "pos", seq.alias("seq"), F.floor((F.col("chunk_seq") + 1) / BLOCK_CHUNKS).alias("block"), "line")
