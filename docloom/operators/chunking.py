"""From Markdown lines to chunks: page counter, sections, breadcrumbs, runs of text and tables, chunk numbers and ids.

Books are ordered sequences; every running state over one is computed in blocks (see functions.blocks), so that a book
that holds a third of all lines is no hot task. Null lines have no header, marker or table; empty input gives empty output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as X
from docloom.functions.blocks import breadcrumbs, running, running_last, running_sum
from docloom.session import cut

#: Blocks shorter than this aren't chunks.
MIN_BLOCK = 20


def with_page(lines: DataFrame, initial: int = 1) -> DataFrame:
    """Lines with the page they stand on: that of the last marker so far."""
    return running_last(lines, ["book_id"], "block", "seq", X.page_marker("line"), "page", initial)


def pages_of(lines: DataFrame) -> DataFrame:
    """(book_id, page, content): the text between markers; the last block of a page wins, pages without text are left out."""
    rows = running_sum(lines, ["book_id"], "block", "seq", X.page_marker("line").isNotNull().cast("int"), "_run")
    body = F.when(X.page_marker("line").isNull(), F.struct("seq", "line"))
    runs = rows.groupBy("book_id", "_run").agg(F.coalesce(F.max(X.page_marker("line")), F.lit(0)).alias("page"), F.sort_array(F.collect_list(body)).alias("_l"))
    runs = runs.withColumn("content", X.strip(F.array_join(F.transform("_l", lambda x: x["line"]), "\n"))).where(F.col("content") != "")
    return runs.groupBy("book_id", "page").agg(F.max_by("content", "_run").alias("content"))


def sections_of(lines: DataFrame) -> DataFrame:
    """(book_id, section_id, level, title, start_page, end_page, content, n_lines, seq, block); section 0 is the text before the first header."""
    states = {"section_id": X.header_level("line").isNotNull().cast("int")}
    rows = running(lines, ["book_id"], "block", "seq", sums=states, lasts={"page": (X.page_marker("line"), 1)})
    is_header = X.header_level("line").isNotNull()
    body = F.when(~is_header, F.struct("seq", "line"))
    grouped = rows.groupBy("book_id", "section_id").agg(
        F.coalesce(F.max(X.header_level("line")), F.lit(0)).alias("level"),
        F.coalesce(F.max(X.header_title("line")), F.lit("[Preamble]")).alias("title"),
        F.coalesce(F.max(F.when(is_header, F.col("page"))), F.lit(1)).alias("start_page"),
        F.max(F.when(~is_header, F.regexp_extract("line", X.PAGE_MARKER, 1).try_cast("int"))).alias("_last"),
        F.sort_array(F.collect_list(body)).alias("_l"),
        F.count_if(~is_header).alias("n_lines"),
        F.min("seq").alias("seq"),
        F.min("block").alias("block"),
    )
    raw = F.array_join(F.transform("_l", lambda x: x["line"]), "\n")
    return grouped.select("book_id", "section_id", "level", "title", "start_page", F.coalesce("_last", "start_page").alias("end_page"), X.clean_section(raw).alias("content"), "n_lines", "seq", "block")


def section_paths(sections: DataFrame) -> DataFrame:
    """Sections with `path`, the breadcrumbs."""
    headers = sections.where("level > 0")
    paths = breadcrumbs(headers, "book_id", "block", "seq", "level", "title", "path").drop("block")
    joined = sections.join(paths, ["book_id", "seq"], "left")
    return joined.withColumn("path", F.coalesce("path", F.array(F.lit("[Preamble]"))))


def runs_of(sections: DataFrame) -> DataFrame:
    """(book_id, section_id, run, type, content): alternating blocks of text and tables. A table of one line is text; empty
    blocks are left out; `run` numbers those that are left."""
    lines = sections.where(F.col("content") != "").select("book_id", "section_id", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    order = Window.partitionBy("book_id", "section_id").orderBy("pos")
    lines = lines.withColumn("is_table", X.is_table_line("line"))
    change = F.coalesce((F.col("is_table") != F.lag("is_table").over(order)).cast("int"), F.lit(1))
    lines = lines.withColumn("_change", change)
    lines = lines.withColumn("_run", F.sum("_change").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = lines.groupBy("book_id", "section_id", "_run").agg(F.first("is_table").alias("is_table"), F.count("*").alias("n_lines"), F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("_l"))
    kind = F.when(F.col("is_table") & (F.col("n_lines") >= 2), "table").otherwise("text")
    blocks = blocks.select("book_id", "section_id", "_run", kind.alias("type"), "n_lines", X.strip(F.array_join(F.transform("_l", lambda x: x["line"]), "\n")).alias("content")).where(F.col("content") != "")
    number = F.row_number().over(Window.partitionBy("book_id", "section_id").orderBy("_run")) - 1
    return blocks.select("book_id", "section_id", number.alias("run"), "type", "n_lines", "content")


def chunks_of(lines: DataFrame) -> DataFrame:
    """(chunk_id, book_id, chunk_index, section_id, path, level, start_page, end_page, type, content, parent_id). A section takes one number,
    and each of its chunks another; ids are UUIDs of book, path, kind, block and number."""
    # Sections are read for the headers, the blocks and the numbers: they are written once, as the table that they are.
    sections = cut(section_paths(cut(sections_of(lines))))
    emitted = runs_of(sections).where(F.length("content") >= MIN_BLOCK)
    emitted = emitted.withColumn("_rank", F.row_number().over(Window.partitionBy("book_id", "section_id").orderBy("run")))
    counts = emitted.groupBy("book_id", "section_id").agg(F.count("*").alias("_n"))
    numbered = sections.join(counts, ["book_id", "section_id"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    numbered = running_sum(numbered, ["book_id"], "block", "seq", F.col("_n") + 1, "_after").withColumn("_first", F.col("_after") - F.col("_n") - 1)
    rows = emitted.join(numbered.select("book_id", "section_id", "_first", "path", "level", "start_page", "end_page"), ["book_id", "section_id"])
    index = F.col("_first") + F.col("_rank")
    key = lambda path, number: F.concat_ws("::", "book_id", F.array_join(path, ">>"), number.cast("string"))
    own = key(F.concat("path", F.array("type", F.col("run").cast("string"))), index)
    parent = F.when(F.col("level") > 0, X.uuid5(key(F.col("path"), F.col("_first"))))
    return rows.select(X.uuid5(own).alias("chunk_id"), "book_id", index.alias("chunk_index"), "section_id", "path", "level", "start_page", "end_page", "type", "content", parent.alias("parent_id"))
