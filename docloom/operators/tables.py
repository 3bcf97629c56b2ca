"""Pipe tables: parsing, sentences, lists, aligned Markdown, patterns, and lookup by page and by headers.

All of it is expressions on one row per table, except the lookups, which are equi joins on (book, page) after the page ranges
have been exploded; a range has as many pages as the chunk. Null contents give a table without rows; ragged rows are filled with empty cells
or cut; rows without content are left out. An empty inner header shifts the cells, as the model this follows does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as X

# Header names by role.
SUBJECT_HEADERS = "parameter item name component system subsystem element description property specification spec characteristic"
PROPERTY_HEADERS = "parameter property characteristic metric attribute field type category"
VALUE_HEADERS = "value values data result reading measurement quantity amount"
UNIT_HEADERS = "unit units uom measure"


def _cells(line: Column) -> Column:
    """The cells of a table line, without outer pipes and white space."""
    bare = F.regexp_replace(F.regexp_replace(line, r"^\|", ""), r"\|$", "")
    return F.transform(F.split(bare, r"\|"), X.strip)


def first_header(headers: Column, words: str) -> Column:
    """The place of the first header among some words, counted from 0; null without one."""
    names = F.array(*(F.lit(w) for w in words.split()))
    return F.get(F.filter(F.transform(headers, lambda h, i: F.when(F.array_contains(names, F.lower(h)), i)), lambda i: i.isNotNull()), 0)


def parsed_tables(chunk: DataFrame) -> DataFrame:
    """(chunk_id, book_id, chunk_seq, section_path, page_range, headers, rows, pattern) of every distinct table chunk."""
    rows = chunk.where("type = 'table'").select("chunk_id", "book_id", "chunk_seq", "section_path", "page_range", "content").distinct()
    lines = F.filter(F.transform(F.split(F.coalesce("content", F.lit("")), "\n"), X.strip), lambda x: (x != "") & ~X.is_separator_row(x))
    rows = rows.withColumn("_cells", F.transform(lines, _cells))
    rows = rows.withColumn("headers", F.coalesce(F.filter(F.get("_cells", 0), lambda h: h != ""), F.array().cast("array<string>")))
    width = F.size("headers")
    filled = F.transform(F.slice("_cells", 2, F.greatest(F.size("_cells") - 1, F.lit(0))), lambda r: F.transform(F.col("headers"), lambda _, i: F.coalesce(F.get(r, i), F.lit(""))))
    kept = F.filter(filled, lambda r: F.exists(r, lambda c: c != "") & (width > 0))
    spec = first_header(F.col("headers"), f"{SUBJECT_HEADERS} {PROPERTY_HEADERS}").isNotNull() & first_header(F.col("headers"), VALUE_HEADERS).isNotNull()
    return rows.select("chunk_id", "book_id", "chunk_seq", "section_path", "page_range", "headers", kept.alias("rows"), F.when(spec, "spec").otherwise("generic").alias("pattern"))


def _generic(headers: Column, cells: Column) -> Column:
    zipped = F.filter(F.zip_with(headers, cells, lambda h, c: F.when(c != "", F.concat(h, F.lit(": "), c))), lambda x: x.isNotNull())
    return F.array_join(zipped, " | ")


def _roles(cells: Column) -> tuple[Column, Column, Column]:
    at = lambda words: F.coalesce(F.get(cells, first_header(F.col("headers"), words)), F.lit(""))
    return at(f"{SUBJECT_HEADERS} {PROPERTY_HEADERS}"), at(VALUE_HEADERS), at(UNIT_HEADERS)


def _unit(unit: Column) -> Column:
    return F.when(unit == "", "").otherwise(F.concat(F.lit(" "), unit))


def _last_of_path() -> Column:
    return F.coalesce(F.try_element_at("section_path", F.lit(-1)), F.lit(""))


def row_sentences(parsed: DataFrame) -> DataFrame:
    """(chunk_id, row_index, sentence): `section parameter is value unit.` for spec tables, `H: v | H: v.` for others."""
    rows = parsed.select("chunk_id", "section_path", "headers", "pattern", F.posexplode("rows").alias("row_index", "cells"))
    parameter, value, unit = _roles(F.col("cells"))
    section = _last_of_path()
    prefix = F.when((section == "") | F.contains(F.lower(parameter), F.lower(section)), "").otherwise(F.concat(section, F.lit(" ")))
    spec = F.concat(prefix, parameter, F.lit(" is "), value, _unit(unit), F.lit("."))
    use = (F.col("pattern") == "spec") & (parameter != "") & (value != "")
    return rows.select("chunk_id", "row_index", F.when(use, spec).otherwise(F.concat(_generic(F.col("headers"), F.col("cells")), F.lit("."))).alias("sentence"))


def linearized(parsed: DataFrame) -> DataFrame:
    """Tables with `linearized`: `Section: a > b.` and the rows; empty without rows."""
    rows = F.array_join(F.transform("rows", lambda r: F.concat(_generic(F.col("headers"), r), F.lit("."))), " ")
    section = F.when(F.coalesce(F.size("section_path"), F.lit(0)) > 0, F.concat(F.lit("Section: "), F.array_join("section_path", " > "), F.lit(". "))).otherwise("")
    return parsed.withColumn("linearized", F.when(F.size("rows") > 0, F.concat(section, rows)).otherwise(""))


def bullets(parsed: DataFrame) -> DataFrame:
    """Tables with `bullets`: a label and one item per row."""

    def item(cells: Column) -> Column:
        parameter, value, unit = _roles(cells)
        use = (F.col("pattern") == "spec") & (parameter != "") & (value != "")
        return F.concat(F.lit("- "), F.when(use, F.concat(parameter, F.lit(": "), value, _unit(unit))).otherwise(_generic(F.col("headers"), cells)))

    label = F.when(_last_of_path() == "", "[TABLE]:").otherwise(F.concat(F.lit("[TABLE — "), _last_of_path(), F.lit("]:")))
    return parsed.withColumn("bullets", F.array_join(F.concat(F.array(label), F.transform("rows", item)), "\n"))


def pipe_tables(parsed: DataFrame) -> DataFrame:
    """Tables with `markdown`: columns padded to the widest cell, pipes escaped."""
    escape = lambda c: F.replace(F.regexp_replace(F.regexp_replace(c, "\r", ""), "\n", " "), F.lit("|"), F.lit("\\|"))
    rows = parsed.where(F.size("rows") > 0).withColumn("_h", F.transform("headers", escape)).withColumn("_r", F.transform("rows", lambda r: F.transform(r, escape)))
    rows = rows.withColumn("_w", F.transform("_h", lambda h, i: F.greatest(F.length(h), F.array_max(F.transform(F.col("_r"), lambda r: F.length(F.get(r, i)))))))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.zip_with(cells, F.col("_w"), lambda c, w: F.rpad(c, w, F.lit(" "))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform("_w", lambda w: F.repeat(F.lit("-"), w)), " | "), F.lit(" |"))
    return rows.select("chunk_id", F.array_join(F.concat(F.array(line(F.col("_h")), rule), F.transform("_r", line)), "\n").alias("markdown"))


def tables_of_pages(page: DataFrame, chunk: DataFrame) -> DataFrame:
    """(book_id, page_number, chunk_id): table chunks on the pages they cover."""
    tables = chunk.where("type = 'table' and page_range.start is not null").select("chunk_id", "book_id", F.explode(F.sequence("page_range.start", F.greatest("page_range.start", F.coalesce("page_range.end", "page_range.start")))).alias("page_number")).distinct()
    return page.select("book_id", "page_number").distinct().join(tables, ["book_id", "page_number"])


def header_matches(parsed: DataFrame) -> DataFrame:
    """(chunk_id, page, match_id): of each table and page, the first other table on the page that shares 60 % of the shorter one's headers."""
    names = F.transform("headers", lambda h: F.lower(F.regexp_replace(h, r"\s+", " ")))
    rows = parsed.where("page_range.start is not null and size(headers) > 0")
    rows = rows.select("chunk_id", "book_id", "chunk_seq", names.alias("names"), F.explode(F.sequence("page_range.start", F.greatest("page_range.start", F.coalesce("page_range.end", "page_range.start")))).alias("page"))
    other = rows.select(F.col("chunk_id").alias("match_id"), "book_id", F.col("chunk_seq").alias("match_seq"), F.col("names").alias("match_names"), "page")
    pairs = rows.join(other, ["book_id", "page"]).where(F.col("chunk_id") != F.col("match_id"))
    shared = F.size(F.filter("names", lambda h: F.array_contains("match_names", h)))
    enough = F.greatest(F.lit(1), F.floor(F.lit(0.6) * F.least(F.size("names"), F.size("match_names"))))
    return pairs.where(shared >= enough).groupBy("chunk_id", "page").agg(F.min_by("match_id", "match_seq").alias("match_id"))
