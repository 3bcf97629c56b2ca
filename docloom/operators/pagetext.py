"""Pipe tables inside page texts: finding them, their headings, the structured table that stands for each, and the text with bullet lists in their place.

A page is one row, and its lines are numbered and grouped within it; the windows run over the lines of one page. Null texts have no tables; a run of one table line is
text; tables without a data row stay as they are. Structured tables are joined by (book, page) after their page ranges have been exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as X
from docloom.operators import tables as T

# Header names by role in page texts, which differ from those of propositions.
PARAMETER_HEADERS = "parameter param item name description property characteristic spec specification attribute"
VALUE_HEADERS = "value values data result reading measurement quantity specification spec"
UNIT_HEADERS = "unit units uom measure"


def _lines(pages: DataFrame, key: list[str]) -> DataFrame:
    rows = pages.where(F.col("content").isNotNull()).select(*key, F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    return rows.withColumn("is_table", X.is_table_line("line"))


def _runs(pages: DataFrame, key: list[str]) -> DataFrame:
    """Lines with `run`, the number of their run of table or other lines, and `label`, the last heading at or before them."""
    order = Window.partitionBy(*key).orderBy("line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = _lines(pages, key)
    change = F.coalesce((F.col("is_table") != F.lag("is_table").over(order)).cast("int"), F.lit(1))
    # A heading within a table run is a line of that table.
    heading = F.when(~F.col("is_table"), X.header_title(X.strip("line")))
    rows = rows.withColumn("_change", change).withColumn("_heading", heading)
    return rows.withColumn("run", F.sum("_change").over(upto)).withColumn("label", F.last("_heading", ignorenulls=True).over(upto)).drop("_change", "_heading")


def _cells(line: Column) -> Column:
    """The cells of a table line that hold something."""
    bare = F.regexp_replace(F.regexp_replace(X.strip(line), r"^\|", ""), r"\|$", "")
    return F.filter(F.transform(F.split(bare, r"\|"), X.strip), lambda c: c != "")


def _list_of(headers: Column, rows: Column, label: Column) -> Column:
    """A bullet list of rows: `parameter: value unit` where the headers tell these, else `header: cell | header: cell`; empty without a row that holds something."""
    at = lambda words: T.first_header(headers, words)
    parameter_at, value_at, unit_at = at(PARAMETER_HEADERS), at(VALUE_HEADERS), at(UNIT_HEADERS)
    cell = lambda r, i: F.coalesce(F.get(r, i), F.lit(""))
    whole = lambda r: F.array_join(F.filter(F.transform(headers, lambda h, i: F.when(cell(r, i) != "", F.concat(h, F.lit(": "), cell(r, i)))), lambda x: x.isNotNull()), " | ")

    def item(r: Column) -> Column:
        parameter, value, unit = cell(r, parameter_at), cell(r, value_at), cell(r, unit_at)
        spec = parameter_at.isNotNull() & value_at.isNotNull() & (parameter != "") & (value != "")
        return F.when(spec, F.concat(parameter, F.lit(": "), value, F.when(unit != "", F.concat(F.lit(" "), unit)).otherwise(""))).otherwise(whole(r))

    items = F.filter(F.transform(rows, item), lambda x: x != "")
    head = F.when(F.coalesce(label, F.lit("")) == "", "[TABLE]:").otherwise(F.concat(F.lit("[TABLE — "), label, F.lit("]:")))
    return F.when(F.size(items) > 0, F.array_join(F.concat(F.array(head), F.transform(items, lambda x: F.concat(F.lit("  - "), x))), "\n")).otherwise("")


def page_tables(pages: DataFrame, key: list[str]) -> DataFrame:
    """(key, start_line, end_line, headers, label, raw, bullets) of every run of two table lines at least: the cells of its first line, the heading above it, its
    text, and the list made directly from its lines, in which empty cells move the others to the left."""
    rows = _runs(pages, key).where("is_table")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    runs = rows.groupBy(*key, "run").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.min("label").alias("label"), lines.alias("_l")).where(F.size("_l") >= 2)
    runs = runs.withColumn("_c", F.filter(F.transform(F.filter("_l", lambda x: ~X.is_separator_row(x)), _cells), lambda c: F.size(c) > 0))
    header = F.coalesce(F.get("_c", 0), F.array().cast("array<string>"))
    data = F.slice("_c", 2, F.greatest(F.size("_c") - 1, F.lit(0)))
    return runs.select(*key, "start_line", "end_line", _cells(F.get("_l", 0)).alias("headers"), "label", F.array_join("_l", "\n").alias("raw"), _list_of(header, data, F.col("label")).alias("bullets"))


def matched_tables(found: DataFrame, parsed: DataFrame, book: str = "book_id", page: str = "page") -> DataFrame:
    """(book, page, start_line, chunk_id, bullets): for each table in a page the first structured table on that page of whose headers it shares enough: 60 % of the
    shorter list, one at least; with the list made from the structured rows."""
    plain = lambda h: F.lower(F.regexp_replace(h, r"\s+", " "))
    tables = parsed.where("page_range.start is not null and size(headers) > 0")
    tables = tables.select("chunk_id", F.col("book_id").alias("_book"), "chunk_seq", F.col("headers").alias("_headers"), F.transform("headers", plain).alias("_names"), "rows", F.explode(F.sequence("page_range.start", F.greatest("page_range.start", F.coalesce("page_range.end", "page_range.start")))).alias("_page"))
    pairs = found.join(tables, (F.col(book) == F.col("_book")) & (F.col(page) == F.col("_page")))
    shared = F.size(F.filter(F.transform("headers", plain), lambda h: F.array_contains("_names", h)))
    enough = F.greatest(F.lit(1), F.floor(F.lit(0.6) * F.least(F.size("headers"), F.size("_names"))))
    first = pairs.where(shared >= enough).groupBy(book, page, "start_line").agg(F.min_by(F.struct("chunk_id", "_headers", "rows", "label"), F.struct("chunk_seq", "chunk_id")).alias("_m"))
    return first.select(book, page, "start_line", "_m.chunk_id", _list_of(F.col("_m._headers"), F.col("_m.rows"), F.col("_m.label")).alias("bullets"))


def page_contents(pages: DataFrame, parsed: DataFrame) -> DataFrame:
    """(book_id, page, content): the pages with a list in place of each table, from the structured table where one matches, else from its lines, else the table as it
    is; without page markers and with one empty line at most in a row."""
    key = ["book_id", "page"]
    found = page_tables(pages, key)
    better = matched_tables(found, parsed).select(*key, "start_line", F.col("bullets").alias("_better"))
    chosen = found.join(better, [*key, "start_line"], "left").select(*key, "start_line", F.coalesce(F.nullif("_better", F.lit("")), F.nullif("bullets", F.lit("")), "raw").alias("_text"))
    rows = _runs(pages, key)
    first = rows.groupBy(*key, "run").agg(F.first("is_table").alias("_t"), F.min("line_no").alias("start_line"), F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("_l"))
    out = first.join(chosen, [*key, "start_line"], "left").select(*key, "start_line", F.when(F.col("_t") & (F.size("_l") >= 2), F.col("_text")).otherwise(F.array_join("_l", "\n")).alias("_part"))
    text = out.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_line", "_part"))), lambda x: x["_part"]), "\n").alias("_all"))
    clean = X.strip(F.regexp_replace(F.regexp_replace(X.strip("_all"), X.PAGE_MARKER, ""), "\n{3,}", "\n\n"))
    return text.select(*key, clean.alias("content"))
