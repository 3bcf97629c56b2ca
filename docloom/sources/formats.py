"""Sources and sinks in the formats of the application that is modelled: Markdown files, JSON checkpoints, page maps, log lines, event streams, HTML; keyed writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import strip, uuid5

CHUNK_JSON = (
    "chunk_id string, book_id string, book_title string, section_path array<string>, level int, page_range struct<start:int,end:int>, type string, content string, parent_id string, original_markdown string, "
    "structured_json struct<headers:array<string>,rows:array<map<string,string>>>, linearized_text string"
)
PAGE_JSON = "map<string,struct<page_number:int,sections:array<string>,full_content:string,book_id:string,total_pages:int,total_chunks:int>>"


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, line_no, line) of whole Markdown files; the book is named by the file. An empty file raises when it is read."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.[^.]*$", 1).alias("book_id"), "value")
    checked = files.withColumn("value", F.when(F.trim("value") == "", F.raise_error(F.concat(F.lit("empty file of book "), "book_id"))).otherwise(F.col("value")))
    return checked.select("book_id", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def read_chunks_json(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON arrays with an explicit schema; a range given as a list is read as one given as a record."""
    return spark.read.schema(CHUNK_JSON).json(path, multiLine=True)


def read_pages_json(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, page_number, sections, full_content) from page maps; the entry with the book's totals is no page."""
    files = spark.read.text(path, wholetext=True).select(F.from_json("value", PAGE_JSON).alias("_m"))
    book = F.element_at("_m", F.lit("__meta__"))["book_id"]
    rows = files.select(book.alias("book_id"), F.explode("_m").alias("_key", "_page")).where(F.col("_key") != "__meta__")
    return rows.select("book_id", F.coalesce("_page.page_number", F.col("_key").try_cast("int")).alias("page_number"), "_page.sections", "_page.full_content")


def split_units(totals: DataFrame, size: int = 10) -> DataFrame:
    """(book_id, chunk_idx, start_offset, page_count): documents of so many pages in units of a fixed size."""
    rows = totals.select("book_id", "total_pages", F.posexplode(F.sequence(F.lit(0), F.col("total_pages") - 1, F.lit(size))).alias("chunk_idx", "start_offset"))
    return rows.where("total_pages > 0").select("book_id", "chunk_idx", "start_offset", F.least(F.lit(size), F.col("total_pages") - F.col("start_offset")).alias("page_count"))


def reassembled(units: DataFrame, part: int = 256) -> DataFrame:
    """(book_id, part_no, markdown): the results of units in their order with empty lines between, in parts of so many units, so that no book has to fit in one row; the
    first begins with the title line. `joined` makes one text of a book whose parts are few."""
    filled = units.where(F.trim("content") != "").withColumn("part_no", F.floor(F.col("chunk_idx") / part).cast("int"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("chunk_idx", "content"))), lambda x: x["content"])
    rows = filled.groupBy("book_id", "part_no").agg(F.array_join(parts, "\n\n").alias("_t"))
    first = rows.groupBy("book_id").agg(F.min("part_no").alias("_first"))
    title = F.when(F.col("part_no") == F.col("_first"), F.concat(F.lit("# Text Extraction: "), "book_id", F.lit("\n\n"))).otherwise("")
    return rows.join(first, "book_id").select("book_id", "part_no", F.concat(title, F.col("_t")).alias("markdown"))


def joined(parts: DataFrame) -> DataFrame:
    """(book_id, markdown): the parts of each book as one text."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct("part_no", "markdown"))), lambda x: x["markdown"])
    return parts.groupBy("book_id").agg(F.array_join(texts, "\n\n").alias("markdown"))


def page_lines(pages: DataFrame) -> DataFrame:
    """(book_id, page, markdown) of converted pages (book_id, start_offset, page_in_unit from 0, text): a marker with the absolute page before each text; pages without text are left out. Headings
    `## Page N`, which a plain-text conversion writes, become markers of the same form."""
    page = F.col("start_offset") + F.col("page_in_unit") + 1
    plain = F.regexp_replace("text", r"(?m)^##\s+Page\s+[0-9]+\s*$\n?", "")
    text = F.regexp_replace(plain, r"^\s+|\s+$", "")
    return pages.select("book_id", page.alias("page"), text.alias("_t")).where("_t <> ''").select("book_id", "page", F.concat(F.lit("## --- PAGE "), F.col("page").cast("string"), F.lit(" ---\n\n"), F.col("_t")).alias("markdown"))


def parse_log(lines: DataFrame) -> DataFrame:
    """(ts, ip, worker_id, severity, online, line) of the log lines that carry a worker's id; for batches and streams."""
    worker = F.regexp_extract("line", r"\[([a-z]+-[0-9a-z]+)\]", 1)
    low = F.lower("line")
    severity = F.when(low.contains("error") | low.contains("failed"), "error").when(low.contains("warn"), "warning").otherwise("info")
    return lines.withColumn("worker_id", worker).where(F.col("worker_id") != "").select("ts", "ip", "worker_id", severity.alias("severity"), (~low.contains("disconnected")).alias("online"), "line")


def parse_events(lines: DataFrame, schema: str = "type string, content string, error string") -> DataFrame:
    """The JSON of `data:` lines; other lines, bad JSON and the end mark are left out."""
    body = F.trim(F.regexp_replace("line", r"^data:\s*", ""))
    rows = lines.where(F.startswith("line", F.lit("data:")) & (body != "[DONE]")).select(*[c for c in lines.columns if c != "line"], F.from_json(body, schema).alias("event"))
    return rows.where(F.col("event").isNotNull() & F.col("event.type").isNotNull())


def accumulated(events: DataFrame, key: str, order: str) -> DataFrame:
    """(key, answer, done): the tokens of each stream joined in their order; a stream without its end event carries a mark."""
    token = F.when(F.col("event.type") == "token", F.struct(order, F.col("event.content").alias("content")))
    rows = events.groupBy(key).agg(F.sort_array(F.collect_list(token)).alias("_t"), F.coalesce(F.bool_or(F.col("event.type") == "done"), F.lit(False)).alias("done"))
    text = F.array_join(F.transform("_t", lambda x: x["content"]), "")
    return rows.select(key, F.when(F.col("done"), text).otherwise(F.concat(text, F.lit(" (Stopped)"))).alias("answer"), "done")


def html_to_text(html: Column) -> Column:
    """Text of HTML: scripts, styles and comments dropped, blocks on lines of their own, common entities resolved."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)</(p|div|li|h[1-6]|tr)\s*>|<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, text in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(text))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[ \t\x{a0}]+", " "), r" *\n\s*", "\n"), r"^\s+|\s+$", "")


def write_books(df: DataFrame, path: str) -> None:
    """Write by book; of the books in the frame the partitions are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id").parquet(path)


def remove_books(spark: SparkSession, path: str, books: list[str], to: str) -> None:
    """Write a table without some books to a new path."""
    spark.read.parquet(path).where(~F.col("book_id").isin(books)).write.mode("overwrite").partitionBy("book_id").parquet(to)


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """The keys that occur more than once: the check that stands for a uniqueness constraint."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


PROPOSITION_JSON = "proposition_id string, text string, parent_chunk_id string, section_path array<string>, page int, source_type string, book_id string, row_data map<string,string>"


def read_propositions_json(spark: SparkSession, path: str) -> DataFrame:
    """Propositions from JSON arrays with an explicit schema."""
    return spark.read.schema(PROPOSITION_JSON).json(path, multiLine=True)


def read_book(spark: SparkSession, path: str, book: str) -> DataFrame:
    """One book of a table written by book: only its partition is read."""
    return spark.read.parquet(path).where(F.col("book_id") == book)


def page_range_of(value: Column) -> Column:
    """A page range as struct(start, end), from the JSON of a record or of a list; nulls where there is none."""
    place = lambda name, i: F.coalesce(F.get_json_object(value, f"$.{name}"), F.get_json_object(value, f"$[{i}]")).try_cast("int")
    return F.struct(place("start", 0).alias("start"), place("end", 1).alias("end"))


def page_texts(page: DataFrame, chunk: DataFrame) -> DataFrame:
    """(book_id, page, text, origin): the text of each page, from the page table, else the texts of the chunks that cover it in their order."""
    meta = page.groupBy("book_id", F.col("page_number").alias("page")).agg(F.min("full_content").alias("_m"))
    rows = chunk.where("page_range.start is not null and content is not null").select("chunk_id", "book_id", "chunk_seq", "page_range", "content").distinct()
    rows = rows.select("chunk_id", "book_id", "chunk_seq", "content", F.explode(F.sequence("page_range.start", F.greatest("page_range.start", F.coalesce("page_range.end", "page_range.start")))).alias("page"))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_seq", "chunk_id", "content"))), lambda x: x["content"]), "\n\n")
    both = meta.join(rows.groupBy("book_id", "page").agg(texts.alias("_c")), ["book_id", "page"], "full_outer")
    own = F.nullif("_m", F.lit(""))
    return both.select("book_id", "page", F.coalesce(own, "_c").alias("text"), F.when(own.isNotNull(), "metadata").otherwise("chunks").alias("origin")).where(F.col("text").isNotNull())


def chunk_log(chunk: DataFrame) -> DataFrame:
    """(page_number, text, chunk_id, chunk_type, section_path, book_id): chunks as the coverage report of the model reads them."""
    rows = chunk.select("chunk_id", "book_id", "page_range", "type", "content", "linearized_text", "section_path").distinct()
    text = F.when(F.col("type") == "text", F.coalesce("content", F.lit(""))).otherwise(F.coalesce(F.nullif("linearized_text", F.lit("")), "content", F.lit("")))
    return rows.select(F.coalesce("page_range.start", F.lit(0)).alias("page_number"), text.alias("text"), "chunk_id", F.col("type").alias("chunk_type"), F.coalesce("section_path", F.array().cast("array<string>")).alias("section_path"), "book_id")


def payloads(proposition: DataFrame, chunk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The payloads of both vector collections with deterministic point ids: propositions (point_id, key, book_id, page, text, section_path, source_type, parent_chunk_id), and sections (point_id,
    key, book_id, page, text, section_path, chunk_type, page_range), whose payload holds no structured table."""
    props = proposition.select("proposition_id", "book_id", "page", "text", "section_path", "source_type", "parent_chunk_id").distinct().where(F.col("text").isNotNull())
    props = props.select(uuid5(F.concat(F.lit("prop::"), "proposition_id")).alias("point_id"), F.col("proposition_id").alias("key"), "book_id", F.coalesce("page", F.lit(0)).alias("page"), "text", "section_path", "source_type", "parent_chunk_id")
    rows = chunk.select("chunk_id", "book_id", "page_range", "type", "content", "linearized_text", "section_path").distinct()
    text = F.when(F.col("type") == "text", strip("content")).otherwise(F.coalesce(F.nullif(strip("linearized_text"), F.lit("")), strip("content")))
    rows = rows.withColumn("text", text).where(F.length("text") >= 20)
    return props, rows.select(uuid5(F.concat(F.lit("section::"), "chunk_id")).alias("point_id"), F.col("chunk_id").alias("key"), "book_id", F.coalesce("page_range.start", F.lit(0)).alias("page"), "text", "section_path", F.col("type").alias("chunk_type"), "page_range")


def write_json(df: DataFrame, path: str) -> None:
    """Write a checkpoint as JSON lines, by book; of the books in the frame the partitions are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id").json(path)


def write_run_log(counters: DataFrame, path: str, run: str) -> None:
    """Append the counters of a run, one row, to the log of runs."""
    counters.withColumn("run", F.lit(run)).withColumn("finished_at", F.current_timestamp()).write.mode("append").json(path)


def clear_tables(spark: SparkSession, paths: list[str]) -> None:
    """Empty tables, their schemas kept."""
    for path in paths:
        spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)


def sse_lines(events: DataFrame) -> Column:
    """An event (type, content, error) as a `data:` line of a server-sent stream; fields without a value are left out."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(*(F.col(c) for c in ("type", "content", "error") if c in events.columns))))


def once_per_batch(path: str):
    """A writer for foreachBatch that is safe to repeat: a batch writes to a folder of its number, which a repeated run replaces, so results of a batch that had been written before a crash are
    not written twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
