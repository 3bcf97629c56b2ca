"""Lines repeated across one source's documents (problem 6).

Copies of a document are collapsed first: documents of one source with the same text are a cluster, whatever their ids. Each
line, reduced to its letters, is then counted over distinct clusters, and over the dates on which they were published, so that
an article that is published again and again counts once. What a line must reach is one of two measures:

* `over="clusters"`: so many distinct clusters, on so many distinct dates where `date` is given, and this share of the source's
  clusters. Republished articles aren't mistaken for boilerplate.
* `over="documents"`: so many documents, and this share of the source's; each cluster counts for its distinct documents. It is for
  tables whose documents are parts of one whole, such as the pages of a book, where a line on five like pages stands on five.

Lines are compared by a 64-bit hash of their letters within a source, and texts by two such hashes; no text is shuffled for counting.

Scale: lines are hashed where the texts are read; a cluster is one row of hashes. Counting is an aggregation on (source, line) with partial
sums before the shuffle, so a source that holds a third of the rows is spread over all tasks by its lines. The lines found are
broadcast after their bytes have been measured, else joined with a shuffle. Nothing is collected.

Cases: a null text or source gives no line and counts in no total; a null date counts in no date; a line without letters is never found; ties don't
arise; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import broadcast_checked, cut

NEWLINE = "\n"


def letters_only(line: Column) -> Column:
    """A line reduced to its Unicode letters, in lower case."""
    return F.lower(F.regexp_replace(line, r"[^\p{L}]+", ""))


def line_keys(text: Column, min_letters: int) -> Column:
    """Of each line of a text the hash of its letters; null for a line with fewer letters."""
    lines = F.transform(F.split(text, NEWLINE), letters_only)
    return F.transform(lines, lambda k: F.when(F.length(k) >= min_letters, F.xxhash64(k)))


def _documents(df: DataFrame, source: str, doc: str, text: str) -> DataFrame:
    return df.where(F.col(text).isNotNull() & F.col(source).isNotNull()).select(F.col(source).alias("_source"), F.col(doc).alias("_doc"), F.col(text).alias("_text"))


def _clusters(df: DataFrame, source: str, doc: str, text: str, min_letters: int, date: str | None) -> DataFrame:
    """One row per source and text: how many distinct documents hold it, its dates and the keys of its lines."""
    rows = df.where(F.col(text).isNotNull() & F.col(source).isNotNull())
    keys = F.array_compact(F.array_distinct(line_keys(F.col(text), min_letters)))
    day = F.lit(None).cast("date") if date is None else F.to_date(date)
    rows = rows.select(F.col(source).alias("_source"), F.struct(F.xxhash64(text), F.xxhash64(text, F.lit(1))).alias("_cluster"), F.col(doc).alias("_doc"), day.alias("_day"), keys.alias("_keys"))
    # A document and date once, then the cluster: both are partial before the shuffle.
    once = rows.groupBy("_source", "_cluster", "_doc", "_day").agg(F.first("_keys").alias("_keys"))
    days = F.sort_array(F.collect_set("_day"))  # as many as there are dates
    return once.groupBy("_source", "_cluster").agg(F.count_distinct("_doc").alias("_documents"), days.alias("_days"), F.first("_keys").alias("_keys"))


def repeated_line_keys(
    df: DataFrame, source: str, doc: str, text: str, min_docs: int = 5, min_share: float = 0.15, min_letters: int = 3, over: str = "documents", date: str | None = None, min_dates: int = 2
) -> DataFrame:
    """(_source, _key, _n, _dates, _total) of the lines that stand in at least `min_docs` documents or clusters and `min_share` of the source's, and with
    `date` on at least `min_dates` dates."""
    if over not in ("documents", "clusters"):
        raise ValueError("over must be documents or clusters")
    clusters = _clusters(df, source, doc, text, min_letters, date)
    clusters = clusters.withColumn("_weight", F.col("_documents") if over == "documents" else F.lit(1).cast("long"))
    clusters = cut(clusters.select("_source", "_weight", "_keys", "_days"))  # read for the lines and for the totals
    lines = clusters.select("_source", "_weight", F.explode("_keys").alias("_key"))
    counted = lines.groupBy("_source", "_key").agg(F.sum("_weight").alias("_n"))
    if over == "documents":  # a document with several texts is one document
        totals = _documents(df, source, doc, text).select("_source", "_doc").distinct().groupBy("_source").agg(F.count("*").alias("_total"))
    else:
        totals = clusters.groupBy("_source").agg(F.sum("_weight").alias("_total"))
    found = counted.where(F.col("_n") >= min_docs).join(totals, "_source").where(F.col("_n") >= min_share * F.col("_total"))
    if date is None:
        return found.select("_source", "_key", "_n", F.lit(None).cast("long").alias("_dates"), "_total")
    found = broadcast_checked(cut(found))
    days = clusters.select("_source", F.explode("_keys").alias("_key"), "_days").join(found.select("_source", "_key"), ["_source", "_key"], "left_semi")
    days = days.select("_source", "_key", F.explode("_days").alias("_day")).groupBy("_source", "_key").agg(F.count_distinct("_day").alias("_dates"))
    return found.join(days, ["_source", "_key"]).where(F.col("_dates") >= min_dates).select("_source", "_key", "_n", "_dates", "_total")


def _marked_lines(df: DataFrame, source: str, doc: str, text: str, keys: DataFrame, min_letters: int) -> DataFrame:
    """(_source, _doc, _line_no) of the lines with one of the keys, each once."""
    rows = _documents(df, source, doc, text).select("_source", "_doc", F.posexplode(line_keys(F.col("_text"), min_letters)).alias("_line_no", "_key"))
    return rows.join(keys, ["_source", "_key"], "left_semi").select("_source", "_doc", "_line_no").distinct()


def _found(df: DataFrame, source: str, doc: str, text: str, limits: dict) -> DataFrame:
    return broadcast_checked(cut(repeated_line_keys(df, source, doc, text, **limits).select("_source", "_key")))


def repeated_lines(df: DataFrame, source: str, doc: str, text: str, **limits) -> DataFrame:
    """(source, doc, line_no) of each repeated line."""
    hits = _marked_lines(df, source, doc, text, _found(df, source, doc, text, limits), limits.get("min_letters", 3))
    return hits.select(F.col("_source").alias(source), F.col("_doc").alias(doc), F.col("_line_no").alias("line_no"))


def line_report(df: DataFrame, source: str, doc: str, text: str, **limits) -> DataFrame:
    """(source, line, n, n_dates, total): every repeated line by its letters, with its counts."""
    keys = broadcast_checked(cut(repeated_line_keys(df, source, doc, text, **limits)))
    lines = _documents(df, source, doc, text).select("_source", F.explode(F.array_distinct(F.transform(F.split("_text", NEWLINE), letters_only))).alias("line"))
    lines = lines.withColumn("_key", F.xxhash64("line")).join(keys, ["_source", "_key"]).select(F.col("_source").alias(source), "line", F.col("_n").alias("n"), F.col("_dates").alias("n_dates"), F.col("_total").alias("total"))
    return lines.distinct()


def without_repeated_lines(df: DataFrame, source: str, doc: str, text: str, **limits) -> DataFrame:
    """(source, doc, clean_text, n_removed): every distinct document with a text, without the repeated lines. A document
    that consists of them becomes the empty text. The lines of a text are numbered where it is read, and only the numbers of those to be
    removed are joined to it."""
    keys = _found(df, source, doc, text, limits)
    rows = _documents(df, source, doc, text).distinct()
    numbered = rows.select("_source", "_doc", F.xxhash64("_text").alias("_h"), F.posexplode(line_keys(F.col("_text"), limits.get("min_letters", 3))).alias("_line_no", "_key"))
    gone = numbered.join(keys, ["_source", "_key"], "left_semi").groupBy("_source", "_doc", "_h").agg(F.collect_set("_line_no").alias("_gone"))
    joined = rows.withColumn("_h", F.xxhash64("_text")).join(gone, ["_source", "_doc", "_h"], "left")
    none = F.coalesce("_gone", F.array().cast("array<int>"))
    kept = F.filter(F.split("_text", NEWLINE), lambda _, i: ~F.array_contains(none, i))
    return joined.select(F.col("_source").alias(source), F.col("_doc").alias(doc), F.array_join(kept, NEWLINE).alias("clean_text"), F.size(none).cast("long").alias("n_removed"))
