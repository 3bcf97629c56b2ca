"""Column functions on text, ids and vectors. Regular expressions use explicit classes, so that they mean the same in other engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line patterns of the Markdown model.
PAGE_MARKER = r"##\s*---\s*PAGE\s+([0-9]+)\s*---"
HEADER = r"^(#{1,3})\s+(\S.*)$"
# Patterns that mark a sentence as noise.
NOISE = (
    r"^[0-9]+[.)]\s*$",
    r"(?i)^[ivxlcdm]+[.)]\s*$",
    r"^[^\p{L}\p{M}\p{N}_]+$",
    r"\.{3,}",
    r"[0-9]+\s*$",
    r"(?i)^(fig|figure|table|ref|see)\s",
    r"(?i)^(page|pg)\s*[0-9]+",
    r"(?i)^\s*(back|next|index|home|print)\s*$",
    r"^[0-9\s.,+\-]+$",
)
# The classes of questions with their patterns; the first that matches holds. Groups capture nothing that is read; DuckDB and Java take them alike.
QUESTION_CLASSES = (
    ("comparison", r"\b(vs|versus|compare|difference)\b"),
    ("process", r"(how\s+(do|does|is|are|was)|explain|describe|sequence|steps|process|procedure)"),
    (
        "spec_lookup",
        r"(what\s+(is|are)\s+(the\s+)+[\w\s]{3,60}?\s+(of|for|in)(\s+|$)"
        r"|\b\d+(\.\d+)?\s*(kn|mpa|bar|kg|s\b|km|n\b|m\b|mm|cm|kw|mw|%|k\b|psi|rpm|t\b|tonne|hz|sec|min|hr|mn)\b"
        r"|\b[A-Z]+-?\d+\b|\b(value|spec|parameter)s?\b)",
    ),
    ("overview", r"^(what\s+is|tell\s+me\s+about|summarize|overview)"),
)
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def text_of(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without outer white space: spaces, tabs, line ends and the Unicode spaces."""
    return F.regexp_replace(text_of(x), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def page_marker(line: Column | str) -> Column:
    """The page that a marker line opens, else null."""
    return F.regexp_extract(text_of(line), "^" + PAGE_MARKER, 1).try_cast("int")


def header_level(line: Column | str) -> Column:
    """The level of a header line, 1 to 3, else null; a page marker is none."""
    line = text_of(line)
    level = F.length(F.regexp_extract(line, HEADER, 1))
    return F.when((level > 0) & ~line.rlike("^" + PAGE_MARKER), level)


def header_title(line: Column | str) -> Column:
    return F.when(header_level(line).isNotNull(), strip(F.regexp_extract(text_of(line), HEADER, 2)))


def is_table_line(line: Column | str) -> Column:
    """A line that begins with a pipe or holds two at least."""
    line = text_of(line)
    return strip(line).startswith("|") | (F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) >= 2)


def is_separator_row(line: Column | str) -> Column:
    """A table row of pipes, dashes, colons and spaces that begins with a pipe or a dash."""
    return strip(line).rlike(r"^[|\-][|\-:\s]*$")


def clean_section(text: Column | str) -> Column:
    """Without page markers, with at most one empty line in a row, dot leaders as a space."""
    out = F.regexp_replace(text_of(text), PAGE_MARKER, "")
    return strip(F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), r"\.{3,}", " "))


def sentences(text: Column | str) -> Column:
    """The reference model's sentences: cut at white space after a terminator and before an ASCII capital."""
    return F.split(text_of(text), r"(?<=[.!?])\s+(?=[A-Z])")


def is_quality_sentence(sentence: Column | str) -> Column:
    """Whether a sentence is worth keeping as a proposition: length, words, no noise."""
    text = strip(sentence)
    kept = (F.length(text) >= 30) & (F.size(F.split(text, r"[\s\p{Z}]+")) >= 8)
    for pattern in NOISE:
        kept = kept & ~text.rlike(pattern)
    return F.coalesce(kept, F.lit(False))


def bm25_tokens(text: Column | str) -> Column:
    """Lower-case tokens of letters, digits, underscores and hyphens, of two characters at least."""
    plain = F.regexp_replace(F.lower(F.coalesce(text_of(text), F.lit(""))), r"[^\p{L}\p{M}\p{N}_\s-]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda t: F.length(t) >= 2)


def uuid5(key: Column | str) -> Column:
    """The name-based UUID (version 5, DNS namespace) of a text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), F.encode(text_of(key), "UTF-8")))
    cut = lambda a, n: F.substring(digest, a, n)
    variant = F.translate(cut(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))


def title_of(book_id: Column | str) -> Column:
    return F.initcap(F.translate(text_of(book_id), "_-", "  "))


def classify_question(question: Column | str) -> Column:
    """comparison, process, spec_lookup, overview or general."""
    text = F.coalesce(text_of(question), F.lit(""))
    out = None
    for name, pattern in QUESTION_CLASSES:
        hit = text.rlike("(?i)" + pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


def excerpt(text: Column | str, size: int = 200) -> Column:
    """The first characters of a text without leading header marks, with an ellipsis if there is more."""
    plain = strip(F.regexp_replace(strip(text), r"^#+\s*", ""))
    return F.when(F.length(plain) > size, F.concat(F.substring(plain, 1, size), F.lit("..."))).otherwise(plain)


def citation(book: Column | str, path: Column | str, start: Column | str, end: Column | str) -> Column:
    """`[Book: b | § path | Page: s-e]`, without the path if it is empty."""
    joined = F.array_join(text_of(path), " > ")
    middle = F.when(F.coalesce(joined, F.lit("")) != "", F.concat(F.lit(" | § "), joined)).otherwise("")
    return F.concat(F.lit("[Book: "), text_of(book), middle, F.lit(" | Page: "), text_of(start).cast("string"), F.lit("-"), text_of(end).cast("string"), F.lit("]"))


def snippet(text: Column | str, needle: Column | str, before: int = 40, after: int = 80) -> Column:
    """The surroundings of the first occurrence of a text in lower case, with ellipses where it was cut; null without one."""
    text, needle = text_of(text), F.lower(text_of(needle))
    at = F.position(needle, F.lower(text))
    begin = F.greatest(at - before, F.lit(1))
    end = F.least(at + F.length(needle) + after - 1, F.length(text))
    body = F.substr(text, begin, end - begin + 1)
    return F.when(at > 0, F.concat(F.when(begin > 1, "...").otherwise(""), body, F.when(end < F.length(text), "...").otherwise("")))


def slug(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(text_of(text)), "[^a-z0-9]+", "")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 for a null or zero vector."""
    size = norm(a) * norm(b)
    return F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(0.0))


# The helpers for SQL users, as SQL over built-in functions.
_STRIP_SQL = r"regexp_replace({0}, r'^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '')"


def register_sql(spark) -> None:
    """Register the helpers that SQL users call, as SQL functions over built-in expressions: docloom_title, docloom_cosine, docloom_uuid5, docloom_tokens,
    docloom_quality_sentence, docloom_classify."""
    create = lambda head, body: spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    create("docloom_title(book_id STRING) RETURNS STRING", "initcap(translate(book_id, '_-', '  '))")
    total = lambda pairs: f"aggregate({pairs}, cast(0 AS double), (s, x) -> s + x)"
    square = lambda v: f"sqrt(aggregate({v}, cast(0 AS double), (s, x) -> s + cast(x AS double) * cast(x AS double)))"
    create("docloom_cosine(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE", f"{total('zip_with(a, b, (x, y) -> cast(x AS double) * cast(y AS double))')} / ({square('a')} * {square('b')})")
    digest = f"sha1(concat(unhex('{DNS_NAMESPACE}'), encode(name, 'UTF-8')))"
    parts = [f"substring({digest}, {a}, {n})" for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    variant = f"translate(substring({digest}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab')"
    create("docloom_uuid5(name STRING) RETURNS STRING", f"concat({parts[0]}, '-', {parts[1]}, '-5', {parts[2]}, '-', {variant}, {parts[3]}, '-', {parts[4]})")
    create("docloom_tokens(text STRING) RETURNS ARRAY<STRING>", r"filter(split(regexp_replace(lower(coalesce(text, '')), r'[^\p{L}\p{M}\p{N}_\s-]', ' '), r'\s+'), t -> length(t) >= 2)")
    plain = _STRIP_SQL.format("sentence")
    noise = " AND ".join(f"NOT {plain} RLIKE r'{p}'" for p in NOISE)
    create("docloom_quality_sentence(sentence STRING) RETURNS BOOLEAN", f"coalesce(length({plain}) >= 30 AND size(split({plain}, r'[\\s\\p{{Z}}]+')) >= 8 AND {noise}, false)".replace("\\\\", "\\"))
    whens = " ".join(f"WHEN coalesce(question, '') RLIKE r'(?i){p}' THEN '{n}'" for n, p in QUESTION_CLASSES)
    create("docloom_classify(question STRING) RETURNS STRING", f"CASE {whens} ELSE 'general' END")
