"""Texts in segments of whole sentences, as column functions: packed segments, windows by size, overlapping windows. A text is one value, and so
is the fold over its sentences; null and blank texts have no segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import strip, text_of

#: Stands between segments while they are built.
_MARK = "\x01"


def loose_sentences(text: Column | str) -> Column:
    """Sentences cut at white space after a terminator, whatever follows."""
    parts = F.transform(F.split(F.translate(text_of(text), _MARK, " "), r"(?<=[.!?])\s+"), strip)
    return F.filter(parts, lambda s: s != "")


def first_sentence(text: Column | str, size: int = 200) -> Column:
    """The first sentence, at most `size` characters of it; empty for a text without content."""
    plain = strip(F.coalesce(text_of(text), F.lit("")))
    return F.when(plain == "", "").otherwise(F.substring(F.get(loose_sentences(plain), 0), 1, size))


def word_count(text: Column | str) -> Column:
    plain = strip(text_of(text))
    return F.when(plain == "", 0).otherwise(F.size(F.split(plain, r"[\s\p{Z}]+")))


def _last(joined: Column) -> Column:
    return F.substring_index(joined, _MARK, -1)


def segments(text: Column | str, words: int) -> Column:
    """Consecutive sentences packed into segments of at most so many words; a longer sentence is a segment of its own."""
    fold = F.aggregate(
        loose_sentences(text), F.lit(""), lambda acc, s: F.when(acc == "", s).when(word_count(_last(acc)) + word_count(s) <= words, F.concat(acc, F.lit(" "), s)).otherwise(F.concat(acc, F.lit(_MARK), s))
    )
    return F.filter(F.split(fold, _MARK), lambda x: x != "")


def windows(text: Column | str, chars: int = 500) -> Column:
    """Windows for a model that reads so many characters: sentences are packed below that size, a longer one is cut into slices of it; slices of 10 characters and less and
    windows below 5 are left out. Line ends count as spaces."""
    plain = strip(F.replace(text_of(text), F.lit("\n"), F.lit(" ")))
    starts = lambda s: F.sequence(F.lit(1), F.length(s), F.lit(chars))
    slices = lambda s: F.filter(F.transform(starts(s), lambda i: F.substring(s, i, F.lit(chars))), lambda x: F.length(x) > 10)
    # The state ends with the window that is open; a cut sentence leaves an empty one behind.
    fold = F.aggregate(
        F.split(F.translate(plain, _MARK, " "), r"(?<=[.!?])\s+"),
        F.lit(""),
        lambda acc, s: F.when(F.length(s) > chars, F.concat(acc, F.lit(_MARK), F.array_join(slices(s), _MARK), F.lit(_MARK)))
        .when(F.length(_last(acc)) + F.length(s) < chars, F.concat(acc, F.lit(" "), s))
        .otherwise(F.concat(acc, F.lit(_MARK), s)),
    )
    return F.filter(F.transform(F.split(fold, _MARK), strip), lambda w: F.length(w) >= 5)


def overlapping(text: Column | str, words: int) -> Column:
    """Windows of about so many words; each begins with the last sentences of the one before, as many as stay within half its size (50 words at least). A text within the size is
    one window."""
    plain = strip(text_of(text))
    step = max(words // 2, 50)
    count = lambda sents: F.aggregate(sents, F.lit(0), lambda n, s: n + word_count(s))

    def kept(open_: Column) -> Column:
        """The tail of the open window that the next begins with: the longest of at most `step` words, one sentence at least."""
        tails = F.transform(F.sequence(F.lit(1), F.size(open_)), lambda i: F.slice(open_, i, F.size(open_)))
        return F.coalesce(F.get(F.filter(tails, lambda t: (count(t) <= step) | (F.size(t) == 1)), 0), F.array().cast("array<string>"))

    def advance(acc: Column, s: Column) -> Column:
        full = (F.size(acc["open"]) > 0) & (count(acc["open"]) + word_count(s) > words)
        begun = F.when(full, kept(acc["open"])).otherwise(acc["open"])
        return F.struct(F.when(full, F.array_append(acc["out"], F.array_join(acc["open"], " "))).otherwise(acc["out"]).alias("out"), F.array_append(begun, s).alias("open"))

    none = F.array().cast("array<string>")
    fold = F.aggregate(loose_sentences(plain), F.struct(none.alias("out"), none.alias("open")), advance, lambda acc: F.array_append(acc["out"], F.array_join(acc["open"], " ")))
    return F.when(plain == "", none).when(word_count(plain) <= words, F.array(plain)).otherwise(F.filter(fold, lambda w: w != ""))


def best_segment(parts: Column, question: Column) -> Column:
    """The segment that shares most distinct words with a question, the first of those that share as many."""
    asked = F.array_distinct(F.split(F.lower(question), r"\s+"))
    shared = lambda s: F.size(F.array_intersect(asked, F.array_distinct(F.split(F.lower(s), r"\s+"))))
    scored = F.transform(parts, lambda s, i: F.struct((-shared(s)).alias("shared"), i.alias("place"), s.alias("text")))
    return F.array_min(scored)["text"]
