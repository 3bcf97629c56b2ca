"""Splitting oversized items at natural boundaries (problem 2).

Balanced targets: the least number of pieces that can hold a text is computed, targets of equal distance are set, and each
is moved to the strongest boundary near it: an empty line, the end of a table row or line, of a sentence, of a clause, of a
word. Where there is none near the target, the nearest place in the whole stretch that the limit allows is taken. While a limit
fails (no place at all, or a cut inside a word although another number of pieces may avoid it), one more piece is tried. Every
piece but the first begins `overlap` characters before the end of the one before, exactly.

Lengths and positions count characters of the stored text; outer white space belongs to no piece. Null, empty and blank
texts, and texts within the limit, give no piece unless `whole` asks for them. A text without any boundary is cut at the targets, but never before a
combining mark. Exact copies of a row come out once.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sentences import sentence_ends

LIMIT, OVERLAP = 1500, 150
#: How far a target may move, as a share of the distance between targets.
REACH = 0.4

_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_LINE = re.compile(r"\n")
_CLAUSE = re.compile(r"[;:,—–、，；：](?=\s|[　-鿿])|(?<=[、，；：])")
_WORD = re.compile(r"\s+")
#: Strengths of boundaries; a cut inside a word has none.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, NONE = 5, 4, 3, 2, 1, 0


def _boundaries(text: str) -> list[tuple[int, list[int]]]:
    """Positions after which a text may be cut, strongest first."""
    table = text.lstrip().startswith("|")
    return [
        (PARAGRAPH, [m.start() for m in _PARAGRAPH.finditer(text)]),
        (LINE, [m.start() for m in _LINE.finditer(text)]),
        (SENTENCE, [] if table else sentence_ends(text)),
        (CLAUSE, [m.end() for m in _CLAUSE.finditer(text)]),
        (WORD, [m.start() for m in _WORD.finditer(text)]),
    ]


def _nearest(places: list[int], low: int, high: int, target: float) -> int | None:
    at, end = bisect_left(places, low), bisect_right(places, high)
    if at >= end:
        return None
    k = bisect_left(places, target, at, end)
    near = [places[i] for i in (k - 1, k) if at <= i < end]
    return min(near, key=lambda p: abs(p - target))


def _whole_characters(text: str, at: int, low: int) -> int:
    """A place no later than `at` that is not before a combining mark or a joiner."""
    while at > low and at < len(text) and (unicodedata.combining(text[at]) or unicodedata.category(text[at])[0] == "M" or text[at] in "‍️" or text[at - 1] == "‍"):
        at -= 1
    return at


def _attempt(text: str, begin: int, end: int, n: int, limit: int, overlap: int, kinds: list[tuple[int, list[int]]]) -> tuple[int, list[int]] | None:
    """The ends of n pieces and how many cuts inside a word another number of pieces may avoid; none if they don't hold the text."""
    fresh = (end - begin - overlap) / n
    ends, avoidable = [], 0
    for i in range(1, n):
        start = begin if not ends else ends[-1] - overlap
        first = (ends[-1] if ends else begin + overlap) + 1
        low = max(end - (n - i) * (limit - overlap), first)
        high = min(start + limit, end - 1)
        if low > high:
            return None
        target = begin + overlap + i * fresh
        near_low, near_high = max(low, math.ceil(target - REACH * fresh)), min(high, math.floor(target + REACH * fresh))
        if near_low > near_high:
            near_low, near_high = low, high
        found = (_nearest(places, near_low, near_high, target) for _, places in kinds)
        place = next((p for p in found if p is not None), None)
        if place is None:
            anywhere = [p for _, places in kinds if (p := _nearest(places, low, high, target)) is not None]
            place = min(anywhere, key=lambda p: abs(p - target), default=None)
        if place is None:
            place = _whole_characters(text, int(min(max(target, low), high)), low)
            # With more pieces the stretch begins earlier: if there is a boundary there, this cut can be avoided.
            avoidable += any(_nearest(places, first, low, target) is not None for _, places in kinds)
        ends.append(place)
    return avoidable, [*ends, end]


def piece_bounds(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Begin and end of each piece of a text; one piece if it is within the limit."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than the limit")
    body = "" if text is None else text.strip()
    if not body:
        return []
    begin = len(text) - len(text.lstrip())
    end = begin + len(body)
    if len(body) <= limit:
        return [(begin, end)]
    kinds = _boundaries(text)
    least = max(2, math.ceil((len(body) - overlap) / (limit - overlap)))
    best: tuple[int, list[int]] | None = None
    # With twice the pieces every stretch reaches back to the cut before it: then no cut can be avoided by one more.
    for n in range(least, 2 * least + 3):
        tried = _attempt(text, begin, end, n, limit, overlap, kinds)
        if tried and (best is None or tried[0] < best[0]):
            best = tried
        if best and not best[0]:
            break
    if best is None:  # no number of balanced pieces holds: cut at the limit
        ends = list(range(begin + limit, end, limit - overlap))
        best = (0, [*ends, end])
    starts = [begin] + [e - overlap for e in best[1][:-1]]
    return list(zip(starts, best[1]))


def pieces(df: DataFrame, key: str, text: str, carry: list[str] | None = None, limit: int = LIMIT, overlap: int = OVERLAP, whole: bool = False) -> DataFrame:
    """(key, piece_no, begin_pos, end_pos, piece, *carry) of every oversized text; with `whole`, of the others too."""
    bounds = _bounds_udf(limit, overlap, whole)
    rows = df if whole else df.where(F.length(text) > limit)  # in the scan, before any Python
    rows = rows.select(key, F.col(text).alias("_text"), *(carry or [])).distinct()
    cut = rows.withColumn("_bounds", bounds(F.col("_text"))).select(key, *(carry or []), F.posexplode("_bounds").alias("piece_no", "_b"))
    return cut.select(key, "piece_no", "_b.begin_pos", "_b.end_pos", "_b.piece", *(carry or []))


def _bounds_udf(limit: int, overlap: int, whole: bool):
    kind = T.ArrayType(T.StructType([T.StructField("begin_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType()), T.StructField("piece", T.StringType())]))

    @F.pandas_udf(kind)
    def bounds(texts: pd.Series) -> pd.Series:
        found = [(t, piece_bounds(t, limit, overlap)) for t in texts]
        return pd.Series([[{"begin_pos": b, "end_pos": e, "piece": t[b:e]} for b, e in own] if whole or len(own) > 1 else [] for t, own in found], dtype="object")

    return bounds.asNondeterministic()  # for the planner only, which else filters on the bounds and computes them again
