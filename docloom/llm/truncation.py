"""Text cut off by field limits (problem 9).

Each text is read once by a stack automaton, which reports what its end leaves open: quotes, brackets, tags, code fences,
table rows, escapes, multibyte sequences, and a missing terminator. Three baselines then decide what counts, all of
them counted over the whole corpus:

* script: where texts of a script end without a terminator as a rule (Thai), its absence is no sign. There a text is cut
  if its last segment ends as no segment inside any text of that script does.
* source and size: a length (in characters or bytes) at which texts of a source pile up and end open is a limit of that source, of which it may
  have several. Texts may also pile up within a word's length below a limit, where they were cut at the end of a word and nothing longer ends open.
  A text at a limit counts as cut on weaker signs (a number before its full stop, an ellipsis, an open end in a source whose
  complete texts lack terminators).
* source: where more than half of a source's texts of a script lack the terminator away from its limit, the absence alone is no sign there.

Cases: null, empty and blank texts are complete; a null source is a source of its own; repeated rows count once for each key.
A text that ends in a heading, list item, whole table row, reference or signature is complete. Texts are read whole; brackets and quotes
don't reach over an empty line, so the stack is emptied there.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.session import cut

from .sentences import _SPACED, ATERM, CLOSE, STERM, Abbreviations

#: A limit shows at least so many texts of one length, of which a share ends open.
LIMIT_TEXTS, LIMIT_OPEN = 4, 0.6
#: They hold this share of the source's texts at least, or are so many and stand out so many times against the lengths around (so many on either side).
LIMIT_SHARE, PROMINENT_TEXTS, PROMINENCE, AROUND = 0.02, 20, 5, 8
#: Texts cut at the end of a word are up to so many characters short of the limit.
WORD_SLACK = 16
#: A script (or a source's texts of a script) does without terminators if this share of its texts ends without.
WITHOUT = 0.5
#: The suffix by which the last segment of a text in a script without terminators is compared, and in how many texts it must end a segment.
SUFFIX, SUFFIX_TEXTS = 6, 2

_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "《": "》", "「": "」", "『": "』", "“": "”", "«": "»"}
_CLOSERS = set(_PAIRS.values())
_SPACED_CHAR = re.compile(f"[{_SPACED}]")
_WIDE = re.compile("[぀-ヿ㐀-鿿가-힯]")
_OPEN_TAG = re.compile(r"<(?:!--[^>]*|/?[A-Za-z][^<>]*|/)?")
_TAG = re.compile(r"<(/?)([a-zA-Z][\w-]*)(?:\s[^<>]*)?(/?)>")
_ESCAPE = re.compile(r"(?:\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|&(?:#\d*|#x[0-9a-fA-F]*|[A-Za-z]{2,8})|%[0-9A-Fa-f]?)")
_VOID = {"br", "hr", "img", "input", "meta", "link", "source", "wbr", "p", "li", "td", "tr", "th", "dd", "dt"}
_STRUCTURE = re.compile(
    r"(?:#{1,6}\s+\S.*|[-*+•]\s+\S.*|\(?\d{1,3}[.)]\s+\S.*|\|.*\||(?:[-—–]{1,2}|~)\s?\S.*|[=\-_*]{3,}"
    r"|(?:ref|rev|revision|version|v|doc|id|page|p|annex|appendix|©)\b[.:#]?\s*\S+"
    r"|(?:see|see also|siehe|siehe auch|voir|voir aussi|véase|véase también|note|source|sources|quelle|fuente)\s*:\s*\S.*|\[\d+\].*|https?://\S+)",
    re.IGNORECASE,
)
#: A line with the end of a sentence within it is prose, whatever it begins with.
_PROSE = re.compile(r"\w{3,}[.!?。！？।]\s+\S")
_TERMINAL = set(STERM + ATERM)
_CLOSING = set(CLOSE) | set("*_`")
#: Abbreviations that are words too: at the end of a text they end a sentence.
_WORDS_TOO = ("par", "art", "no", "s", "ed")

_QUOTE_ENDS = ("straight", "“”", "”", "»", "」", "』")
_OPENING_QUOTES = "“„«「『\""


def _one_sentence_after_quote(body: str) -> bool:
    """Whether the last quotation mark is followed by one sentence: a text that ends with it ends inside the quotation."""
    at = max(body.rfind(c) for c in _OPENING_QUOTES)
    return at >= 0 and not any(c in _TERMINAL for c in body[at + 1 :].rstrip()[:-1])


def _open_from(body: str, marks: str, pattern: re.Pattern) -> bool:
    """Whether a text ends within what begins with the last of some marks."""
    at = max(body.rfind(c) for c in marks)
    return at >= 0 and pattern.fullmatch(body, at) is not None


SIGNS = T.StructType(
    [
        T.StructField("script", T.StringType()),
        T.StructField("broken", T.StringType()),
        T.StructField("terminated", T.BooleanType()),
        T.StructField("structured", T.BooleanType()),
        T.StructField("weak", T.BooleanType()),
        T.StructField("suffix", T.StringType()),
        T.StructField("inner", T.ArrayType(T.StringType())),
        T.StructField("chars", T.IntegerType()),
        T.StructField("bytes", T.IntegerType()),
    ]
)


_MARKS = re.compile('["„“”' + re.escape("".join(_PAIRS) + "".join(_PAIRS.values())) + "]|\\n\\n")


def open_marks(text: str) -> list[str]:
    """The marks that are open at the end of a text: a stack of brackets and quotes, emptied by an empty line, in which
    apostrophes, emoticons and list numbers close nothing; tags and code fences over the whole text."""
    stack: list[str] = []
    straight = False
    for mark in _MARKS.finditer(text):
        c, i = mark.group(), mark.start()
        if c == "\n\n":
            stack, straight = [], False
        elif c == '"':
            previous = text[i - 1] if i else " "
            if straight and "straight" in stack:
                del stack[len(stack) - 1 - stack[::-1].index("straight") :]
                straight = False
            elif previous in " \n\t([{—-" and i + 1 < len(text) and not text[i + 1].isspace():
                stack.append("straight")
                straight = True
        elif c == "„":
            stack.append("“”")
        elif c in _PAIRS and not (c == "“" and stack and stack[-1] == "“”"):
            stack.append(_PAIRS[c])
        else:
            for depth in range(len(stack) - 1, -1, -1):
                if c in stack[depth]:
                    del stack[depth:]
                    break
    if "<" in text:
        names: list[str] = []
        for close, name, alone in _TAG.findall(text):
            name = name.lower()
            if close:
                if name in names:
                    del names[len(names) - 1 - names[::-1].index(name) :]
            elif not alone and name not in _VOID:
                names.append(name)
        stack += [f"<{n}>" for n in names]
    if text.count("```") % 2:
        stack.append("```")
    return stack


def signs_of(text: str | None) -> dict | None:
    """What the automaton sees at the end of a text; null for a text without content."""
    body = "" if text is None else text.rstrip()
    if not body.strip("​﻿  \n\t"):
        return None
    last_line = body[body.rfind("\n") + 1 :].strip()
    script = "spaced" if _SPACED_CHAR.search(body[-40:]) else "wide" if _WIDE.search(body[-40:]) else "other"
    core = body
    while core and core[-1] in _CLOSING:
        core = core[:-1]
    end = core[-1:] if core else body[-1]
    terminated = end in _TERMINAL
    broken = ""
    weak = False
    if body[-1] == "�" or "\ud800" <= body[-1] <= "\udfff":
        broken = "multibyte"
    elif _open_from(body, "<", _OPEN_TAG):
        broken = "markup"
    elif not terminated and _open_from(body, "\\&%", _ESCAPE):
        broken = "escape"
    elif last_line.startswith("|") and not last_line.endswith("|"):
        broken = "table"
    structured = not broken and bool(_STRUCTURE.fullmatch(last_line)) and not _PROSE.search(last_line, 4) and (len(last_line) < len(body) or last_line[:1] == "#")
    if not broken and not structured:
        left = open_marks(body)
        if terminated and left:
            left = [x for x in left if x in _QUOTE_ENDS and _one_sentence_after_quote(body)]
        elif script == "spaced":  # an unclosed tag says nothing where a complete text can't be told by its terminator
            left = [x for x in left if x[0] != "<"]
        if left:
            broken = "markup" if any(x[0] in "<`" for x in left) else "quote" if any(x in _QUOTE_ENDS for x in left) else "bracket"
        elif end == "…" or core.endswith("..."):
            before = core.rstrip("….").rstrip()
            if before and before[-1] not in _TERMINAL:
                broken = "ellipsis"
        elif terminated and end in ATERM:
            stem = core[:-1]
            word = "" if not stem or stem[-1].isspace() else stem.rsplit(None, 1)[-1].lstrip("([„“«\"'")
            low = word.lower()
            alone = len(body) <= len(word) + 2
            if not alone:
                before = core[: len(core) - 1 - len(word)].rstrip()
                counted = before[-1:].isdigit()
                held = Abbreviations(body)
                if len(low) > 1 and not counted and (held.holds("title", low) or held.holds("number", low) and low not in _WORDS_TOO):
                    broken = "abbreviation"
                elif low in ("i.e", "e.g", "z.b", "d.h", "p.ex", "p.ej", "т.е") or re.search(r"(?:^|[\s(])(?:[zd]\. [bh]|p\. (?:ex|ej)|т\. е|i\. e|e\. g)$", core[:-1].lower()[-8:]):
                    broken = "abbreviation"
                weak = word.isdigit() or low in ("p", "a")
    segments = body.split() if script == "spaced" and not structured else []
    inner = list({s[-SUFFIX:] for s in segments[:-1] if _SPACED_CHAR.match(s[-1]) and len(s) >= SUFFIX})
    return {
        "script": script,
        "broken": broken,
        "terminated": terminated,
        "structured": structured,
        "weak": weak,
        "suffix": segments[-1][-SUFFIX:] if segments else None,
        "inner": inner,
        "chars": len(text),
        "bytes": len(text.encode("utf-8", "surrogatepass")),
    }


@F.pandas_udf(SIGNS)
def _signs_udf(texts: pd.Series) -> pd.DataFrame:
    rows = [signs_of(t) for t in texts]
    names = [f.name for f in SIGNS.fields]
    return pd.DataFrame({n: pd.Series([None if r is None else r[n] for r in rows], dtype="object") for n in names})


_signs_once = _signs_udf.asNondeterministic()  # for the planner only, which else computes the signs again for each field


def end_signs(text: Column) -> Column:
    return _signs_once(text)


def _limits(marked: DataFrame) -> DataFrame:
    """(_source, _unit, _size, _short): every length at a limit of a source, and for characters those up to a word below one, with by how much
    they fall short. Each distinct length of a source is one row here, however many texts have it."""
    units = F.array(*(F.struct(F.lit(u).alias("unit"), F.col(u).alias("size")) for u in ("chars", "bytes")))
    sizes = marked.where(~F.col("structured")).select("_source", F.explode(units).alias("_z"), "_open")
    piles = sizes.groupBy("_source", F.col("_z.unit").alias("_unit"), F.col("_z.size").alias("_size")).agg(F.count("*").alias("_n"), F.sum("_open").alias("_o"))
    totals = marked.groupBy("_source").agg(F.count("*").alias("_all"))
    by_size = Window.partitionBy("_source", "_unit").orderBy("_size")
    over = lambda c, low, high: F.coalesce(F.sum(c).over(by_size.rangeBetween(low, high)), F.lit(0))
    piles = piles.select(
        "*", ((over("_n", -AROUND, AROUND) - F.col("_n")) / (2 * AROUND)).alias("_around"), over("_o", -WORD_SLACK + 1, 0).alias("_o_within"), over("_n", -WORD_SLACK + 1, 0).alias("_n_within"),
        over("_o", 1, WORD_SLACK).alias("_o_after"), over("_o", -2 * WORD_SLACK + 1, -WORD_SLACK).alias("_o_before"),
    ).join(totals, "_source")
    share = LIMIT_SHARE * F.col("_all")
    exact = (F.col("_n") >= LIMIT_TEXTS) & (F.col("_o") >= LIMIT_OPEN * F.col("_n")) & ((F.col("_n") >= share) | (F.col("_n") >= PROMINENT_TEXTS) & (F.col("_n") >= PROMINENCE * F.col("_around")))
    words = (F.col("_o_within") >= F.greatest(F.lit(2 * LIMIT_TEXTS), share)) & (F.col("_o_within") >= LIMIT_OPEN * F.col("_n_within"))
    words = words & (F.col("_o_within") >= 10 * F.col("_o_after")) & (F.col("_o_within") >= PROMINENCE * F.col("_o_before")) & (F.col("_unit") == "chars") & (F.col("_o") > 0)
    # A pile of one length explains the lengths that are up to a word longer.
    piles = piles.withColumn("_exact", exact).withColumn("_explained", F.max(F.col("_exact").cast("int")).over(by_size.rangeBetween(-WORD_SLACK, 0)))
    found = piles.where(F.col("_exact") | words & (F.col("_explained") == 0)).select("_source", "_unit", "_size", "_exact")
    short = F.when(F.col("_unit") == "chars", F.sequence(F.lit(0), F.lit(WORD_SLACK))).otherwise(F.array(F.lit(0)))
    rows = found.select("_source", "_unit", "_exact", "_size", F.explode(short).alias("_short"))
    # A length that is the top of a pile of words' ends is near a limit, not at one.
    return rows.select("_source", "_unit", (F.col("_size") - F.col("_short")).alias("_size"), F.when(F.col("_exact"), F.col("_short")).otherwise(F.greatest("_short", F.lit(1))).alias("_short"))


def truncation(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """(key, source, truncated, sign, script, chars): one row per distinct record with content."""
    seen = df.where(F.length(F.trim(F.col(text))) > 0)
    seen = seen.select(F.col(key).alias("_key"), F.coalesce(F.col(source), F.lit("")).alias("_source"), F.col(source).alias("_shown"), end_signs(F.col(text)).alias("_s"))
    seen = seen.select("_key", "_source", "_shown", "_s.*").where(F.col("script").isNotNull()).distinct()
    seen = cut(seen)  # signs without texts, read by the five branches below: the automaton runs once
    open_end = ~F.col("terminated") & ~F.col("structured") & (F.col("broken") == "")

    marked = seen.withColumn("_open", (open_end | (F.col("broken") != "")).cast("int"))
    limits = _limits(marked)
    near, exact = limits.where("_unit = 'chars'").groupBy("_source", F.col("_size").alias("chars")).agg(F.min("_short").alias("_short")), limits.where("_unit = 'bytes' and _short = 0")
    exact = exact.select("_source", F.col("_size").alias("bytes"), F.lit(True).alias("_exact")).distinct()
    marked = marked.join(near, ["_source", "chars"], "left").join(exact, ["_source", "bytes"], "left")
    marked = marked.withColumn("_at", F.coalesce(F.col("_short") == 0, F.lit(False)) | F.col("_exact").isNotNull()).withColumn("_near", F.col("_short").isNotNull() | F.col("_exact").isNotNull())

    # Scripts, and sources by script, that do without terminators away from the limits.
    plain = marked.where(~F.col("structured") & (F.col("broken") == "") & ~F.col("_at"))
    by_source = plain.groupBy("_source", "script").agg(F.count("*").alias("_n"), F.sum((~F.col("terminated")).cast("long")).alias("_m"))
    by_script = by_source.groupBy("script").agg((F.sum("_m") > WITHOUT * F.sum("_n")).alias("_script_without"))
    by_source = by_source.select("_source", "script", ((F.col("_m") > WITHOUT * F.col("_n")) & (F.col("_n") >= 20)).alias("_source_without"))

    # Suffixes that end segments inside texts of scripts without terminators.
    suffixes = seen.select("script", F.explode("inner").alias("suffix")).groupBy("script", "suffix").agg(F.count("*").alias("_n"))
    suffixes = suffixes.where(F.col("_n") >= SUFFIX_TEXTS).select("script", "suffix", F.lit(True).alias("_known"))

    joined = marked.join(by_script, "script", "left").join(by_source, ["_source", "script"], "left").join(suffixes, ["script", "suffix"], "left")
    no_rule = F.coalesce("_script_without", F.lit(False))
    habit = F.coalesce("_source_without", F.lit(False)) & ~no_rule
    unknown_end = F.col("suffix").isNotNull() & F.col("_known").isNull()
    sign = (
        F.when(F.col("structured"), None)
        .when(F.col("broken") == "ellipsis", F.when(F.col("_near"), "ellipsis"))
        .when(F.col("broken") != "", F.col("broken"))
        .when(F.col("weak") & F.col("_at"), "limit")
        .when(F.col("terminated"), None)
        .when(no_rule, F.when(unknown_end, "segment"))
        .when(habit, F.when(F.col("_at"), "limit"))
        .otherwise("terminator")
    )
    out = joined.select(F.col("_key").alias(key), F.col("_shown").alias(source), sign.alias("sign"), "script", "chars")
    return out.withColumn("truncated", F.col("sign").isNotNull())


def truncation_rates(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """Texts, cut texts and their share for each source; texts without content count as complete."""
    found = truncation(df, key, source, text).where("truncated").select(F.col(key).alias("_key")).distinct().withColumn("_cut", F.lit(1))
    every = df.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(source).alias(source)).distinct()
    counted = every.join(found, "_key", "left").groupBy(source).agg(F.count("*").alias("n_texts"), F.count("_cut").alias("n_truncated"))
    return counted.withColumn("share", F.round(F.col("n_truncated") / F.col("n_texts"), 6))
