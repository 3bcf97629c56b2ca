"""Sentence boundaries across languages and scripts (problem 4).

The rules are those of the standard character-property sentence break: terminators by property (full stops, which are
ambiguous, and other terminators, which are not), closing marks that follow them, spaces, paragraph separators. Added to
them are abbreviations by language that suppress a boundary, and quotations, inside which there is none.

Rules in the order of application:

1. An empty line always ends a sentence; a single line feed ends one unless the text runs on in lower case.
2. A quotation (paired marks within a paragraph) is passed over as a whole. If it ends with a terminator, a sentence ends
   after it only where a capital or an opening mark follows a space, or the paragraph ends.
3. `! ? 。 ！ ？ । ؟` and the like end a sentence, together with closing marks after them.
4. A full stop ends one unless it belongs to a number, an initial, an abbreviation or an ellipsis that runs on, or the
   text goes on in lower case. A styled word such as `pH` or `e-stop` may open a sentence.
5. In scripts without terminators (Thai, Lao, Khmer, Burmese) a space between two letters of the script ends one.

Terminators and closing marks are read from the Unicode property tables (Sentence_Break, General_Category). Abbreviations
hold in the languages of the text only, which its function words tell; a text without any has those of its script.
A text is read once from left to right, whatever its length.
"""

from __future__ import annotations

import re

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Abbreviations by language. "title" never ends a sentence; "number" doesn't before a digit or a label of
# one letter or code; "open" may end a sentence, which it does where a capital follows.
ABBREVIATIONS = {
    "en": {
        "title": "dr prof mr mrs ms st sr jr rev gen col capt lt sgt hon messrs mt vs viz approx ca cf al eg ie resp incl excl dept est",
        "number": "no nos fig figs sec secs ch chap eq eqs app vol vols p pp par art tab ref refs ed",
        "open": "etc inc ltd corp co am pm a.m p.m e.g i.e u.s u.k ph.d",
    },
    "de": {
        "title": "dr prof hr fr frl ing dipl z.b d.h u.a i.d.r o.ä z.t ca bzw vgl evtl ggf inkl exkl bspw sog gem zzgl max min",
        "number": "nr abb tab kap abs art bd s seite ziff",
        "open": "usw etc ff uvm str",
    },
    "fr": {
        "title": "m mm mme mlle dr pr me st ste p.ex c.-à-d cf env ex",
        "number": "n no fig p pp art chap vol tab éd réf",
        "open": "etc",
    },
    "es": {
        "title": "sr sra srta dr dra d da ud uds p.ej aprox prof ing lic ej cf",
        "number": "pág págs fig núm nº art cap vol tab n",
        "open": "etc ee.uu",
    },
    "ru": {
        "title": "т.е т.к т.н г-н г-жа проф акад им ул св напр ср прибл",
        "number": "рис стр табл гл п пп см ст разд",
        "open": "др пр т.д т.п г гг руб тыс млн",
    },
}
# The most frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to is in that for with on are was it as be by from this at or not if when must has have its an",
    "de": "der die das und ist in den von zu mit auf für nicht ein eine dem des im sich wird werden bei nach es an aus wenn vor zum zur oder",
    "fr": "le la les de des et est en un une du dans que pour pas sur par avec au ce sont il elle ne ou si aux",
    "es": "el la los las de del y es en un una que por para con no se al su como son si o está",
    "ru": "и в не на что с по для из к от при или как это до если у",
}
# The German words after which a number with a full stop is an ordinal, and the months.
ORDINAL_BEFORE = "am dem der den des die das im vom zum beim bis ab seit"
MONTHS = "januar februar märz april mai juni juli august september oktober november dezember"

_EVERY = "".join(map(chr, range(0x20000)))


def having(properties: str) -> str:
    """The characters with Unicode properties, in order."""
    return "".join(regex.findall(f"(?V1)[{properties}]", _EVERY))


#: Terminators (property STerm), full stops (property ATerm), and the marks that close after them: of the property Close those that are final
#: or closing punctuation, the straight ones, and the high one that closes in German.
STERM = having(r"\p{Sentence_Break=STerm}")
ATERM = having(r"\p{Sentence_Break=ATerm}")
CLOSE = having(r"\p{Sentence_Break=Close}&&[\p{Pe}\p{Pf}]") + "\"'“"

_by_language = {lang: {kind: frozenset(words.split()) for kind, words in kinds.items()} for lang, kinds in ABBREVIATIONS.items()}
_anywhere = {kind: frozenset().union(*(kinds[kind] for kinds in _by_language.values())) for kind in ("title", "number", "open")}
_function = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}
_every_function = frozenset(w for words in _function.values() for w in words)
_ordinal, _months = set(ORDINAL_BEFORE.split()), set(MONTHS.split())

_SPACED = "\u0e00-\u0e7f\u0e80-\u0eff\u1780-\u17ff\u1000-\u109f"
_QUOTES = "|".join(
    (
        "„[^„“”\\n]*(?:\\n(?!\\s*\\n)[^„“”\\n]*)*[“”]",
        "“[^“”\\n]*(?:\\n(?!\\s*\\n)[^“”\\n]*)*”",
        "«[^«»\\n]*(?:\\n(?!\\s*\\n)[^«»\\n]*)*»",
        "「[^「」\\n]*(?:\\n(?!\\s*\\n)[^「」\\n]*)*」",
        "『[^『』\\n]*(?:\\n(?!\\s*\\n)[^『』\\n]*)*』",
        "(?<![^\\s(\\[{])\"(?=\\S)[^\"\\n]*(?:\\n(?!\\s*\\n)[^\"\\n]*)*\"",
    )
)


def _tokens(sterm: str, aterm: str, close: str) -> re.Pattern:
    sterm, aterm, close = map(re.escape, (sterm, aterm, close))
    return re.compile(
        f"(?P<quote>{_QUOTES})"
        f"|(?P<term>(?:[{sterm}…]|[{aterm}](?![0-9]))[{sterm}{aterm}…]*[{close}]*)"
        "|(?P<line>[^\\S\\n]*(?:\\r\\n|[\\n\\r\\u0085\\u2028\\u2029])\\s*)"
        f"|(?P<gap>(?<=[{_SPACED}])[ \\u00a0]+(?=[{_SPACED}]))"
    )


_BEYOND = re.compile("[\U00010000-\U0010ffff]")
_near = lambda marks: "".join(c for c in marks if c < "\U00010000")
#: The break points of any text, and those of a text without characters beyond the basic plane, for which the classes are found faster.
_TOKEN, _TOKEN_NEAR = _tokens(STERM, ATERM, CLOSE), _tokens(_near(STERM), _near(ATERM), _near(CLOSE))
_LEADING = "([{“„«»”\"'‘’"
_AFTER = re.compile(r"\s*")
_STYLED = re.compile(r"[^\W\d_]-\w|[a-z]+[A-Z]")
_LABEL = re.compile(r"[A-Z](?:[\W\d]|$)|[A-Z]+-?\d")
_NEXT_WORD = re.compile(r"\w+")
_LETTERS = re.compile(r"[^\W\d_]+")
_CYRILLIC = re.compile("[\u0400-\u04ff]")


class Abbreviations:
    """The abbreviations that hold in a text: those of the languages whose function words it holds at least half as often as those
    of the most frequent one. The languages are looked for when an abbreviation is asked for."""

    def __init__(self, text: str):
        self.text, self.sets = text, None

    def _languages(self) -> list[str]:
        words = _LETTERS.findall(self.text.lower())
        own = [w for w in words if w in _every_function]
        counts = {lang: sum(w in held for w in own) for lang, held in _function.items()}
        most = max(counts.values())
        if most:
            return [lang for lang, n in counts.items() if 2 * n >= most]
        cyrillic = _CYRILLIC.search(self.text) is not None
        return [lang for lang in ABBREVIATIONS if (lang == "ru") == cyrillic]

    def holds(self, kind: str, word: str) -> bool:
        """Whether a word is an abbreviation of a kind in the text."""
        if word not in _anywhere[kind]:
            return False
        if self.sets is None:
            languages = self._languages()
            self.sets = {k: frozenset().union(*(_by_language[lang][k] for lang in languages)) for k in _anywhere}
        return word in self.sets[kind]


class _Reader:
    """What stands before the full stops of a text, found while they are visited from left to right."""

    def __init__(self, text: str):
        self.text, self.held = text, Abbreviations(text)
        self.read = self.begin = 0
        self.chain_end = self.chain_begin = -1

    def run_before(self, at: int) -> int:
        """Where the run without spaces that ends at `at` begins."""
        part = self.text[self.read : at]
        self.read = at
        last = part.rsplit(None, 1)
        if not part:
            return self.begin
        if not last or part[-1].isspace():
            self.begin = at
        elif len(last[-1]) < len(part):
            self.begin = at - len(last[-1])
        return self.begin

    def single_letters(self, at: int) -> int:
        """Where the letters with full stops between them (U. S. A) that end at `at` begin; `at` if there is only one letter or none."""
        text, start = self.text, at - 1
        if start < 0 or not text[start].isalpha():
            return at
        while True:
            stop = start - 1
            if stop >= 0 and text[stop].isspace():
                stop -= 1
            if stop < 1 or text[stop] != "." or not text[stop - 1].isalpha():
                break
            start = self.chain_begin if stop == self.chain_end else stop - 1
            if stop == self.chain_end:
                break
        self.chain_end, self.chain_begin = at, start
        return start if start < at - 1 else at

    def back_over_spaces(self, at: int) -> int:
        while at > 0 and self.text[at - 1].isspace():
            at -= 1
        return at


def _stop_ends(reader: _Reader, at: int, nxt: str, after: int, spaced: bool) -> bool:
    """Whether the full stop at `at` ends a sentence, given the next character that is no space."""
    text, held = reader.text, reader.held
    word = text[max(reader.run_before(at), at - 64) : at]  # only short words are looked up
    for mark in _LEADING:
        if mark in word:
            word = word[word.rfind(mark) + 1 :]
    head, _, tail = word.rpartition(".")
    if len(head.rpartition(".")[2]) > 2:  # a sentence began without a space, as in "minutes.Dr. X"
        word = tail
    low = word.lower()
    letters = reader.single_letters(at)
    upper = nxt.isupper() or nxt.istitle()
    if nxt.islower():
        if not _STYLED.match(text, after) or not spaced:
            return False
        return not held.holds("title", low) and not held.holds("number", low)
    if not spaced and not (upper and (after + 1 >= len(text) or not text[after + 1].isupper()) or nxt in "¿¡“„«「"):
        return not (nxt.isalnum() or nxt in "/_@-,;:") or not nxt.isascii()
    if held.holds("open", low):
        return not nxt.isdigit()
    if letters < at:
        return held.holds("open", re.sub(r"\s", "", text[letters:at]).lower()) and not nxt.isdigit()
    if len(word) == 1 and word.isalpha():
        if text[after + 1 : after + 2] == "." and (held.holds("title", f"{low}.{nxt.lower()}") or held.holds("open", f"{low}.{nxt.lower()}")):
            return False  # the first part of an abbreviation, as in z. B.
        place = at - 1
        place = reader.back_over_spaces(place - 1 if text[place - 1 : place] == "°" else place)
        if place > 0 and text[place - 1].isdigit():
            return True  # a unit
        following = _NEXT_WORD.match(text, after)
        if following and following.group().lower() in _every_function:
            return True  # an initial is followed by a name
        return not (word.isupper() or held.holds("title", low) or held.holds("number", low))
    if held.holds("title", low):
        place = reader.back_over_spaces(at - len(word))
        return place > 0 and text[place - 1].isdigit()  # a unit, as in 5 min
    if held.holds("number", low):
        return not (nxt.isdigit() or upper and _LABEL.match(text, after))
    if word.isdigit() and len(word) <= 2 and upper:
        following = _NEXT_WORD.match(text, after)
        if following and following.group().lower() in _months:
            return False
        end = begin = reader.back_over_spaces(at - len(word))
        while begin > 0 and end - begin <= 8 and (text[begin - 1].isalnum() or text[begin - 1] == "_"):
            begin -= 1
        if begin < end < at - len(word) and text[begin:end].lower() in _ordinal:
            return False
        if at - len(word) == 0 or text[at - len(word) - 1] == "\n":
            return False  # the number of a list item
    return True


def sentence_ends(text: str | None) -> list[int]:
    """The number of characters up to the end of each sentence. No content, or null: none."""
    if text is None:
        return []
    ends: list[int] = []
    size, start, pos = len(text), 0, 0
    find, reader = (_TOKEN_NEAR if text.isascii() or not _BEYOND.search(text) else _TOKEN).search, _Reader(text)

    def close(end: int) -> None:
        nonlocal start
        piece = text[start:end].rstrip()
        if piece and any(c.isalnum() for c in piece):
            ends.append(start + len(piece))
            start = end

    while m := find(text, pos):
        kind, end = m.lastgroup, m.end()
        if kind == "gap":
            close(m.start())
        elif kind == "line":
            if end < size and m.start() > start:
                several = m.group().count("\n") + m.group().count("\r") > 1 + m.group().count("\r\n")
                if several or not (text[end].islower() and not _STYLED.match(text, end)):
                    close(m.start())
        else:
            after = _AFTER.match(text, end).end()
            nxt = text[after] if after < size else ""
            if kind == "quote":
                inside = text[end - 2]
                if not nxt or "\n\n" in text[end:after]:
                    if inside in STERM or inside in ATERM or inside == "…":
                        close(end)
                elif inside in STERM or inside in ATERM or inside == "…":
                    if after > end and (nxt.isupper() or nxt in "¿¡“„«「『"):
                        close(end)
            elif not nxt:
                close(end)
            else:
                mark = m.group()
                closed = mark[-1] not in STERM and mark[-1] not in ATERM and mark[-1] != "…"
                core = mark.rstrip(CLOSE)
                if "\n\n" in text[end:after]:
                    close(end)
                elif closed and nxt.islower():
                    pass
                elif any(c in STERM for c in core):
                    close(end)
                elif len(core) > 1 or core == "…":  # an ellipsis
                    if not nxt.islower() and (after > end or nxt.isupper()):
                        close(end)
                elif _stop_ends(reader, m.start(), nxt, after, after > end):
                    close(end)
        pos = end
    close(size)
    return ends


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _ends_udf(texts: pd.Series) -> pd.Series:
    return texts.map(sentence_ends)


#: Not deterministic for the planner only: it would else filter on the positions before it computes them again.
_ends_once = _ends_udf.asNondeterministic()


def sentence_positions(text: Column) -> Column:
    """The end of each sentence of a text, as an array of positions counted in characters."""
    return _ends_once(text)


def sentence_rows(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """One row per sentence: the key, end_pos. Exact copies of a row come out once, through an aggregation of the
    positions and not of the texts; null, empty and blank texts give no row."""
    ends = df.select(*key, sentence_positions(F.col(text)).alias("_ends")).distinct()
    return ends.select(*key, F.explode("_ends").alias("end_pos"))


def sentence_pieces(text: str | None) -> list[dict]:
    """The sentences of a text with their ends, stripped of outer white space."""
    start, out = 0, []
    for end in sentence_ends(text):
        out.append({"end_pos": end, "sentence": text[start:end].strip()})
        start = end
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("end_pos", T.IntegerType()), T.StructField("sentence", T.StringType())])))
def _pieces_udf(texts: pd.Series) -> pd.Series:
    return texts.map(sentence_pieces)


_pieces_once = _pieces_udf.asNondeterministic()


def sentence_units(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """One row per sentence with its number and its text, stripped of outer white space. Exact copies of a row are removed before
    they are cut; the sentences are cut where they are found, in one reading of the text."""
    rows = df.select(*key, F.col(text).alias("_text")).distinct().select(*key, F.posexplode(_pieces_once("_text")).alias("sentence_no", "_s"))
    return rows.select(*key, "sentence_no", "_s.end_pos", "_s.sentence")
