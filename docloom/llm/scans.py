"""Noise in text from scanned pages (problem 5).

Misread words: words are grouped by a skeleton in which confusable glyphs are one (`c` and `e`, `1` and `l`, `rn` and `m`).
A form that clean text doesn't use, in a group with a form that is frequent, is misread; where several frequent forms share the
skeleton, the one that follows the same word elsewhere is chosen. Word counts are taken over all texts, scanned or not.

Running heads and page numbers: the lines at the edges of a page, with digits masked and reduced to skeletons, are counted
over the pages of a book. Texts that run over several pages hold them between their lines: there a line is a head if its mask is
one of the book's, and a number if it is that of a page of the text. Hyphenation: a line that ends in a hyphen and the line after it are joined, unless the word is
known with a hyphen of its own.

Repair: heads and numbers are dropped, misread words replaced, broken words joined, and lines reflowed into
paragraphs with SQL windows over the lines of a text.

Scale: words are cut by three narrow passes in Arrow batches: one over all texts for the word counts, one over the scanned texts
for everything that the rules look at, one over the clean texts for the contexts. Counts are summed up within each batch, before
the shuffle. Of the words of scanned texts only those go on that are among the misread forms; these are broadcast after their bytes
have been measured, and joined with a shuffle beyond the bound (a frequent word is never misread, so no form is hot). Texts themselves are shuffled only
where exact copies of a row were found. Nothing is collected.

Cases: null and empty texts have no lines; a text that was not scanned isn't touched; repeated rows count once; a book of one page has no
repeated edges and its heads are found by their page number only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.session import broadcast_checked, cut

from .sentences import _BEYOND, having

# Glyphs that scanning confuses: single ones, then groups, in this order.
SINGLE_GLYPHS = ("j1059e8f|!$", "ilosgcbtlls")
GROUPED_GLYPHS = (("m", "rn"), ("w", "vv"), ("h", "li"), ("u", "ii"), ("d", "cl"))
# The marks that end a broken line.
HYPHENS = "-‐‑¬­"
#: A form is misread if a form of its group is so many times more frequent, and clean text has it so many times less often than scanned text has.
LEAD, CLEAN_LEAD = 4, 5
#: A head stands on so many pages of its book at least if it looks like a title, else on so many and this share.
TITLE_PAGES, LINE_PAGES, LINE_SHARE = 2, 5, 0.15

_WORD = r"[\p{L}\p{M}\p{N}]+"

def skeleton(word: Column) -> Column:
    """A word in lower case with confusable glyphs made equal. Glyphs that look like two are written as the two: taken the other
    way round, overlapping groups (`liil`) would depend on where one begins to read."""
    out = F.translate(F.lower(word), *SINGLE_GLYPHS)
    for one, pair in GROUPED_GLYPHS:
        out = F.replace(out, F.lit(one), F.lit(pair))
    return out

def skeleton_of(word: str) -> str:
    """`skeleton` of a Python string."""
    out = word.lower().translate(_SINGLE)
    for one, pair in GROUPED_GLYPHS:
        out = out.replace(one, pair)
    return out


_SINGLE = str.maketrans(*SINGLE_GLYPHS)
_LETTER = regex.compile(r"\p{L}")
_COMPOUNDS = regex.compile(r"[\p{L}\p{M}]++(?:-[\p{L}\p{M}]++)+")
_LINE_HYPHEN = re.compile(rf"[{HYPHENS}][^\S\n]*\n")
_HYPHEN_SET = frozenset(HYPHENS)
_LAST_PART = regex.compile(rf"([\p{{L}}\p{{M}}]+(?:[-‐‑][\p{{L}}\p{{M}}]+)*)([{HYPHENS}])\s*$")
_FIRST_PART = regex.compile(r"\s*([\p{L}\p{M}]+(?:[-‐‑][\p{L}\p{M}]+)*)")
_LAST_WORD = regex.compile(rf"({_WORD})[{HYPHENS}]\s*$")
_FIRST_WORD = regex.compile(rf"\s*({_WORD})")


def _word_patterns(marks: str) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """Words, words with hyphens between, and words broken over lines. The underscore, which this class holds, must have been replaced."""
    word = rf"[\w{marks}]"
    return re.compile(f"{word}+"), re.compile(f"{word}++(?:-{word}++)*+"), re.compile(rf"{word}++[{HYPHENS}][^\S\n]*\n\s*{word}*")


_ALL_MARKS = having(r"\p{M}")
_NEAR_PATTERNS, _ALL_PATTERNS = _word_patterns("".join(c for c in _ALL_MARKS if c < "\U00010000")), _word_patterns(_ALL_MARKS)


def _patterns(text: str) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    return _NEAR_PATTERNS if text.isascii() or not _BEYOND.search(text) else _ALL_PATTERNS


def distinct_texts(texts: DataFrame) -> DataFrame:
    """The distinct rows of (src, rec_id, ..., text) that have a text. Rows are compared by a hash of all columns; only those whose hash occurs more
    than once are shuffled."""
    rows = texts.where(F.col("text").isNotNull())
    hashed = rows.withColumn("_hash", F.xxhash64(*rows.columns))
    several = broadcast_checked(cut(hashed.groupBy("_hash").agg(F.count("*").alias("_n")).where("_n > 1").select("_hash")))
    return hashed.join(several, "_hash", "left_anti").select(*rows.columns).unionByName(hashed.join(several, "_hash", "left_semi").select(*rows.columns).distinct())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs: tuple[Counter, Counter] = (Counter(), Counter())
        for scanned, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            _, hyphened, broken = _patterns(text)
            body = text.replace("_", " ")
            body = broken.sub(" ", body) if _LINE_HYPHEN.search(body) else body
            runs[bool(scanned)].update(hyphened.findall(body.lower().replace("‐", "-").replace("‑", "-")))
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for own, found in zip(counts, runs):
            for run, n in found.items():
                if "-" in run:
                    for word in (*run.split("-"), *_COMPOUNDS.findall(run)):
                        own[word] += n
                else:
                    own[run] += n
        words = [w for w in counts[0].keys() | counts[1].keys() if _LETTER.search(w)]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in counts)], names=["word", "n_clean", "n_scan"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n_clean, n_scan): how often each form occurs in distinct texts (ocr, text), words broken over lines left out.
    Compounds with a hyphen count as a form of their own, beside their parts."""
    partial = texts.select("ocr", "text").mapInArrow(_counted, "word string, n_clean long, n_scan long")
    return partial.groupBy("word").agg(F.sum("n_clean").alias("n_clean"), F.sum("n_scan").alias("n_scan"))


def misread_forms(counts: DataFrame) -> DataFrame:
    """(word, skeleton, right, n_rivals): the misread forms, the most frequent form of each one's group, and how many forms of the
    group are frequent. Only forms of letters are right; forms with digits are looked at if letters outnumber them, so that codes and
    values with units are left."""
    forms = counts.where(~F.col("word").contains("-") & (F.length("word") >= 2)).withColumn("skeleton", skeleton(F.col("word")))
    letters = ~F.col("word").rlike(r"\p{N}")
    total = F.col("n_clean") + F.col("n_scan")
    best = forms.where(letters).groupBy("skeleton").agg(F.max(F.struct(total.alias("n"), "n_clean", "word")).alias("best"), F.count_if(_in_use()).alias("n_rivals"))
    digits = F.length(F.regexp_replace("word", r"[^\p{N}]", ""))
    plausible = letters | (~F.col("word").rlike(r"^\p{N}+\p{L}{1,2}$") & (digits * 2 <= F.length("word")) & ~F.col("word").rlike(r"^\p{L}\p{N}{2,}$"))
    plausible = plausible & ~F.col("word").rlike("^[ivxlcdm]+$")
    rows = forms.where(plausible).join(best, "skeleton").where(F.col("word") != F.col("best.word"))
    rows = rows.where((F.col("best.n") >= LEAD * total) & (F.col("n_clean") * CLEAN_LEAD <= F.col("n_scan")) & (F.col("n_scan") > 0))
    return rows.select("word", "skeleton", F.col("best.word").alias("right"), "n_rivals")

def _in_use() -> Column:
    """A form that clean text uses more than once."""
    return ~F.col("word").rlike(r"\p{N}") & (F.col("n_clean") > 1)

def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for text in batch.column(0).to_pylist():
            words = _patterns(text)[0].findall(text.lower().replace("_", " "))
            counts.update(zip(["", *words], words))
        before, form = zip(*counts) if counts else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(before, pa.string()), pa.array(form, pa.string()), pa.array(counts.values(), pa.int64())], names=["before", "form", "n"])


def with_context(misread: DataFrame, counts: DataFrame, texts: DataFrame) -> DataFrame:
    """Misread words (.., word, skeleton, right, n_rivals, before) with `right` chosen by context where several forms of the group are in use:
    the form that follows the same word most often in clean text, else the most frequent. Only pairs with such forms are counted."""
    used = counts.where(~F.col("word").contains("-") & (F.length("word") >= 2) & _in_use()).withColumn("skeleton", skeleton(F.col("word")))
    rivals = used.join(used.groupBy("skeleton").agg(F.count("*").alias("_n")).where("_n > 1"), "skeleton").select("skeleton", F.col("word").alias("form"), F.col("n_clean").alias("n_form"))
    rivals = broadcast_checked(cut(rivals))
    clean = texts.where(~F.coalesce("ocr", F.lit(False))).select("text").mapInArrow(_pairs, "before string, form string, n long")
    pairs = clean.join(rivals.select("form"), "form", "left_semi").groupBy("before", "form").agg(F.sum("n").alias("n_pair"))
    several = misread.where("n_rivals > 1").join(rivals, "skeleton").join(pairs, ["before", "form"], "left")
    keys = [c for c in misread.columns if c != "right"]
    chosen = several.groupBy(*keys).agg(F.max(F.struct(F.coalesce("n_pair", F.lit(0)).alias("n_pair"), "n_form", "form")).alias("_best")).select(*keys, F.col("_best.form").alias("right"))
    return misread.where("n_rivals <= 1").unionByName(chosen)

#: What the rules look at, one row each: kind, line, two words, and the flags of a kind.
MARKS = "src string, rec_id string, kind string, line_no int, word string, before string, book string, page int, last_page int, flags int"
#: Flags of a hyphen: it stands on the last line, it can't be a word's own. Flags of an edge: number, numbered, titled, capitals.
IS_LAST, SOFT = 1, 2
IS_NUMBER, NUMBERED, TITLED, CAPITALS = 1, 2, 4, 8

_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
_FIGURES = str.maketrans("lios", "1105")
_NUMBER_LINE = regex.compile(r"(?:page|p\.|seite|página|стр\.)?\s*[-–—\[(~·.]*\s*([0-9lios]+|[ivxlcdm]+)\s*[-–—\])~·]*(?:\s*(?:of|/|von|de)\s*[0-9]+)?")
_BEFORE, _AFTER = regex.compile(r"(?i)([0-9]+|[ivxlcdm]+)\s{2,}\S"), regex.compile(r"(?i)\S\s{2,}([0-9]+|[ivxlcdm]+)$")
_APART = regex.compile(r"(?i)(?:^(?:[0-9]+|[ivxlcdm]+)\s{2,}|\s{2,}(?:[0-9]+|[ivxlcdm]+)\s*$)")
_SMALL = r"(?:of|the|and|for|in|on|to|a|an|with|de|la|le|les|des|du|et|der|die|das|und|von|y|el|los|las)"
_TITLE = regex.compile(rf"(?:[^\p{{Ll}}\s]\S*|{_SMALL})(?:\s+(?:[^\p{{Ll}}\s]\S*|{_SMALL}))*")
_TITLE_END, _THREE = regex.compile(r"[.!?:;,]$"), regex.compile(r"\p{L}{3}")
_LOWER, _FOUR_CAPITALS, _CODE = regex.compile(r"\p{Ll}"), regex.compile(r"\p{Lu}{4}"), regex.compile(r"\p{L}-?\p{N}")
_STRUCTURE, _NO_LETTER, _DIGITS = regex.compile(r"#|\[|\||[-*•]\s"), regex.compile(r"[^\p{L}]"), regex.compile(r"\p{N}+")


def number_of(text: str) -> int | None:
    """The number that a page's number in figures or Roman numerals shows, confusable glyphs read as figures; none for another text."""
    if regex.fullmatch("[0-9lios]+", text) and regex.search("[0-9]", text):
        return int(text.translate(_FIGURES)[-18:])  # no page has a number of so many figures
    if not text or not regex.fullmatch("[ivxlcdm]+", text):
        return None
    total = last = 0
    for value in map(_ROMAN.__getitem__, text):
        total += value - (2 * last if last < value else 0)
        last = value
    return total


def _edge(line: str, page: int, last_page: int) -> tuple[str, int] | None:
    """The mask of a line that may be a head or a number, and its flags; none for a line that can't."""
    bare = " ".join(line.split())
    shown = _NUMBER_LINE.fullmatch(bare.lower().replace("|", "l").replace("!", "l"))
    own = lambda n: n is not None and page <= n <= last_page
    if shown and own(number_of(shown.group(1))):
        return "", IS_NUMBER
    if _STRUCTURE.match(bare):
        return None
    line = line.strip(" ")
    title = _APART.sub("", line).strip(" ")
    if len(_NO_LETTER.sub("", title)) < 3:
        return None
    flags = 0
    number = _BEFORE.match(line) or _AFTER.search(line)
    if number and own(number_of(number.group(1).lower())):
        flags |= NUMBERED
    if _TITLE.fullmatch(title) and not _TITLE_END.search(title) and _THREE.search(title):
        flags |= TITLED
        if not _LOWER.search(title) and _FOUR_CAPITALS.search(title) and not _CODE.search(title):
            flags |= CAPITALS
    if page != last_page and not flags & TITLED:
        return None
    return skeleton_of(" ".join(_DIGITS.sub("#", title).split())), flags


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at: list[int] = []
        kind: list[str] = []
        line_no: list[int] = []
        word: list[str] = []
        before: list[str] = []
        flags: list[int] = []

        def add(row: int, k: str, n: int, w: str, b: str, f: int) -> None:
            at.append(row), kind.append(k), line_no.append(n), word.append(w), before.append(b), flags.append(f)  # noqa: B018

        for row, (page, last_page, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page", "last_page", "text")))):
            lines = text.split("\n")
            if page is not None and page == last_page:
                add(row, "page", -1, "", "", 0)
            find = _patterns(text)[0].findall
            broken = False
            for n, line in enumerate(lines):
                hyphen = line.rstrip()[-1:] in _HYPHEN_SET
                tail = _LAST_WORD.search(line) if hyphen else None
                first = _FIRST_WORD.match(line) if broken else None
                words = find((line[: tail.start()] if tail else line)[first.end() if first else 0 :].lower().replace("_", " "))
                at.extend([row] * len(words)), kind.extend(["word"] * len(words)), line_no.extend([n] * len(words)), flags.extend([0] * len(words))  # noqa: B018
                word.extend(words), before.extend(["", *words[:-1]] if words else [])  # noqa: B018
                broken = tail is not None
                if not hyphen:
                    continue
                following = lines[n + 1] if n + 1 < len(lines) else None
                left = _LAST_PART.search(line)
                right = _FIRST_PART.match(following) if following is not None else None
                if left and (right or following is None):
                    add(row, "hyphen", n, left.group(1).lower(), right.group(1).lower() if right else "", (following is None) * IS_LAST | (left.group(2) in "¬­") * SOFT)
                rest = _FIRST_WORD.match(following) if following is not None else None
                if tail and rest:
                    add(row, "broken", n, tail.group(1).lower(), rest.group(1).lower(), 0)
            if page is not None and last_page is not None:
                filled = [n for n, line in enumerate(lines) if line.strip()]
                for n in sorted({*filled[:1], *filled[-2:]}) if page == last_page else filled:
                    found = _edge(lines[n], page, last_page)
                    if found:
                        add(row, "edge", n, found[0], "", found[1])
        rows = pa.array(at, pa.int32())
        taken = {c: batch.column(c).take(rows) for c in ("src", "rec_id", "book", "page", "last_page")}
        own = {"kind": pa.array(kind, pa.string()), "line_no": pa.array(line_no, pa.int32()), "word": pa.array(word, pa.string()), "before": pa.array(before, pa.string()), "flags": pa.array(flags, pa.int32())}
        names = [c.split()[0] for c in MARKS.split(", ")]
        yield pa.RecordBatch.from_arrays([(taken | own)[c] for c in names], names=names)


def scan_marks(scanned: DataFrame, forms: DataFrame) -> DataFrame:
    """What the rules look at in the scanned texts: words among the misread `forms`, hyphens at the ends of lines, words broken over lines, lines that
    may be heads or numbers, pages."""
    columns = ["src", "rec_id", "book", F.col("page").cast("int").alias("page"), F.col("last_page").cast("int").alias("last_page"), "text"]
    marks = scanned.select(*columns).mapInArrow(_marked, MARKS)
    wrong = forms.select(F.col("word").alias("_form"), F.lit("word").alias("_kind"), "skeleton", "right", "n_rivals")
    joined = marks.join(broadcast_checked(wrong), (F.col("word") == F.col("_form")) & (F.col("kind") == F.col("_kind")), "left")
    return joined.where((F.col("kind") != "word") | F.col("_form").isNotNull()).drop("_form", "_kind")


def _hyphen_breaks(marks: DataFrame, counts: DataFrame) -> DataFrame:
    """(src, rec_id, line_no) of lines that end inside a word without a hyphen of its own."""
    has = lambda flag: F.col("flags").bitwiseAND(F.lit(flag)) > 0
    rows = marks.where("kind = 'hyphen'").select("src", "rec_id", "line_no", F.col("word").alias("left"), F.col("before").alias("right"), has(SOFT).alias("soft"), has(IS_LAST).alias("is_last"))
    rows = rows.withColumn("joined", F.concat("left", "right")).withColumn("hyphened", F.concat_ws("-", "left", "right"))
    # The joined word may itself be misread: it is looked up by its skeleton too.
    known = counts.withColumn("n", F.col("n_clean") + F.col("n_scan")).select("word", "n")
    shapes = known.where(~F.col("word").contains("-")).groupBy(skeleton(F.col("word")).alias("shape")).agg(F.sum("n").alias("n_joined"))
    compounds = known.where(F.col("word").contains("-")).groupBy(F.col("word").alias("hyphened")).agg(F.sum("n").alias("n_hyphened"))
    heads = known.where(F.col("word").contains("-")).groupBy(F.regexp_replace("word", "-[^-]*$", "").alias("left")).agg(F.sum("n").alias("n_head"))
    wholes = known.where(~F.col("word").contains("-"))
    rows = rows.withColumn("shape", skeleton(F.col("joined")))
    rows = rows.join(shapes, "shape", "left").join(compounds, "hyphened", "left").join(heads, "left", "left")
    rows = rows.join(wholes.select(F.col("word").alias("left"), F.col("n").alias("n_left")), "left", "left")
    rows = rows.join(wholes.select(F.col("word").alias("right"), F.col("n").alias("n_right")), "right", "left")
    count = lambda c: F.coalesce(c, F.lit(0))
    own = (
        F.when(count("n_hyphened") > count("n_joined"), True)
        .when(count("n_joined") > 0, False)
        .when(F.col("soft"), False)
        .when(F.col("is_last"), (count("n_head") > 0) & (count("n_left") > 0))
        .otherwise((count("n_left") > 0) & (count("n_right") > 0) & (F.length("left") > 2) & (F.length("right") > 3))
    )
    return rows.where(~own).select("src", "rec_id", "line_no")

def _edges(marks: DataFrame) -> DataFrame:
    """(src, rec_id, line_no, defect) of running heads and page numbers."""
    has = lambda flag: F.col("flags").bitwiseAND(F.lit(flag)) > 0
    rows = marks.where("kind = 'edge'").withColumn("mask", F.col("word"))
    rows = rows.withColumns({"is_number": has(IS_NUMBER), "numbered": has(NUMBERED), "titled": has(TITLED), "capitals": has(CAPITALS)})
    is_page = F.col("page") == F.col("last_page")
    candidates = rows.where(~F.col("is_number"))
    on_pages = candidates.where(is_page).groupBy("book", "mask").agg(F.count_distinct("page").alias("on_pages"))
    in_book = marks.where("kind = 'page'").groupBy("book").agg(F.count_distinct("page").alias("in_book"))
    heads = candidates.join(on_pages, ["book", "mask"], "left").join(in_book, "book", "left")
    pages = F.coalesce("on_pages", F.lit(0))
    repeated = pages >= F.greatest(F.lit(LINE_PAGES), F.ceil(LINE_SHARE * F.col("in_book")))
    is_head = F.col("titled") & (F.col("numbered") | F.col("capitals") | (pages >= TITLE_PAGES)) | F.col("numbered") & (pages >= TITLE_PAGES) | F.coalesce(repeated, F.lit(False))
    numbers = rows.where("is_number").select("src", "rec_id", "line_no", F.lit("page_number").alias("defect"))
    return numbers.unionByName(heads.where(is_head).select("src", "rec_id", "line_no", F.lit("running_head").alias("defect")))

def _misread_words(marks: DataFrame) -> DataFrame:
    """(src, rec_id, line_no, word, skeleton, right, n_rivals, before) of misread words; parts of words broken over lines are left out."""
    return marks.where("kind = 'word'").select("src", "rec_id", "line_no", "word", "skeleton", "right", "n_rivals", "before")


def _broken_misreads(marks: DataFrame, shapes: DataFrame) -> DataFrame:
    """Misread words that are broken over two lines: (src, rec_id, line_no) of the part that holds the wrong glyph."""
    rows = marks.where("kind = 'broken'").select("src", "rec_id", "line_no", F.col("word").alias("left"), F.col("before").alias("rest"))
    rows = rows.withColumn("shape", skeleton(F.concat("left", "rest")))
    rows = rows.join(shapes, "shape").where(F.concat("left", "rest") != F.col("word"))
    first = ~F.startswith("word", "left")
    second = ~F.endswith("word", "rest")
    hit = F.filter(F.array(F.when(first, F.col("line_no")), F.when(second, F.col("line_no") + 1)), lambda x: x.isNotNull())
    return rows.select("src", "rec_id", F.explode(hit).alias("line_no"))


def _frequent_shapes(counts: DataFrame, least: int = 5) -> DataFrame:
    """(shape, word): skeletons with one form of letters that is frequent in clean text."""
    forms = counts.where(~F.col("word").contains("-") & ~F.col("word").rlike(r"\p{N}") & (F.col("n_clean") >= least) & (F.length("word") >= 5))
    shapes = forms.groupBy(skeleton(F.col("word")).alias("shape")).agg(F.max(F.struct("n_clean", "word")).alias("_best"), F.count("*").alias("_forms"))
    return shapes.where(F.col("_forms") == 1).select("shape", F.col("_best.word").alias("word"))

def _read(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The distinct texts, the scanned ones of these, the word counts and the marks."""
    once = distinct_texts(texts.select("src", "rec_id", "book", "page", "last_page", "ocr", "text"))
    scanned = once.where(F.coalesce("ocr", F.lit(False)))
    counts = cut(word_counts(once))
    return once, scanned, counts, cut(scan_marks(scanned, cut(misread_forms(counts))))


def scan_defects(texts: DataFrame) -> DataFrame:
    """(src, rec_id, line_no, defect) of the scanned texts among (src, rec_id, book, page, last_page, ocr, text); page and
    last_page, the pages over which a text runs, are equal for a page and may be null. Defects: hyphen_break, misread, running_head, page_number."""
    once, _, counts, marks = _read(texts)
    misread = with_context(_misread_words(marks), counts, once).where("word <> right").select("src", "rec_id", "line_no")
    misread = misread.unionByName(_broken_misreads(marks, _frequent_shapes(counts))).withColumn("defect", F.lit("misread"))
    breaks = _hyphen_breaks(marks, counts).withColumn("defect", F.lit("hyphen_break"))
    return misread.unionByName(breaks).unionByName(_edges(marks)).distinct()


def repaired(texts: DataFrame) -> DataFrame:
    """(src, rec_id, paragraph_no, paragraph): the scanned texts as continuous paragraphs."""
    once, scanned, counts, marks = _read(texts)
    key = ["src", "rec_id", "line_no"]
    dropped = _edges(marks).select(*key).distinct()
    breaks = _hyphen_breaks(marks, counts).distinct().withColumn("_join", F.lit(True))
    # A word that is misread twice in a line gets one form.
    fixes = with_context(_misread_words(marks), counts, once).groupBy(*key, "word").agg(F.min("right").alias("right")).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("word", "right"))).alias("_fixes"))
    lines = scanned.select("src", "rec_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = lines.join(dropped, key, "left_anti").join(breaks, key, "left").join(fixes, key, "left")

    parts = F.regexp_extract_all("line", F.lit(rf"{_WORD}|[^\p{{L}}\p{{M}}\p{{N}}]+"), F.lit(0))
    cased = lambda word, right: F.when(word == F.upper(word), F.upper(right)).when(F.substring(word, 1, 1) == F.upper(F.substring(word, 1, 1)), F.concat(F.upper(F.substring(right, 1, 1)), F.substring(right, 2, 1 << 20))).otherwise(right)
    fixed = F.array_join(F.transform(parts, lambda w: F.coalesce(F.when(F.element_at("_fixes", F.lower(w)).isNotNull(), cased(w, F.element_at("_fixes", F.lower(w)))), w)), "")
    text = F.regexp_replace(F.when(F.col("_fixes").isNull(), F.col("line")).otherwise(fixed), r"(?U)^\s+|\s+$", "")
    rows = rows.select(*key, F.when(F.col("_join"), F.regexp_replace(text, f"[{HYPHENS}]+$", "")).otherwise(text).alias("text"), F.coalesce("_join", F.lit(False)).alias("_join"))

    order = Window.partitionBy("src", "rec_id").orderBy("line_no")
    alone = F.col("text").rlike(r"^(?:#|\||\[|[-*•]\s)")
    starts = (F.col("text") == "") | alone | F.lag((F.col("text") == "") | F.col("text").rlike(r"^(?:#|\||\[)"), 1, True).over(order)
    rows = rows.withColumn("_paragraph", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("text") != "")
    glue = F.when(F.col("_join") | F.col("text").rlike("[\\p{L}]-$"), "").otherwise(" ")
    flowed = rows.groupBy("src", "rec_id", "_paragraph").agg(F.sort_array(F.collect_list(F.struct("line_no", "text", glue.alias("glue")))).alias("_lines"))
    paragraph = F.trim(F.array_join(F.transform("_lines", lambda x: F.concat(x["text"], x["glue"])), ""))
    number = F.row_number().over(Window.partitionBy("src", "rec_id").orderBy("_paragraph")) - 1
    return flowed.select("src", "rec_id", number.alias("paragraph_no"), paragraph.alias("paragraph"))
