"""Broken prompt and response pairs (problem 1).

Each pair gets the one defect it has, looked for in this order: empty, copies_question, refusal, truncated,
other_language. Two models are fitted on labelled texts:

* a naive Bayes classifier over character n-grams. The posteriors of prompt and response over all languages are compared: their
  product, summed up, is the probability that both are in one language. Each character stands in n-grams of every length, so the
  log-likelihood is divided by their number; a text of a few letters thus stays undecided by itself.
* an end-of-text model: for the contexts at the ends of sentences, by n-gram length, how often a sentence ends with
  them, apart for contexts that end with a terminator; and for words, how often one is a sentence's last. The likelihood of an end after the last n-grams
  of a response, from the longest known context with back-off to shorter ones, says whether it is complete. What the stack automaton of
  problem 9 finds open there makes an end less likely by a fixed factor; the likelihood decides.

Refusals, for which no model is named, are denials of answering itself in one of the first two sentences, outside quotations, however long the response is.

The models are fitted on every distinct labelled text. Tasks count n-grams, contexts and words in arrays and hand on partial sums; a second pass over
the texts counts how often the known contexts stand anywhere. What the driver holds are the sums: they grow with the distinct contexts at the ends of sentences
and the distinct n-grams, not with the texts. They go to the workers with the function; scoring is a narrow pass.

Cases: a null question has no language and copies nothing; null, blank and placeholder answers are empty; an answer without
enough letters, or a language the texts don't hold, has no other language; repeated rows come out once.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.session import cut as materialised
from docloom.session import distinct_rows, repeated_keys

from .sentences import ATERM, CLOSE, STERM, sentence_ends
from .truncation import signs_of

#: Characters that are counted at once, distinct keys that a task holds before it hands on their sums, and bins of a direct count. None of them changes a result.
COUNTED_CHARS, HELD_KEYS, BINS = 1_000_000, 200_000, 1 << 22
#: The longest character n-grams of the language classifier.
NGRAM = 3
#: How often prompt and response are in one language beforehand, and the probability after seeing both below which they are not.
SAME_BEFORE, SAME_AFTER = 0.98, 0.5
#: Lengths of the contexts of the end model.
CONTEXTS = (2, 4, 7, 11, 16, 24)
#: A response is cut if its end is less likely than this: one with a terminator, one without that ends no sentence, one without that ends others with
#: terminators, an item of a list. How much less likely an end is inside open marks.
END_TERMINATED, END_LIKELIHOOD, END_LIKELIHOOD_AFTER, END_ITEM, OPEN_FACTOR = 0.05, 0.12, 0.7, 0.006, 0.01
#: A response of a few words, such as a name or a value, is cut if its last word is so frequent and so seldom a sentence's last.
FEW_WORDS, WORD_SEEN, WORD_END = 3, 20, 0.005

# Answers that stand for none, compared in lower case without outer marks.
PLACEHOLDERS = {"", "null", "none", "n/a", "na", "nan", "nil", "undefined", "tbd", "br", "br/", "br /", "p", "empty", "no answer", "stopped", "nbsp"}
# Fixed value: what the application adds to an answer whose generation was cancelled.
STOPPED = "(Stopped)"
# Ways to decline, by language. A phrase holds a denial and what is denied.
REFUSALS = {
    "en": [
        r"\b(?:i|we)\b.*?\b(?:can ?not|can['’]?t|could ?n['’]?t|won['’]?t|will not|unable|not able|decline|refuse|not (?:feel )?comfortable|don['’]t feel comfortable|not allowed|not permitted|may not)\b.*?\b(?:answer|help|assist|respond|reply|discuss|provid|comply|giv|shar|offer|advis|comment|speak|talk|do (?:that|this|so))",
        r"\bnot (?:something|a topic|a question|a request) (?:that )?(?:i|we) (?:can|may|will|could)\b",
        r"\bfalls? outside (?:of )?(?:what|my|the scope)\b",
        r"\bno answer can be given\b",
        r"\b(?:unable|not able|not allowed|not permitted) to (?:answer|help|assist|respond|discuss|provide|comply)\b",
        r"\b(?:request|question|topic) (?:has to|must|will) be (?:declined|refused)\b",
        r"\b(?:can ?not|can['’]t|won['’]t) be answered\b",
    ],
    "de": [r"\bkann (?:ich|wir)\b.*?\bnicht (?:helfen|beantworten|behilflich|weiterhelfen|antworten)", r"\bdarf (?:ich|wir)\b.*?\bnicht beantworten", r"\b(?:muss|möchte)\b.*?\bablehnen", r"\bich (?:kann|darf|möchte)\b.*?\bnicht (?:\w+ )?(?:helfen|beantworten|antworten|geben)", r"\bnicht in der lage\b.*?\b(?:helfen|beantworten|antworten)"],
    "fr": [r"\bje ne (?:peux|puis|suis) pas\b.*?\b(?:répondre|aider|traiter|fournir|autorisé|en mesure)", r"\bimpossible de (?:vous )?(?:aider|répondre)", r"\bje (?:dois|préfère) (?:refuser|décliner|ne pas répondre)", r"\bje refuse\b"],
    "es": [r"\bno (?:me )?(?:es posible|puedo|podemos|podré)\b.*?\b(?:responder|ayudar|contestar|atender|facilitar|ofrecer|hablar)", r"\b(?:debo|tengo que) (?:rechazar|declinar)", r"\bno estoy autorizad[oa]\b"],
    "ru": [r"\b(?:я )?не (?:могу|можем|смогу|вправе)\b.*?\b(?:ответить|помочь|отвечать|обсуждать|предоставить)", r"\b(?:помочь|ответить|обсуждать)\b.*?\bне (?:могу|смогу|вправе)", r"\b(?:вынужден|должен)\b.*?\bотказать"],
    "zh": [r"(?:无法|不能|不便|没办法|不会)(?:为您|就此|对此)?(?:回答|协助|提供|帮助|帮您|讨论|处理)", r"(?:拒绝|谢绝)回答", r"不在.*?回答.*?范围"],
    "ja": [r"(?:お答え|回答|お手伝い|対応|お応え)(?:は|が|を)?(?:でき|致しかね|いたしかね|しかね|差し控え|控え)", r"お断り"],
    "hi": [r"(?:उत्तर|जवाब|मदद|सहायता|चर्चा)\s*(?:नहीं|देने में असमर्थ|करने में असमर्थ)", r"(?:नहीं|असमर्थ).*?(?:उत्तर|जवाब|मदद|सहायता|सकता|सकती|सकते)"],
    "th": [r"ไม่สามารถ(?:ตอบ|ช่วย|ให้ข้อมูล|พูดคุย)", r"ขอปฏิเสธ", r"(?:ตอบ|ช่วย).*?ไม่ได้"],
}
# The names of languages, in the languages in which a question may ask for them.
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés английск англійськ 英语 英文 英語 अंग्रेज़ी अंग्रेजी ภาษาอังกฤษ",
    "de": "german deutsch allemand alemán немецк 德语 德文 ドイツ語 जर्मन ภาษาเยอรมัน",
    "fr": "french französisch français francés французск 法语 法文 フランス語 फ्रेंच फ़्रेंच ภาษาฝรั่งเศส",
    "es": "spanish spanisch espagnol español castellano испанск 西班牙语 西班牙文 スペイン語 स्पेनिश ภาษาสเปน",
    "ru": "russian russisch russe ruso русск по-русски 俄语 俄文 ロシア語 रूसी ภาษารัสเซีย",
    "zh": "chinese chinesisch chinois chino китайск 中文 汉语 中国語 चीनी ภาษาจีน",
    "ja": "japanese japanisch japonais japonés японск 日语 日文 日本語 जापानी ภาษาญี่ปุ่น",
    "hi": "hindi хинди 印地语 ヒンディー語 हिंदी हिन्दी ภาษาฮินดี",
    "th": "thai thailändisch thaï tailandés тайск 泰语 タイ語 थाई ภาษาไทย",
}

_REFUSAL = re.compile("|".join(p for group in REFUSALS.values() for p in group), re.IGNORECASE)
_NAMES = {code: re.compile("|".join((r"\b" if n[0].isascii() else "") + re.escape(n) for n in names.split()), re.IGNORECASE) for code, names in LANGUAGE_NAMES.items()}
_QUOTED = re.compile(r"[“„«「『][^“”„«»「」『』]*[”“»」』]|(?<!\w)\"[^\"\n]*\"")
_LETTER_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_CODES = re.compile(r"https?://\S+|[A-Za-z0-9.,:/_+-]*[0-9][A-Za-z0-9.,:/_+-]*")  # ASCII only: scripts without spaces have no words to drop
_LAST_WORDS = re.compile(r"(?:^|[^\W\d_]\s+)[^\W\d_]+$")
_MARKS = re.compile(r"^[\W_]+|[\W_]+$")
_TAGS = re.compile(r"</?[A-Za-z][^<>]*>|&[a-zA-Z]{2,8};")
_LEAD = re.compile(
    r"^(?:you asked|question|q|the question was|your question|frage|ihre frage|vous avez demandé|votre question|pregunta|su pregunta|вопрос|вы спросили|问题|您问|質問|प्रश्न|คำถาม)\s*[:：]\s*", re.IGNORECASE
)
_INVISIBLE = "​‌‍⁠﻿ ­"


def _letters(text: str) -> str:
    """What the language classifier reads: words in lower case, without codes, numbers, tables and markup."""
    lines = [x for x in text.split("\n") if not x.lstrip().startswith("|")]
    return " ".join(_LETTER_WORDS.findall(_CODES.sub(" ", _TAGS.sub(" ", " ".join(lines))))).lower()


def _points(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _letter_stream(texts: list[str]) -> np.ndarray:
    """The code points of `_letters` of each text with a space before and after, a zero after each text. Codes and words are found in arrays; only texts
    that may hold addresses, tables or markup are read one by one. A text without letters leaves no more than a space."""
    plain = [(_letters(t) if "<" in t or "&" in t or "|" in t or "http" in t else t).replace("\0", " ") for t in texts]
    points = _points("".join(f" {t} \0" for t in plain))
    kinds = np.zeros(0x110000, dtype=np.uint8)  # 1: a letter, 2: part of a code, 4: a digit, 8: joins letters
    for c in np.flatnonzero(np.bincount(points)):
        char = chr(c)
        code = char.isascii() and (char.isalnum() or char in ".,:/_+-")
        kinds[c] = (char.isalnum() and not char.isdecimal()) + 2 * code + 4 * (code and char.isdigit()) + 8 * (char in "'’-")
    kind = kinds[points]
    edges = np.flatnonzero(np.diff((kind & 2).astype(np.int8), prepend=0, append=0))
    begins, ends = edges[::2], edges[1::2]
    digits = np.concatenate([[0], np.cumsum(kind & 4 != 0)])
    coded = digits[ends] > digits[begins]
    change = np.zeros(len(points) + 1, dtype=np.int8)
    change[begins[coded]], change[ends[coded]] = 1, -1
    letter = (kind & 1 != 0) & (np.cumsum(change[:-1], dtype=np.int8) == 0)
    kept = letter.copy()
    kept[1:-1] |= (kind[1:-1] & 8 != 0) & letter[:-2] & letter[2:]
    end = points == 0
    follows = np.zeros(len(points), dtype=bool)
    follows[:-1] = kept[1:] | end[1:]
    chosen = kept | end | follows & ~kept
    stream = np.where(kept | end, points, 32)[chosen].astype(np.uint32)
    return _points(stream.tobytes().decode("utf-32-le", "surrogatepass").lower())


def gram_counts(texts: list[str]) -> Counter:
    """How often each character n-gram of one to `NGRAM` stands in what the language classifier reads of some texts. A space by itself isn't counted."""
    out: Counter = Counter()
    if not texts:
        return out
    stream = _letter_stream(texts)
    alphabet = np.flatnonzero(np.bincount(stream))  # zero is the first
    place = np.zeros(int(alphabet[-1]) + 1, dtype=np.int64)
    place[alphabet] = np.arange(len(alphabet))
    ids = place[stream]
    code, whole = ids, ids > 0
    for n in range(1, NGRAM + 1):
        if n > 1:
            code, whole = code[:-1] * len(alphabet) + ids[n - 1 :], whole[:-1] & (ids[n - 1 :] > 0)
        if len(alphabet) ** n <= BINS:
            times = np.bincount(code[whole])
            found = np.flatnonzero(times)
            times = times[found]
        else:
            found, times = np.unique(code[whole], return_counts=True)
        chars = np.stack([alphabet[found // len(alphabet) ** k % len(alphabet)] for k in range(n - 1, -1, -1)], axis=1) if len(found) else np.zeros((0, n))
        joined = chars.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
        out.update({joined[i * n : i * n + n]: t for i, t in enumerate(times.tolist())})
    out.pop(" ", None)
    return out


class LanguageModel:
    """Naive Bayes over character n-grams of one to three."""

    def __init__(self, labelled: list[tuple[str, str]]):
        texts: dict[str, list[str]] = defaultdict(list)
        for language, text in labelled:
            texts[language].append(text)
        counts = {language: gram_counts(own) for language, own in texts.items()}
        self._fit({x: sum(c.values()) for x, c in counts.items()}, {g: {x: c[g] for x, c in counts.items() if g in c} for own in counts.values() for g, n in own.items() if n > 1})

    @classmethod
    def counted(cls, totals: dict[str, int], vocabulary: dict[str, dict[str, int]]) -> LanguageModel:
        """From the number of n-grams of each language, and the counts by language of those that stand more than once in one."""
        model = cls.__new__(cls)
        model._fit(totals, vocabulary)
        return model

    def _fit(self, totals: dict[str, int], vocabulary: dict[str, dict[str, int]]) -> None:
        self.languages = sorted(totals)
        at = {x: i for i, x in enumerate(self.languages)}
        alpha, size = 0.1, len(vocabulary) + 1
        self.index = {g: i for i, g in enumerate(sorted(vocabulary))}
        counts = np.zeros((len(self.index), len(self.languages)))
        for g, by in vocabulary.items():
            for x, n in by.items():
                counts[self.index[g], at[x]] = n
        self.logs = np.log((counts + alpha) / (np.array([totals[x] for x in self.languages], dtype=float) + alpha * size))

    def posterior(self, text: str | None) -> np.ndarray | None:
        """The probability of each language; none for a text without letters that the model knows."""
        letters = _letters(text or "")
        index, padded = self.index, f" {letters} "
        own = [i for n in range(1, NGRAM + 1) for j in range(len(padded) - n + 1) if (i := index.get(padded[j : j + n])) is not None]
        if not own:
            return None
        score = self.logs[own].sum(axis=0) / NGRAM
        odds = np.exp(score - score.max())
        return odds / odds.sum()


def end_counts(texts: Iterable[str]) -> tuple[Counter, Counter, Counter, Counter, Counter]:
    """Over the sentences of some texts, but for the last of each: how often each context ends one; how often each context that ends with a terminator ends one, and how
    often it stands there; how often each word is the last of one (of all sentences), and how often it stands there."""
    ended, closing, stops, last, words = [], [], [], [], []
    for text in texts:
        text = _shape(text)
        ends = sentence_ends(text)[:-1]
        lower = text.lower()
        words += _LETTER_WORDS.findall(lower)
        if not ends:
            continue
        for end in ends:
            core = text[max(0, end - 40) : end].rstrip(_ENDING)
            ended += [core[-n:] for n in CONTEXTS if len(core) >= n]
        closed = {len(text[:end].rstrip(CLOSE)) for end in ends}
        find = _STOPS_ASCII if text.isascii() else _STOPS_NEAR if max(text) <= "\uffff" else _STOPS
        for at in (m.end() for m in find.finditer(text, 0, ends[-1])):
            keys = [text[at - n : at] for n in CONTEXTS if at >= n]
            stops += keys
            if at in closed:
                closing += keys
        last += [word for at in {len(text[:end].rstrip(_ENDING)) for end in ends} if (word := _word_before(lower, at))]
    return Counter(ended), Counter(closing), Counter(stops), Counter(last), Counter(words)


def _is_letter(c: str) -> bool:
    return c.isalnum() and not c.isdecimal()


def _word_before(text: str, at: int) -> str | None:
    """The word that ends at a place."""
    if not at or not _is_letter(text[at - 1 : at]) or _GOES_ON.match(text, at):
        return None
    begin = at
    while begin and ((c := text[begin - 1]) in "'’-" or _is_letter(c)):
        begin -= 1
    return next((m.group() for m in _LETTER_WORDS.finditer(text, begin, at) if m.end() == at), None)


#: The base of the polynomial that stands for a context; sums are taken modulo 2 ** 64.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


class ContextTotals:
    """Counts how often known contexts stand anywhere in texts. A context is known only if its ends are, so that the longer are looked up only where the shorter were found."""

    def __init__(self, known: Iterable[str]):
        by: dict[int, list[str]] = {n: [] for n in CONTEXTS}
        for k in known:
            by[len(k)].append(k)
        self.keys, self.hashes, self.filters = {}, {}, {}
        for n, keys in by.items():
            points = _points("".join(keys)).reshape(-1, n).astype(np.uint64)
            hashes = np.zeros(len(keys), dtype=np.uint64)
            for j in range(n):
                hashes = hashes * _BASE + points[:, j]
            order = np.argsort(hashes)
            self.keys[n], self.hashes[n] = [keys[i] for i in order], hashes[order]
            self.filters[n] = np.zeros(1 << 22, dtype=bool)
            self.filters[n][(self.hashes[n] * _BASE) >> np.uint64(42)] = True

    def count(self, texts: list[str]) -> dict[int, np.ndarray]:
        """By length: how often each known context stands in the texts."""
        points = _points("".join(texts)).astype(np.uint64)
        points[(points >= 48) & (points <= 57)] = 48  # as in _shape
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        place = np.arange(1, len(points) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)

        def after(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
            """Of each place the polynomial over what `left` has n places before and over the n of `right`."""
            out = right.copy()
            out[n:] += left[:-n] * _power(n)
            return out

        two = after(points, points, 1)
        three, four = after(two, points, 1), after(two, two, 2)
        eight = after(four, four, 4)
        rolled = {2: (None, two, 0), 4: (None, four, 0), 7: (four, three, 3), 11: (eight, three, 3), 16: (eight, eight, 8), 24: (after(eight, eight, 8), eight, 8)}
        at, out = np.flatnonzero(place >= CONTEXTS[0]), {}
        for n in CONTEXTS:
            left, right, shift = rolled[n]
            at = at[place[at] >= n]
            value = right[at] if left is None else right[at] + left[at - shift] * _power(shift)
            may = self.filters[n][(value * _BASE) >> np.uint64(42)]
            at, value = at[may], value[may]
            slot = np.searchsorted(self.hashes[n], value)
            held = slot < len(self.hashes[n])
            held[held] = self.hashes[n][slot[held]] == value[held]
            at = at[held]
            out[n] = np.bincount(slot[held], minlength=len(self.hashes[n]))
        return out


class EndModel:
    """How likely a sentence ends after the last characters of a text."""

    def __init__(self, texts: list[str]):
        ended, closing, stops, last, words = end_counts(texts)
        known = {k: v for k, v in ended.items() if _told(k, v)}
        totals = ContextTotals(known)
        total = {k: t for n, times in totals.count(texts).items() for k, t in zip(totals.keys[n], times.tolist())}
        self._fit(known, total, {k: (closing[k], n) for k, n in stops.items() if n > 1}, {k: (last[k], n) for k, n in words.items() if n >= WORD_SEEN})

    @classmethod
    def counted(cls, ended: dict[str, int], total: dict[str, int], stops: dict[str, tuple[int, int]], words: dict[str, tuple[int, int]]) -> EndModel:
        """From the sums over all texts."""
        model = cls.__new__(cls)
        model._fit(ended, total, stops, words)
        return model

    def _fit(self, ended: dict, total: dict, stops: dict, words: dict) -> None:
        self.table = {k: (v, max(v, total.get(k, 0))) for k, v in ended.items()}
        self.stops, self.words = stops, words

    def after_terminator(self, text: str) -> float:
        """The likelihood that a sentence ends with a terminator in its context."""
        text = _shape(text.rstrip(CLOSE))[-CONTEXTS[-1] :]
        p = 0.9
        for n in CONTEXTS:
            seen = self.stops.get(text[-n:]) if len(text) >= n else None
            if seen is None:
                break
            p = (seen[0] + 2 * p) / (seen[1] + 2)
        return p

    def after_word(self, word: str) -> float:
        """How often a word is the last of a sentence; 1 for one that isn't frequent."""
        ends, seen = self.words.get(word.lower(), (1, 1))
        return ends / seen

    def likelihood(self, text: str) -> float:
        """From short to long contexts, each known one drawn towards the one before; an unknown long context weighs against an end."""
        text = _shape(text)[-CONTEXTS[-1] :]
        p = 0.02
        for n in CONTEXTS:
            if len(text) < n:
                break
            seen = self.table.get(text[-n:])
            if seen is None:
                return p * 0.5 if n <= 7 else p
            ends, total = seen
            p = (ends + 2 * p) / (total + 2)
        return p


_ENDING = STERM + ATERM + CLOSE
_STOPS = re.compile(f"[{re.escape(STERM + ATERM)}]")
# The same without characters that a text doesn't hold, which is several times faster.
_STOPS_NEAR = re.compile(f"[{re.escape(''.join(c for c in STERM + ATERM if c <= '\uffff'))}]")
_STOPS_ASCII = re.compile(f"[{re.escape(''.join(c for c in STERM + ATERM if c.isascii()))}]")
_GOES_ON = re.compile(r"(?:['’-])?[^\W\d_]")


def _told(context: str, ends: int) -> bool:
    """Whether a context at the end of sentences is kept: a long one that ended one only isn't."""
    return ends > 1 or len(context) <= 11


def _shape(text: str) -> str:
    return re.sub(r"[0-9]", "0", text)


def _plain(text: str) -> str:
    """Letters and digits only, for comparing an answer with its question."""
    return "".join(c for c in text.casefold() if c.isalnum())


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    bare = answer.strip().strip(_INVISIBLE).strip()
    bare = _TAGS.sub("", bare).strip()
    core = _MARKS.sub("", bare).casefold()
    return core in PLACEHOLDERS or not any(c.isalnum() for c in bare)


def copies(question: str | None, answer: str) -> bool:
    """Whether an answer says nothing but the question, once or several times, in marks, letter case or an introduction of its own."""
    asked = _plain(question or "")
    if not asked:
        return False
    said = _plain(answer)
    if not said:
        return False
    for text in (said, _plain(_LEAD.sub("", _MARKS.sub("", answer.strip())))):
        times, rest = divmod(len(text), len(asked))
        if not rest and times and text == asked * times:
            return True
    return False


def refuses(answer: str) -> bool:
    """Whether an answer declines: one of its first two sentences denies answering. A denial within a quotation is none."""
    bare = _QUOTED.sub(" ", answer)
    if not _REFUSAL.search(bare):
        return False
    begin = 0
    for end in sentence_ends(bare)[:2]:
        if _REFUSAL.search(bare[begin:end]):
            return True
        begin = end
    return False


def end_likelihood(answer: str, ends: EndModel) -> tuple[float, float]:
    """How likely an answer is complete where it ends, and the least likelihood by which it counts as complete."""
    body = answer.rstrip()
    if body.endswith(STOPPED):
        return 0.0, 1.0
    signs = signs_of(body)
    if signs is None:
        return 1.0, 0.0
    factor = OPEN_FACTOR if signs["broken"] and signs["broken"] != "abbreviation" else 1.0
    if signs["terminated"] and signs["broken"] != "ellipsis":
        return factor * ends.after_terminator(body), END_TERMINATED
    last = body[body.rfind("\n") + 1 :].strip()
    if last.startswith("|") and last.endswith("|") or last.startswith(("#", "```")):
        return factor, END_LIKELIHOOD
    words = _LETTER_WORDS.findall(_CODES.sub(" ", body))
    wide = signs["script"] != "other"
    if not wide and len(words) <= FEW_WORDS and "\n" not in body:
        sentence = words and _LAST_WORDS.search(body)  # a word after a number is a unit
        return factor * (ends.after_word(words[-1]) if sentence else 1.0), WORD_END
    bullet = re.match(r"(?:[-*+•]|\d{1,3}[.)])\s+(.*)", last)
    if bullet and len(_LETTER_WORDS.findall(bullet.group(1))) <= 5 and not re.match(r"\d", last):
        return factor * ends.likelihood(bullet.group(1)), END_ITEM
    own = len(sentence_ends(body[body.rfind("\n\n") + 1 :])) > 1
    return factor * ends.likelihood(body), END_LIKELIHOOD_AFTER if own else END_LIKELIHOOD


def cut(answer: str, ends: EndModel) -> bool:
    """Whether an answer breaks off."""
    likelihood, least = end_likelihood(answer, ends)
    return likelihood < least


def same_language(asked: np.ndarray, said: np.ndarray) -> float:
    """The probability that two texts are in one language, from their posteriors and how often they are beforehand."""
    if len(asked) < 2:
        return 1.0
    agree = float(asked @ said)
    same, different = SAME_BEFORE * agree, (1 - SAME_BEFORE) * (1 - agree) / (len(asked) - 1)
    return same / (same + different)


def asks_for(question: str | None, language: str) -> bool:
    names = _NAMES.get(language)
    return bool(question and names and names.search(question))


def defect(question: str | None, answer: str | None, languages: LanguageModel, ends: EndModel) -> str | None:
    """The defect of one pair, or none."""
    if is_empty(answer):
        return "empty"
    if copies(question, answer):
        return "copies_question"
    if refuses(answer):
        return "refusal"
    if cut(answer, ends):
        return "truncated"
    asked, said = languages.posterior(question), languages.posterior(answer)
    if asked is not None and said is not None and same_language(asked, said) < SAME_AFTER and not asks_for(question, languages.languages[int(said.argmax())]):
        return "other_language"
    return None


def labelled(texts: DataFrame, text: str, language: str) -> DataFrame:
    """(_label, _text) of the distinct texts with a label of a language; labels are reduced to two lower-case letters. Only copies are shuffled."""
    label = F.regexp_extract(F.lower(F.trim(F.col(language))), r"^([a-z]{2})(?:[-_].*)?$", 1)
    rows = texts.select(label.alias("_label"), F.col(text).alias("_text")).where((F.col("_label") != "") & F.col("_text").isNotNull())
    rows = rows.withColumn("_at", F.xxhash64("_label", "_text"))
    return distinct_rows(rows, "_at", repeated_keys(rows, "_at")).select("_label", "_text")


def labelled_sample(texts: DataFrame, text: str, language: str, per_language: int) -> list[tuple[str, str]]:
    """At most `per_language` of the distinct labelled texts of each label, by a hash of the text. For trials only: the models are fitted on all."""
    ranked = Window.partitionBy("_label").orderBy(F.xxhash64("_text"))
    chosen = labelled(texts, text, language).withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= per_language)
    return sorted((r[0], r[1]) for r in chosen.select("_label", "_text").collect())


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, str]]]:
    """The (label, text) of a task, some characters at a time."""
    held, size = [], 0
    for batch in batches:
        for row in zip(batch[0].to_pylist(), batch[1].to_pylist()):
            held.append(row)
            size += len(row[1])
            if size >= COUNTED_CHARS:
                yield held
                held, size = [], 0
    if held:
        yield held


_COUNTED = "kind string, label string, key string, n long, m long"


def _counted_batches(sums: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (kind, label), (n, m) in sums.items():
        keys = list(m)
        table = pa.table([pa.array([kind] * len(keys), pa.string()), pa.array([label] * len(keys), pa.string()), pa.array(keys, pa.string()), pa.array([n[k] for k in keys], pa.int64()), pa.array(list(m.values()), pa.int64())], names=["kind", "label", "key", "n", "m"])
        yield from table.to_batches(max_chunksize=10_000)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partial sums of both models over the texts of a task."""
    sums: dict = defaultdict(lambda: (Counter(), Counter()))
    for rows in _pieces(batches):
        own: dict[str, list[str]] = defaultdict(list)
        for label, text in rows:
            own[label].append(text)
        for label, texts in own.items():
            sums["gram", label][1].update(gram_counts(texts))
        ended, closing, stops, last, words = end_counts(t for _, t in rows)
        for kind, n, m in (("ended", Counter(), ended), ("stop", closing, stops), ("word", last, words)):
            sums[kind, ""][0].update(n)
            sums[kind, ""][1].update(m)
        if sum(len(m) for _, m in sums.values()) > HELD_KEYS:
            yield from _counted_batches(sums)
            sums.clear()
    yield from _counted_batches(sums)


def fitted(texts: DataFrame, text: str = "text", language: str = "lang") -> tuple[LanguageModel, EndModel]:
    """Both models from every distinct labelled text."""
    rows = labelled(texts, text, language)
    sums = materialised(rows.mapInArrow(_count, _COUNTED).groupBy("kind", "label", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))
    grams = sums.where("kind = 'gram'")
    totals = {r[0]: r[1] for r in grams.groupBy("label").agg(F.sum("m")).collect()}
    often = grams.groupBy("key").agg(F.collect_list(F.struct("label", "m")).alias("by"), F.max("m").alias("most")).where("most > 1")
    vocabulary = {r["key"]: {x["label"]: x["m"] for x in r["by"]} for r in often.select("key", "by").collect()}
    told = (F.col("m") > 1) | (F.length("key") <= 11)
    ended = {r[0]: r[1] for r in sums.where((F.col("kind") == "ended") & told).select("key", "m").collect()}
    stops = {r[0]: (r[1], r[2]) for r in sums.where("kind = 'stop' and m > 1").select("key", "n", "m").collect()}
    words = {r[0]: (r[1], r[2]) for r in sums.where((F.col("kind") == "word") & (F.col("m") >= WORD_SEEN)).select("key", "n", "m").collect()}

    counter = ContextTotals(ended)
    shared = texts.sparkSession.sparkContext.broadcast(counter)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for piece in _pieces(batches):
            for n, times in shared.value.count([t for _, t in piece]).items():
                found[n] = found[n] + times if n in found else times
        for n, times in found.items():
            at = np.flatnonzero(times)
            table = pa.table([pa.array(np.full(len(at), n, dtype=np.int32)), pa.array(at), pa.array(times[at])], names=["size", "at", "n"])
            yield from table.to_batches(max_chunksize=10_000)

    standing = rows.mapInArrow(total, "size int, at long, n long").groupBy("size", "at").agg(F.sum("n"))
    everywhere = {counter.keys[r[0]][r[1]]: r[2] for r in standing.collect()}
    return LanguageModel.counted(totals, vocabulary), EndModel.counted(ended, everywhere, stops, words)


def pair_defects(pairs: DataFrame, key: str, question: str, answer: str, texts: DataFrame, text: str = "text", language: str = "lang") -> DataFrame:
    """(key, defect) of every distinct defective pair. `texts` holds the labelled texts on which the models are fitted."""
    models = pairs.sparkSession.sparkContext.broadcast(fitted(texts, text, language))

    def flag(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        languages, ends = models.value
        for questions, answers in batches:
            yield pd.Series([defect(q, a, languages, ends) for q, a in zip(questions, answers)], dtype="object")

    once = F.pandas_udf(flag, T.StringType()).asNondeterministic()  # for the planner only, which else computes the defect once more to filter on it
    flagged = once(F.col(question), F.col(answer))
    return pairs.select(key, flagged.alias("defect")).where(F.col("defect").isNotNull()).distinct()
