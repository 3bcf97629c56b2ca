import math
from collections import Counter

import pytest

from docloom.llm.pairs import (
    ContextTotals, EndModel, LanguageModel, _letters, copies, cut, defect, end_likelihood, fitted, gram_counts, is_empty, labelled_sample, pair_defects, refuses, same_language,
)

TEXTS = {
    "en": ["The pump must be closed before the valve is opened. Store the wheel upright at all times. Never open the tank while the pump is hot."] * 3,
    "de": ["Die Pumpe muss geschlossen sein, bevor das Ventil geöffnet wird. Lagern Sie das Rad immer aufrecht. Der Tank darf nicht geöffnet werden."] * 3,
    "fr": ["La pompe doit être fermée avant que la vanne soit ouverte. Gardez toujours la roue debout. Le réservoir ne doit pas être ouvert."] * 3,
    "zh": ["请先关闭阀门，再检查水泵。第3次试验中，水箱没有泄漏。轴承座的压力会缓慢下降。"] * 3,
    "ja": ["ポンプを閉じてから、弁を点検すること。タンクの圧力が下がった。値は基準より低い。"] * 3,
}
SAMPLE = [(lang, t) for lang, ts in TEXTS.items() for t in ts]
MODELS = LanguageModel(SAMPLE), EndModel([t for _, t in SAMPLE])


@pytest.mark.parametrize(
    "question,answer,want",
    [
        ("Why?", None, "empty"), ("Why?", "", "empty"), ("Why?", " ​ ", "empty"), ("Why?", "N/A", "empty"), ("Why?", "[]", "empty"), ("Why?", "<br>", "empty"), ("Why?", "(Stopped)", "empty"), ("Why?", "null", "empty"),
        ("Can I open the tank?", "can i open the tank", "copies_question"), ("Can I open the tank?", "You asked: Can I open the tank?", "copies_question"), ("Can I open it?", "> Can I open it?\nCan I open it?", "copies_question"),
        ("Can I open the tank?", "Can I open the tank? Never open the tank while the pump is hot.", None),
        ("Why is the tank hot?", "I'm sorry, but I can't help with that request.", "refusal"), ("Why is it hot?", "No answer can be given by me on this topic.", "refusal"), ("Warum?", "Dabei kann ich leider nicht helfen.", "refusal"), ("为什么？", "抱歉，我无法回答这个问题。", "refusal"),
        ("Why is it hot?", "Unfortunately, the pump cannot be reset by hand; open the valve first.", None), ("Why is it hot?", "Sorry for the earlier mix-up: The pump must be closed before the valve is opened.", None),
        ("How do I store it?", "Store the wheel upright at all times. Never open the tank wh", "truncated"), ("How?", "The pump must be closed bef (Stopped)", "truncated"), ("What is it?", "The pump must be closed.\n\n| a | b |\n|---|---|\n| tank | 4 |\n| whe", "truncated"),
        ("What is the limit?", "26.1 bar", None), ("Is it so?", "Yes.", None), ("Which part?", "AB-123", None), ("How do I store it?", "Store the wheel upright at all times", None),
        ("How should the wheel be stored in the hall?", "Lagern Sie das Rad immer aufrecht. Die Pumpe muss geschlossen sein.", "other_language"), ("How should the wheel be stored? German, please.", "Lagern Sie das Rad immer aufrecht.", None),
        ("Wie muss die Pumpe geschlossen werden?", "请先关闭阀门，再检查水泵。第3次试验中，水箱没有泄漏。", "other_language"), (None, "The pump must be closed before the valve is opened.", None), ("Can it?", "The pump must be closed before the valve is opened.", None),
    ],
)
def test_defects(question, answer, want):
    assert defect(question, answer, *MODELS) == want


def test_parts():
    assert is_empty("—") and not is_empty("No.") and copies("A b?", "**A b?**") and not copies(None, "x") and not refuses('The sign said "I cannot help you" and no more was seen on the wall of the hall.')


def test_held_out_languages(spark):
    folder = "/root/testdata/sf0.01/documents.parquet"
    rows = [(r.lang[:2].lower(), r.text) for r in spark.read.parquet(folder).where("lang is not null and length(text) > 60 and lang not like 'und%'").select("lang", "text").collect()]
    half = len(rows) // 2
    model = LanguageModel(rows[:half])
    got = [model.languages[int(model.posterior(t[-120:]).argmax())] == lang for lang, t in rows[half:]]
    assert sum(got) / len(got) > 0.95


def test_rows(spark):
    texts = spark.createDataFrame([(t, lang.upper()) for lang, t in SAMPLE] + [(None, "en"), ("x", None), ("odd label", "und")], "text string, lang string")
    pairs = spark.createDataFrame([(1, "Why?", None, "x"), (1, "Why?", None, "x"), (2, "What is it?", "26.1 bar", "x")], "ask_id long, question string, full_text string, defect string")
    assert [tuple(r) for r in pair_defects(pairs, "ask_id", "question", "full_text", texts).collect()] == [(1, "empty")]
    assert pair_defects(pairs.limit(0), "ask_id", "question", "full_text", texts).count() == 0


def test_copies_do_not_fill_the_sample(spark):
    distinct = [f"Text number {i} of a language, which is long enough to be taken for a sample." for i in range(6)]
    texts = spark.createDataFrame([(t, "en") for t in distinct for _ in range(5)], "text string, lang string")
    got = labelled_sample(texts, "text", "lang", 4)
    assert len(got) == len(set(got)) == 4 and {t for _, t in got} <= set(distinct)


def test_long_refusals_and_posteriors():
    more = "The matter is one for the people of the hall. They know the pump and the valve well. " * 8
    assert refuses("I'm sorry, but I can't help with that request. " + more) and refuses("Thank you for asking. I am unable to answer this question. " + more)
    assert not refuses("I can't find fault with the pump. The valve is shut.") and not refuses(more + "I can't help with that.")
    model = MODELS[0]
    assert model.posterior(None) is None and model.posterior("12 %") is None
    english, german = model.posterior("The pump must be closed."), model.posterior("Die Pumpe muss geschlossen sein.")
    assert abs(english.sum() - 1) < 1e-9 and same_language(english, english) > 0.9 > 0.1 > same_language(english, german)


def test_the_likelihood_decides_what_is_cut():
    ends = MODELS[1]
    whole, part = end_likelihood("Store the wheel upright at all times.", ends), end_likelihood("Store the wheel upright at all times. Never open the tank wh", ends)
    assert whole[0] >= whole[1] and part[0] < part[1]
    held = end_likelihood("Store the wheel (upright at all times.", ends)
    assert held[0] <= whole[0]
    few = EndModel(["Put it on the wheel of the pump. See the valve."] * 40)
    assert cut("See the", few) and not cut("Vikas Engine", few) and not cut("26.1 bar", few)


def test_models_are_fitted_on_every_labelled_text(spark):
    distinct = [f"Text number {i} of the hall ends with turbine{i % 7}. The pump is shut and valve {i} stays open." for i in range(500)] + ["A long text goes on. " * 300, "Short."]
    rows = [(t, lang) for t in distinct for lang in ("en", "EN-x")] + [(t, lang) for lang, ts in TEXTS.items() for t in ts] + [("12 %", "en"), (None, "en"), ("unlabelled", "und")]
    languages, ends = fitted(spark.createDataFrame(rows, "text string, lang string").repartition(5), "text", "lang")
    labelled_rows = sorted({(lang.lower()[:2], t) for t, lang in rows if t is not None and lang != "und"})
    brute: dict = {}
    for lang, t in labelled_rows:
        padded = f" {_letters(t)} " if _letters(t) else ""
        brute.setdefault(lang, Counter()).update(g for n in (1, 2, 3) for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) != " ")
    assert set(languages.index) == {g for c in brute.values() for g, n in c.items() if n > 1} and languages.languages == sorted(brute)
    size, total = len(languages.index) + 1, sum(brute["en"].values())
    assert abs(languages.logs[languages.index["pum"], languages.languages.index("en")] - math.log((brute["en"]["pum"] + 0.1) / (total + 0.1 * size))) < 1e-9
    assert ends.table["urbine0"] == (sum(t.count("turbine") for _, t in labelled_rows),) * 2
    assert ends.words["hall"][1] == sum(t.lower().count("hall") for _, t in labelled_rows)
    local = EndModel([t for _, t in labelled_rows])
    assert (ends.table, ends.stops, ends.words) == (local.table, local.stops, local.words)


def test_counts_in_arrays_equal_those_of_each_text():
    texts = ["", "12 %", "İstanbul a1-b2 ΑΣ ΟΔΟΣ. x", "a\0b c", "see http://a.b/c?d e-f g", "<b>x</b> y &amp; z", "| a | b |\nword-", "it's ’tis rock-n-roll -- a-", "3.5 bar A4 x² 𝒜b", "第3次试验中，水箱没有泄漏。"]
    want: Counter = Counter()
    for t in texts:
        padded = f" {_letters(t)} " if _letters(t) else ""
        want.update(g for n in (1, 2, 3) for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) != " ")
    assert gram_counts(texts) == want and gram_counts([]) == Counter()
    counter = ContextTotals(["ab", "abab", "cababab", "ng"])
    texts = ["abababcababab", "", "b", "ng 4", "ing"]
    got = {k: int(n) for size, times in counter.count(texts).items() for k, n in zip(counter.keys[size], times)}
    assert got == {k: sum(t.startswith(k, i) for t in texts for i in range(len(t))) for k in ("ab", "abab", "cababab", "ng")}
