import pytest

from docloom.llm.sentences import sentence_ends, sentence_rows, sentence_units


def cut(text):
    out, begin = [], 0
    for end in sentence_ends(text):
        out.append(text[begin:end].strip())
        begin = end
    return out


@pytest.mark.parametrize(
    "text,want",
    [
        ("One is here. Two is there! Three?", ["One is here.", "Two is there!", "Three?"]),
        ("Dr. Ito and Prof. Ek et al. met in St. Elm hall. They left.", ["Dr. Ito and Prof. Ek et al. met in St. Elm hall.", "They left."]),
        ("It holds approx. 4.5 mm, i.e. less. See Fig. 3 and No. 7, e.g. at 5 p.m. in May.", ["It holds approx. 4.5 mm, i.e. less.", "See Fig. 3 and No. 7, e.g. at 5 p.m. in May."]),
        ("Come by 5 p.m. Then go. Bring clips, shims, etc. Never wait.", ["Come by 5 p.m.", "Then go.", "Bring clips, shims, etc.", "Never wait."]),
        ("“Is it dry? Then go.” was the note. Fine.", ["“Is it dry? Then go.” was the note.", "Fine."]),
        ('The log read "Open. Hold." before noon. Next.', ['The log read "Open. Hold." before noon.', "Next."]),
        ('He said "Stop." Then he left.', ['He said "Stop."', "Then he left."]),
        ("It hummed... then stopped. Was 7.5 L. Did it end?pH is low.", ["It hummed... then stopped.", "Was 7.5 L.", "Did it end?", "pH is low."]),
        ("Rates fell slowly. pH drift follows. e-stop wiring runs.", ["Rates fell slowly.", "pH drift follows.", "e-stop wiring runs."]),
        ("It reached 9 min. The rest took 12 ms. Done.", ["It reached 9 min.", "The rest took 12 ms.", "Done."]),
        ("The last was glued.See Sec. 4.2 for more.Dr. Ek knows.", ["The last was glued.", "See Sec. 4.2 for more.", "Dr. Ek knows."]),
        ("Firmware v13.4.1 is old. Use 1.2.3.", ["Firmware v13.4.1 is old.", "Use 1.2.3."]),
        ("Am 3. Mai kam z. B. Dr. Ulm, d. h. der Chef. „Zu. Weiter.“ rief er. Ende.", ["Am 3. Mai kam z. B. Dr. Ulm, d. h. der Chef.", "„Zu. Weiter.“ rief er.", "Ende."]),
        ("La pièce n° 9 (p. ex. FK-9) reste. M. Ek a noté : « Fermée. On va. » avant midi.", ["La pièce n° 9 (p. ex. FK-9) reste.", "M. Ek a noté : « Fermée. On va. » avant midi."]),
        ("¿Qué pasa? ¡No toque! La Sra. Ek vio la pág. 12.", ["¿Qué pasa?", "¡No toque!", "La Sra. Ek vio la pág. 12."]),
        ("Насос показал 9 единиц, т. е. мало. Стоп.", ["Насос показал 9 единиц, т. е. мало.", "Стоп."]),
        ("第3次试验。他说：“已停。可以。”随后走了。读数为7.4，低。", ["第3次试验。", "他说：“已停。可以。”随后走了。", "读数为7.4，低。"]),
        ("値は2.3で低い。「止まった。よい。」と書いた。", ["値は2.3で低い。", "「止まった。よい。」と書いた。"]),
        ("दाब घटाएँ। क्या रहा? हाँ।", ["दाब घटाएँ।", "क्या रहा?", "हाँ।"]),
        ("ห้ามถอด ตรวจสอบ 12 นาที", ["ห้ามถอด", "ตรวจสอบ 12 นาที"]),
        ("A title\n\nText runs\non here. End", ["A title", "Text runs\non here.", "End"]),
        ("", []), (None, []), (" \n ", []), ("...", []), ("no end", ["no end"]),
    ],
)
def test_cases(text, want):
    assert cut(text) == want


def test_ends_grow_and_cover_long_texts():
    text = "Alpha beta gamma 1.5 delta. " * 20000
    ends = sentence_ends(text)
    assert len(ends) == 20000 and ends == sorted(set(ends)) and ends[-1] == len(text.rstrip())


def test_rows(spark):
    df = spark.createDataFrame([(1, "A b. C d.", "x"), (1, "A b. C d.", "y"), (2, None, "x"), (3, "", "x")], "rec int, text string, end_pos string")
    assert sorted(map(tuple, sentence_rows(df, ["rec"], "text").collect())) == [(1, 4), (1, 9)]
    assert sorted((r.rec, r.sentence_no, r.sentence) for r in sentence_units(df, ["rec"], "text").collect()) == [(1, 0, "A b."), (1, 1, "C d.")]
    assert sentence_rows(df.limit(0), ["rec"], "text").count() == 0


def test_long_quotations_and_properties():
    lines = "\n".join(f"Line {i} of what was said. And more of it." for i in range(30))
    text = f"He wrote “{lines}” and left. The end."
    assert [text[:e][-5:] for e in sentence_ends(text)] == ["left.", " end."]
    assert len(sentence_ends(f"He wrote “{lines} and left")) == 60  # a mark that nothing closes quotes nothing
    for mark in "؞܀។︒﹖𑁇":
        assert sentence_ends(f"ab{mark} cd{mark}") == [3, 7], mark
    assert sentence_ends("x" * 10_000 + ". Dr. Y came.") == [10_001, 10_013]


def test_abbreviations_hold_in_the_languages_of_the_text():
    german, english = "Der Wert ist max. Siehe die Tabelle und das Blatt.", "The value is at its max. See the table and the sheet."
    assert len(sentence_ends(german)) == 1 and len(sentence_ends(english)) == 2
    assert len(sentence_ends("Das ist z. B. Öl und nicht Wasser.")) == 1
    assert len(sentence_ends("See annex B. The valve is shut.")) == 2 and len(sentence_ends("It is by J. Smith and not by me.")) == 1


def test_long_runs_take_linear_time():
    import time

    began = time.perf_counter()
    assert len(sentence_ends("a." * 200_000 + " End")) <= 2 and sentence_ends("x" * 300_000 + " y. The end.")[-1] == 300_012
    assert time.perf_counter() - began < 20
