from docloom.llm.truncation import open_marks, signs_of, truncation, truncation_rates


def broken(text):
    return signs_of(text)["broken"]


def test_automaton():
    assert broken('He said "yes and') == "quote" and broken("操作员说：“已停。") == "quote" and broken("normal (cf. A") == "bracket"
    assert broken("together, the<spa") == "markup" and broken("to the feed&nb") == "escape" and broken("a\\u00") == "escape" and broken("cut �") == "multibyte"
    assert broken("| a | b |\n|---|---|\n| c") == "table" and broken("as shown in Fig.") == "abbreviation" and broken("less, i.e.") == "abbreviation"
    assert broken("It's 5 o'clock. The end.") == "" and broken("A (whole) [text]. 'Tis so.") == "" and broken("It took 5 min.") == ""
    assert open_marks("<b>x</b> (y) “z”") == [] and open_marks("((x)") == [")"]
    assert signs_of(None) is None and signs_of(" \n​") is None
    for end in ("## End of section 2", "- a\n- b", "| a | 1 |", "Ref. AB-1", "— night desk", "Revision 3", "See also: annex F"):
        assert signs_of("A text stands here.\n\n" + end)["structured"], end


def test_baselines(spark):
    rows = [(i, "plain", f"Text number {chr(97 + i % 26)} stands here.") for i in range(20)]
    rows += [(100 + i, "limited", ("word%02d text goes on and " % i * 40)[:200]) for i in range(8)] + [(110, "limited", "A whole one.")]
    rows += [(200 + i, "thai", "ห้ามถอดขณะยังร้อนอยู่ ตรวจสอบหลังล้างระบบ ห้ามถอดขณะยังร้อนอยู่ ตรวจสอบหลังล้างระบบ") for i in range(6)] + [(250, "thai", "ห้ามถอดขณะยังร้อนอยู่ ตรวจสอบหลังล้")]
    rows += [(300, "plain", None), (301, "plain", ""), (302, "plain", "  "), (303, None, "Null source cut of"), (0, "plain", "Text number a stands here.")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    cut = {r.doc_id for r in truncation(df, "doc_id", "source", "text").where("truncated").collect()}
    assert cut == {100 + i for i in range(8)} | {250, 303}
    rates = {r.source: (r.n_texts, r.n_truncated) for r in truncation_rates(df, "doc_id", "source", "text").collect()}
    assert rates["limited"] == (9, 8) and rates["thai"] == (7, 1) and rates[None] == (1, 1) and rates["plain"] == (22, 0)
    assert truncation(df.limit(0), "doc_id", "source", "text").count() == 0


def test_several_limits_of_one_source(spark):
    text = lambda i, size: (f"word{i:02d} text goes on and " * 60)[:size]
    rows = [(i, "a", f"Text number {chr(97 + i % 26)} stands {'here ' * (i % 20)}now.") for i in range(200)]
    rows += [(1000 + i, "a", text(i, 200) if text(i, 200)[-1] != " " else text(i, 199) + "x") for i in range(6)] + [(1100 + i, "a", text(i, 320)) for i in range(5)]
    # At a limit a number before the last full stop is a cut number; elsewhere it is none.
    number = lambda size: ("a text goes on and " * 60)[: size - 4].rstrip().ljust(size - 4, "x") + " 12."
    rows += [(2000, "a", number(200)), (2001, "a", number(320)), (2002, "a", "The pump gives 12.")]
    got = {r.doc_id for r in truncation(spark.createDataFrame(rows, "doc_id long, source string, text string"), "doc_id", "source", "text").where("truncated").collect()}
    assert got == {1000 + i for i in range(6)} | {1100 + i for i in range(5)} | {2000, 2001}


def test_whole_texts_are_read():
    long = "word " * 400
    assert signs_of(f'He said "{long}and')["broken"] == "quote" and signs_of(f"normal (cf. {long}A")["broken"] == "bracket"
    assert signs_of(f"see <a title='{long}")["broken"] == "markup"
    assert signs_of("A text stands here.\n\n- " + "item of a long list " * 20 + "end")["structured"]
    assert signs_of("An open (bracket\n\nin an earlier paragraph. The end.")["broken"] == ""
