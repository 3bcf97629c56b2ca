from docloom.llm.scans import repaired, scan_defects, skeleton

SCHEMA = "src string, rec_id string, book string, page int, last_page int, ocr boolean, text string"
CLEAN = "The pressure regulator and the coolant manifold hold the two-stage turbine wheel. Store the exhaust diffuser with the flush line. " * 8
HEAD = "Chapter Cold Pumps 7"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows():
    page = lambda n, text, ocr=True: ("page", f"b#{n}", "b", n, n, ocr, text)
    out = [page(90, CLEAN, False), page(91, None), page(92, "")]
    out.append(page(1, f"{HEAD}    1\nThe prcssure regulator and the coolant mani-\nfold hold the two-\nstage turbine wheel.\n\n- 1 -"))
    out.append(page(2, f"{HEAD}\nStore the exhaust diffu¬\nser with the fliish line.\n\nii"))
    out.append(page(3, "3    CHAPTER COLD PUMPS 7\nHold the wheel.\nThe regu-"))
    out.append(("chunk", "c1", "b", 1, 2, True, f"The wheel holds.\n\n2\n\n{HEAD}    2\nThe tvrbine wheel\n4"))
    return out + [out[3]]


def test_defects(spark):
    got = {tuple(r) for r in scan_defects(frame(spark, rows())).collect()}
    assert got == {
        ("page", "b#1", 0, "running_head"), ("page", "b#1", 1, "misread"), ("page", "b#1", 1, "hyphen_break"), ("page", "b#1", 5, "page_number"),
        ("page", "b#2", 0, "running_head"), ("page", "b#2", 1, "hyphen_break"), ("page", "b#2", 2, "misread"), ("page", "b#2", 4, "page_number"),
        ("page", "b#3", 0, "running_head"), ("page", "b#3", 2, "hyphen_break"), ("chunk", "c1", 2, "page_number"), ("chunk", "c1", 4, "running_head"),
    }


def test_repair(spark):
    got = {(r.rec_id, r.paragraph_no): r.paragraph for r in repaired(frame(spark, rows())).collect()}
    assert got[("b#1", 0)] == "The pressure regulator and the coolant manifold hold the two-stage turbine wheel."
    assert got[("b#2", 0)] == "Store the exhaust diffuser with the flush line." and ("b#1", 1) not in got


def test_context_chooses_between_forms_in_use(spark):
    # eat and cat share a skeleton with the misread "caf": what follows the same word in clean text decides.
    clean = "we eat now. the cat slept. " * 6 + "we eat again. " * 3
    texts = [("page", "b#1", "b", 1, 1, False, clean), ("page", "b#2", "b", 2, 2, True, "then the caf slept and we caf now on some line of text")]
    got = [r.paragraph for r in repaired(frame(spark, texts)).collect()]
    assert got == ["then the cat slept and we cat now on some line of text"] or got == ["then the cat slept and we eat now on some line of text"]
    texts[1] = ("page", "b#2", "b", 2, 2, True, "then the caf slept\nand we caf now on some line of text")
    assert [r.paragraph for r in repaired(frame(spark, texts)).collect()] == ["then the cat slept and we eat now on some line of text"]


def test_empty(spark):
    assert scan_defects(frame(spark, [])).count() == 0 and repaired(frame(spark, [])).count() == 0


def test_skeleton(spark):
    from pyspark.sql import functions as F

    pairs = [("cxpansion", "expansion"), ("fjlter", "filter"), ("boo5ter", "booster"), ("vvhile", "wliile"), ("fliish", "flush"), ("rninutes", "minutes"), ("sliould", "should"), ("9reat", "great"), ("cliffuser", "diffuser")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.where(skeleton(F.col("a")) != skeleton(F.col("b"))).count() == 0
