import random
import uuid

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions.blocks import breadcrumbs, running_last, running_sum


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression.alias("y")).first().y


def test_ids(spark):
    for key in ("a::b>>c::0", "größe::x", ""):
        assert one(spark, key, X.uuid5("x")) == str(uuid.uuid5(uuid.NAMESPACE_DNS, key))


@pytest.mark.parametrize("line,level,page", [("# A", 1, None), ("### B c", 3, None), ("#### C", None, None), ("#A", None, None), ("## --- PAGE 12 ---", None, 12), ("##---PAGE 3---", None, 3), ("text", None, None), (None, None, None)])
def test_lines(spark, line, level, page):
    assert one(spark, line, X.header_level("x")) == level and one(spark, line, X.page_marker("x")) == page


@pytest.mark.parametrize("line,want", [("| a | b |", True), ("a | b | c", True), ("a | b", False), ("  |x", True), ("", False)])
def test_table_lines(spark, line, want):
    assert one(spark, line, X.is_table_line("x")) is want


@pytest.mark.parametrize("line,want", [("|---|:--|", True), ("---", True), ("| a |", False), (":--|", False), ("", False)])
def test_separators(spark, line, want):
    assert one(spark, line, X.is_separator_row("x")) is want


@pytest.mark.parametrize(
    "sentence,want",
    [("The pump must be closed before the valve is opened.", True), ("Too short to be kept here.", False), ("Seven words are not enough to keeping.", False), ("The reading of the gauge in hall two was about 42", False),
     ("See the drawing of the pump on the next page of it.", False), ("Contents of the first chapter ........ and then some more", False), ("1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16", False), (None, False)],
)
def test_quality(spark, sentence, want):
    assert one(spark, sentence, X.is_quality_sentence("x")) is want


@pytest.mark.parametrize(
    "question,want",
    [("Compare how A works with B", "comparison"), ("How does it work?", "process"), ("What is the thrust of the engine", "spec_lookup"), ("reach 58 bar", "spec_lookup"), ("What is it?", "overview"), ("", "general"), (None, "general"), ("hello there", "general")],
)
def test_classes(spark, question, want):
    assert one(spark, question, X.classify_question("x")) == want


def test_scalars(spark):
    assert one(spark, "## A title", X.excerpt("x")) == "A title" and one(spark, "y" * 201, X.excerpt("x")) == "y" * 200 + "..."
    assert one(spark, "a" * 60 + "Needle" + "b" * 100, X.snippet("x", F.lit("needle"))) == "..." + "a" * 40 + "Needle" + "b" * 80 + "..."
    assert one(spark, "nothing", X.snippet("x", F.lit("needle"))) is None and one(spark, "The SSLV-D1, a x!", X.bm25_tokens("x")) == ["the", "sslv-d1"]
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0], None)], "a array<float>, b array<float>, z array<float>, n array<float>")
    assert tuple(df.select(F.round(X.cosine(F.col("a"), F.col("b")), 6), X.cosine(F.col("a"), F.col("z")), X.cosine(F.col("a"), F.col("n"))).first()) == (0.707107, 0.0, 0.0)
    X.register_sql(spark)
    assert spark.sql("SELECT docloom_title('cold_pump-7')").first()[0] == "Cold Pump 7"


def test_running_state(spark):
    rng = random.Random(4)
    data = [(b, i // 5, i, rng.choice([None, None, i])) for b in ("x", "y") for i in range(23)]
    df = spark.createDataFrame(data, "book string, block long, seq long, v long")
    last = {(r.book, r.seq): r.page for r in running_last(df, ["book"], "block", "seq", F.col("v"), "page", -1).collect()}
    total = {(r.book, r.seq): r.s for r in running_sum(df, ["book"], "block", "seq", F.coalesce("v", F.lit(0)), "s").collect()}
    for b in ("x", "y"):
        state, s = -1, 0
        for _, _, i, v in [d for d in data if d[0] == b]:
            state, s = v if v is not None else state, s + (v or 0)
            assert (last[(b, i)], total[(b, i)]) == (state, s)


def test_breadcrumbs(spark):
    rng = random.Random(6)
    levels = [1, 3, 3, 2, 1, 2] + [rng.randint(1, 3) for _ in range(60)]
    data = [("b", i // 4, i, level, f"t{i}") for i, level in enumerate(levels)] + [("c", 0, 5, 3, "only")]
    df = spark.createDataFrame(data, "book string, block long, seq long, level int, title string")
    got = {(r.book, r.seq): r.path for r in breadcrumbs(df, "book", "block", "seq", "level", "title", "path").collect()}
    stack = []
    for i, level in enumerate(levels):
        stack = stack[: level - 1] + [f"t{i}"]
        assert got[("b", i)] == stack
    assert got[("c", 5)] == ["only"] and got[("b", 2)] == ["t0", "t1", "t2"]
