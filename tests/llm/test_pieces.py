from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm.pieces import piece_bounds, pieces


def check(text, limit=1500, overlap=150):
    bounds = piece_bounds(text, limit, overlap)
    body = text.strip()
    begin = len(text) - len(text.lstrip())
    assert bounds[0][0] == begin and bounds[-1][1] == begin + len(body)
    assert all(0 < e - b <= limit for b, e in bounds)
    assert all(b2 == e1 - overlap and e2 > e1 for (_, e1), (b2, e2) in zip(bounds, bounds[1:]))
    return bounds


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n|é漢", min_size=1, max_size=900).filter(str.strip), st.integers(30, 200), st.integers(0, 25))
def test_every_text_is_covered_within_the_limits(text, limit, overlap):
    check(text, limit, overlap)


def test_natural_boundaries():
    paragraph = "Word and word again here. " * 20
    text = "\n\n".join([paragraph.strip()] * 6)
    assert all(text[e : e + 2] == "\n\n" for _, e in check(text)[:-1])
    table = "\n".join(f"| row {i} | {i * 7} | kPa |" for i in range(200))
    assert all(table[e] == "\n" for _, e in check(table)[:-1])
    sentences = "A sentence of some length stands here. " * 100
    assert all(sentences[e - 1] == "." for _, e in check(sentences)[:-1])


def test_balanced():
    sizes = [e - b for b, e in check("x" * 4000)]
    assert max(sizes) - min(sizes) <= 2
    assert len(check("y" * 1_000_000)) == -(-(1_000_000 - 150) // 1350)


def test_rows(spark):
    big = "Some words in a row. " * 100
    rows = [("a", big, ["s"], "t"), ("a", big, ["s"], "t"), ("b", "short", None, "t"), ("c", None, None, "t"), ("d", " " * 3000, None, "t"), ("e", " " * 1400 + "x" * 101, ["q"], "t")]
    df = spark.createDataFrame(rows, "chunk_id string, content string, section_path array<string>, piece string")
    got = pieces(df, "chunk_id", "content", carry=["section_path"]).orderBy("piece_no").collect()
    assert {r.chunk_id for r in got} == {"a"} and [r.piece for r in got] == [big[r.begin_pos : r.end_pos] for r in got] and all(r.section_path == ["s"] for r in got)
    assert {r.chunk_id for r in pieces(df, "chunk_id", "content", whole=True).collect()} == {"a", "b", "e"}
    assert pieces(df.limit(0), "chunk_id", "content").count() == 0


def test_pieces_are_added_until_no_word_is_cut():
    run = "z" * 1000
    text = " ".join([run] * 9)  # the least number of pieces would cut inside the runs
    bounds = check(text)
    assert all(text[e] == " " for _, e in bounds[:-1]) and len(bounds) > -(-(len(text) - 150) // 1350)
    forced = check("z" * 5000 + " " + "y" * 10)  # a run longer than the limit can't be kept whole
    assert forced[-1][1] == 5011
