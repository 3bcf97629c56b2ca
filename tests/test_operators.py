import math

import numpy as np
from pyspark.sql import functions as F

from docloom.operators import chunking as C
from docloom.operators import context as P
from docloom.operators import graph as G
from docloom.operators import lexical as L
from docloom.operators import reports as R
from docloom.operators import tables as T
from docloom.functions import segments as G2
from docloom.operators import vectors as V
from docloom.operators.jobs import Job, job_events, job_states
from docloom.sources import formats as S


def lines(spark, text, book="b"):
    rows = [(book, 0, i, i, 0, x) for i, x in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "book_id string, chunk_seq int, pos int, seq long, block long, line string")


def test_chunking(spark):
    text = "# Book\n## --- PAGE 2 ---\nSome first text that is long enough.\n### Deep\n| a | b |\n|---|---|\n| 1 | 2 |\n| lone | pipe |\n\n## --- PAGE 3 ---\nMore text that is long enough here.\n| single line that is long |"
    chunks = {r.chunk_index: r for r in C.chunks_of(lines(spark, text)).collect()}
    assert [(i, r.type, r.start_page, r.end_page) for i, r in sorted(chunks.items())] == [(1, "text", 1, 2), (3, "table", 2, 3), (4, "text", 2, 3), (5, "text", 2, 3)]
    assert chunks[3].path == ["Book", "Deep"] and chunks[5].content == "| single line that is long |" and chunks[3].parent_id == chunks[4].parent_id
    assert {(r.page, r.content.split("\n")[0]) for r in C.pages_of(lines(spark, text)).collect()} == {(0, "# Book"), (2, "Some first text that is long enough."), (3, "More text that is long enough here.")}
    assert C.chunks_of(lines(spark, text).limit(0)).count() == 0


def test_tables(spark):
    rows = [
        ("t1", "b", 0, ["Engines", "Vikas Engine"], (1, 2), "table", "| Parameter | Value | Unit |\n|---|---|---|\n| Thrust | 799 | kN |\n| ISP | 293 | s | more |\n|  |  |  |\n| only |"),
        ("t2", "b", 1, None, None, "table", "Place | Size | Use\n x | 2 |"),
        ("t3", "b", 2, ["S"], (1, 1), "table", None),
    ]
    df = spark.createDataFrame(rows, "chunk_id string, book_id string, chunk_seq int, section_path array<string>, page_range struct<start:int,end:int>, type string, content string")
    parsed = T.parsed_tables(df)
    by = {r.chunk_id: r for r in parsed.collect()}
    assert by["t1"].rows == [["Thrust", "799", "kN"], ["ISP", "293", "s"], ["only", "", ""]] and by["t1"].pattern == "spec" and by["t2"].pattern == "generic" and by["t3"].rows == []
    sentences = {(r.chunk_id, r.row_index): r.sentence for r in T.row_sentences(parsed).collect()}
    assert sentences[("t1", 0)] == "Vikas Engine Thrust is 799 kN." and sentences[("t1", 2)] == "Parameter: only." and sentences[("t2", 0)] == "Place: x | Size: 2."
    assert {r.chunk_id: r.linearized for r in T.linearized(parsed).collect()}["t3"] == ""
    assert {r.chunk_id: r.bullets for r in T.bullets(parsed).collect()}["t1"].split("\n")[:2] == ["[TABLE — Vikas Engine]:", "- Thrust: 799 kN"]
    assert {r.chunk_id: r.markdown for r in T.pipe_tables(parsed).collect()}["t1"].split("\n")[2] == "| Thrust    | 799   | kN   |"


def test_bm25(spark):
    docs = [(1, "alpha beta gamma"), (2, "alpha alpha delta"), (3, "epsilon zeta"), (4, ""), (5, None)]
    df = spark.createDataFrame(docs, "id int, text string")
    questions = spark.createDataFrame([(1, "alpha alpha gamma"), (2, ""), (3, None)], "query_id int, question string")
    got = {(r.query_id, r.id): r.score for r in L.bm25_scores(df, "id", "text", questions).collect()}
    tokens = [(i, (t or "").split()) for i, t in docs]
    n, avg = len(tokens), sum(len(t) for _, t in tokens) / len(tokens)
    df_ = {w: sum(w in t for _, t in tokens) for _, t in tokens for w in t}
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df_.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    want = {}
    for i, t in tokens:
        s = sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in "alpha alpha gamma".split())
        if s > 0:
            want[(1, i)] = round(s, 6)
    assert got == want


def test_fusion(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "q int, k string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "q int, k string, rank int")
    got = {r.k: r.rrf_score for r in L.fuse(a, b, "q", "k").collect()}
    assert got == {"x": round(1 / 61 + 1 / 1000060, 6), "y": round(1 / 62 + 1 / 61, 6), "z": round(1 / 62 + 1 / 1000060, 6)}


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(V, "QUERY_BLOCK", 3)  # several blocks of queries
    rng = np.random.default_rng(2)
    data = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)] + [(60, None), (61, [0.0] * 8), (62, [1.0])]
    points = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    queries = points.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r.query_id, r.rank): r.vec_id for r in V.vector_topk(points, queries, 5).collect()}
    unit = {i: np.array(v, dtype=np.float32).astype(float) / np.linalg.norm(v) if v and len(v) == 8 and any(v) else np.zeros(8) for i, v in data}
    for q in range(0, 60, 10):
        order = sorted(unit, key=lambda i: (-round(float(unit[i] @ unit[q]), 6), i))[:5]
        assert [got[(q, k)] for k in range(1, 6)] == order
    assert V.vector_topk(points, queries.limit(0), 5).count() == 0 and V.vector_topk(points.limit(0), queries, 5).count() == 0


def test_mmr(spark):
    rows = [(1, 1, 0.9, [1.0, 0.0]), (1, 2, 0.89, [1.0, 0.0]), (1, 3, 0.5, [0.0, 1.0]), (1, 4, 0.1, None)]
    df = spark.createDataFrame(rows, "query_id int, vec_id int, score double, embedding array<float>")
    got = {r.pick: r.vec_id for r in V.mmr(df, 3).collect()}
    assert (got[1], got[2]) == (1, 3)


def test_packing(spark):
    def pack(items, budget):
        df = spark.createDataFrame([(1, i, k, float(s), 0, "x" * n) for i, k, s, n in items], "query_id int, item_id string, kind string, score double, place long, text string")
        q = spark.createDataFrame([(1, budget)], "query_id int, max_chars int")
        return [(r.item_id, r.used) for r in P.pack(df, q).orderBy("seq").collect()]

    assert pack([("a", "chunk", 9, 100), ("t", "table", 8, 500), ("b", "chunk", 1, 600)], 550) == [("a", 100), ("b", 450)]
    assert pack([("a", "chunk", 9, 100), ("p", "page", 1, 900)], 601) == [("a", 100), ("p", 501)] and pack([("a", "chunk", 9, 100), ("p", "page", 1, 900)], 600) == [("a", 100)]
    assert pack([("a", "chunk", 9, 100), ("b", "chunk", 1, 900)], 300) == [("a", 100)] and pack([("z", "page", 0, 50)], 100) == [("z", 50)]


def test_graph(spark):
    sentences = spark.createDataFrame([("c", "b", "s1", 0, "Alphaone meets Betatwo and Alphaone."), ("c", "b", "s2", 1, "Betatwo left Alphaone."), ("c", "b", "s2", 2, None)], "chunk_id string, book_id string, section string, pos int, sentence string")
    mentions = G.entity_mentions(sentences)
    assert {(r.a, r.b, r.n, tuple(r.sections)) for r in G.cooccurrence(mentions).collect()} == {("Alphaone", "Betatwo", 2, ("s1", "s2"))}
    texts = spark.createDataFrame([(1, "chamber pressure of 58.5 bar; speed 17,000 rpm. The 5 kg"), (2, None)], "id int, text string")
    assert [(r.subject, r.value, r.unit) for r in G.spec_mentions(texts, "id", "text").orderBy("pos").collect()][:2] == [("chamber pressure", 58.5, "bar"), ("speed", 17000.0, "rpm")]


def test_reports(spark):
    rows = [("c1", "b", (1, 1), "w " * 50), ("c2", "b", (2, 2), "w " * 10), ("c3", "b", (3, 3), "w " * 9), ("c4", "b", (3, 4), None), ("c5", "d", None, "w")]
    chunk = spark.createDataFrame(rows + rows[:1], "chunk_id string, book_id string, page_range struct<start:int,end:int>, content string")
    r = R.coverage(chunk).first()
    assert (r.pages, r.good, r.short, r.blank, r.chunks, r.multi_chunk_pages, r.coverage) == (3, 1, 1, 1, 4, 1, 33.3)
    assert {x.book_id: x.n_pages for x in R.page_counts(chunk).collect()} == {"b": 4, "d": 1}
    items = spark.createDataFrame([(i, "g") for i in range(7)] + [(0, "g")], "id int, grp string")
    assert [(x.start, x.n) for x in R.batch_units(items, "id", "grp", 3).orderBy("start").collect()] == [(0, 3), (3, 3), (6, 1)]


def test_jobs(spark):
    job = Job()
    for at, event in [(0, "view"), (700, "view"), (800, "error"), (900, "view"), (2000, "click")]:
        job.apply(at, event)
    assert (job.status, job.attempts, job.n_expired) == ("FAILED", 3, 2)
    rows = [(i, 1.0 * i, 7, e, 0.0, "") for i, e in enumerate(["view", "purchase", "purchase", "signup"])] + [(1, 1.0, 7, "purchase", 0.0, ""), (9, 1.0, None, "view", 0.0, "")]
    df = spark.createDataFrame(rows, "event_id long, s double, user_id long, event_type string, value double, props string").withColumn("ts", F.timestamp_seconds("s"))
    got = job_states(job_events(df)).collect()
    assert [(r.job_id, r.status, r.n_events, r.n_ignored) for r in got] == [(7, "COMPLETED", 4, 2)]
    assert job_states(job_events(df.limit(0))).count() == 0


def test_formats(spark, tmp_path):
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "cold_pump.md").write_text("# A\ntext")
    assert [tuple(r) for r in S.read_markdown(spark, str(tmp_path / "md")).collect()] == [("cold_pump", 0, "# A"), ("cold_pump", 1, "text")]
    (tmp_path / "p.json").write_text('{"1": {"page_number": 1, "sections": ["S"], "full_content": "x"}, "__meta__": {"book_id": "b", "total_pages": 1}}')
    assert [tuple(r) for r in S.read_pages_json(spark, str(tmp_path / "p.json")).collect()] == [("b", 1, ["S"], "x")]
    (tmp_path / "c.json").write_text('[{"chunk_id": "1", "page_range": {"start": 1, "end": 2}, "section_path": ["a"]}]')
    assert S.read_chunks_json(spark, str(tmp_path / "c.json")).first().page_range.end == 2
    totals = spark.createDataFrame([("b", 23), ("e", 0)], "book_id string, total_pages int")
    assert [(r.start_offset, r.page_count) for r in S.split_units(totals).orderBy("chunk_idx").collect()] == [(0, 10), (10, 10), (20, 3)]
    units = spark.createDataFrame([("b", 1, "two"), ("b", 0, "one"), ("b", 2, " ")], "book_id string, chunk_idx int, content string")
    assert S.joined(S.reassembled(units)).first().markdown == "# Text Extraction: b\n\none\n\ntwo"
    logs = spark.createDataFrame([("t", "ip", "[gpu-1a] task failed"), ("t", "ip", "no id"), ("t", "ip", "[cpu-2] Disconnected")], "ts string, ip string, line string")
    assert [(r.worker_id, r.severity, r.online) for r in S.parse_log(logs).collect()] == [("gpu-1a", "error", True), ("cpu-2", "info", False)]
    sse = spark.createDataFrame([(1, 0, 'data: {"type": "token", "content": "He"}'), (1, 1, 'data: {"type": "token", "content": "y"}'), (1, 2, "data: {bad"), (1, 3, "data: [DONE]"), (1, 4, 'data: {"type": "done"}'), (2, 0, 'data: {"type": "token", "content": "cut"}')], "id int, n int, line string")
    assert {r.id: (r.answer, r.done) for r in S.accumulated(S.parse_events(sse), "id", "n").collect()} == {1: ("Hey", True), 2: ("cut (Stopped)", False)}
    html = spark.createDataFrame([("<h1>A &amp; B</h1><script>x<y</script><p>one<br>two</p>",)], "h string").select(S.html_to_text(F.col("h"))).first()[0]
    assert html == "A & B\none\ntwo"
    books = spark.createDataFrame([("a", 1), ("b", 2)], "book_id string, v int")
    S.write_books(books, str(tmp_path / "t"))
    S.write_books(spark.createDataFrame([("b", 3)], "book_id string, v int"), str(tmp_path / "t"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).select("book_id", "v").collect()} == {("a", 1), ("b", 3)}
    S.remove_books(spark, str(tmp_path / "t"), ["a"], str(tmp_path / "u"))
    assert spark.read.parquet(str(tmp_path / "u")).count() == 1 and S.duplicate_keys(books, ["book_id"]).count() == 0


def test_second_pass_searches_again(spark):
    from docloom.operators import retrieval as Q
    from docloom.plans.retrieval import Stages

    stages = Stages(spark, "/root/testdata/sf0.01")
    pairs = lambda df: {(r.query_id, r.chunk_id, r.rank) for r in df.collect()}
    first = stages.ranked().where("rerank_score is not null")
    most = max(r.rerank_score for r in first.collect())
    assert pairs(stages.adaptive(-1.0)) == pairs(first)
    every = stages.adaptive(most + 1).collect()
    assert every and {r["pass"] for r in every} == {2}
    limits = {r.query_id: (r.prop_limit, r.sect_limit) for r in stages.questions.collect()}
    wider = Q.widened(stages.questions, stages.questions)
    assert {r.query_id: (r.prop_limit, r.sect_limit) for r in wider.collect()} == {q: (2 * p, 2 * s) for q, (p, s) in limits.items()}
    one = spark.createDataFrame([(1, "a", 1.0, None, True), (1, "b", None, 2.0, False)], "query_id long, chunk_id string, direct_score double, child_score double, from_direct boolean")
    two = spark.createDataFrame([(1, "a", 1.0, 3.0, True), (1, "c", 0.5, None, True)], one.schema)
    assert {tuple(r) for r in Q.second_pass(one, two).collect()} == {(1, "a", 1.0, 3.0, True), (1, "b", None, 2.0, False), (1, "c", 0.5, None, True)}


def test_lookups_by_containment(spark):
    terms = spark.createDataFrame([(1, "warm", ["b"], False), (2, "pumps", None, False), (3, "warm", ["c"], False), (4, "warm", ["c"], True)], "query_id long, term string, book_ids array<string>, cross_book boolean")
    spec = spark.createDataFrame([("1", "b", "the warm-up time", "s", 5.0, "5 s", None), ("2", "b", "Pump", None, 1.0, "1", "x"), ("3", "b", "", None, 1.0, "1", None), ("4", "b", None, None, 1.0, "1", None), ("5", "b", "warm", None, 1.0, None, None)], "spec_id string, book_id string, subject string, unit string, value double, raw string, section string")
    assert {(r.query_id, r.book_id, r.subject) for r in G.spec_lookup(terms, spec).collect()} == {(1, "b", "the warm-up time"), (2, "b", "Pump"), (4, "b", "the warm-up time")}
    nodes = spark.createDataFrame([("b", "Warming", "S1"), ("b", "Pump", "S2"), ("b", "War", "S3")], "book_id string, name string, section string")
    assert {(r.query_id, r.section) for r in G.sections_of_terms(terms, nodes).collect()} == {(1, "S1"), (1, "S3"), (2, "S2"), (4, "S1"), (4, "S3")}
    many = spark.createDataFrame([("b", f"Warm{i}", f"S{i:03d}") for i in range(80)], "book_id string, name string, section string")
    one = terms.where("query_id = 1")
    assert G.sections_of_terms(one, many).count() == 50 and G.sections_of_terms(one, many, limit=None).count() == 80


def test_packing_by_priority(spark):
    items = [("p:b:2", "page", 1.0, 10_000_002, 300), ("p:b:1", "page", 9.0, 10_000_001, 300), ("p:b:9", "page", 9.0, 20_000_009, 700), ("t", "table", 5.0, 0, 900), ("u", "table", 4.0, 0, 100), ("c", "chunk", 8.0, 0, 400)]
    df = spark.createDataFrame([(1, i, k, s, p, "x" * n) for i, k, s, p, n in items], "query_id int, item_id string, kind string, score double, place long, text string")
    q = spark.createDataFrame([(1, 1000), (2, 50)], "query_id int, max_chars int")
    specs = spark.createDataFrame([(1, "s" * 50)], "query_id int, block string")
    got = [(r.item_id, r.used) for r in P.pack(df, q, specs, priority=True).where("query_id = 1").orderBy("seq").collect()]
    assert got == [("specs", 50), ("p:b:1", 300), ("p:b:2", 300), ("u", 100), ("c", 250)]
    text = P.context_text(P.pack(df, q, specs, priority=True), df, specs).first()
    assert text.context.count("\n\n---\n\n") == 4 and text.total_chars == len(text.context) == 1000 + 4 * 7


def test_segments(spark):
    def one(text, f):
        return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]

    text = "One two three. Four five! six seven eight nine. Ten."
    assert one(text, lambda c: G2.segments(c, 5)) == ["One two three. Four five!", "six seven eight nine. Ten."]
    assert one("a b. " * 3, lambda c: G2.segments(c, 1)) == ["a b.", "a b.", "a b."] and one(None, lambda c: G2.segments(c, 5)) is None and one(" ", lambda c: G2.segments(c, 5)) == []
    long = "Short one. " + "x" * 1201 + ". After it. And more."
    assert [len(w) for w in one(long, G2.windows)] == [10, 500, 500, 202, 19]
    sentences = " ".join(f"{'word ' * 29}end{i}." for i in range(6))
    got = one(sentences, lambda c: G2.overlapping(c, 100))
    assert [w.count("end") for w in got] == [3, 3, 2] and "end2." in got[0] and "end2." in got[1] and one("few words", lambda c: G2.overlapping(c, 100)) == ["few words"]
    assert one("The tank. The pump is hot. The pump is cold.", lambda c: G2.best_segment(G2.loose_sentences(c), F.lit("is the pump hot."))) == "The pump is hot."
    assert one("A first one. Two.", G2.first_sentence) == "A first one." and one(" ", G2.first_sentence) == ""


def test_orphans(spark):
    from docloom.operators import retrieval as Q

    hits = spark.createDataFrame([(1, "gone", ["a", "b"], "x"), (1, None, ["a", "b"], "x"), (1, "c1", ["z"], "x"), (2, None, None, "x"), (3, None, ["a", "b"], "y")], "query_id int, parent_chunk_id string, section_path array<string>, book_id string")
    chunks = spark.createDataFrame([("c1", "x", ["z"]), ("c2", "x", ["a", "b"]), ("c3", "x", ["a", "b"]), ("c4", "x", None)], "chunk_id string, book_id string, section_path array<string>")
    assert {tuple(r) for r in Q.orphan_parents(hits, chunks).collect()} == {(1, "c2"), (1, "c3")}


def test_breadcrumbs_in_a_tree_of_blocks(spark):
    import random

    from docloom.functions.blocks import breadcrumbs

    rng = random.Random(4)
    rows, want = [], {}
    for book in ("a", "b"):
        stack = []
        for seq in range(400):
            level = rng.choice([1, 2, 3, 3])
            stack = [*stack[: level - 1], f"{book}{seq}"]
            rows.append((book, seq // 3, seq, level, f"{book}{seq}"))
            want[book, seq] = tuple(stack)
    df = spark.createDataFrame(rows, "book string, block long, seq long, level int, title string")
    for fan in (4, 256):
        got = {(r.book, r.seq): tuple(r.path) for r in breadcrumbs(df, "book", "block", "seq", "level", "title", "path", fan=fan).collect()}
        assert got == want
    assert breadcrumbs(df.limit(0), "book", "block", "seq", "level", "title", "path").count() == 0


def test_vectors_in_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(300)] + [(900, None), (901, [0.0] * 8)]
    points = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = points.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    whole = {tuple(r) for r in V.vector_topk(points, queries, 5).collect()}
    monkeypatch.setattr(V, "POINT_BLOCK", 40)
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    assert {tuple(r) for r in V.vector_topk(points, queries, 5).collect()} == whole and len(whole) == 30 * 5
    assert V.vector_topk(points.limit(0), queries, 5).count() == 0 and V.vector_topk(points, queries.limit(0), 5).count() == 0


def _ranked_by_hand(docs, questions):
    """The search over rows in Python: documents (key, book, text), questions (id, text, books, cross, limit)."""
    pieces = {}
    for key, _, text in docs:
        t = text.split()
        pieces.setdefault((key, len(t)), []).extend(t)
    n, average = len(docs), sum(len(t.split()) for *_, t in docs) / len(docs)
    words = {w for t in pieces.values() for w in t}
    df = {w: sum(w in t for t in pieces.values()) for w in words}
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    out = set()
    for q, asked, books, cross, limit in questions:
        score = {}
        for (key, dl), t in pieces.items():
            for w in asked.split():
                if t.count(w):
                    score[key] = score.get(key, 0) + idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * dl / average))
        found = sorted((-round(score.get(key, 0), 6), key) for key, book, _ in docs if score.get(key, 0) > 0 and (cross or not books or book in books))
        out |= {(q, key, -s, i + 1) for i, (s, key) in enumerate(found[:limit])}
    return out


def test_search_keeps_no_pair_of_question_and_document(spark, monkeypatch):
    """Every question meets every document in a few blocks; only the best leave the tasks: keys in several rows and books, ties, limits, questions in several passes."""
    import random

    from docloom.operators import retrieval as R

    some = random.Random(3)
    words = [f"w{i:02d}" for i in range(12)]
    docs = [(f"k{some.randrange(330):03d}", f"b{some.randrange(4)}", " ".join(some.choices(words, k=some.randrange(1, 6)))) for _ in range(400)]
    docs += [("k000", "b0", "w00 w01"), ("k000", "b1", "w00 w01"), ("k000", "b1", "w02 w03"), ("tie", "b0", "w05 w06"), ("tie2", "b0", "w05 w06")]
    questions = [(i, " ".join(some.choices(words, k=3)), [None, [], ["b1"], ["b0", "b2"]][i % 4], i % 8 == 3, 1 + i % 7) for i in range(24)]
    df = spark.createDataFrame(docs, "id string, book_id string, text string").repartition(5)
    asked = spark.createDataFrame(questions, "query_id long, question string, book_ids array<string>, cross_book boolean, top int")
    for terms, cells, held in ((10_000, 1_000_000, 1_000_000), (20, 24, 50)):
        for name, value in (("PASS_TERMS", terms), ("CELLS", cells), ("HELD", held)):
            monkeypatch.setattr(L, name, value)
        found = R.search(df, "id", asked, "top")
        assert {(r.query_id, r.id, r.score, r["rank"]) for r in found.collect()} == _ranked_by_hand(docs, questions)
        # What leaves the tasks is bounded by the limits and the tasks, not by the pairs.
        best = L.bm25_best(df, "id", "text", asked, "top", spark.createDataFrame([(d[0],) for d in docs], "id string").groupBy("id").count().where("count > 1").select("id"))
        assert best.count() < len(docs) * len(questions) / 4
    assert R.search(df, "id", asked.limit(0), "top").count() == 0 and R.search(df.limit(0), "id", asked, "top").count() == 0


def test_distinct_rows(spark):
    from docloom.session import distinct_rows, repeated_keys

    rows = [("a", 1), ("a", 1), ("a", 2), ("b", 1), (None, 1), (None, 1), (None, 2), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v int")
    keys = repeated_keys(df, "k")
    assert [r.k for r in keys.collect()] == ["a"]
    assert sorted(map(str, distinct_rows(df, "k", keys).collect())) == sorted(map(str, df.distinct().collect()))


def test_text_blocks_are_not_computed_in_a_join(spark):
    """A filter on the block, which holds lambda functions, must not become the condition of a join: on larger tables such a plan failed."""
    import pyspark.sql.functions as F

    from docloom.operators import context as C

    chunks = spark.createDataFrame(
        [("c1", "b", ["A"], (1, 2), "text", "The pump is shut. " * 200), ("c2", "b", ["A"], (1, 1), "text", " ")],
        "chunk_id string, book_id string, section_path array<string>, page_range struct<start:int,end:int>, type string, content string",
    )
    ranked = spark.createDataFrame([(1, "c1"), (1, "c2")], "query_id long, chunk_id string")
    questions = spark.createDataFrame([(1, "Is the pump shut?")], "query_id long, question string")
    blocks = C.text_blocks(ranked, chunks, questions).where(F.length(F.trim("block")) > 0)
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and "content" in x]
    assert [(r.query_id, r.chunk_id) for r in blocks.collect()] == [(1, "c1")]


def test_first_matches_are_those_of_all_pairs(spark):
    import random

    dice = random.Random(5)
    books = ["a", "b", "c", None]
    terms = [(dice.randrange(6), dice.choice("xyz"), dice.choice([None, [], ["a"], ["a", "b", None], ["c"]]), dice.random() < 0.3) for _ in range(30)]
    matched = [(dice.choice("xyzw"), dice.choice(books), f"S{dice.randrange(40)}") for _ in range(300)]
    t, m = spark.createDataFrame(terms, "query_id int, term string, book_ids array<string>, cross_book boolean"), spark.createDataFrame(matched, "term string, book_id string, section string")
    for limit in (4, None):
        want = set()
        for q in {x[0] for x in terms}:
            own = {s for _, term, ids, cross in (x for x in terms if x[0] == q) for t2, b, s in matched if t2 == term and (cross or not ids or (b is not None and b in ids))}
            want |= {(q, s) for s in sorted(own)[:limit]}
        assert {tuple(r) for r in G._first_matches(t, m, ["section"], limit).collect()} == want


def test_texts_are_not_shuffled_for_the_few_that_are_ranked(spark):
    from docloom.operators import propositions, retrieval
    from docloom.session import repeated_keys

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chunks = spark.createDataFrame([("c1", "pump valve"), ("c2", "tank")], "chunk_id string, content string")
        candidates = spark.createDataFrame([(1, "c1", 2.0, None, True, False)], "query_id int, chunk_id string, direct_score double, child_score double, from_direct boolean, from_graph boolean")
        questions = spark.createDataFrame([(1, "the pump", 3, 1.0)], "query_id int, question string, top_n int, boost double")
        ranked = retrieval.reranked(candidates, chunks, questions)
        assert "SortMergeJoin" not in ranked._jdf.queryExecution().executedPlan().toString() and [r.rerank_score for r in ranked.collect()] == [0.5]
        rows = [("k", "b", 1, None, "text", "The pump is a Turbine of the hall.", ["A", "B"]), ("k", "b", 1, None, "text", "The pump is a Turbine of the hall.", ["A", "C"]), ("l", "b", 2, None, "text", "The other Turbine is in the hall.", None), (None, "b", 3, None, "text", "The third Turbine is in the hall.", ["A"])]
        chunk = spark.createDataFrame(rows, "chunk_id string, book_id string, chunk_seq int, page_range struct<start:int,end:int>, type string, content string, section_path array<string>")
        got = propositions.section_sentences(chunk, repeated_keys(chunk, "chunk_id"))
        section = chunk.select("chunk_id", F.coalesce(F.try_element_at("section_path", F.lit(-1)), F.lit("")).alias("section")).distinct()
        want = propositions.chunk_sentences(chunk).join(section, "chunk_id").select(got.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_garbage_is_collected_once_for_each_kept_stage(spark, monkeypatch):
    from docloom.plans import retrieval

    calls = []
    monkeypatch.setattr(retrieval, "release", calls.append)
    stages = retrieval.Stages(spark, "/root/testdata/sf0.001")
    assert stages.kept("numbers", lambda: spark.range(3)).count() == stages.kept("numbers", lambda: spark.range(4)).count() == 3 and len(calls) == 1


def test_release_hands_back_what_the_jvm_has_freed_outside_its_heap(spark):
    from pathlib import Path

    from docloom.session import release

    jvm = spark.sparkContext._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status")
    resident = lambda: int(next(x for x in status.read_text().splitlines() if x.startswith("VmRSS")).split()[1]) // 1024
    platform, size = jvm.org.apache.spark.unsafe.Platform, 100_000
    jvm.System.gc()
    blocks = [platform.allocateMemory(size) for _ in range(2000)]
    for at in blocks:
        platform.setMemory(at, 1, size)
    for i, at in enumerate(blocks):
        if i % 10:  # the rest holds the ends of the C library's pools
            platform.freeMemory(at)
    before = resident()
    release(spark)
    after = resident()
    for at in blocks[::10]:
        platform.freeMemory(at)
    assert after < before - 100


def test_no_plan_of_the_candidates_reads_the_chunks_many_times(spark, monkeypatch):
    from docloom.plans import retrieval

    scans, cut = [], retrieval.cut

    def counted(df):
        scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return cut(df)

    monkeypatch.setattr(retrieval, "cut", counted)
    assert retrieval.Stages(spark, "/root/testdata/sf0.001", 1).candidates().count() and max(scans) <= 20, scans
