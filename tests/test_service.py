import json
import uuid

import pytest
from pyspark.sql import functions as F

from docloom import models as M
from docloom.functions.text import register_sql
from docloom.operators import graph as G
from docloom.operators import pagetext as P
from docloom.operators import retrieval as R
from docloom.operators import service as S
from docloom.sources import formats as X


def test_replay_keeps_clears_and_skips(spark):
    cache = spark.createDataFrame([("a", json.dumps({"x": "ü"})), ("b", json.dumps({"x": 1})), ("c", "not valid json{{{"), ("d", "{}"), ("e", None)], "job_id string, payload string")
    answers = spark.createDataFrame([("a", 200), ("b", 500), ("c", 200)], "job_id string, http_status int")
    assert {tuple(r) for r in S.replayed(cache, answers).collect()} == {("a", "cleared"), ("b", "kept"), ("c", "skipped"), ("d", "kept"), ("e", "skipped")}


def test_backoff_doubles_up_to_the_cap(spark):
    got = [r.d for r in spark.range(6).orderBy("id").select(S.backoff(F.col("id"), 1.0, 10.0).alias("d")).collect()]
    assert got == [1.0, 2.0, 4.0, 8.0, 10.0, 10.0]


def test_service_tables(spark):
    units = spark.createDataFrame([(1, "COMPLETED", 5.0), (1, "FAILED", 9.0), (2, "PENDING", 1.0), (2, "COMPLETED", 2.0)], "book_id int, status string, at double")
    assert {r.book_id: (r.finished, r.cleanup_at) for r in S.barriers(units).collect()} == {1: (True, 309.0), 2: (False, None)}
    workers = spark.createDataFrame([("k", "w0", 0, 100.0, False), ("k", "w1", 1, 100.0, True), ("k", "w2", 2, 50.0, False)], "kind string, worker string, rank int, last_seen double, busy boolean")
    asks = spark.createDataFrame([(1, "w3", "k", 3, 105.0), (2, "w0", "k", 0, 105.0), (3, "w3", "k", 3, 200.0), (4, "z", "other", 9, 1.0)], "request_id int, worker string, kind string, rank int, at double")
    wait = lambda n: {r.request_id: r.wait for r in S.must_wait(asks, workers, spark.createDataFrame([("k", n)], "kind string, n_pending long")).collect()}
    assert wait(1) == {1: True, 2: False, 3: False, 4: False} and wait(2)[1] is False
    status = spark.createDataFrame([("b", "chunks", "done"), ("b", "graph", "failed")], "book_id string, stage string, status string")
    assert {tuple(r) for r in S.resumed(status).collect()} == {("b", "chunks", "done"), ("b", "graph", "pending")}
    assert spark.range(1).select(S.phase_percent(F.lit(100.0), F.lit(100.0))).first()[0] == 99 and spark.range(1).select(S.phase_percent(F.lit(0.0), F.lit(50.0))).first()[0] == 73
    ids = spark.createDataFrame([("plain",), (None,), ('{"id": "", "book_id": {"title": "deep"}}',), ('{"$oid": "o"}',), ('{"x": 1}',)], "v string")
    assert [r[0] for r in ids.select(S.book_id_of(F.col("v"))).collect()] == ["plain", "", "deep", "o", ""]
    wanted, held = spark.createDataFrame([("x",), ("x",), ("y",)], "k string"), spark.createDataFrame([("y",), ("z",)], "k string")
    assert [r.k for r in S.missing(wanted, held, ["k"]).collect()] == ["x"]
    rows = spark.createDataFrame([(1, 1, "a", 1), (1, 2, None, 2), (2, 1, None, 0)], "k int, n int, v string, c long")
    assert {tuple(r) for r in S.applied(rows, ["k"], ["n"], ["v"], ["c"]).collect()} == {(1, "a", 3), (2, None, 0)}
    chats = spark.createDataFrame([("c", "u")], "chat_id string, user_id string")
    assert S.owned(spark.createDataFrame([("c", "u"), ("c", "v"), ("d", "u")], "chat_id string, user_id string"), chats).count() == 1
    assert [r.worker_id for r in S.dashboard(spark.createDataFrame([("2", "a", "w2"), ("1", "b", "w1"), ("1", "a", "w3")], "ip string, type string, worker_id string")).collect()] == ["w3", "w1", "w2"]


def test_page_tables(spark):
    text = "# Engines\nIntro\n| Parameter | Value | Unit |\n|---|---|---|\n| Thrust | 799 | kN |\n| ISP | 293 |  |\n|  |  |  |\nMiddle | of | text\n\n\n\n| a | b |\n| only | one |\nEnd"
    pages = spark.createDataFrame([("b", 1, text), ("b", 2, None), ("b", 3, "no table")], "book_id string, page int, content string")
    got = {r.start_line: (r.end_line, r.headers, r.label, r.bullets) for r in P.page_tables(pages, ["book_id", "page"]).collect()}
    assert got[2][:3] == (7, ["Parameter", "Value", "Unit"], "Engines") and got[2][3].split("\n")[:3] == ["[TABLE — Engines]:", "  - Thrust: 799 kN", "  - ISP: 293"]
    assert got[11] == (12, ["a", "b"], "Engines", "[TABLE — Engines]:\n  - a: only | b: one")
    parsed = spark.createDataFrame([("c1", "b", 5, (1, 2), ["Parameter", "Value"], [["Thrust", "800"]]), ("c2", "b", 6, (1, 1), ["x"], [["y"]])], "chunk_id string, book_id string, chunk_seq int, page_range struct<start:int,end:int>, headers array<string>, rows array<array<string>>")
    out = {r.page: r.content for r in P.page_contents(pages, parsed).collect()}
    assert out[3] == "no table" and out[1].startswith("# Engines\nIntro\n[TABLE — Engines]:\n  - Thrust: 800\n\n[TABLE — Engines]:\n  - a: only | b: one\nEnd")


def test_hooks(spark):
    texts = spark.createDataFrame([(1, "Pump one and pump two"), (2, None), (3, "")], "id int, text string")
    got = {r.id: r.embedding for r in M.embedded(texts, "text").collect()}
    assert len(got[1]) == 64 and abs(sum(x * x for x in got[1]) - 1) < 1e-5 and got[2] is None

    def broken():
        def fail(_):
            raise RuntimeError("no model")

        return fail

    assert {r.embedding for r in M.embedded(texts, "text", load=broken).collect()} == {None}
    assert len({r.id: r.token_vectors for r in M.token_vectors(texts, "text").collect()}[1]) == 5

    def names():
        return lambda windows: [[(w.split()[0], "First")] for w in windows]

    assert {tuple(r) for r in M.recognised(texts, "id", "text", names).collect()} == {(1, "pump", "First", "Pump")}
    assert M.recognised(texts, "id", "text", broken).count() == 0
    candidates = spark.createDataFrame([(1, "a", 0.5, 2.0, True, True), (1, "b", 0.9, None, True, False)], "query_id int, chunk_id string, direct_score double, child_score double, from_direct boolean, from_graph boolean")
    chunks = spark.createDataFrame([("a", "x"), ("b", "yy")], "chunk_id string, content string")
    questions = spark.createDataFrame([(1, "q", 5, 1.0)], "query_id int, question string, top_n int, boost double")
    ranked = lambda load, **kw: {r.chunk_id: (r.rerank_score, r.rank) for r in R.reranked(candidates, chunks, questions, scorer=M.scorer(load), **kw).collect()}
    assert ranked(lambda: lambda q, ts: [float(len(t)) for t in ts]) == {"a": (1.32, 2), "b": (2.0, 1)}
    assert ranked(broken) == {"a": (0.62, 2), "b": (0.9, 1)}  # the direct score, without the boost for the child
    assert set(ranked(lambda: lambda q, ts: [float(len(t)) for t in ts], floor=1.5)) == {"b"}
    units = spark.createDataFrame([("b", 10, bytearray(b"one|two"), True), ("b", 0, bytearray(b"x|"), False)], "book_id string, start_offset int, content binary, ocr boolean")
    pages = M.converted(units, lambda scanned: lambda data: [("scan " if scanned else "") + t for t in data.decode().split("|")])
    assert {tuple(r) for r in X.page_lines(pages).collect()} == {("b", 11, "## --- PAGE 11 ---\n\nscan one"), ("b", 12, "## --- PAGE 12 ---\n\nscan two"), ("b", 1, "## --- PAGE 1 ---\n\nx")}


def test_sinks_and_sources(spark, tmp_path):
    chunk = spark.createDataFrame([("c1", "b", 1, (1, 2), "text", "Some content that is long enough.", None, ["S"]), ("c2", "d", 2, None, "table", "raw", "linear text of the table", None)], "chunk_id string, book_id string, chunk_seq int, page_range struct<start:int,end:int>, type string, content string, linearized_text string, section_path array<string>")
    assert {(r.page_number, r.text, r.chunk_type) for r in X.chunk_log(chunk).collect()} == {(1, "Some content that is long enough.", "text"), (0, "linear text of the table", "table")}
    X.write_json(chunk, str(tmp_path / "j"))
    X.write_books(chunk, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2 and X.read_book(spark, str(tmp_path / "t"), "b").count() == 1
    X.write_run_log(chunk.agg(F.count("*").alias("n")), str(tmp_path / "log"), "r1")
    X.write_run_log(chunk.agg(F.count("*").alias("n")), str(tmp_path / "log"), "r2")
    assert {r.run for r in spark.read.json(str(tmp_path / "log")).collect()} == {"r1", "r2"}
    X.write_books(chunk, str(tmp_path / "u"))
    X.clear_tables(spark, [str(tmp_path / "u")])
    assert spark.read.schema(chunk.schema).parquet(str(tmp_path / "u")).count() == 0
    (tmp_path / "p.json").write_text(json.dumps([{"proposition_id": "1", "text": "x", "section_path": ["a"], "page": 3, "row_data": {"k": "v"}}]))
    assert X.read_propositions_json(spark, str(tmp_path / "p.json")).first().row_data == {"k": "v"}
    ranges = spark.createDataFrame([('{"start": 1, "end": 2}',), ("[3, 4]",), (None,)], "v string")
    assert [tuple(r[0]) for r in ranges.select(X.page_range_of(F.col("v"))).collect()] == [(1, 2), (3, 4), (None, None)]
    line = spark.createDataFrame([("token", "a", None)], "type string, content string, error string").select(X.sse_lines(spark.createDataFrame([], "type string, content string, error string"))).first()[0]
    assert line == 'data: {"type":"token","content":"a"}'
    write = X.once_per_batch(str(tmp_path / "s"))
    for number in (0, 1, 1):
        write(chunk.select("chunk_id"), number)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 4
    units = spark.createDataFrame([("b", i, f"p{i}") for i in range(5)], "book_id string, chunk_idx int, content string")
    parts = X.reassembled(units, part=2)
    assert parts.count() == 3 and X.joined(parts).first().markdown == "# Text Extraction: b\n\np0\n\np1\n\np2\n\np3\n\np4"


def test_sql_functions(spark):
    register_sql(spark)
    one = lambda e: spark.sql(f"SELECT {e}").first()[0]
    assert one("docloom_uuid5('x::y')") == str(uuid.uuid5(uuid.NAMESPACE_DNS, "x::y")) and one("docloom_title('cold_pump-1')") == "Cold Pump 1"
    assert one("docloom_tokens('A big-bang, of 2 things!')") == ["big-bang", "of", "things"] and one("docloom_classify('Compare A and B')") == "comparison" and one("docloom_classify(NULL)") == "general"
    assert one("docloom_quality_sentence('The pump must be closed before the valve is opened.')") and not one("docloom_quality_sentence('Figure 3 shows the pump that must be closed before use.')")
    assert one("docloom_cosine(array(cast(1 AS float), cast(0 AS float)), array(cast(1 AS float), cast(1 AS float)))") == pytest.approx(0.70710678)


def test_graph_merges(spark):
    finds = spark.createDataFrame([(1, "The TX-100 of the Booster at 58.5 bar and the Booster.")], "id int, text string")
    assert {(r.name, r.label) for r in G.recognised(finds, "id", "text").collect()} == {("tx-100", "Code"), ("booster", "Entity"), ("58.5 bar", "Quantity")}
    labels = spark.createDataFrame([("A",), ("A",), ("B",), ("A <> B",), ("Match",)], "label string")
    assert [tuple(r) for r in G.label_dictionary(labels).collect()] == [("A", 2), ("B", 1)]
    mentions = spark.createDataFrame([("b", "Pump", "Entity"), ("b", "pump", "Part")], "book_id string, name string, label string")
    spec = spark.createDataFrame([("b", "Pump"), ("b", "Valve"), ("b", None)], "book_id string, subject string")
    assert {(r.name, r.type, r.n) for r in G.entity_nodes(mentions, spec).collect()} == {("pump", "Entity", 3), ("valve", "equipment", 1)}
