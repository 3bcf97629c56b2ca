import random

from docloom.llm.repeated_lines import line_report, repeated_lines, without_repeated_lines

SCHEMA = "book string, page int, text string, line_no string"


def brute(rows):
    pages = {(b, p): t for b, p, t, _ in rows if t is not None and b is not None}
    total, at = {}, {}
    for (b, p), t in pages.items():
        total[b] = total.get(b, 0) + 1
        for line in t.split("\n"):
            at.setdefault((b, "".join(c for c in line if c.isalpha()).lower()), set()).add(p)
    good = {k for k, ps in at.items() if len(k[1]) >= 3 and len(ps) >= 5 and len(ps) >= 0.15 * total[k[0]]}
    return {(b, p, n) for (b, p), t in pages.items() for n, line in enumerate(t.split("\n")) if (b, "".join(c for c in line if c.isalpha()).lower()) in good}


def test_against_brute_force(spark):
    rng = random.Random(2)
    furniture = ["Page {n} of the book", "ALL RIGHTS RESERVED", "!!", "ab", "Größe {n}"]
    rows = []
    for b in ("x", "y"):
        for p in range(30 if b == "x" else 4):
            lines = [rng.choice(furniture).format(n=p) if rng.random() < 0.5 else f"own line {rng.randint(0, 40)} {chr(97 + p % 26) * 3}" for _ in range(5)]
            rows.append((b, p, "\n".join(lines), "z"))
    rows += rows[:6] + [("x", 99, None, "z"), (None, 1, "ALL RIGHTS RESERVED", "z"), ("x", 100, "", "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {tuple(r) for r in repeated_lines(df, "book", "page", "text").collect()}
    assert found == brute(rows) and found
    clean = {(r.book, r.page): (r.clean_text, r.n_removed) for r in without_repeated_lines(df, "book", "page", "text").collect()}
    for (b, p, t, _) in rows:
        if t is not None and b is not None:
            kept = [line for n, line in enumerate(t.split("\n")) if (b, p, n) not in found]
            assert clean[(b, p)] == ("\n".join(kept), len(t.split("\n")) - len(kept))
    assert repeated_lines(df.limit(0), "book", "page", "text").count() == 0


def test_republished_articles_are_one_cluster(spark):
    rows = [("s", i, "the same article\nwith a line", f"2024-01-{i + 1:02d}", 1) for i in range(20)] + [("s", 20 + i, f"other {chr(97 + i)}\nshare this page", f"2024-02-0{i + 1}", 1) for i in range(6)]
    rows += [("s", 40 + i, f"another {chr(97 + i)}\nall on one day", "2024-03-01", 1) for i in range(6)] + [("s", 60, "null date\nshare this page", None, 1), rows[0], ("t", 1, None, "2024-01-01", 1), (None, 2, "share this page", "2024-01-01", 1)]
    df = spark.createDataFrame(rows, "source string, doc int, text string, day string, line int")
    found = {(r.line): (r.n, r.n_dates, r.total) for r in line_report(df, "source", "doc", "text", over="clusters", date="day").collect()}
    assert found == {"sharethispage": (7, 6, 14)}
    every = {r.line: r.n for r in line_report(df, "source", "doc", "text").collect()}
    assert every == {"sharethispage": 7, "allononeday": 6, "thesamearticle": 20, "withaline": 20}
    assert line_report(df.limit(0), "source", "doc", "text", over="clusters", date="day").count() == 0
