import random
import re

from docloom.llm.leaks import align, leaks


def test_align():
    a = "a b c d e f g".split()
    assert align(a, a) == (14.0, 7) and align(a, []) == (0.0, 0) and align([], a) == (0.0, 0)
    score, run = align("x a b c z d e f g y".split(), a)
    assert (score, run) == (13.0, 4)
    rng = random.Random(1)
    for _ in range(30):
        d, i = [rng.choice("abcd") for _ in range(25)], [rng.choice("abcd") for _ in range(12)]
        table = [[0.0] * (len(d) + 1) for _ in range(len(i) + 1)]
        for r in range(1, len(i) + 1):
            for c in range(1, len(d) + 1):
                table[r][c] = max(0, table[r - 1][c - 1] + (2 if i[r - 1] == d[c - 1] else -1), table[r - 1][c] - 1, table[r][c - 1] - 1)
        assert align(d, i)[0] == max(map(max, table))


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["the", "of", "and"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(4, 40)))) for i in range(12)] + [(50, None), (51, ""), (52, "Das ist ein Satz, mit Größe und noch mehr Wörtern als zwölf im Ganzen.")]
    docs = []
    for d in range(80):
        text = " ".join(rng.choice(words) for _ in range(40))
        if d % 3 == 0:
            own = rng.choice(items[:12])[1].split()
            start, size = rng.randint(0, max(0, len(own) - 11)), rng.randint(10, 16)
            text += ". " + ", ".join(own[start : start + size]).upper() + ". " + rng.choice(words)
        docs.append((d, text, "extra"))
    docs += [(200, None, "e"), (201, "", "e"), (202, "das ist ein satz mit GRÖSSE und noch mehr", "e"), (203, "x DAS IST EIN SATZ MIT GRÖßE UND NOCH MEHR WÖRTERN ALS ZWÖLF im y", "e"), docs[0]]
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    runs = lambda t: {tuple(w[i : i + 12]) for w in [cut(t)] for i in range(len(w) - 11)}
    want = {(d, i) for d, t, _ in docs for i, s in items if runs(t) & runs(s)}
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = leaks(df, it, "doc_id", "item_id", "text").collect()
    assert {(r.doc_id, r.item_id) for r in got if r.longest_run >= 12} == want and want and (203, 52) in want
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    assert leaks(df.limit(0), it, "doc_id", "item_id", "text").count() == 0
    assert leaks(df, it.limit(0), "doc_id", "item_id", "text").count() == 0


def test_edited_copies_are_aligned_however_common(spark):
    item = " ".join(f"w{i}" for i in range(24))
    edited = [w if i % 6 != 5 else "x" for i, w in enumerate(item.split())]  # four runs of five words, none of twelve
    docs = [(d, item) for d in range(30)] + [(100 + d, " ".join(edited)) for d in range(30)] + [(200, "w0 w1 w2 w3 x")]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.score, r.longest_run) for r in leaks(df, it, "doc_id", "item_id", "text").collect()}
    assert set(got) == {d for d, _ in docs if d < 200}
    assert got[100] == align(edited, item.split()) and got[100][1] == 5
    assert {r.doc_id for r in leaks(df, it, "doc_id", "item_id", "text", run=12).collect() if r.longest_run >= 12} == set(range(30))


def test_recall_of_edited_copies(spark):
    """Copies with a share of their words replaced at random: those that keep a run of five words are found, whatever their number."""
    rng = random.Random(3)
    words = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(20)]
    docs, want = [], set()
    for d in range(600):
        i, text = items[d % 20]
        rate = (0.05, 0.1, 0.15, 0.2)[d % 4]
        edited = ["x" + w if rng.random() < rate else w for w in text.split()]
        docs.append((d, " ".join(rng.choice(words) for _ in range(30)) + " " + " ".join(edited)))
        want.add((d, i))
    docs += [(1000 + k, " ".join(w if p % 8 else "y" for p, w in enumerate(items[0][1].split()))) for k in range(40)]  # every eighth word
    want |= {(1000 + k, 0) for k in range(40)}
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in leaks(df, it, "doc_id", "item_id", "text").collect()}
    found = {p for p in want if got.get(p, 0) >= 0.4}
    assert len(found) / len(want) >= 0.99


def test_align_many_equals_align():
    import numpy as np

    from docloom.llm.leaks import align_many, gram_hashes

    rng = random.Random(9)
    lists = [([rng.choice("abcdef") for _ in range(rng.randint(0, 90))], [rng.choice("abcdef") for _ in range(rng.randint(0, 30))]) for _ in range(60)]
    code = lambda ws: np.array([ord(w) for w in ws], dtype=np.int32)
    score, longest = align_many([(code(d), code(i)) for d, i in lists])
    assert [(float(s), int(r)) for s, r in zip(score, longest)] == [align(d, i) for d, i in lists]
    a, b, c = gram_hashes(["one two three four five six", "x one two three four five", None], 5)
    assert len(a) == 2 and len(b) == 2 and len(c) == 0 and a[0] == b[1] and a[1] not in b
