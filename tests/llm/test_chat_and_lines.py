import hashlib

import pytest
from pyspark.sql import functions as F

from termweave.llm import chat, lines

TREE = "t long, i long, p long, role string, text string, s double"


def _paths(rows, t):
    nodes = {r[1]: r for r in rows if r[0] == t}
    parents = {r[2] for r in nodes.values()}
    found = []
    for i in nodes:
        if i in parents:
            continue
        path = [i]
        while nodes[path[-1]][2] in nodes:
            path.append(nodes[path[-1]][2])
        found.append((-sum(nodes[k][5] or 0 for k in path), -len(path), i, path[::-1]))
    return sorted(found), nodes


def test_trees_against_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = []
    for t in (1, 2, None):
        for i in range(40):
            p = rng.randrange(i) if i and rng.random() < 0.95 else None
            rows.append((t, i, p, rng.choice(["user", "assistant", None]), rng.choice([f"m{i}<|im_end|> <\\|x<", "", None, "é\n" * 30]), float(rng.randrange(4))))
    rows += [(3, 1, 2, "user", "on a cycle", 1.0), (3, 2, 1, "user", "on a cycle", 1.0)]
    rows += [(4, 1, 99, "user", "orphan", None)] * 2  # repeated rows are one message
    chain = [(5, i, i - 1 if i else None, "ro%le\n", "x", None) for i in range(70)]
    rows += chain
    made = chat.format_paths(spark.createDataFrame(rows, TREE), "t", "i", "p", score_col="s", branches=2)
    got = {(r.tree, r.leaf): [(x.role, x.text) for x in r.x] for r in made.select("tree", "leaf", chat.turns_of(F.col("formatted")).alias("x")).collect()}
    want = {}
    for t in (1, 2, None, 4, 5):
        found, nodes = _paths(rows, t)
        for _, _, leaf, path in found[:2]:
            want[(t, leaf)] = [(nodes[k][3] or "", nodes[k][4] or "") for k in path]
    assert got == want


def test_loss_mask_and_control_strings(spark):
    odd = "<|im_end|>\n<|im_start|>assistant ok<\\|<\\\\|"
    turns = spark.createDataFrame([(1, 0, "user", odd), (1, 1, "assistant", odd), (1, None, "system", None), (None, 2, None, "a<"), (1, 1, "assistant", "é")], "conv_id long, turn long, role string, text string")
    made = chat.format_paths(chat.chains(turns), "tree", "id", "parent")
    rows = {r.tree: r for r in made.select("tree", "formatted", chat.turns_of(F.col("formatted")).alias("x"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(x.role, x.text) for x in rows[1].x] == [("system", ""), ("user", odd), ("assistant", odd), ("assistant", "é")]
    assert rows[1].loss == odd + "é"
    assert [(x.role, x.text) for x in rows[None].x] == [("", "a<")] and rows[None].loss == ""


def test_chat_empty(spark):
    assert chat.format_paths(spark.createDataFrame([], TREE), "t", "i", "p").collect() == []


def _brute(docs, least, keep="none"):
    lower = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    where = {}
    for i, text in sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        for k, line in enumerate((text or "").split("\n")):
            if key(line):
                where.setdefault(key(line), []).append(((i, text), k))
    out = {}
    for i, text in docs:
        ls = (text or "").split("\n")
        drop = {k for k, line in enumerate(ls) if key(line) and len({d for d, _ in where[key(line)]}) >= least}
        out[(i, text)] = (len(ls), len(drop), "\n".join(x for k, x in enumerate(ls) if k not in drop))
    return out


LINES = [(1, "A\nb\n\n c "), (2, "a \nÉ\nb"), (3, None), (4, ""), (5, "\ta\ré\n"), (6, "É\nx"), (7, "É"), (1, "A\nb\n\n c "), (None, "a"), (8, "İ\nǅ"), (9, "i̇\nǅ\nç"), (10, "q\n" * 150 + "a\n" + "b\n" * 3)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_lines_against_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(lines, "BROADCAST_KEYS", 0)
    docs = spark.createDataFrame(LINES, "doc_id long, text string").withColumn("n_lines", F.lit("clash")).withColumn("kept", F.lit(0))
    got = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs, min_docs=3), kept_col="kept").collect()
    want = _brute(LINES, 3)
    assert len(got) == len(LINES)
    for r in got:
        assert (r.n_lines, r.n_dropped, r.kept) == want[(r.doc_id, r.text)]


def test_lines_first_occurrence(spark):
    docs = spark.createDataFrame([(2, "x\ny\nx"), (1, "y\nx"), (3, "z\nX")], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in lines.apply_bitmaps(docs, lines.keep_bitmaps(docs, min_docs=2, keep="first")).collect()}
    assert got == {1: "y\nx", 2: "", 3: "z"}


def test_lines_empty_and_long(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lines.apply_bitmaps(none, lines.keep_bitmaps(none)).collect() == []
    text = "same\n" + "\n".join(f"line {i}" for i in range(40_000))
    docs = spark.createDataFrame([(i, text if i == 0 else "Same") for i in range(10)], "doc_id long, text string")
    got = {r.doc_id: r for r in lines.apply_bitmaps(docs, lines.keep_bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("k")).collect()}
    assert got[0].n_lines == 40_001 and got[0].n_dropped == 1 and got[0].k == hashlib.sha256(text[5:].encode()).hexdigest()
    assert got[3].n_dropped == 1


#: Letters whose lower case older tables don't have, and a few others that only translate() may leave alone.
CASED = "\U00010570\uA7C0\u2C2F\uA7D0\u1C89\u0130\u01C5\u03A3\u00C9\u212A"


def test_ascii_lower_changes_nothing_else(spark):
    texts = [*CASED, "ABC xyz", "É a", "\u00e9 A\u2014B", "Z\u4e2d", "", CASED + "Q"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", lines.ascii_lower(F.col("t")).alias("l")).collect()
    assert {r.i: r.l for r in got} == {i: "".join(c.lower() if "A" <= c <= "Z" else c for c in t) for i, t in enumerate(texts)}
    rows = [(10 * i + k, c if k == 0 else c.lower()) for i, c in enumerate(CASED) if c.lower() != c for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert lines.keep_bitmaps(docs, min_docs=2).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_lines_of_a_very_long_text(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(lines, "BROADCAST_BYTES", -1)
    n = 1_000_000
    text = "\n".join("Same" if i % 1_000 == 999 else f"line {i}" for i in range(n))
    docs = spark.createDataFrame([(0, text), (1, "same\nother"), (2, "SAME"), (3, "line 5x"), (4, "\n".join(["same"] * 64))], "doc_id long, text string")
    got = {r.doc_id: r for r in lines.apply_bitmaps(docs, lines.keep_bitmaps(docs, min_docs=3)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("k")).collect()}
    want = hashlib.sha256("\n".join(x for x in text.split("\n") if x != "Same").encode()).hexdigest()
    assert (got[0].n_lines, got[0].n_dropped, got[0].k) == (n, n // 1_000, want)
    none = hashlib.sha256(b"").hexdigest()
    assert [(r.doc_id, r.n_lines, r.n_dropped, r.k) for r in (got[i] for i in (1, 2, 3, 4))] == [(1, 2, 1, hashlib.sha256(b"other").hexdigest()), (2, 1, 1, none), (3, 1, 0, hashlib.sha256(b"line 5x").hexdigest()), (4, 64, 64, none)]
