"""Chat formatting, vector codes and conversation repair: against SQL, against brute force, and at the edges."""

import hashlib
import itertools
import json
import random

import numpy as np
import pytest

from framelake.llm import chat, vector_codes
from framelake.llm import conversation_repair as cr
from framelake.llm.queries import ORACLE_SQL, QUERIES

from ..check import connect, rows


@pytest.mark.parametrize("name", ["op11_chat_format", "op12_filtering_lloyd", "op13_earley_repair"])
def test_equals_sql(spark, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), connect(sf).sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 0
    assert rows(got) == rows(want)


# ---- chat ----

RECORDS = [
    ({"prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
    ({"prompt": "p", "completion": "r", "system": "s", "score": 3}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "x", "output": "o", "history": [["a", "b"], ["c", "d"]]}, [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"), ("user", "i\n\nx"), ("assistant", "o")]),
    ({"instruction": "i", "output": "o", "history": []}, [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "context": "c", "response": "o"}, [("user", "i\n\nc"), ("assistant", "o")]),
    ({"system_prompt": "s", "question": "q", "answer": "a"}, [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ({"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": None, "weight": 1}]}, [("user", "u"), ("assistant", "")]),
    ({"messages": []}, []),
    ({"messages": [{"role": "user", "content": [{"type": "x", "text": "a"}, {"text": "b"}]}, {"role": "assistant", "content": []}]}, [("user", "ab"), ("assistant", "")]),
    ({"id": 7, "conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}]}, [("user", "u"), ("assistant", "a")]),
    ({"prompt": "p", "chosen": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"chosen": [{"role": "user", "content": "u"}]}, [("user", "u")]),
    ({"role": "tool", "text": "t"}, [("tool", "t")]),
    ({"prompt": None, "response": 3}, [("user", ""), ("assistant", "3")]),
]


def test_layouts(spark):
    texts = [json.dumps(r) for r, _ in RECORDS] + ["{}", "no json", None, '{"prompt": "p"}', "[1]"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, layout string").withColumnRenamed("layout", "raw.text").repartition(3)
    got = {r["n"]: r for r in chat.canonical_turns(df, "raw.text").collect()}
    for n, (_, want) in enumerate(RECORDS):
        assert got[n]["layout"] is not None and [(t["role"], t["text"]) for t in got[n]["turns"]] == want, RECORDS[n]
    assert all(got[n]["layout"] is None and got[n]["turns"] == [] for n in range(len(RECORDS), len(texts)))
    # equal structures share a fingerprint, whatever their values
    assert chat.record_turns({"prompt": "x", "response": "y", "more": [1]})[0] == got[0]["layout_sha"]
    assert chat.canonical_turns(df.limit(0), "raw.text").count() == 0


def _digests(conversation):
    turns, loss = "".join(f"{r}\n{t}\n" for r, t in conversation), "".join(t for r, t in conversation if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(conversation), sha(turns), len(loss), sha(loss)


def test_formatted_text_is_read_back(spark):
    rng = random.Random(5)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "[SYS]", "[ROLE]", "[/TEXT]", "\\", "<\\s>", "[\\\\/INST]", "<", "[", " ", "\n", "é", "𝒳", "s>", "INST]", ""]
    made = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
    data = {c: [(rng.choice(["user", "assistant", "system", "tool", "text", "", made()]), made()) for _ in range(rng.randrange(1, 9))] for c in range(200)}
    df = spark.createDataFrame([(c, k, r, t) for c, x in data.items() for k, (r, t) in enumerate(x)], "conv_id long, turn long, role string, text string").repartition(5)
    for piece in (chat.PIECE, 30):
        pieces = chat.format_chat(df, piece=piece)
        got = {r["conv_id"]: r for r in chat.read_back(pieces).collect()}
        assert set(got) == set(data)
        for c, x in data.items():
            assert tuple(got[c])[1:5] == _digests(x)
        assert pieces.count() == len(data) or piece == 30
        assert sum(r["formatted_chars"] for r in got.values()) == sum(len(r["text"]) for r in pieces.collect())


def test_chat_edges(spark):
    data = [(None, None, None, None), (1, 2, "user", "b"), (1, None, "user", "a"), (1, 2, "assistant", "c"), (1, 2, "user", "b"), (2, 1, "assistant", "x" * 300_000)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS cell", "2 AS size", "3 AS at", "4 AS piece")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.format_chat(df)).collect()}
    assert got == {None: _digests([("", "")]), 1: _digests([("user", "a"), ("assistant", "c"), ("user", "b"), ("user", "b")]), 2: _digests([("assistant", "x" * 300_000)])}
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat.piece_turns("[INST] a [/INST]?")


# ---- vector codes ----


def _lloyd(ids, ints, parts, entries, rounds):
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, list(ints[i])))
    cut = ints.reshape(len(ints), parts, -1)
    books = cut[order[:entries]].transpose(1, 0, 2).copy()
    near = lambda: ((cut[:, :, None, :] - books[None]) ** 2).sum(-1)
    for _ in range(rounds):
        found = near().argmin(-1)
        for p, e in itertools.product(range(parts), range(books.shape[1])):
            mine = cut[found[:, p] == e, p]
            if len(mine):
                books[p, e] = mine.sum(0) // len(mine)
    far = near()
    found = far.argmin(-1)
    return ["".join(f"{e:02x}" for e in row) for row in found], far.min(-1).sum(-1), books


@pytest.mark.parametrize("n,entries,tree", [(700, 64, 100), (700, 64, 8192), (40, 64, 8192), (1, 3, 10), (300, 1, 64)])
def test_codes_equal_brute_force(spark, monkeypatch, n, entries, tree):
    monkeypatch.setattr(vector_codes, "TREE_ROWS", tree)
    rng = np.random.default_rng(n + entries)
    x = (rng.integers(-6, 7, size=(n, 12)) / 64).astype(np.float32)  # coarse, so that ties are many
    x[n // 2 :: 3] = x[0]
    ids = [int(i) for i in rng.integers(0, n, size=n)]
    bad = [(5, None, 1), (6, [], 1), (7, [float("nan")] * 12, 1), (8, [None, *[0.0] * 11], 2), (9, [float("inf"), *[0.0] * 11], None)]
    data = [(i, v.tolist(), int(i) % 4 if i % 7 else None) for i, v in zip(ids, x)] + bad
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS code", "2 AS ints").repartition(3)
    coded, books = vector_codes.product_codes(df, keep=("label",), parts=4, entries=entries)
    got = sorted((r["vec_id"], r["code"], r["error"]) for r in coded.collect())
    ints = np.floor(x.astype(np.float64) * 256).astype(np.int64)
    code, error, want = _lloyd(ids, ints, 4, entries, 2)
    assert np.array_equal(books, want)
    assert got == sorted(zip(ids, code, error.tolist()))
    total = {}
    for (i, _, label), e in zip(data, error.tolist()):
        total[label] = total.get(label, 0) + e
    assert all(r["label_error"] == total[r["label"]] for r in vector_codes.with_label_error(coded).collect())


def test_boxes_spare_distances():
    rng = np.random.default_rng(1)
    parts = (rng.normal(size=(3, 4000, 4)) * 20 + rng.integers(-400, 400, size=(40, 4))[rng.integers(0, 40, 4000)]).astype(np.int32)
    tree, books = vector_codes.Tree.build(parts), parts[:, :64].astype(np.int64)
    found, count, total, measured = tree.assign(books)
    far = ((tree.points[:, :, None, :].astype(np.int64) - books[:, None]) ** 2).sum(-1)
    assert np.array_equal(found, far.argmin(-1)) and count.sum() == 12_000
    assert np.array_equal(total.sum(1), parts.sum(1, dtype=np.int64))
    assert measured < 0.15 * far.size


def test_vector_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    coded, books = vector_codes.product_codes(spark.createDataFrame([], schema), keep=("label",))
    assert coded.count() == 0 and books.shape[1] == 0 and vector_codes.with_label_error(coded).count() == 0
    for bad in ([(1, [0.0] * 16, 1), (2, [0.0] * 32, 1)], [(1, [0.0] * 15, 1)], [(1, [1e9] * 16, 1)]):
        with pytest.raises(Exception, match="one length|beyond"):
            vector_codes.product_codes(spark.createDataFrame(bad, schema))[0].collect()


# ---- conversation repair ----


def _least(rows):
    """All sequences of edits with at most three inserts in a row, by recursion."""
    best = [None]

    def go(k, out, cost, audit, idle):
        if best[0] and cost > best[0][0]:
            return
        if k == len(rows):
            body = out[1:] if out[:1] == "s" else out
            if (body and body == "ua" * (len(body) // 2)) or not out:
                best[0] = min(best[0] or (cost, audit), (cost, audit))
        else:
            initial, fault = rows[k]
            extra = 3 * (fault == "truncated")
            go(k + 1, out, cost + 4, audit + "D", 0)
            if fault not in ("blank", "duplicate"):
                go(k + 1, out + initial, cost + extra, audit + "K", 0)
                for r in "ua":
                    go(k + 1, out + r, cost + extra + 3, audit + "R", 0)
        if idle < 3 and len(out) <= len(rows) + 2:
            for r in "ua":
                go(k, out + r, cost + 3, audit + "I", idle + 1)

    go(0, "", 0, "", 0)
    return best[0]


def _parsed(rows):
    chart, audit = cr.Chart(), ""
    for initial, fault in rows:
        audit += chart.row(initial, fault in ("blank", "duplicate"), fault == "truncated")
    cost, rest = chart.end()
    return cost, audit + rest


def test_parse_equals_all_edits(monkeypatch):
    rng = random.Random(3)
    for settle in (cr.SETTLE, 1):
        monkeypatch.setattr(cr, "SETTLE", settle)
        for n in range(5):
            for _ in range(60):
                sample = [(rng.choice("suatx"), rng.choice([None, None, None, "blank", "truncated", "duplicate"])) for _ in range(n)]
                assert _parsed(sample) == _least(sample), sample


def _states(rows):
    """Least (cost, audit) of an automaton's four states: nothing yet, after s, after u, after a."""
    far = (10**9, "")
    z = {"n": (0, ""), "s": far, "u": far, "a": far}

    def inserts(z):
        for _ in range(3):
            for source, to in (("n", "u"), ("s", "u"), ("a", "u"), ("u", "a")):
                z[to] = min(z[to], (z[source][0] + 3, z[source][1] + "I"))
        return z

    z = inserts(z)
    for initial, fault in rows:
        new = {k: (c + 4, a + "D") for k, (c, a) in z.items()}
        if fault not in ("blank", "duplicate"):
            extra = 3 * (fault == "truncated")
            for source, to in (("n", "s"), ("n", "u"), ("s", "u"), ("a", "u"), ("u", "a")):
                c, a = z[source]
                if initial == to:
                    new[to] = min(new[to], (c + extra, a + "K"))
                if to != "s":
                    new[to] = min(new[to], (c + extra + 3, a + "R"))
        z = inserts(new)
    return min(z["n"], z["a"])


def test_long_conversations_in_linear_memory():
    rng = random.Random(9)
    for letters, n in (("ua", 4000), ("suat", 3000), ("s", 1500), ("t", 1200), ("uuuuua", 3000)):
        sample = [(rng.choice(letters), rng.choice([None, None, "blank", "truncated"])) for _ in range(n)]
        assert _parsed(sample) == _states(sample)
    chart = cr.Chart()
    for k in range(20_000):
        chart.row("ua"[k % 2], False, False)
    assert max(len(a) for _, a in chart.column.values()) <= cr.SETTLE + 2


def test_repaired_turns(spark):
    data = [
        (1, None, "system", "Be."), (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, None, "Yes."), (1, 4, "user", " \t"), (1, 5, "user", "Go!"),
        (2, 1, "assistant", "cut"), (None, 3, "user", None), (None, 4, "assistant", "Ok?\n"),
    ]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS fault", "2 AS nth", "3 AS edit").repartition(4)
    edits = {}
    for r in sorted(cr.repair_turns(df).collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.seq)):
        edits.setdefault(r.conv_id, []).append((r.edit, r.role, r.text, r.fault))
    assert edits[1] == [
        ("K", "system", "Be.", None), ("K", "user", "Hi.", None), ("D", "user", "Hi.", "duplicate"), ("R", "assistant", "Yes.", None), ("D", "user", " \t", "blank"), ("K", "user", "Go!", None), ("I", "assistant", "", None),
    ]
    assert edits[2] == [("D", "assistant", "cut", "truncated")]
    assert edits[None] == [("D", "user", " ", "blank"), ("I", "user", "", None), ("K", "assistant", "Ok?\n", None)]
    report = {r.conv_id: r for r in cr.repair_report(df).collect()}
    assert {k: "".join(e[0] for e in v) for k, v in edits.items()} == {k: r.audit for k, r in report.items()}
    one = report[1]
    assert (one.gaps, one.blank, one.duplicate, one.truncated, one.illegal, one.cost) == (2, 1, 1, 0, 4, 4 + 3 + 4 + 3)
    want = "\n".join(f"{r}:{t}" for e, r, t, _ in edits[1] if e != "D")
    assert one.repaired_sha256 == hashlib.sha256(want.encode()).hexdigest()
    gone = cr.repair_report(df.selectExpr("*", "false AS present")).collect()
    assert len(gone) == 3 and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for r in gone)
    assert cr.repair_report(df.limit(0)).count() == 0 and cr.repair_turns(df.limit(0)).count() == 0
