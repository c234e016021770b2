"""The registered queries, with all their columns, against brute force on the smallest tables; columns with clashing names; the risk of the classifier."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from framelake.llm import bpe, decontamination, exact_dedup, language_id, near_dedup, pii, sharding, toxicity
from framelake.llm.queries import QUERIES

from .test_operators import _links


@pytest.fixture(scope="module")
def texts(sf):
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(zip(t["doc_id"], t["text"]))


def collected(spark, sf, name, columns):
    df = QUERIES[name](spark, sf)
    assert {c for c, _ in columns} <= set(df.columns) and all(dict(df.dtypes)[c] == k for c, k in columns)
    rows = df.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: r for r in rows}


def test_op1(spark, sf, texts):
    got = collected(spark, sf, "op1_shard_matrix", [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")])
    assert set(got) == set(texts)
    for i, r in got.items():
        raw = (texts[i] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    counts = Counter(r.shard for r in got.values())
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in got.values() if r.shard == s) == list(range(n)) for s, n in counts.items())


def test_op1_is_uniform(spark):
    """Over many seeds every row comes to every shard, and to either half of its slots, equally often."""
    df = spark.range(12).repartition(3).selectExpr("id AS doc_id", "concat('t', id) AS text").cache()
    seen = Counter((r.doc_id, r.shard, r.slot) for seed in range(20) for r in sharding.shuffle_into_shards(df, 3, seed, stable_layout=True).collect())
    table = np.array([[seen[d, s, k] + seen[d, s, k + 1] for s in range(3) for k in (0, 2)] for d in range(12)])
    mean = 240 / 72
    assert table.sum() == 240 and ((table - mean) ** 2 / mean).sum() < 55 + 4 * np.sqrt(2 * 55)


def test_op3(spark, sf, texts):
    got = collected(spark, sf, "op3_simhash", [("contaminated", "boolean")])
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    shingles = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)]
    items = [(i, words(t)) for i, t in zip(*pq.read_table(f"{sf}/benchmark.parquet", columns=["item_id", "text"]).to_pydict().values())]
    items = [(i, w, Counter(shingles(w))) for i, w in items if w]
    for d, t in texts.items():
        w, want = words(t), set()
        have = set(shingles(w)) | {tuple(w[k : k + n]) for n in {len(x) for _, x, _ in items if len(x) < 5} for k in range(len(w))}
        for i, x, c in items:
            if len(have & set(c)) * 2 < len(c):  # fewer can't reach 0.75
                continue
            n = min(len(x), len(w))
            for s in range(len(w) - n + 1):
                both = sum((c & (other := Counter(shingles(w[s : s + n])))).values())
                if both / (c.total() + other.total() - both) >= 0.75:
                    want.add(i)
                    break
        assert set(got[d].item_ids) == want and got[d].contaminated == bool(want), d


def test_op4(spark, sf, texts):
    got = collected(spark, sf, "op4_crf", [("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")])
    assert set(got) == set(texts) and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", texts[i] or "")) for i, r in got.items())


def test_long_chains_are_exact():
    """Marginals of texts of many stretches equal those of one chain over all words."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    model = language_id.Model(["a", "b", "c", "d"], (rng.normal(size=(1 << language_id.BITS, 4)) * 0.3).astype(np.float32), rng.normal(size=(4, 4)))
    docs = pa.array([" ".join(f"w{chr(97 + rng.integers(26))}{chr(97 + rng.integers(26))}" for _ in range(n)) for n in (1, 127, 128, 129, 256, 257, 3000, 0, 5)] + [None])
    row, got = model.words(docs)
    data, start, end, _ = language_id._spans(docs)
    emit = model.emissions(data, start, end)
    for i in set(row.tolist()):
        x = np.flatnonzero(row == i)
        want, _, _ = language_id.forward_backward(emit[x][None].astype(float), np.ones((1, len(x)), dtype=bool), model.trans)
        assert np.allclose(got[x], want[0], atol=1e-5)


def test_op5(spark, sf, texts):
    from tokenizers import Tokenizer

    got = collected(spark, sf, "op5_simple8b", [("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")])
    tok, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for i in sorted(texts):
        ids = tok.encode(texts[i] or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)


def test_op6(spark, sf, texts):
    got = collected(spark, sf, "op6_minhash", [("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")])
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == _links(texts.items()) and all(r.kept == (i == r.component_id) for i, r in got.items())


def test_op7(spark, sf, texts):
    got = collected(spark, sf, "op7_surrogates", [("n_entities", "bigint")])
    for i, r in got.items():
        old = pii.mentions(texts[i] or "")
        assert r.n_entities == len(old) and r.types == sorted({x[2] for x in old})
        assert r.text_sha256 == (None if texts[i] is None else hashlib.sha256(r.text.encode()).hexdigest()) and (old or r.text == texts[i])
        assert not {x[3] for x in old if x[2] != "name"} & {x[3] for x in pii.detect(r.text or "")}


def test_op8(spark, sf, texts):
    """Columns on the smallest tables; accuracy of held-out documents on larger ones, as 200 documents hold few toxic ones to learn from."""
    got = collected(spark, sf, "op8_nnpu", [("held_out", "boolean"), ("score", "double"), ("predicted", "int")])
    assert set(got) == set(texts) and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    more = sf.replace("sf0.001", "sf0.01")
    got = {r.doc_id: r for r in QUERIES["op8_nnpu"](spark, more).collect()}
    labels = pq.read_table(f"{more}/labels.parquet", columns=["doc_id", "toxic"]).to_pydict()
    right = [got[i].predicted == t for i, t in zip(labels["doc_id"], labels["toxic"]) if i in got and t is not None and got[i].held_out]
    print(len(right), np.mean(right))
    assert np.mean(right) > 0.9


def test_op9(spark, sf, texts):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = collected(spark, sf, "op9_duckdb_bpe", [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for i, t in texts.items():
        ids = enc.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode()))


CLASH = "_gone_id _gone_sha _gone_key _first _ends _n _key _moved _sha _own_id _own_key _nth _offset _row _parts _pos _name _norm _k1 _k2 _mid _part _rank _block _text_key kept n row best identity n_blocks slot_ a b".split()


def test_clashing_names(spark, sf, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in ((1, "Mr. Bo Ya at a@b.co"), (1, "Mr. Bo Ya at a@b.co"), (2, "x y"), (3, None), (3, None), (4, "x  y"))], "doc_id long, text string").selectExpr("*", *(f"'{c}' AS {c}" for c in CLASH))
    same = lambda out: all(r[c] == c for r in out.collect() for c in CLASH)
    for out, n in ((exact_dedup.drop_exact_duplicates(df), 3), (near_dedup.drop_near_duplicates(df), 4), (sharding.shuffle_into_shards(df, 2), 6)):
        assert out.count() == n and same(out)
    model = toxicity.train(df, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    for out in (decontamination.find_items(df, bench), toxicity.score(df, model), language_id.identify(df, None), bpe.encode_decode(df), pii.replace_entities(df, b"k")):
        assert out.count() == 6 and same(out)
    monkeypatch.setattr(pii, "BROADCAST_BYTES", -1)
    plain = sorted(str(r.text) for r in pii.replace_entities(df, b"k").collect())
    monkeypatch.undo()
    assert plain == sorted(str(r.text) for r in pii.replace_entities(df, b"k").collect())


def test_passes_of_decontamination(spark, sf, monkeypatch):
    """A benchmark in many passes, and texts in many stretches, give what one pass gives."""
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet")
    found = lambda: {r.doc_id: sorted((m.item_id, m.first_word) for m in r.matches) for r in decontamination.find_items(docs, bench).collect()}
    want = found()
    assert any(want.values())
    monkeypatch.setattr(decontamination, "PASS_BYTES", 1 << 13)
    assert found() == want
    import pyarrow as pa

    items = [(r.item_id, r.text) for r in bench.collect() if r.text]
    rows = pa.array([r.text for r in docs.collect()])
    one = decontamination.Index.of(items).search(rows)
    monkeypatch.setattr(decontamination, "STRETCH", 100)
    assert decontamination.Index.of(items).search(rows) == one


def test_risk_of_the_classifier():
    """No step from the fitted weights lowers the non-negative risk, worked out from its definition, by more than a hundredth of what fitting has taken off it. The minimum lies at the kink where the estimate of the negatives' risk is zero, so the last steps of a fit go to and fro."""
    rng, prior, decay = np.random.default_rng(2), 0.2, 2e-3
    positive = [np.unique(np.append(rng.integers(0, 5, 3), rng.integers(5, 900, 12))).astype(np.int32) for _ in range(150)]
    clean = [np.unique(np.append(rng.integers(3, 5, 1), rng.integers(5, 900, 12))).astype(np.int32) for _ in range(500)]
    unlabelled = clean + [np.unique(np.append(rng.integers(0, 5, 3), rng.integers(5, 900, 12))).astype(np.int32) for _ in range(120)]
    m = toxicity.fit(positive, unlabelled, prior, steps=4000, rate=0.02, decay=decay)
    place = {f: k for k, f in enumerate(m.index.tolist())}
    assert len(place) >= 3
    matrix = lambda rows: np.array([[f in set(r.tolist()) for f in place] for r in rows], dtype=float)
    xp, xu = matrix(positive), matrix(unlabelled)

    def risk(w, b):
        fp, fu = xp @ w + b, xu @ w + b
        return m.prior * np.logaddexp(0, -fp).mean() + max(0.0, np.logaddexp(0, fu).mean() - m.prior * np.logaddexp(0, fp).mean()) + decay / 2 * (w * w).sum()

    best = risk(m.weights.astype(float), m.bias)
    gain = risk(np.zeros(len(place)), np.log(m.prior / (1 - m.prior))) - best
    assert gain > 0.1
    for _ in range(1000):
        step = rng.normal(size=len(place) + 1) * rng.choice([0.01, 0.05, 0.3])
        assert risk(m.weights + step[:-1], m.bias + step[-1]) > best - gain / 100
