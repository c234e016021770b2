"""Each operator against brute force, round trips or held-out accuracy, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm import bpe, decontamination, exact_dedup, language_id, license_scan, near_dedup, pii, sharding, token_files, toxicity
from framelake.llm.queries import ORACLE_SQL, QUERIES

from ..check import connect, rows

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("ids", T.StringType()), T.StructField("matches", T.StringType())])
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (4, "a b c"), (5, "A b C"), (None, "a b c"), (6, LONG), (7, LONG + " end"), (8, LONG), (9, None), (10, "don't é x\n\n  y"), (11, "!!! 123 --")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", "i", "m") for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), connect(sf).sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_matrix_has_its_margins():
    counts = [5, 0, 17, 3, 1]
    m = sharding.communication_matrix(counts, [9, 9, 8], 3)
    assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == [9, 9, 8] and (m >= 0).all()
    rng = np.random.default_rng(1)
    x = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(20_000)]
    assert abs(np.mean(x) - 6) < 0.05 and abs(np.var(x) - 20 * 0.3 * 0.7 * 80 / 99) < 0.12
    assert abs(sharding.hypergeometric(rng, 10**12, 3 * 10**12, 10**9) - 25 * 10**7) < 10**6


def test_sharding(spark, odd, none):
    out = sharding.shuffle_into_shards(odd, 4, block_rows=2).collect()
    assert len(out) == len(ODD) and sorted((r.doc_id or 0, r.text or "") for r in out) == sorted((i or 0, t or "") for i, t in ODD)
    by = {s: sorted(r.slot for r in out if r.shard == s) for s in range(4)}
    assert all(v == list(range(len(v))) for v in by.values()) and {len(v) for v in by.values()} <= {3, 4}
    assert sharding.shuffle_into_shards(none, 4).count() == 0


def test_exact_dedup(odd, none):
    out = exact_dedup.exact_duplicates(odd, block=1000).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in ODD:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i))
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in out) == sorted((str(i), str(min(groups[norm(t)])[2]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in ODD)
    assert sum(r.kept for r in out) == len(groups)
    assert exact_dedup.drop_exact_duplicates(odd).count() == len(groups)
    assert exact_dedup.exact_duplicates(none).count() == 0


def _links(docs):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_dedup(spark, odd, none, monkeypatch):
    rng = random.Random(5)
    docs = []
    for g in range(12):  # chains of edits, with similarities all over the range
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(3, 90))]
        for k in range(12):
            docs.append((len(docs), " ".join(words)))
            words = [w if rng.random() > 0.02 * (k % 4) else f"e{rng.randrange(10**6)}" for w in words]
    docs += [(1000, None), (1001, ""), (1002, "A  B"), (1003, "a b")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = _links(docs)
    for block in (256, 5):  # the second size sends clusters through links along stars and pairs of blocks
        monkeypatch.setattr(near_dedup, "BLOCK_DOCS", block)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
        assert got == want
    assert near_dedup.drop_near_duplicates(df).count() == len({c for _, c in want.values()})
    assert near_dedup.near_duplicates(none).count() == 0
    out = near_dedup.near_duplicates(odd).collect()
    assert len(out) == len(ODD) and {r.component_id for r in out if r.doc_id in (4, 5)} == {4}


def test_decontamination(spark, odd, none):
    rng = random.Random(2)
    words = lambda n: [f"Tok{rng.randrange(10**6)}" for _ in range(n)]
    items = [(1, words(40)), (2, words(15)), (3, words(3)), (4, []), (5, words(300))]
    bench = spark.createDataFrame([(i, " ".join(w) if w else None) for i, w in items], "item_id long, text string")
    near = list(items[0][1])
    near[20] = "changed"
    docs = [(1, words(50) + items[0][1] + words(9)), (2, near), (3, [w.upper() + "," for w in items[1][1]]), (4, words(5) + items[2][1]), (5, words(400)), (6, items[0][1][:20] + words(30)), (7, items[4][1])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    got = {r.doc_id: {m.item_id for m in r.matches} for r in decontamination.find_items(df, bench).collect()}
    assert got == {1: {1}, 2: {1}, 3: {2}, 4: {3}, 5: set(), 6: set(), 7: {5}}
    assert all(r.matches == [] for r in decontamination.find_items(odd, bench).collect())
    assert decontamination.find_items(none, bench).count() == 0 and decontamination.find_items(odd, bench.limit(0)).count() == len(ODD)


def test_decontamination_near_the_threshold(sf):
    """Items with an end cut off, with a similarity of 0.75 to 0.85, within other documents: all are found, by brute force over the windows."""
    import pyarrow.parquet as pq

    rng, word = random.Random(1), re.compile(r"[^\W_]+")
    items = [(i, t) for i, t in zip(*pq.read_table(f"{sf}/benchmark.parquet", columns=["item_id", "text"]).to_pydict().values()) if t]
    docs = [word.findall(t.lower()) for t in pq.read_table(f"{sf}/documents.parquet", columns=["text"])["text"].to_pylist() if t and 300 < len(t) < 3000]
    shingles = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    texts, want = [], []
    for i, t in items:
        w = word.findall(t.lower())
        n, mine = len(w), shingles(w)
        for _ in range(60 if n >= 16 else 0):
            cut = round(n * rng.uniform(0.08, 0.13))
            left, right, edited = rng.choice(docs)[-n:], rng.choice(docs)[:n], w[cut:] if rng.random() < 0.5 else w[: n - cut]
            doc, best = left + edited + right, 0.0
            for s in range(max(0, len(left) - n // 4), len(left) + n // 4):
                both = sum((mine & (other := shingles(doc[s : s + n]))).values())
                best = max(best, both / (sum(mine.values()) + sum(other.values()) - both))
            if 0.75 <= best <= 0.85:
                texts.append(" ".join(doc))
                want.append(i)
    found = decontamination.Index.of(items).search(pa.array(texts))
    assert len(want) > 300 and [i for f, i in zip(found, want) if i not in {x[0] for x in f}] == []


def test_language(spark, sf, odd, none):
    q = QUERIES["op4_crf"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in q]) > 0.95
    model = language_id.train(spark.read.parquet(f"{sf}/documents.parquet"))
    out = language_id.identify(odd, model, words=True).collect()
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) and 0 <= r.lang_score <= 1 for r in out)
    assert language_id.identify(none, model).count() == 0 and language_id.train(none) is None
    assert {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}
    switched = spark.createDataFrame([("the with that and of the that with " * 3 + "der und von auf die der und von " * 3,)], "text string")
    tags = language_id.identify(switched, model, words=True).first().lang_words
    assert tags[4] == "en" and tags[-4] == "de"


def test_forward_backward():
    rng = np.random.default_rng(4)
    e, t = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    marginal, _, log_z = language_id.forward_backward(e, np.ones((1, 4), dtype=bool), t)
    paths = np.array(np.meshgrid(*[range(3)] * 4)).reshape(4, -1).T
    w = np.exp([sum(e[0, i, p[i]] for i in range(4)) + sum(t[p[i], p[i + 1]] for i in range(3)) for p in paths])
    assert np.isclose(log_z[0], np.log(w.sum()))
    assert np.allclose(marginal[0], [[w[paths[:, i] == k].sum() / w.sum() for k in range(3)] for i in range(4)])


def test_simple8b():
    rng = np.random.default_rng(1)
    for a in (np.zeros(0), np.zeros(5000), rng.integers(0, 49408, 10001), rng.integers(0, 3, 5000), [1, 2**64 - 1, 2**64 - 1, 2**60 - 1, 2**60, 0]):
        a = np.array(a, dtype=np.uint64)
        p = token_files.pack(a)
        assert (token_files.unpack(p) == a).all()
        assert all((token_files.unpack(p, k) == a[k * token_files.BLOCK_IDS : (k + 1) * token_files.BLOCK_IDS]).all() for k in range(-(-len(a) // token_files.BLOCK_IDS)))


def test_token_files(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    strange = ["Don't it's 'The x.'s", "A1b22 x--y .'' é.É Straße", "日本 テ　x <|endoftext|> y", None, "é ab İI ΑΣ", " \n", "x" * 5000]
    ids, n = token_files.word_ids(pa.array(strange), path)
    assert [i.tolist() for i in np.split(ids, np.cumsum(n)[:-1])] == [tok.encode(t or "", add_special_tokens=False).ids for t in strange]
    out = token_files.read_token_files(token_files.write_token_files(odd, files=3)).orderBy("start").collect()
    assert len(out) == len(ODD) and [r.start for r in out] == [sum(x.n_tokens for x in out[:k]) for k in range(len(out))]
    crc = lambda t: zlib.crc32(np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4").tobytes())
    assert sorted((str(r.doc_id), zlib.crc32(bytes(r.ids))) for r in out) == sorted((str(i), crc(t)) for i, t in ODD)
    assert token_files.read_token_files(token_files.write_token_files(none)).count() == 0


def test_bpe(odd, none):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    strange = ["", "  a b  c ", "it's 'the don'T\n\n  q\t\t1234 5  ", " é ÉÉ\x1c\x1d x\x85 y", "日本語 テ　 x 　y", "a" * 300, None, "a   b c    d", "<|endoftext|>"]
    ids, n, back = bpe.tokenize(pa.array(strange), bpe.Codec(path))
    assert [i.tolist() for i in np.split(ids, np.cumsum(n)[:-1])] == [enc.encode_ordinary(t or "") for t in strange]
    assert back == [(t or "").encode() for t in strange]
    rng = random.Random(8)
    letters = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    # long matches: random ones, ones of word parts, runs of one sign, few letters with many overlapping pairs
    long = [letters(100_000, "abcdefghijklmnopqrstuvwxyz"), letters(30_000, ["ing", "tion", "the", "and", "er", "a"]), "a" * 50_000, " " * 20_000 + "x", letters(3_000, "abAB"), "=-" * 2_000, "日本語の文章" * 300, "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(2_000))]
    ids, n, back = bpe.tokenize(pa.array(long), bpe.Codec(path))
    assert [i.tolist() for i in np.split(ids, np.cumsum(n)[:-1])] == [enc.encode_ordinary(t) for t in long] and back == [t.encode() for t in long]
    out = bpe.encode_decode(odd).collect()
    assert all(r.ids == enc.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() for r in out) and len(out) == len(ODD)
    assert bpe.encode_decode(none).count() == 0


def test_bpe_of_other_ranks(tmp_path):
    """Ranks beyond 65,536, and merges that give pairs of lower rank than their own; few parts kept."""
    import base64

    import public_tokenizers
    import tiktoken

    rng = random.Random(4)
    for trial in range(6):
        tokens = [bytes([i]) for i in range(256)]
        grown = set(tokens)
        while len(grown) < 400:
            grown.add(rng.choice(short := sorted(t for t in grown if set(t) <= set(b"abc") and len(t) < 30)) + rng.choice(short))
        more = sorted(t for t in grown if len(t) > 1)
        rng.shuffle(more)
        ranks = {t: i for i, t in enumerate(tokens)} | {t: 256 + i * (1 if trial % 2 else 700) for i, t in enumerate(more)}
        path = tmp_path / f"{trial}.tiktoken"
        path.write_text("".join(f"{base64.b64encode(t).decode()} {r}\n" for t, r in ranks.items()))
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)
        codec = bpe.Codec(str(path))
        texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 400))) for _ in range(60)]
        for _ in range(2):
            ids, n, _ = bpe.tokenize(pa.array(texts), codec)
            assert [i.tolist() for i in np.split(ids, np.cumsum(n)[:-1])] == [enc.encode_ordinary(t) for t in texts]


def test_bpe_keeps_few_parts(monkeypatch):
    import public_tokenizers
    import tiktoken

    monkeypatch.setattr(bpe, "KEPT_PARTS", 50)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    codec, rng = bpe.Codec(path), random.Random(5)
    for _ in range(12):
        texts = [" ".join(rng.choice(["the", "x1", "don't", f"w{rng.randrange(99)}"]) for _ in range(40)) for _ in range(5)]
        ids, n, _ = bpe.tokenize(pa.array(texts), codec)
        assert [i.tolist() for i in np.split(ids, np.cumsum(n)[:-1])] == [enc.encode_ordinary(t) for t in texts] and len(codec.key) <= 50


def test_surrogates(spark, odd, none):
    key = b"k"
    assert sorted(pii.permute(x, 1000, key, b"t") for x in range(1000)) == list(range(1000))
    t = 'Mr. John Smith and Frau Müller: a@b.co 1.2.3.4 +1 (017) 555-7713 4111-1111-1111-1111 token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    df = spark.createDataFrame([(1, t), (2, "again A@B.co and 1.2.3.4")], "doc_id long, text string")
    a, b = pii.replace_entities(df, key).orderBy("doc_id").collect()
    old, new = [x[2:] for x in pii.detect(t)], [x[2:] for x in pii.detect(a.text)]
    assert [k for k, _ in old] == [k for k, _ in new] == ["name", "name", "email", "ip", "phone", "card", "secret"]
    assert all(x != y and len(x) == len(y) or k in ("ip", "name") for (k, x), (_, y) in zip(old, new)) and pii.luhn(re.sub(r"\D", "", new[5][1]))
    assert [v for _, v in (x[2:] for x in pii.detect(b.text))] == [new[2][1], new[3][1]]
    assert new[0][1].split()[0] in pii.GIVEN["latin_m"]
    out = pii.replace_entities(odd, key).collect()
    assert len(out) == len(ODD) and sorted(str(r.text) for r in out) == sorted(str(x) for _, x in ODD)
    assert pii.replace_entities(none, key).count() == 0


def test_colliding_surrogates_move(spark):
    key = b"k"
    first = pii.surrogate("ip", "9.9.9.9", key)
    df = spark.createDataFrame([(1, f"x 9.9.9.9 y"), (2, f"x {first} y")], "doc_id long, text string")
    assert [(r.entity, r.attempt) for r in pii.moved_entities(df, key).collect()] == [("9.9.9.9", 1)]


def test_names_and_classes(spark):
    """Other mentions of a name get its surrogate; valid IBANs stay valid and others not; addresses stay in their blocks."""
    import ipaddress

    key = b"k"
    texts = ["Mr. Alex Smith called. Alex Smith left, and Smith's dog; Smithson stayed. Mr. Smith", "no title: Alex Smith"]
    a, b = (r.text for r in pii.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key).orderBy("doc_id").collect())
    m = re.fullmatch(r"Mr\. (\w+) (\w+) called\. (\w+ \w+) left, and (\w+)'s dog; Smithson stayed\. Mr\. (\w+)", a)
    assert m and m[3] == f"{m[1]} {m[2]}" and m[2] == m[4] == m[5] != "Smith" and m[1] != "Alex" and b == texts[1]
    rng = random.Random(3)
    for _ in range(200):
        bban = "".join(rng.choice("0123456789") for _ in range(18))
        right = next(x for x in (f"DE{c:02d}{bban}" for c in range(2, 99)) if pii._iban_valid(x))
        wrong = f"DE{(int(right[2:4]) + 1) % 97 + 2:02d}{bban}"
        assert pii._iban_valid(pii.surrogate("iban", right, key)) and pii._iban_valid(pii.surrogate("iban", wrong, key)) == pii._iban_valid(wrong)
    for v in ("192.168.1.4", "127.0.0.1", "10.0.0.7", "8.8.8.8", "169.254.3.3", "fe80::1", "2001:db9::5"):
        old, new = ipaddress.ip_address(v), ipaddress.ip_address(pii.surrogate("ip", v, key))
        assert old != new and [old in n for n in pii._BLOCKS] == [new in n for n in pii._BLOCKS]
    assert [x[2:] for x in pii.detect("+4915112345678")] == [("phone", "+4915112345678")]


def test_full_formats(spark):
    """More entities than their formats have room for: all names of the lists, all two-letter ones, letters of no class, one-letter names and addresses."""
    names = [n for v in pii.GIVEN.values() for n in v] + [c + "i" for c in "BCDFGHJKLMNPQRSTVWXYZ"] + ["A", "B", "Łł", "Ø"]
    old = [("name", n) for n in names] + [("email", f"{a}@{b}.co") for a in "aeiou" for b in "aeiou"]
    df = spark.createDataFrame([(i, f"Mr. {v}, x" if k == "name" else f"to {v} x") for i, (k, v) in enumerate(old)], "doc_id long, text string")
    assert [next(pii.detect(r.text))[2:] for r in df.orderBy("doc_id").collect()] == old
    out = pii.replace_entities(df, b"k").orderBy("doc_id").collect()
    new = [(k, r.text[4:-3] if k == "name" else r.text[3:-2]) for (k, _), r in zip(old, out)]
    assert len(set(new)) == len(old) and not set(new) & set(old)
    assert [next(pii.detect(r.text))[2:] for r in out] == new and not any(c in v for _, v in new for c in "ŁłØ")


def test_forms_of_entities(spark):
    """Entities at the start of a text and after signs, in all their formats; equal ones keep equal surrogates across formats."""
    h = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    one = [("secret", h), ("secret", h * 4), ("phone", "+14155552671"), ("phone", "+33 1 23 45 67 89"), ("phone", "01 23 45 67 89"), ("phone", "+49 170 123 45 67"), ("ip", "2001:db8::8a2e:370:7334"), ("ip", "2001:0db8:0:0:0:0:0:1"), ("ip", "fe80::1")]
    for text in ("{}", "({})", "see /{}, ok", "at {}: x", "so {}.\n"):
        assert all([x[2:] for x in pii.detect(text.format(v))] == [(k, v)] for k, v in one)
    assert [x[2:] for x in pii.detect("+33 1 23 45 67 89 2024 1177")] == [("phone", "+33 1 23 45 67 89 2024")]
    assert not [x for t in ("at 12:30:45", "abc::def", "std::vector", "a: b:: c", "x [::] 1:2:3", "10:20") for x in pii.detect(t)]
    assert [x[2:] for x in pii.detect("x 12:30:10.0.0.1 and 2:3:4111111111111111")] == [("ip", "10.0.0.1"), ("card", "4111111111111111")]
    same = [["+1 (323) 555-9830", "+1 323-555-9830", "+13235559830"], ["DE44 5001 0517 5407 3249 31", "DE44500105175407324931"], ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111"], ["2001:db8::1", "2001:0DB8:0:0:0:0:0:1"]]
    df = spark.createDataFrame([(i, f"is {v} so") for i, v in enumerate(v for x in same for v in x)], "doc_id long, text string")
    new = [r.text[3:-3] for r in pii.replace_entities(df, b"k").orderBy("doc_id").collect()]
    for old in same:
        mine, new = new[: len(old)], new[len(old) :]
        kind = next(pii.detect(f"is {old[0]} so"))[2]
        assert len({pii.canonical(kind, x) for x in mine}) == 1 and not set(mine) & set(old)
        assert ":" in old[0] or [re.sub("[0-9A-Z]", "0", x) for x in mine] == [re.sub("[0-9A-Z]", "0", x) for x in old]


def test_toxicity(spark, sf, odd, none):
    rng = random.Random(3)
    clean = lambda: " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}q" for _ in range(60))
    docs = [(i, clean() + (" dreadword" if i % 6 == 0 else "")) for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(0, 900, 3)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    got = {r.doc_id: r.toxicity >= 0.5 for r in toxicity.score(df, model).collect()}
    assert np.mean([got[i] == (i % 6 == 0) for i in got]) > 0.98
    out = toxicity.score(odd, model).collect()
    assert len(out) == len(ODD) and all(0 <= r.toxicity < 0.5 for r in out)
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0


def test_licenses(spark, odd, none):
    mit = license_scan._MIT
    texts = [mit, "Copyright (c) 2020 Someone\n\n" + mit.upper(), "The MIT Licence (MIT)\n\nCopyright 1999 X\n" + mit.replace(",", " ,"), mit + " extra", "bla\nReleased under the MIT Licence!\nbla"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.license_id, r.notices) for r in license_scan.scan_licenses(df).collect()}
    assert [got[i][0] for i in range(5)] == ["MIT", "MIT", "MIT", None, None] and got[4][1] == ["MIT"]
    out = license_scan.scan_licenses(odd).collect()
    assert len(out) == len(ODD) and all((r.digest is None) == (r.doc_id in (1, 2, 3, 9)) for r in out)
    assert license_scan.scan_licenses(none).count() == 0


def test_whole_license_texts(spark):
    """A document that is one whole licence text, set in other lines and letter case, with its own copyright line."""
    import textwrap
    from pathlib import Path

    bodies = {f.stem: f.read_text("utf-8") for f in (Path(license_scan.__file__).parent / "licenses").glob("*.txt")}
    clause = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
    bodies["BSD-3-Clause"] = "BSD 3-Clause License\n\n" + bodies["BSD-2-Clause"].replace("<year> <owner>", "2021, Some One").replace("THIS SOFTWARE IS", clause + "THIS SOFTWARE IS")
    bodies |= {"MIT": license_scan._MIT, "ISC": license_scan._ISC}
    assert set(license_scan.NAMES) - set(bodies) == {"CC-BY-4.0", "CC-BY-NC-4.0"}
    docs = [(i, t) for i, t in bodies.items()] + [(i, "Copyright (c) 2020 Some One\n\n" + t.upper()) for i, t in bodies.items()]
    docs += [(i, bodies[i].split("END OF TERMS")[0]) for i in ("Apache-2.0", "GPL-2.0", "GPL-3.0")] + [("Apache-2.0", bodies["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2019 Some One"))]
    docs += [(i, "\n\n".join(textwrap.fill(p, 60) for p in bodies[i].split("\n\n"))) for i in ("BSD-2-Clause", "BSD-3-Clause", "MIT", "ISC")]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in license_scan.scan_licenses(df).collect()}
    assert [got[k] for k in range(len(docs))] == [i for i, _ in docs]


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id for r in p.run(spark, sf).collect()}
    model = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    left = {i: docs[i] for i, s in zip(docs, model.score(pa.array(list(docs.values())))) if s < 0.5}
    best = {}
    for i, t in left.items():
        k = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[k] = min(best.get(k, (1, 0)), (-len(t or ""), i))
    left = {i: left[i] for _, i in best.values()}
    left = {i: left[i] for i, (_, c) in _links(left.items()).items() if i == c}
    items = [re.findall(r"[^\W_]+", r.text.lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held = {i for i, t in left.items() for w in [" ".join(re.findall(r"[^\W_]+", (t or "").lower()))] for x in items if " ".join(x) in w}
    assert got == set(left) - held
