"""Repeated rows in sharding and in the classifier's sample; large benchmarks."""

import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

from framelake.llm import bpe, decontamination, pii, sharding, toxicity


def test_copies_are_shuffled_like_other_rows(spark):
    """10,000 equal rows among 40,000 spread over shards, and over the slots of each."""
    df = spark.range(40_000, numPartitions=6).selectExpr("IF(id % 4 = 0, -1, id) AS doc_id", "IF(id % 4 = 0, 'same', concat('t', id)) AS text")
    got = sharding.shuffle_into_shards(df, 8, stable_layout=True, block_rows=512).toPandas()
    assert sorted(got.groupby("shard").size()) == [5_000] * 8
    assert all(sorted(g) == list(range(5_000)) for _, g in got.groupby("shard")["slot"])
    copies = got[got.doc_id == -1]
    table = np.array([np.bincount(g // 500, minlength=10) for _, g in copies.groupby("shard")["slot"]])
    assert table.sum() == 10_000 and table.shape == (8, 10)
    assert ((table - 125) ** 2 / 125 / 0.75).sum() < 79 + 5 * np.sqrt(2 * 79)
    # neighbours are copies as often as chance says
    one = got[got.shard == 0].sort_values("slot").doc_id.to_numpy() == -1
    pairs = (one[1:] & one[:-1]).sum()
    assert abs(pairs - 5_000 * 0.0625) < 5 * np.sqrt(5_000 * 0.0625)


def test_sample_of_repeated_rows_is_bounded(spark, monkeypatch):
    texts = spark.range(20_000).selectExpr("IF(id < 19000, 7, id) AS doc_id", "IF(id < 19000, concat('bad ', id % 3), concat('fine words ', id)) AS text")
    labels = spark.range(20_000).selectExpr("IF(id < 19000, 7, id) AS doc_id", "IF(id < 19000, 1, 0) AS toxic")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda p, u, prior: seen.append((len(p), len(u))))
    toxicity.train(texts, labels, max_positive=10, max_unlabelled=50)
    assert seen == [(1, 50)]
    toxicity.train(texts.limit(0), labels.limit(0), max_positive=10, max_unlabelled=50)
    assert seen[1:] == [(0, 0)]


def _brute(items, text):
    """Items whose best window reaches the similarity, by counting shingles of every window."""
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    w, out = words(text), set()
    for i, t in items:
        x = words(t)
        n, k = len(x), min(5, len(x))
        if not n:
            continue
        bag = lambda y: Counter(tuple(y[j : j + k]) for j in range(len(y) - k + 1))  # noqa: B023, E731
        item = bag(x)
        for s in range(max(1, len(w) - n + 1)):
            here = bag(w[s : s + n])
            both = sum((here & item).values())
            if both and both / (sum(here.values()) + sum(item.values()) - both) >= 0.75:
                out.add(i)
                break
    return out


def test_large_benchmark():
    """2,500 items of one size, many of them near one another: found as by brute force, fast, and repeated words don't matter."""
    rng = random.Random(4)
    vocabulary = ["w%d" % k for k in range(3_000)]
    base = [[rng.choice(vocabulary) for _ in range(30)] for _ in range(500)]
    items = []
    for k in range(2_500):
        x = list(base[k % 500])
        for _ in range(k // 500):
            x[rng.randrange(30)] = rng.choice(vocabulary)
        items.append((k, " ".join(x)))
    items += [(9_000, "Same same"), (9_001, "same SAME!"), (9_002, "a " * 12), (9_003, ""), (9_004, "one")]
    index = decontamination.Index.of(items)
    texts = []
    for _ in range(12):
        t = [rng.choice(vocabulary) for _ in range(rng.randrange(200))]
        for _ in range(3):
            x = items[rng.randrange(2_500)][1].split()
            for _ in range(rng.randrange(3)):
                x[rng.randrange(30)] = "new"
            at = rng.randrange(len(t) + 1)
            t[at:at] = x
        texts.append(" ".join(t))
    texts += ["a " * 40, "x same same y", "", None, "one", " ".join(base[3][:26])]
    got = [{m[0] for m in found} for found in index.search(pa.array(texts, pa.string()))]
    assert got == [_brute(items, t or "") for t in texts]
    assert sum(map(len, got)) > 15
    began = time.time()
    long = " ".join(t for _, t in items[:40])
    assert {m[0] for m in index.search(pa.array([long]))[0]} >= set(range(40))
    assert time.time() - began < 2
    many = index.search(pa.array(["a " * 100_000]))[0]
    assert [m[:3] for m in many if m[0] == 9_002][:2] == [(9_002, 0, 12), (9_002, 12, 12)]


def test_very_long_words_by_stretches(monkeypatch):
    """Joined stretches give what the whole word gives; one letter 3,000,000 times stays within bounds."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    codec, rng = bpe.Codec(path), random.Random(8)
    letters = "".join(rng.choice("abcdefghijklmnop") for _ in range(9_000))
    words = [letters, "a" * 5_003, "ab" * 1_500, "the" * 1_000, "é" * 1_501, "aab" * 1_001, "x", "hello", letters[:1_500]]

    def same(words):
        ids, n = codec.contract([w.encode() for w in words])
        ends = np.concatenate([[0], np.cumsum(n)])
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [whole.encode_ordinary(w) for w in words]
        assert codec.expand(ids, n) == [w.encode() for w in words]

    for stretch, overlap in ((700, 64), (300, 2), (64, 40)):
        monkeypatch.setattr(bpe, "STRETCH", stretch)
        monkeypatch.setattr(bpe, "OVERLAP", overlap)
        same(words)
    monkeypatch.undo()
    ids, n = codec.contract([b"a" * 3_000_000])
    assert codec.expand(ids, n) == [b"a" * 3_000_000] and len(set(ids.tolist())) == 1


def _replaced(text):
    out, done = [], 0
    for a, b, kind, value, word in pii.mentions(text):
        new = pii.surrogate(kind, pii.canonical(kind, value), b"k")
        out += [text[done:a], pii.laid_over(kind, value, new) if word is None else new.split(" ")[word]]
        done = b
    return "".join([*out, text[done:]])


def test_every_word_of_a_name_is_replaced_alike():
    got = _replaced("Dr. Anna Maria Huber came. Huber left. Anna too, with Maria. Hubertus stayed.")
    first, second, last = got.removeprefix("Dr. ").split(" came")[0].split(" ")
    assert got == f"Dr. {first} {second} {last} came. {last} left. {first} too, with {second}. Hubertus stayed."
    assert not {first, second, last} & {"Anna", "Maria", "Huber"}
    for given, names in pii.GIVEN.items():
        for key in (b"a" * 32, b"b" * 32):
            turned = pii._turn(given, key)
            assert sorted(turned) == list(range(len(names))) and all(i != j for i, j in enumerate(turned))


def test_mentions_are_linear():
    names = ["N" + "".join(c) for c in itertools.islice(itertools.product("abcdefghij", repeat=5), 16_000)]
    began = time.time()
    found = pii.mentions("".join(f"Mr. {n.capitalize()} Xy{n.lower()} said so to {n.capitalize()}. " for n in names))
    assert len(found) == 32_000 and time.time() - began < 5
