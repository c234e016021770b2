"""Benchmark decontamination with SimHash over windows of the items' own sizes.

Every window of a document that is as long as a benchmark item gets a 64-bit
SimHash of its words. Cut into RADIUS + 1 blocks, any two fingerprints within
RADIUS bits agree on a whole block, so a test of blocks loses no item within the
radius. What it finds is verified by the exact similarity of the 5-word shingles
weighted by their counts.

Blocks of three bits alone would let nearly all pairs meet. So a window meets
only items with which it shares enough shingles to reach the similarity at all;
postings of each item's rarest shingles and a running count tell that without
loss.
"""

from __future__ import annotations

from bisect import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import settle

WIDTH, SIMILARITY, RADIUS = 5, 0.75, 20
#: Bytes of benchmark text that one pass over the documents takes; more items make more passes.
PASS_BYTES = 8 << 20
#: Windows that are fingerprinted at a time, and postings that are open at a time.
STRETCH, POSTINGS = 1 << 14, 1 << 20

_APART = np.ones(256, dtype=bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_CUTS = [round(64 * k / (RADIUS + 1)) for k in range(RADIUS + 2)]


def _rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` words from each place on; the last places have none."""
    with np.errstate(over="ignore"):
        m = max(0, len(h) - width + 1)
        acc = np.zeros(m, dtype=np.uint64)
        for k in range(width):
            acc = acc * np.uint64(0x9FB21C651E98DF25) + h[k : k + m]
    return K.mix(acc)


class Prints:
    """SimHash of any stretch of the words `h`: each bit is what most of its words have there. One running sum for each bit serves all stretches."""

    def __init__(self, h: np.ndarray, longest: int):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # sums may wrap round: a difference is right as long as a stretch is shorter than the type's range
        kind = np.uint16 if longest < 1 << 15 else np.uint64
        self.run = np.zeros((len(h) + 1, 64), dtype=kind)
        np.cumsum(bits, axis=0, out=self.run[1:], dtype=kind)

    def of(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), dtype=np.uint64)
        for a in range(0, len(start), 16_384):
            s, n = start[a : a + 16_384], length[a : a + 16_384]
            most = 2 * (self.run[s + n] - self.run[s]) > n[:, None].astype(self.run.dtype)
            out[a : a + 16_384] = np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()
        return out


def _blocks(f: np.ndarray) -> np.ndarray:
    """Keys of the blocks of each fingerprint: number of the block and its bits."""
    return np.stack([(np.uint64(k) << np.uint64(32)) | ((f >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)) for k, (a, b) in enumerate(zip(_CUTS[:-1], _CUTS[1:]))], axis=1)


@dataclass
class Index:
    """The items of one pass. Equal word sequences are one entry with several ids.

    A window that reaches the similarity holds so many of the item's shingles
    that it can't miss all of its rarest quarter, and one more; `posts` has those
    alone, so text without a telling shingle of an item never meets it.
    """

    ids: list[list[int]]
    words: np.ndarray  # words of each item
    prints: np.ndarray  # its fingerprint
    keys: np.ndarray  # its blocks, one row an item
    at: np.ndarray  # bounds of each item in the next two
    shingles: np.ndarray  # sorted distinct shingles
    counts: np.ndarray
    posts: dict[int, tuple[np.ndarray, np.ndarray]]  # shingle width -> sorted telling shingles, their items

    @staticmethod
    def of(items: list[tuple[int, str]]) -> "Index":
        data, at = K.buffer(K.lowered(pa.array([t for _, t in items], pa.string())))
        start, end, row = K.words(data, at, _APART)
        h = K.hashes(data, start, end)
        ends = np.searchsorted(row, np.arange(len(items) + 1))
        same: dict[bytes, int] = {}
        ids, sizes, prints, sets = [], [], [], []
        for (item, _), a, b in zip(items, ends[:-1], ends[1:]):
            if b > a:
                k = same.setdefault(h[a:b].tobytes(), len(ids))
                if k < len(ids):
                    ids[k].append(item)
                    continue
                ids.append([item])
                sizes.append(int(b - a))
                prints.append(Prints(h[a:b], int(b - a)).of(np.array([0]), np.array([b - a]))[0])
                sets.append(np.unique(_rolling(h[a:b], min(WIDTH, int(b - a))), return_counts=True))
        empty = np.zeros(0, dtype=np.uint64)
        words, prints = np.array(sizes, dtype=np.int64), np.array(prints, dtype=np.uint64)
        bounds = np.cumsum([0, *(len(x) for x, _ in sets)])
        shingles, counts = np.concatenate([empty, *(x for x, _ in sets)]), np.concatenate([np.zeros(0, dtype=np.int64), *(c for _, c in sets)])
        posts = {}
        for width in {min(WIDTH, n) for n in sizes}:
            mine = [k for k, n in enumerate(sizes) if min(WIDTH, n) == width]
            known, often = np.unique(np.concatenate([sets[k][0] for k in mine]), return_counts=True)
            telling = []
            for k in mine:
                x, c = sets[k]
                # whatever a window's size, it shares this part of the item's shingles, as their union is no smaller than the item
                least = int(np.ceil(SIMILARITY * c.sum() - 1e-9))
                by = np.argsort(often[np.searchsorted(known, x)], kind="stable")
                telling.append(x[by[: np.searchsorted(np.cumsum(c[by]), c.sum() - least + 1) + 1]])
            flat, owner = np.concatenate(telling), np.repeat(mine, [len(x) for x in telling])
            by = np.argsort(flat, kind="stable")
            posts[width] = flat[by], owner[by]
        return Index(ids, words, prints, _blocks(prints) if len(prints) else empty.reshape(0, RADIUS + 1), bounds, shingles, counts, posts)

    def search(self, texts: pa.Array) -> list[list[tuple[int, int, int, float]]]:
        """For each text: (item id, first word, words, similarity) of its matches; of overlapping ones with one item, the best."""
        out: list[list] = [[] for _ in range(len(texts))]
        data, at = K.buffer(K.lowered(texts))
        start, end, row = K.words(data, at, _APART)
        h = K.hashes(data, start, end)
        bounds = np.searchsorted(row, np.arange(len(texts) + 1))
        for width, (known, owner) in self.posts.items():
            shingle = _rolling(h, width)
            if not len(shingle):
                continue
            bitmap = np.zeros(1 << 20, dtype=bool)
            bitmap[known >> np.uint64(44)] = True
            maybe = np.flatnonzero(bitmap[shingle >> np.uint64(44)] & (row[: len(shingle)] == row[width - 1 :]))
            maybe = maybe[np.isin(shingle[maybe], known)]
            for r, i, first, last in self._stretches(maybe, shingle, row, known, owner):
                found = self._in_stretch(h, shingle, i, first, last, int(bounds[r]), int(bounds[r + 1]), width)
                out[r] += [(item, s - int(bounds[r]), m, sim) for s, m, sim in found for item in self.ids[i]]
        return [self._best(x) for x in out]

    def _stretches(self, place, shingle, row, known, owner):
        """(row, item, first and last place) where telling shingles of an item lie less than the item's length apart. Postings are opened a bounded number at a time."""
        lo, hi = np.searchsorted(known, shingle[place], side="left"), np.searchsorted(known, shingle[place], side="right")
        ends = np.cumsum(hi - lo)
        open_: dict[tuple[int, int], tuple[int, int]] = {}
        a = 0
        while a < len(place):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + POSTINGS, side="right")))
            k = hi[a:b] - lo[a:b]
            p = np.repeat(place[a:b], k)
            i = owner[np.repeat(lo[a:b] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))]
            by = np.lexsort((p, i, row[p]))
            p, i = p[by], i[by]
            r = row[p]
            new = np.ones(len(p), dtype=bool)
            new[1:] = (r[1:] != r[:-1]) | (i[1:] != i[:-1]) | (p[1:] - p[:-1] >= self.words[i[1:]])
            begin = np.flatnonzero(new)
            stop = np.append(begin[1:], len(p)) - 1
            for rr, ii, f, z in zip(r[begin].tolist(), i[begin].tolist(), p[begin].tolist(), p[stop].tolist()):
                was = open_.get((rr, ii))
                if was and f - was[1] < self.words[ii]:
                    f = was[0]
                elif was:
                    yield rr, ii, *was
                open_[rr, ii] = f, z
            here = int(row[place[b - 1]])
            for key in [key for key in open_ if key[0] < here]:
                yield *key, *open_.pop(key)
            a = b
        for key, was in open_.items():
            yield *key, *was

    def _in_stretch(self, h, shingle, i: int, first: int, last: int, begin: int, stop: int, width: int):
        """(first word, words, similarity) of the windows that hold one of the places and reach the similarity with item i; long stretches are worked on in parts."""
        n = int(self.words[i])
        if stop - begin < n:
            yield from self._windows(h, shingle, i, np.array([begin]), stop - begin, width)
            return
        low, high = max(begin, first - n + width), min(last, stop - n)
        for a in range(low, high + 1, STRETCH):
            yield from self._windows(h, shingle, i, np.arange(a, min(a + STRETCH, high + 1)), n, width)

    def _windows(self, h, shingle, i: int, s: np.ndarray, m: int, width: int):
        """Windows of m words that begin at the places s, one after the other: enough shingles of the item, a fingerprint that shares a block and lies within the radius, then the exact similarity."""
        n, a, b = int(self.words[i]), int(self.at[i]), int(self.at[i + 1])
        own, times, size = self.shingles[a:b], self.counts[a:b], m - width + 1
        base = int(s[0])
        here = shingle[base : int(s[-1]) + size]
        place = np.minimum(np.searchsorted(own, here), len(own) - 1)
        member = own[place] == here
        run = np.concatenate([[0], np.cumsum(member)])
        k = s - base
        s = s[run[k + size] - run[k] >= self._least(m, n, width)]
        if not len(s):
            return
        f = Prints(h[base : int(s[-1]) + m], m).of(s - base, np.full(len(s), m))
        s = s[(_blocks(f) == self.keys[i]).any(axis=1) & (np.bitwise_count(f ^ self.prints[i]) <= RADIUS)]
        simple = not len(s) or (np.bincount(place[member], minlength=len(own)) <= times).all()
        for x in s.tolist():
            k = x - base
            if simple:  # no shingle is here more often than in the item
                both = int(run[k + size] - run[k])
            else:
                inside = slice(k, k + size)
                both = int(np.minimum(np.bincount(place[inside][member[inside]], minlength=len(own)), times).sum())
            sim = both / (size + n - width + 1 - both)
            if sim >= SIMILARITY:
                yield x, m, sim

    @staticmethod
    def _least(m, n: int, width: int):
        """Fewest shingles of an item of n words that a window of m words must have to reach the similarity."""
        total = (m - width + 1) + (n - width + 1)
        return np.ceil(SIMILARITY * total / (1 + SIMILARITY) - 1e-9)

    @staticmethod
    def _best(found: list) -> list:
        out: list = []
        starts: dict[int, list[int]] = {}  # of what is chosen, by item
        sizes: dict[tuple[int, int], int] = {}
        for x in sorted(found, key=lambda x: (-x[3], x[1], x[0])):
            mine = starts.setdefault(x[0], [])
            k = bisect(mine, x[1])
            if (k == 0 or mine[k - 1] + sizes[x[0], mine[k - 1]] <= x[1]) and (k == len(mine) or x[1] + x[2] <= mine[k]):
                mine.insert(k, x[1])
                sizes[x[0], x[1]] = x[2]
                out.append(x)
        return sorted(out, key=lambda x: (x[1], x[0]))


_MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("first_word", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("similarity", T.DoubleType())]))


def find_items(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """`docs` plus `matches`: the benchmark items found in each whole text, with place and similarity.

    Words are runs of letters and digits in lower case. An item matches
    where a window of as many words (the whole text, where it is shorter) has a
    count-weighted Jaccard similarity of 5-word shingles of 0.75 or more; items
    of fewer than five words are one shingle. Null and empty texts match
    nothing; null and empty items match nothing. Repeated rows are searched
    like any other; a column `matches` of the input gives way. A benchmark
    beyond PASS_BYTES makes several passes, each written before the next, so
    that tasks hold the index of one pass only.
    """
    spark = docs.sparkSession
    docs = docs.drop("matches")
    items = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // PASS_BYTES))
    out, schema = docs, T.StructType([*docs.schema.fields, T.StructField("matches", _MATCH)])
    for k in range(passes):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k) if passes > 1 else items
        cell = spark.sparkContext.broadcast(Index.of(sorted(((r.item_id, r.text) for r in mine.collect()), key=str)))  # PASS_BYTES of text at most, about

        def run(batches, cell=cell, again=k > 0):
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int32()), ("words", pa.int32()), ("similarity", pa.float64())]))
            for whole in batches:
                for part in K.batches([whole]):
                    found = [[dict(zip(("item_id", "first_word", "words", "similarity"), x)) for x in m] for m in cell.value.search(part.column(text))]
                    if again:
                        found = [a + b for a, b in zip(part.column("matches").to_pylist(), found)]
                    columns = [c for c, n in zip(part.columns, part.schema.names) if n != "matches"]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], [*(n for n in part.schema.names if n != "matches"), "matches"])

        out = out.mapInArrow(run, schema)
        if k < passes - 1:
            out = settle(out, "decontamination-pass")
    return out


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """One row per document: whether it holds a benchmark item, which ones, and the best similarity."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.array_sort(F.array_distinct(F.col("matches.item_id")))
    return out.select("doc_id", (F.size("matches") > 0).alias("contaminated"), ids.alias("item_ids"), F.coalesce(F.array_max("matches.similarity"), F.lit(0.0)).alias("similarity"), F.size("matches").cast("long").alias("n_matches"))
