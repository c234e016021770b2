"""MinHash near-dedup with tensored banding.

Two small collections of M sub-keys (HALF minhashes each) are computed for a
document; each of the M * M tables takes one sub-key from either collection as
its key. So 2 * M * HALF minhashes serve M * M tables of 2 * HALF minhashes. A
pair of similarity J meets in some table with probability
(1 - (1 - J^HALF)^M)^2: 0.999996 at J = 0.75. All that meets is verified on
whole shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import discard, private_name, settle

#: Words in a shingle; minhashes in a sub-key; sub-keys in each of the two collections.
WIDTH, HALF, M = 5, 2, 16
#: Similarity of a link, in hundredths.
PERCENT = 75
#: Bounds on a block of documents that one task compares with another block.
BLOCK_DOCS, BLOCK_SHINGLES = 256, 1_000_000

_MUL = np.random.Generator(np.random.PCG64(61)).integers(1, 2**63, 2 * M * HALF, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_ADD = np.random.Generator(np.random.PCG64(62)).integers(1, 2**63, 2 * M * HALF, dtype=np.int64).astype(np.uint64)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and the bounds of each row in them."""
    data, at = K.buffer(texts)
    start, end, row = K.words(data, at)
    h, owner = K.distinct_per_row(*K.shingles(K.hashes(data, start, end), row, len(texts), WIDTH))
    return h, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])


def sub_keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The 2 * M sub-keys of each row that has shingles."""
    first = bounds[:-1][np.diff(bounds) > 0]
    out = np.zeros((len(first), 2 * M), dtype=np.uint64)
    if len(first):
        with np.errstate(over="ignore"):
            for k in range(2 * M):
                for i in range(k * HALF, (k + 1) * HALF):
                    low = np.minimum.reduceat((h ^ _ADD[i]) * _MUL[i], first)
                    out[:, k] = K.mix(out[:, k] * np.uint64(0x9FB21C651E98DF25) + low)
    return out


def _digests(h: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """128 bits that name a set: two sums of independently mixed elements; None for the empty set."""
    n = np.diff(bounds)
    out = np.zeros((len(n), 2), dtype=np.uint64)
    if len(h):
        first = bounds[:-1][n > 0]
        with np.errstate(over="ignore"):
            out[n > 0, 0] = np.add.reduceat(K.mix(h + np.uint64(0x632BE59BD9B4E019)), first)
            out[n > 0, 1] = np.add.reduceat(K.mix(h ^ np.uint64(0x8CB92BA72F3D8DD7)) * np.uint64(0x9E3779B97F4A7C15), first)
    return [x.tobytes() if k else None for x, k in zip(out, n)]


_SIGNED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text_key", T.StringType()), T.StructField("n", T.LongType()),
    T.StructField("set_id", T.BinaryType()), T.StructField("a", T.ArrayType(T.LongType())), T.StructField("b", T.ArrayType(T.LongType())),
])


def _sign(batches):
    for whole in batches:
        for part in K.batches([whole]):
            h, bounds = shingle_sets(part.column("text"))
            n = np.diff(bounds)
            keys = np.zeros((part.num_rows, 2 * M), dtype=np.int64)
            keys[n > 0] = sub_keys(h, bounds).view(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * M), pa.array(np.ascontiguousarray(x).ravel())) for x in (keys[:, :M], keys[:, M:])]
            yield pa.record_batch([part.column("doc_id").cast(pa.int64()), part.column("text_key"), pa.array(n, pa.int64()), pa.array(_digests(h, bounds), pa.binary()), *lists], names=_SIGNED.names)


def _sets(batches):
    for whole in batches:
        for part in K.batches([whole]):
            h, bounds = shingle_sets(part.column("text"))
            cells = [h[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.record_batch([part.column("set_id"), pa.array(cells, pa.binary())], names=["set_id", "shingles"])


def _explode(batches):
    for part in batches:
        K.give_back()
        for s, cell in zip(part.column("set_id").to_pylist(), part.column("shingles").to_pylist()):
            h = np.frombuffer(cell, dtype=np.int64)
            for k in range(0, len(h), 65_536):
                x = h[k : k + 65_536]
                yield pa.record_batch([pa.array(x), pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(x), dtype=np.int32)), pa.array([s], pa.binary())).cast(pa.binary())], names=["shingle", "set_id"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable from each node of `edges`, by alternating large and small stars.

    Each round writes its edges to the shared folder; only the number of
    changed edges comes to the driver. Rounds grow with the logarithm of the
    longest path.
    """
    spark = edges.sparkSession
    now = settle(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while True:
        # large star: each node ties its larger neighbours to the smallest node it sees
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        # small star: each node ties its smaller neighbours, and itself, to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u")
        after = tied.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = settle(after, "edges")
        same = after.count() == now.count() and after.join(now, ["u", "v"], "left_anti").isEmpty()
        discard(spark, now)
        now = after
        if same:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _linked(pairs_of: pa.Table) -> pa.Table:
    """Links between different components inside one pair of blocks; a spanning set of them is enough.

    Rows: set_id, n, comp, side (0: new to each other as well, 1: only against side 0), shingles.
    """
    none = pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
    side = pairs_of.column("side").to_numpy()
    order = np.argsort(side, kind="stable")
    t = pairs_of.take(pa.array(order))
    side, ids, comp = side[order], t.column("set_id").to_pylist(), t.column("comp").to_pylist()
    cells = t.column("shingles").to_pylist()
    n = np.array([len(c) // 8 for c in cells], dtype=np.int64)
    rows, cut = len(ids), int((side == 0).sum())
    if rows < 2 or not cut:
        return none
    _, col, times = np.unique(np.frombuffer(b"".join(cells), dtype=np.int64), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(rows), n)
    common = times[col] > 1
    names, col = np.unique(col[common], return_inverse=True)
    row = row[common]
    by = np.argsort(col, kind="stable")
    row, col = row[by], col[by]
    inter = np.zeros((cut, rows), dtype=np.float32)
    for k in range(0, len(names), 4_096):
        lo, hi = np.searchsorted(col, [k, k + 4_096])
        dense = np.zeros((rows, min(4_096, len(names) - k)), dtype=np.float32)
        dense[row[lo:hi], col[lo:hi] - k] = 1
        inter += dense[:cut] @ dense.T
    inter = np.rint(inter).astype(np.int64)
    x, y = np.nonzero(100 * inter >= PERCENT * (n[:cut, None] + n[None, :] - inter))
    root = {c: c for c in comp}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    del t, cells, col, row, inter
    K.give_back()
    out = []
    for i, j in zip(x.tolist(), y.tolist()):
        if (p := find(comp[i])) != (q := find(comp[j])):
            root[p] = q
            out.append((ids[i], ids[j]))
    return pa.table({"a": pa.array([p for p, _ in out], pa.binary()), "b": pa.array([q for _, q in out], pa.binary())})


def _star_links(batches):
    """Of pairs with both sets, those that are links."""
    for part in batches:
        keep = []
        for k, (x, y) in enumerate(zip(part.column("x").to_pylist(), part.column("y").to_pylist())):
            x, y = np.frombuffer(x, dtype=np.int64), np.frombuffer(y, dtype=np.int64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= PERCENT * (len(x) + len(y) - both):
                keep.append(k)
        yield part.select(["a", "b"]).take(pa.array(keep, pa.int64()))
        K.give_back()


def _links(reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between different sets: enough of them to join all sets that any chain of links joins.

    `reps`: one row per set (set_id, doc_id, text_key, n, a, b). `texts`: (doc_id, text_key, text), whole corpus.
    """
    spark = reps.sparkSession
    # tables: first the sub-keys of one collection that two sets share, then, for those sets, the pairs of sub-keys
    one = reps.select("set_id", "b", F.posexplode("a").alias("i", "ka"))
    shared = one.groupBy("i", "ka").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    pairs = one.join(shared, ["i", "ka"]).select("set_id", "i", "ka", F.posexplode("b").alias("j", "kb")).select("set_id", F.xxhash64("i", "ka", "j", "kb").alias("bucket"))
    pairs = settle(pairs, "tables")
    meet = pairs.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.min("set_id").alias("pivot")).filter("c > 1").drop("c")
    buckets = settle(pairs.join(meet, "bucket").select("bucket", "set_id", "pivot"), "buckets")
    # a set with more than a quarter of its shingles in no other candidate has no link
    chosen = buckets.select("set_id").distinct().join(reps.select("set_id", F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key"), "n"), "set_id")
    # by document as well, so that the copies of a text don't all meet at its key
    mine = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key"))
    whole = texts.join(chosen.drop("n"), mine).dropDuplicates(["set_id"]).select("text", "set_id")
    sets = settle(whole.mapInArrow(_sets, "set_id binary, shingles binary").join(chosen.select("set_id", "n"), "set_id"), "sets")
    private = sets.select("set_id", "shingles").mapInArrow(_explode, "shingle long, set_id binary").groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("set_id").alias("set_id")).filter("c = 1")
    private = private.groupBy("set_id").agg(F.count(F.lit(1)).alias("p"))
    live = sets.join(private, "set_id", "left").filter(100 * (F.col("n") - F.coalesce("p", F.lit(0))) >= PERCENT * F.col("n")).select("set_id", "n")
    live = settle(live, "live")
    # clusters: all that meets in tables, over any number of steps
    kept = buckets.join(live.select("set_id"), "set_id", "left_semi").select("bucket", "set_id")
    first = kept.groupBy("bucket").agg(F.min("set_id").alias("pivot"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    stars = settle(kept.join(first, "bucket").filter("pivot <> set_id").select(F.col("pivot").alias("a"), F.col("set_id").alias("b")).distinct(), "stars")
    cluster = components(stars).withColumnRenamed("root", "cluster").join(live.withColumnRenamed("set_id", "node"), "node")
    total = cluster.groupBy("cluster").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles"))
    cluster = settle(cluster.join(total, "cluster"), "clusters")
    # clusters too large for one block: link along the stars first, so that most of their sets are joined already
    big = cluster.filter((F.col("docs") > BLOCK_DOCS) | (F.col("shingles") > BLOCK_SHINGLES)).select(F.col("node").alias("a"))
    checked = stars.join(big, "a", "left_semi")
    pair = checked.join(sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("y")), "b")
    star_links = settle(pair.select("a", "b", "x", "y").mapInArrow(_star_links, "a binary, b binary"), "star-links")
    comp = components(star_links)
    member = cluster.join(comp, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    sizes = member.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    major = sizes.groupBy("cluster").agg(F.max(F.struct("c", "comp")).alias("m"), F.max_by("s", F.struct("c", "comp")).alias("major_shingles")).select("cluster", F.col("m.comp").alias("major"), F.col("m.c").alias("major_docs"), "major_shingles")
    member = member.join(major, "cluster").withColumn("is_major", (F.col("comp") == F.col("major")) & (F.col("major_docs") > 1))
    # blocks: what isn't in a cluster's largest component meets itself and the rest; that component's own pairs are settled
    blocks = lambda docs, shingles: F.ceil(F.greatest(docs / BLOCK_DOCS, shingles / BLOCK_SHINGLES, F.lit(1.0))).cast("int")
    joined = F.col("major_docs") > 1
    minor_docs = F.col("docs") - F.when(joined, F.col("major_docs")).otherwise(0)
    minor_shingles = F.col("shingles") - F.when(joined, F.col("major_shingles")).otherwise(0)
    member = member.withColumns({"minor_n": blocks(minor_docs, minor_shingles), "major_n": blocks(F.col("major_docs"), F.col("major_shingles")), "left_over": minor_docs}).filter("left_over > 0")
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("is_major"), F.col("major_n")).otherwise(F.col("minor_n"))).cast("int")
    all_minor = F.sequence(F.lit(0), F.col("minor_n") - 1)
    meets = (
        F.when(F.col("is_major"), F.transform(all_minor, lambda i: F.struct(i.alias("p"), (-1 - F.col("mine")).alias("q"), F.lit(1).alias("side"))))
        .otherwise(
            F.concat(
                F.transform(all_minor, lambda i: F.struct(F.least(i, F.col("mine")).alias("p"), F.greatest(i, F.col("mine")).alias("q"), F.lit(0).alias("side"))),
                F.when(joined, F.transform(F.sequence(F.lit(0), F.col("major_n") - 1), lambda k: F.struct(F.col("mine").alias("p"), (-1 - k).alias("q"), F.lit(0).alias("side")))).otherwise(F.expr("array()")),
            )
        )
    )
    dealt = member.withColumn("mine", mine).select(F.col("node").alias("set_id"), "comp", "cluster", F.explode(meets).alias("at")).select("set_id", "comp", "cluster", "at.*")
    dealt = dealt.join(sets.select("set_id", "shingles"), "set_id")
    block_links = dealt.groupBy("cluster", "p", "q").applyInArrow(_linked, "a binary, b binary")
    out = settle(star_links.unionByName(block_links), "links")
    discard(spark, pairs, buckets, sets, live, stars, cluster, star_links)
    return out


def _grouped(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, n, set_id) of each document, and (set_id, root) of each set: sets of one root are tied by links."""
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    keyed = docs.withColumn("text_key", F.md5("text"))
    signed = settle(keyed.mapInArrow(_sign, _SIGNED), "signed")
    # equal sets are one node from here on
    low = F.min(F.struct("doc_id", "text_key"))
    reps = signed.filter("set_id IS NOT NULL").groupBy("set_id").agg(low.alias("low"), F.first("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    reps = settle(reps.select("set_id", "low.*", "n", "a", "b"), "reps")
    roots = components(_links(reps, keyed.select("doc_id", "text_key", "text")))
    both = reps.select("set_id").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").select("set_id", F.coalesce("root", "set_id").alias("root"))
    return signed.select("doc_id", "text_key", "n", "set_id"), both


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: `doc_id`, `n_shingles`, `component_id`, `kept`.

    Documents are linked when their sets of distinct 5-word shingles (A-Z in
    lower case; fewer words: the whole sequence as one shingle) have a Jaccard
    similarity of 0.75 or more. `component_id` is the smallest doc_id that
    links reach. A null or empty text has no shingle and no link: it is its own
    component. A null doc_id stays null in `doc_id`; a component of null ids
    alone has a null `component_id`, and `kept` is true there. Repeated rows
    are linked like any equal texts.
    """
    signed, roots = _grouped(docs, doc_id, text)
    lowest = signed.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("low")).join(roots, "set_id")
    named = lowest.groupBy("root").agg(F.min("low").alias("component_id")).join(roots, "root").select("set_id", "component_id")
    out = signed.join(named, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text and any other columns) with one document of each group of near duplicates: the one of the smallest doc_id.

    Documents without words stay. Of rows equal in doc_id and text one stays.
    """
    key, own_id, own_key = (private_name(docs, x) for x in ("key", "own_id", "own_key"))
    signed, roots = _grouped(docs, "doc_id", "text")
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))
    lowest = signed.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min(rank).alias("low")).join(roots, "set_id")
    best = lowest.groupBy("root").agg(F.min("low").alias("best")).join(roots, "root").select("set_id", "best")
    decided = signed.join(best, "set_id").withColumn("kept", rank == F.col("best"))
    keys = settle(decided.groupBy("doc_id", "text_key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "near-keys")
    named = keys.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key), "kept", "n")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_key))
    marked = docs.withColumn(key, F.md5(F.coalesce("text", F.lit(""))))
    out = marked.join(named.filter("NOT kept").select(own_id, own_key), same, "left_anti")
    again = named.filter("kept AND n > 1").select(own_id, own_key)
    if not again.isEmpty():  # repeated rows
        out = out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates(["doc_id", key]))
    return out.drop(key)


def op6_minhash(spark, sf_dir: str) -> DataFrame:
    """All documents: size of the shingle set, component, and whether it is the one of its component that stays. Null and empty texts have no shingle."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
