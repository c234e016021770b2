"""Uniform sharding with exact shard sizes, by a hypergeometric communication matrix.

How many rows each input partition sends to each shard is drawn first, exactly
as a uniform permutation of all rows would deal them. Every partition then
permutes its rows locally, cuts the permuted rows by its row of the matrix,
exchanges them, and every shard permutes what it got.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import BROADCAST_BYTES, private_name, settle, text_bytes

#: Input partitions that the matrix may have; more are joined without a shuffle.
MAX_PARTS = 65_536
#: Rows that one task of the last permutation gets, about.
BLOCK_ROWS = 8_192


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """A draw at any size: weights relative to the mode by their ratios, in double precision, over twelve standard deviations on either side, beyond which less than 1e-30 of them lies."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    var = draws * (good / (good + bad)) * (bad / (good + bad)) * (good + bad - draws) / max(1, good + bad - 1)
    reach = int(12 * var**0.5) + 40
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    grow = np.cumprod((good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1)))
    fall = np.cumprod(down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1)))
    weights = np.concatenate([fall[::-1], [1.0], grow])
    run = np.cumsum(weights)
    return int(mode - len(fall) + np.searchsorted(run, rng.random() * run[-1], side="right"))


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Rows of partition p that go to shard s: row sums `counts`, column sums `sizes`, drawn as a uniform permutation deals them."""
    if sum(counts) != sum(sizes):
        raise ValueError(f"{sum(counts)} rows for shards of {sum(sizes)}")
    rng, left = np.random.default_rng(seed), [int(x) for x in sizes]
    out = np.zeros((len(counts), len(sizes)), dtype=np.int64)
    for p, n in enumerate(counts):
        need, rest = int(n), sum(left)
        for s in range(len(left)):
            rest -= left[s]
            x = hypergeometric(rng, left[s], rest, need) if need else 0
            out[p, s], need = x, need - x
            left[s] -= x
    return out


def shuffle_into_shards(docs: DataFrame, n_shards: int = 8, seed: int = 7, *, block_rows: int = BLOCK_ROWS, stable_layout: bool = False) -> DataFrame:
    """`docs` with `shard` (0 .. n_shards-1) and `slot` (gapless from 0 in each shard): one uniform random permutation.

    Shard sizes are exact: they differ by one at most. All columns of `docs`
    stay; its own `shard` and `slot`, if any, give way. Nulls in any column,
    empty and long texts and repeated rows are rows like any other; an empty
    table gives an empty result. The order depends on `seed`, on the rows and
    on how they lie in input partitions.

    `stable_layout=True` says that every run of `docs` finds the same rows in
    the same partitions, as a scan of files does; else `docs` is written out
    first. Only counts by partition (MAX_PARTS at most) reach the driver.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    if not stable_layout:
        docs = settle(docs, "shard-input")
    if docs.rdd.getNumPartitions() > MAX_PARTS:
        docs = docs.coalesce(MAX_PARTS)
    first, second, mid, part, rank, block, ends, offset = (private_name(docs, x) for x in ("k1", "k2", "mid", "part", "rank", "block", "ends", "offset"))
    plain = [F.col(f"`{c}`") if not isinstance(t, (T.MapType, T.VariantType)) else F.to_json(F.col(f"`{c}`")) for c, t in ((f.name, f.dataType) for f in docs.schema)]
    counted = {r[0]: r[1] for r in docs.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    total = sum(counted.values())
    parts = sorted(counted)
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([counted[p] for p in parts], sizes, seed)
    if matrix.nbytes > BROADCAST_BYTES:
        raise ValueError("too many shards for this many partitions: the matrix is broadcast")
    bounds = spark.createDataFrame(
        [(p, [int(x) for x in np.cumsum(m)]) for p, m in zip(parts, matrix)], T.StructType([T.StructField(part, T.LongType()), T.StructField(ends, T.ArrayType(T.LongType()))])
    )
    # rows get numbers by a keyed sort of all they hold, so that a rerun gives the same ones; equal rows get numbers next to each other
    local = docs.withColumns({first: F.xxhash64(F.lit(seed), *plain), second: F.xxhash64(F.lit(seed + 1), *plain)}).sortWithinPartitions(first, second)
    local = local.withColumn(mid, F.monotonically_increasing_id())
    # permute locally: a keyed hash of the number tells copies apart, so that they go to all shards and blocks like other rows
    local = local.drop(first, second).withColumns({first: F.xxhash64(F.lit(seed + 2), mid), second: F.xxhash64(F.lit(seed + 3), mid)}).sortWithinPartitions(first, mid)
    local = local.drop(mid).withColumn(mid, F.monotonically_increasing_id())
    local = local.withColumns({part: F.shiftright(mid, 33), rank: F.col(mid).bitwiseAND(F.lit((1 << 33) - 1))})
    dealt = local.join(F.broadcast(bounds), part).withColumn("shard", F.size(F.filter(ends, lambda e: e <= F.col(rank))))
    ranges = 1
    while total / n_shards / ranges > block_rows:
        ranges *= 2
    # blocks of a shard: equal ranges of the key that orders it, so that their counts give each block's first slot
    dealt = dealt.withColumn(block, F.shiftrightunsigned(second, 64 - ranges.bit_length() + 1) if ranges > 1 else F.lit(0).cast("long"))
    per = settle(dealt.groupBy("shard", block).agg(F.count(F.lit(1)).alias(rank)), "shard-blocks")
    got = {r["shard"]: r["n"] for r in per.groupBy("shard").agg(F.sum(rank).alias("n")).collect()}
    if any(got.get(s, 0) != n for s, n in enumerate(sizes)) or sum(got.values()) != total:
        raise ValueError("the partitions of docs changed between two runs; pass stable_layout=False")
    first_slot = per.select("shard", block, (F.sum(rank).over(Window.partitionBy("shard").orderBy(block)) - F.col(rank)).alias(offset))
    again = Window.partitionBy("shard", block).orderBy(second, first, rank, part)
    out = dealt.withColumn("slot", F.row_number().over(again).cast("long") - 1)
    out = out.join(first_slot, ["shard", block]).withColumn("slot", F.col("slot") + F.col(offset))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), "shard", "slot")


def op1_shard_matrix(spark, sf_dir: str) -> DataFrame:
    """All documents in 8 shards under the law `rows`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shuffle_into_shards(docs, 8, stable_layout=True)
    return out.select(
        "doc_id",
        (text_bytes(F.col("text")) + 1).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
