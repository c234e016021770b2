"""Run-length work: gaps and islands over any ordered table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.binary import le_hex
from ..sources.stage import checked_broadcast, staged

#: A run-length token holds 16 bits of length.
CAP, PACKET = 65_535, 128
#: Bytes of text that a task turns into runs at a time.
TEXT_BYTES = 1 << 20


def runs(df: DataFrame, unit: list[str], order: list[str], value: str, cap: int = CAP) -> DataFrame:
    """Maximal equal runs of `value` in `order` within each `unit`, cut at `cap`.

    Gives `run_index`, `start`, `run_length` and the value. One shuffle, by
    unit: the grouping and the numbering of runs keep that partitioning. Runs
    are counted before they are cut, so a long run is one row until then.
    """
    w = Window.partitionBy(*unit).orderBy(*order)
    flag = F.when(F.row_number().over(w) == 1, 1).when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    islands = df.select(*unit, *order, value, flag.alias("_new")).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = islands.groupBy(*unit, "_island").agg(F.count(F.lit(1)).alias("_n"), F.first(value).alias(value))
    at = Window.partitionBy(*unit).orderBy("_island")
    before = at.rowsBetween(Window.unboundedPreceding, -1)
    piece = F.ceil(F.col("_n") / cap)
    size = size.withColumns({"_start": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_first": F.coalesce(F.sum(piece).over(before), F.lit(0))})
    cut = size.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), piece - 1)))
    return cut.select(*unit, (F.col("_first") + F.col("_k")).cast("long").alias("run_index"), (F.col("_start") + F.col("_k") * cap).cast("long").alias("start"), F.least(F.lit(cap), F.col("_n") - F.col("_k") * cap).cast("long").alias("run_length"), value)


def block_runs(df: DataFrame, unit: list[str], block: str, order: list[str], value: str) -> DataFrame:
    """Runs of each block of a unit by itself: `k` (0, 1, ... in the block), `at` (values of the block before it), `n` and the value.

    A unit is cut into blocks that follow one another in `order` (a frame into
    its lines, a stream into stretches); one shuffle, by unit and block, so a
    unit of any size is spread over tasks. `merge_runs` joins the blocks.
    """
    keys = [*unit, block]
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.row_number().over(w) == 1, 1).when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    islands = df.select(*keys, *(c for c in order if c not in keys), value, new.alias("_new")).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = islands.groupBy(*keys, "_island").agg(F.count(F.lit(1)).alias("n"), F.first(value).alias(value))
    before = Window.partitionBy(*keys).orderBy("_island").rowsBetween(Window.unboundedPreceding, -1)
    return size.select(*keys, (F.col("_island") - 1).cast("long").alias("k"), F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("at"), "n", value)


def _starts(v: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Where runs begin: a value other than the one before, or another row."""
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (row[1:] != row[:-1])
    return np.flatnonzero(new)


def _cells(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All values of `width` bytes of a binary column as big-endian numbers, and the row of each. Null is empty."""
    a = column.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(a.buffers()[1], dtype=np.int64, count=len(a) + 1, offset=8 * a.offset)
    data = np.frombuffer(a.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]]
    return data.view(f">u{width}").astype(np.int64), np.repeat(np.arange(len(a)), np.diff(at) // width)


def line_runs(lines: DataFrame, unit: list[str], line: str, data: str, value: str = "color", width: int = 4) -> DataFrame:
    """`block_runs` of lines at rest: each row holds a line's values as a binary column of `width` bytes a value. No shuffle, and no row for each value."""
    keys = [*unit, line]
    schema = T.StructType([*(lines.schema[c] for c in keys), *(T.StructField(c, T.LongType()) for c in ("k", "at", "n", value))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, row = _cells(b.column(len(keys)), width)
            start = _starts(v, row)
            owner = row[start]
            n = np.diff(np.append(start, len(v)))
            first = np.searchsorted(owner, owner)
            columns = [c.take(pa.array(owner)) for c in b.columns[: len(keys)]]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, (np.arange(len(start)) - first, start - start[first], n, v[start]))], schema.names)

    return lines.select(*keys, data).mapInArrow(run, schema)


def merge_runs(local: DataFrame, unit: list[str], block: str, value: str, cap: int = CAP) -> DataFrame:
    """`runs` of whole units from the runs of their blocks.

    Blocks merge associatively: a block is known by its first and its last run
    and by how many runs and values it has, and two neighbours join where the
    last value of one is the first of the next. Running sums over one row a
    block give each run's place and number; runs are cut at `cap` last. Only
    these rows are dealt by unit: runs stay where they are and look up their
    block. Blocks without values have no row and change nothing.
    """
    keys = [*unit, block]
    local = staged(local)
    pieces = lambda n: F.ceil(F.col(n) / cap).cast("long")
    at = lambda f, c, name: f(c, "k").alias(name)
    facts = local.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("r"), F.sum("n").alias("total"), F.sum(pieces("n")).alias("pieces"),
        at(F.min_by, value, "first"), at(F.min_by, "n", "n_first"), at(F.max_by, value, "last"), at(F.max_by, "n", "n_last"),
    )
    w = Window.partitionBy(*unit).orderBy(block)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    joined = (F.row_number().over(w) > 1) & F.col("first").eqNullSafe(F.lag("last").over(w))
    facts = facts.withColumn("joined", joined.cast("long"))
    # number of the run that holds the block's first value, and of the one that holds its last
    facts = facts.withColumns({"offset": F.coalesce(F.sum("total").over(before), F.lit(0)), "g_first": F.coalesce(F.sum(F.col("r") - F.col("joined")).over(before), F.lit(0)) - F.col("joined")})
    facts = staged(facts.withColumn("g_last", F.col("g_first") + F.col("r") - 1))
    ends = facts.select(*unit, F.col("g_first").alias("g"), F.col("n_first").alias("n")).unionByName(facts.filter("r > 1").select(*unit, F.col("g_last").alias("g"), F.col("n_last").alias("n")))
    whole = ends.groupBy(*unit, "g").agg(F.sum("n").alias("whole"))
    facts = match(facts, whole.withColumnRenamed("g", "g_last"), [*unit, "g_last"])
    # tokens of the runs that begin in the block: all but a first run that began before, and the last one at its whole length
    begins = F.when((F.col("r") == 1) & (F.col("joined") == 1), 0).otherwise(F.col("pieces") - F.when(F.col("joined") == 1, pieces("n_first")).otherwise(0) - pieces("n_last") + pieces("whole"))
    facts = facts.withColumn("_first", F.coalesce(F.sum(begins).over(before), F.lit(0)))
    facts = facts.select(*keys, "r", "offset", "_first", "whole", F.when(F.col("joined") == 1, pieces("n_first")).otherwise(0).alias("_skip"), "joined")
    inside = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = local.withColumn("_before", F.coalesce(F.sum(pieces("n")).over(inside), F.lit(0)))
    out = match(placed, facts, keys, small=True).filter("NOT (k = 0 AND joined = 1)")
    n = F.when(F.col("k") == F.col("r") - 1, F.col("whole")).otherwise(F.col("n"))
    out = out.select(*unit, value, n.alias("_n"), (F.col("offset") + F.col("at")).alias("_start"), (F.col("_first") + F.col("_before") - F.when(F.col("k") > 0, F.col("_skip")).otherwise(0)).alias("_i"))
    cut = out.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), pieces("_n") - 1)))
    return cut.select(*unit, (F.col("_i") + F.col("_k")).cast("long").alias("run_index"), (F.col("_start") + F.col("_k") * cap).cast("long").alias("start"), F.least(F.lit(cap), F.col("_n") - F.col("_k") * cap).cast("long").alias("run_length"), value)


def match(left: DataFrame, right: DataFrame, keys: list[str], small: bool = False) -> DataFrame:
    """Inner join in which null keys match; the keys of `left` stay. `small`: `right` is broadcast if its size allows it."""
    right = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys))
    return left.join(checked_broadcast(right) if small else right, on).drop(*(f"_of_{k}" for k in keys))


def runs_by_block(df: DataFrame, unit: list[str], block: str, order: list[str], value: str, cap: int = CAP) -> DataFrame:
    """`runs` for units too large for a task: runs of their blocks, merged."""
    return merge_runs(block_runs(df, unit, block, order, value), unit, block, value, cap)


def text_runs(df: DataFrame, unit: list[str], text: str, value: str = "v", cap: int = CAP) -> DataFrame:
    """`runs` of the characters of a text column: a text lies in order in its row, so its runs are found there, without a shuffle.

    Null and empty texts have no run.
    """
    schema = T.StructType([*(df.schema[c] for c in unit), *(T.StructField(c, T.LongType()) for c in ("run_index", "start", "run_length")), T.StructField(value, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b, TEXT_BYTES):
                texts = part.column(len(unit)).to_pylist()
                code = np.frombuffer("".join(x for x in texts if x).encode("utf-32-le"), dtype=np.uint32)
                row = np.repeat(np.arange(len(texts)), [len(x) if x else 0 for x in texts])
                start = _starts(code, row)
                n = np.diff(np.append(start, len(code)))
                if len(n) and n.max() > cap:
                    k = -(-n // cap)
                    nth = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
                    start, n = np.repeat(start, k) + nth * cap, np.minimum(cap, np.repeat(n, k) - nth * cap)
                owner = row[start]
                each = np.bincount(owner, minlength=len(texts))
                first = np.repeat(np.cumsum(each) - each, each)
                which = code[start]
                known = np.flatnonzero(np.bincount(which))  # counted, not sorted
                nth = np.zeros(known[-1] + 1 if len(known) else 0, dtype=np.int32)
                nth[known] = np.arange(len(known))
                which = nth[which]
                columns = [c.take(pa.array(owner)) for c in part.columns[: len(unit)]]
                values = pa.array([chr(c) for c in known.tolist()], pa.string()).take(pa.array(which))
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, (np.arange(len(start)) - first, start - start[first], n)), values], schema.names)

    return df.select(*unit, text).mapInArrow(run, schema)


def _slices(b: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of `size` bytes, about; one long row stays whole."""
    step = max(1, int(b.num_rows * size / max(1, b.nbytes)))
    for at in range(0, b.num_rows, step):
        yield b.slice(at, step)


def packet_runs(df: DataFrame, unit: list[str], order: list[str], value: str) -> DataFrame:
    """Still-image packets: repeats of 2 to 128, and single values joined to literal packets of 128 at most.

    Gives `packet_index`, `start`, `n`, `is_repeat` and the value (null for a
    literal packet). What is left over of a long run, if it is one value,
    joins the literals after it.
    """
    r = runs(df, unit, order, value, PACKET)
    w = Window.partitionBy(*unit).orderBy("run_index")
    single = F.col("run_length") == 1
    joins = single & F.coalesce(F.lag("run_length").over(w) == 1, F.lit(False))
    groups = r.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # literals are cut at 128: a place within the group decides the packet
    place = F.row_number().over(Window.partitionBy(*unit, "_group").orderBy("run_index")) - 1
    parts = groups.withColumn("_part", F.floor(place / PACKET))
    packets = parts.groupBy(*unit, "_group", "_part").agg(F.min("start").alias("start"), F.sum("run_length").cast("long").alias("n"), F.max("run_length").alias("_longest"), F.first(value).alias("_v"))
    index = F.row_number().over(Window.partitionBy(*unit).orderBy("_group", "_part")) - 1
    repeat = F.col("_longest") > 1
    return packets.select(*unit, index.cast("long").alias("packet_index"), "start", "n", repeat.alias("is_repeat"), F.when(repeat, F.col("_v")).alias(value))


def encoded_sizes(r: DataFrame, unit: list[str]) -> DataFrame:
    """Bytes of each unit as run-length tokens and as they are, for colours and for indices; run-length only if strictly smaller."""
    s = r.groupBy(*unit).agg(F.count(F.lit(1)).alias("n_runs"), F.sum("run_length").cast("long").alias("n_values"))
    size = {"raw_rgba": F.col("n_values") * 4, "rle_rgba": F.col("n_runs") * 6, "raw_index": F.col("n_values"), "rle_index": F.col("n_runs") * 3}
    return s.withColumns(size).withColumns({"data_rgba": F.least("raw_rgba", "rle_rgba"), "data_index": F.least("raw_index", "rle_index"), "rgba_is_rle": F.col("rle_rgba") < F.col("raw_rgba"), "index_is_rle": F.col("rle_index") < F.col("raw_index")})


def packet_sizes(packets: DataFrame, unit: list[str]) -> DataFrame:
    """Bytes of each unit as still-image packets: five for a repeat, one and four for each pixel of a literal."""
    return packets.groupBy(*unit).agg(F.sum("n").alias("n_pixels"), F.sum(F.when(F.col("is_repeat"), 5).otherwise(1 + 4 * F.col("n"))).cast("long").alias("packed_bytes"))


def encode_runs(r: DataFrame, unit: list[str], value: str, indexed: bool = False) -> DataFrame:
    """Token bytes of each unit (`data`): 16 bits of length, then RGBA or an index."""
    color = F.lpad(F.hex(F.col(value).cast("long")), 2 if indexed else 8, "0")
    token = F.concat(le_hex(F.col("run_length"), 2), color)
    return r.groupBy(*unit).agg(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run_index", token.alias("t")))), lambda x: x["t"]), "")).alias("data"))


def decode_fixed_runs(units: DataFrame, unit: list[str], indexed: bool = False, data: str = "data") -> DataFrame:
    """Tokens of 6 bytes (3 if indexed) back to rows: `run_index`, `start`, `run_length`, `color`. Start places are folded within each row's array: no shuffle."""
    k = 3 if indexed else 6
    d = F.hex(data)
    n = F.floor(F.octet_length(data) / k).cast("int")
    tokens = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(d, i * 2 * k + 1, F.lit(2 * k)))
    number = lambda h: F.conv(h, 16, 10).cast("long")
    length = lambda t: number(F.concat(F.substring(t, 3, 2), F.substring(t, 1, 2)))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("array()").cast("array<struct<start:bigint,run_length:bigint,color:bigint>>").alias("out"))
    step = lambda s, t: F.struct((s["at"] + length(t)).alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), length(t).alias("run_length"), number(F.substring(t, 5, 2 * k - 4)).alias("color")))).alias("out"))
    rows = F.when(n > 0, F.aggregate(tokens, zero, step)["out"])
    return units.select(*unit, F.posexplode(rows).alias("run_index", "_r")).select(*unit, F.col("run_index").cast("long").alias("run_index"), "_r.*")


def expand_runs(r: DataFrame, unit: list[str], value: str, width: int | None = None) -> DataFrame:
    """Runs back to one row per place (`pixel_index`), with x and y where a width is given."""
    out = r.filter("run_length > 0").select(*unit, value, F.explode(F.sequence("start", F.col("start") + F.col("run_length") - 1)).alias("pixel_index"))
    return out if width is None else out.withColumns({"x": F.pmod("pixel_index", F.lit(width)).cast("int"), "y": F.floor(F.col("pixel_index") / width).cast("int")})


def color_histogram(r: DataFrame, group: list[str], value: str) -> DataFrame:
    """Places of each value straight from the runs."""
    return r.groupBy(*group, value).agg(F.sum("run_length").cast("long").alias("n_pixels"))
