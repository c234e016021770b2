"""Frame change and frame choice over lines at rest: a binary column holds a line's pixels, and no pixel becomes a row.

Small kernels give each line's facts (runs, box of change, alpha ratios); they
merge associatively over the lines of a frame by sums, minima and one pass in
line order. Only the facts move between tasks, but for the one shuffle that
brings a line to the same line one frame before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.stage import checked_broadcast, staged
from .change import DELTA, FULL, TRANSFORM, decide
from .runs import CAP, _cells, _starts

KEYS = ["file_id", "frame_index"]
_RUNS = "r long, first long, last long, n_first long, n_last long, inner long, inner_n long"
_CHANGE = "seen boolean, x0 int, x1 int, changed long, same boolean, appears boolean, ratio double, low double, high double"


def _run_facts(v: np.ndarray, row: np.ndarray, rows: int) -> list[pa.Array]:
    """Of each row: runs, first and last value and their runs' lengths, tokens and values of the runs between. Rows without values have zeros."""
    start = _starts(v, row)
    n, owner = np.diff(np.append(start, len(v))), row[start]
    r = np.bincount(owner, minlength=rows)
    a = np.cumsum(r) - r
    have = r > 0
    pick = lambda x, at: np.where(have, np.append(x, 0)[np.minimum(at, len(x))], 0)
    n_first, n_last = pick(n, a), pick(n, a + r - 1)
    ends = lambda x: pick(x, a) + np.where(r > 1, pick(x, a + r - 1), 0)
    sums = lambda x: np.bincount(owner, weights=x, minlength=rows).astype(np.int64)
    tokens = -(-n // CAP)
    return [pa.array(x.astype(np.int64)) for x in (r, pick(v[start], a), pick(v[start], a + r - 1), n_first, n_last, sums(tokens) - ends(tokens), sums(n) - ends(n))]


def _change_facts(v: np.ndarray, row: np.ndarray, before: pa.Array, rows: int) -> list[pa.Array]:
    """Of each row against the line before it: whether there is one, first and last changed place, and the facts that tell one alpha factor."""
    seen = np.asarray(before.is_valid())
    p, prow = _cells(before, 4)
    mine = seen[row]
    x = (np.arange(len(row)) - np.searchsorted(row, row))[mine]
    v, row = v[mine], row[mine]
    if len(v) != len(p) or (row != prow).any():
        raise ValueError("a line has another length than the same line one frame before")
    different = v != p
    at, owner = x[different], row[different]
    changed = np.bincount(owner, minlength=rows)
    end = np.cumsum(changed)
    some = changed > 0
    pick = lambda a, k: np.append(a, 0)[np.minimum(k, len(a))]
    never = lambda bad: np.bincount(row[bad], minlength=rows) == 0
    has = (p & 255) != 0
    ratio, rrow = (v & 255)[has] / (p & 255)[has], row[has]
    begin = np.flatnonzero(np.append(True, rrow[1:] != rrow[:-1])) if len(rrow) else np.zeros(0, dtype=np.int64)
    cells = np.full((3, rows), np.nan)
    if len(rrow):
        cells[:, rrow[begin]] = ratio[begin], np.minimum.reduceat(ratio, begin), np.maximum.reduceat(ratio, begin)
    masked = lambda a, keep, t: pa.array(a, t, mask=~keep)
    return [
        pa.array(seen), masked(pick(at, end - changed), some, pa.int32()), masked(pick(at, end - 1), some, pa.int32()), pa.array(changed), masked(never((v >> 8) != (p >> 8)), seen, pa.bool_()),
        masked(~never(~has & ((v & 255) != 0)), seen, pa.bool_()), *(masked(c, ~np.isnan(c), pa.float64()) for c in cells),
    ]


def _with_facts(df: DataFrame, kept: list[str], binary: list[str], facts: str, of) -> DataFrame:
    """`kept` columns and the facts that `of(batch columns of binary)` gives, batch by batch."""
    schema = T.StructType([*(df.schema[c] for c in kept), *T._parse_datatype_string(facts).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *of(*b.columns[len(kept) :])], schema.names)

    return df.select(*kept, *binary).mapInArrow(run, schema)


def line_facts(lines: DataFrame) -> DataFrame:
    """Facts of every line (file_id, frame_index, y, rgba): its runs, and its change from the same line one frame before. One shuffle, by file and line."""
    w = Window.partitionBy("file_id", "y").orderBy("frame_index")
    paired = lines.select(*KEYS, "y", "rgba").withColumn("_prev", F.lag("rgba").over(w))

    def of(rgba: pa.Array, before: pa.Array) -> list[pa.Array]:
        v, row = _cells(rgba, 4)
        return [*_run_facts(v, row, len(rgba)), *_change_facts(v, row, before, len(rgba))]

    return _with_facts(paired, [*KEYS, "y"], ["rgba", "_prev"], f"{_RUNS}, {_CHANGE}", of)


def crop_facts(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Facts of the runs of each line within its frame's box (x, y, w, h): lines outside are dropped, and no line is cut apart."""
    b = boxes.select(*KEYS, F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("w").alias("_w"), F.col("h").alias("_h"))
    inside = lines.join(checked_broadcast(b), KEYS).filter("y >= _y AND y < _y + _h")

    def of(rgba: pa.Array, left: pa.Array, wide: pa.Array) -> list[pa.Array]:
        v, row = _cells(rgba, 4)
        x = np.arange(len(row)) - np.searchsorted(row, row)
        low, n = np.asarray(left)[row], np.asarray(wide)[row]
        keep = (x >= low) & (x < low + n)
        return _run_facts(v[keep], row[keep], len(rgba))

    return _with_facts(inside, [*KEYS, "y"], ["rgba", "_x", "_w"], _RUNS, of)


def merge_lines(facts: DataFrame, more: list[Column]) -> DataFrame:
    """Tokens and values of each frame's runs, joined over its lines, beside the aggregates `more`.

    `more` are sums, minima and the like under names `m_...`, taken twice: over
    the lines that share a run, then over the frame; so they must merge. One
    shuffle, by frame, of one row a line.
    """
    w = Window.partitionBy(*KEYS).orderBy("y")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    joined = (F.coalesce(F.lag("r").over(w), F.lit(0)) > 0) & (F.col("r") > 0) & F.col("first").eqNullSafe(F.lag("last").over(w))
    f = facts.withColumn("_j", joined.cast("long")).withColumn("_g", F.coalesce(F.sum(F.col("r") - F.col("_j")).over(before), F.lit(0)) - F.col("_j"))
    # the first run of a line, and its last one if that is another
    end = lambda g, n, is_first: F.struct(g.alias("_g"), n.alias("_n"), F.lit(is_first).alias("_head"))
    ends = F.array(end(F.col("_g"), F.col("n_first"), True), end(F.col("_g") + F.col("r") - 1, F.col("n_last"), False))
    f = f.withColumn("_e", F.explode(F.when(F.col("r") > 1, ends).otherwise(F.slice(ends, 1, 1)))).withColumns({"_g": F.col("_e._g"), "_n": F.col("_e._n"), "_head": F.col("_e._head")})
    once = lambda c: F.sum(F.when(F.col("_head"), F.col(c)).otherwise(0))
    names = [c._jc.toString().rpartition(" AS ")[2] for c in more]
    runs_ = f.groupBy(*KEYS, "_g").agg(F.sum("_n").alias("_n"), once("inner").alias("_t"), once("inner_n").alias("_v"), *more)
    again = [_AGAIN[n.rpartition("_")[2]](n).alias(n) for n in names]
    return runs_.groupBy(*KEYS).agg(F.sum(F.ceil(F.col("_n") / CAP) + F.col("_t")).cast("long").alias("tokens"), F.sum(F.col("_n") + F.col("_v")).cast("long").alias("n_values"), *again)


#: How an aggregate is taken again, by the end of its name.
_AGAIN = {"min": F.min, "max": F.max, "all": F.bool_and, "any": F.bool_or}


def _frame_facts(lines: DataFrame) -> DataFrame:
    """Of each frame: tokens and values, box of change, whether a frame came before, and its alpha facts."""
    shown = F.col("ratio").isNotNull()
    more = [
        F.min("x0").alias("m_x_min"), F.max("x1").alias("m_x_max"), F.min(F.when(F.col("changed") > 0, F.col("y"))).alias("m_y_min"), F.max(F.when(F.col("changed") > 0, F.col("y"))).alias("m_y_max"), F.max("seen").alias("m_seen_max"),
        F.bool_and("same").alias("m_same_all"), F.bool_or("appears").alias("m_appears_any"), F.min("low").alias("m_low_min"), F.max("high").alias("m_high_max"), F.min(F.when(shown, F.struct("y", "ratio"))).alias("m_ratio_min"),
    ]
    f = merge_lines(line_facts(lines), more)
    first = F.col("m_ratio_min.ratio")
    near = first.isNull() | ((F.col("m_high_max") - first <= 1.0 / 255.0) & (first - F.col("m_low_min") <= 1.0 / 255.0))
    value = F.when(first.isNull(), 255).otherwise(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), first)) * 255, 0).cast("int"))
    return f.select(
        *KEYS, "tokens", "n_values", F.col("m_seen_max").alias("seen"), F.col("m_x_min").alias("x"), F.col("m_y_min").cast("int").alias("y"), (F.col("m_x_max") - F.col("m_x_min") + 1).alias("w"), (F.col("m_y_max") - F.col("m_y_min") + 1).cast("int").alias("h"),
        F.when(F.col("m_seen_max") & F.col("m_same_all") & ~F.col("m_appears_any") & near, value).alias("alpha"),
    )


def change_bbox_lines(lines: DataFrame) -> DataFrame:
    """`change_bbox` from lines."""
    return _frame_facts(lines).filter("w IS NOT NULL").select(*KEYS, *"xywh")


def uniform_alpha_lines(lines: DataFrame) -> DataFrame:
    """`uniform_alpha` from lines."""
    return _frame_facts(lines).filter("seen").select(*KEYS, "alpha")


def data_bytes(tokens: Column, values: Column, indexed: bool) -> Column:
    """Bytes of a unit's data: run-length tokens if strictly smaller than the values as they are."""
    return F.least(values * (1 if indexed else 4), tokens * (3 if indexed else 6))


def choose_frames_lines(lines: DataFrame, *, indexed: bool = False, force_full_every: int = 0, editor: bool = False) -> DataFrame:
    """`choose_frames` (or, with `editor`, `choose_export_frames`) from lines (file_id, frame_index, y, rgba).

    Every frame of a file has the same lines. Indices and colours have the same
    runs, so `indexed` changes sizes only. Three shuffles: lines by file and
    line, their facts by frame, and the facts of lines within boxes by frame,
    which bring what is known of the frame along. A frame of any size is spread
    over tasks as lines; of a line one row of facts goes to its frame.
    """
    whole = staged(_frame_facts(lines))
    boxes = whole.filter("w IS NOT NULL")
    # what is known of the frame stands before its first line
    one = lambda c: F.when(F.col("_known"), F.col(c))
    zeros = {c: F.lit(0).cast("long") for c in ("r", "first", "last", "n_first", "n_last", "inner", "inner_n")}
    facts = ["tokens", "n_values", "seen", *"xwh", "alpha"]
    known = whole.select(*KEYS, F.lit(-1).alias("y"), *(c.alias(n) for n, c in zeros.items()), *(F.col(c).alias(f"f_{c}") for c in facts), F.col("y").alias("f_y"), F.lit(True).alias("_known"))
    cut = crop_facts(lines, boxes).withColumn("_known", F.lit(False))
    both = cut.unionByName(known, allowMissingColumns=True)
    names = [*facts, "y"]
    out = merge_lines(both, [F.max(one(f"f_{c}")).alias(f"m_{c}_max") for c in names])
    out = out.select(*KEYS, F.when(F.col("n_values") > 0, data_bytes(F.col("tokens"), F.col("n_values"), indexed)).alias("_delta"), *(F.col(f"m_{c}_max").alias(c if c not in ("tokens", "n_values") else f"_{c}") for c in names))
    out = out.select(*KEYS, *"xywh", "alpha", F.when(F.col("seen"), False).otherwise(True).alias("_first"), (data_bytes(F.col("_tokens"), F.col("_n_values"), indexed) + 16).alias("full_bytes"), (F.col("_delta") + 24).alias("delta_bytes"))
    return decide(out, force_full_every=force_full_every, editor=editor)


def lines_of(pixels: DataFrame, color: str = "color") -> DataFrame:
    """Lines (file_id, frame_index, y, rgba) of pixels (x, y and a packed colour)."""
    cells = F.array_sort(F.collect_list(F.struct("x", F.lpad(F.hex(color), 8, "0").alias("t"))))
    return pixels.groupBy(*KEYS, "y").agg(F.unhex(F.array_join(F.transform(cells, lambda c: c["t"]), "")).alias("rgba"))


def _tokens(image: np.ndarray) -> int:
    """Run-length tokens of an image in line order."""
    v = image.ravel()
    n = np.diff(np.append(np.flatnonzero(np.append(True, v[1:] != v[:-1])), len(v)))
    return int((-(-n // CAP)).sum())


def _least_bytes(image: np.ndarray, indexed: bool) -> int:
    return min(image.size * (1 if indexed else 4), _tokens(image) * (3 if indexed else 6))


def exact_alpha(before: np.ndarray, now: np.ndarray) -> int | None:
    """The alpha under which `before` (packed RGBA) shows exactly as `now`, a * alpha div 255 in every pixel; null if there is none.

    Of several, the nearest to 255 times the ratio of the first pixel that is
    not transparent in `before`. Colours must be equal everywhere.
    """
    a, b = before & 255, now & 255
    seen = a > 0
    if ((before >> 8) != (now >> 8)).any() or b[~seen].any():
        return None
    a, b = a[seen], b[seen]
    if not len(a):
        return 255
    low, high = int((-(-255 * b // a)).max()), int(np.minimum(255, -(-255 * (b + 1) // a) - 1).min())
    return min(max(round(255 * (int(b[0]) / int(a[0]))), low), high) if low <= high else None


class _Choice:
    """Choices of one segment in frame order: the canvas that a decoder holds, and the alpha it shows it under."""

    def __init__(self, indexed: bool):
        self.indexed, self.canvas, self.alpha = indexed, None, 255

    def frame(self, image: np.ndarray) -> tuple:
        """frame_type, alpha, full_bytes, delta_bytes, payload_bytes, x, y, w, h of the next frame."""
        full = _least_bytes(image, self.indexed) + 16
        delta, box, alpha = None, (None,) * 4, None
        if self.canvas is None:
            kind = FULL
        elif (alpha := exact_alpha(self.canvas.ravel(), image.ravel())) is not None:
            kind = TRANSFORM
        elif self.alpha != 255:
            kind = FULL  # only a FULL frame takes a fade back
        else:
            y, x = np.nonzero(self.canvas != image)
            box = int(x.min()), int(y.min()), int(x.max() - x.min() + 1), int(y.max() - y.min() + 1)
            delta = _least_bytes(image[box[1] : box[1] + box[3], box[0] : box[0] + box[2]], self.indexed) + 24
            kind = DELTA if delta < full else FULL
        if kind == TRANSFORM:
            self.alpha = alpha
        else:
            self.canvas, self.alpha = image, 255
        return kind, alpha, full, delta, {FULL: full, DELTA: delta, TRANSFORM: 28}[kind], *(box if kind == DELTA else (None,) * 4)


def choose_frames_absolute(lines: DataFrame, *, indexed: bool = False, force_full_every: int = 0) -> DataFrame:
    """Frame choice whose fades come back exactly: TRANSFORM where one alpha over the last FULL or DELTA frame gives the frame to the last digit.

    Each choice depends on those before it, so a segment (a file, or
    `force_full_every` frames of one) is worked through in frame order; its
    first frame is FULL. Lines stream by in order, and a task holds the canvas
    and one frame. After a fade, what isn't a fade of the same frame is FULL,
    as a DELTA would show under the old alpha. One shuffle, by segment.
    """
    schema = T.StructType([lines.schema["file_id"], lines.schema["frame_index"], *T._parse_datatype_string("frame_type int, alpha int, full_bytes long, delta_bytes long, payload_bytes long, x int, y int, w int, h int").fields])
    segment = F.floor(F.col("frame_index") / force_full_every) if force_full_every > 0 else F.lit(0)
    dealt = lines.select("file_id", segment.cast("long").alias("_segment"), "frame_index", "y", "rgba").repartition("file_id", "_segment").sortWithinPartitions("file_id", "_segment", "frame_index", "y")

    def table(rows: list[tuple]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kinds)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, frame, held, choice, out = None, None, [], None, []

        def close() -> None:
            if held:
                out.append((unit[0], frame, *choice.frame(np.stack([np.frombuffer(x, dtype=">u4").astype(np.int64) for x in held]))))
                held.clear()

        for b in batches:
            for file, segment_, index, _, rgba in zip(*(c.to_pylist() for c in b.columns)):
                if choice is None or (file, segment_) != unit:
                    close()
                    unit, frame, choice = (file, segment_), index, _Choice(indexed)
                elif index != frame:
                    close()
                    frame = index
                held.append(rgba)
            if out:
                yield table(out)
                out.clear()
        close()
        if out:
            yield table(out)

    return dealt.mapInArrow(run, schema)


def sparse_lines(pixels: DataFrame, widths: DataFrame, keys: list[str]) -> DataFrame:
    """Lines (keys, y, rgba) of pixels (keys, x, y, r, g, b, a) of which some are missing, which stand for transparent ones; `widths`: the first key and out_width. Lines without any pixel have no row."""
    cell = F.concat(*(F.lpad(F.hex(F.col(c).cast("long")), 2, "0") for c in "rgba"))
    held = pixels.groupBy(*keys, "y").agg(F.map_from_entries(F.collect_list(F.struct(F.col("x").cast("int").alias("x"), cell.alias("t")))).alias("_m")).join(widths.select(keys[0], "out_width"), keys[0])
    return held.select(*keys, "y", F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.col("out_width") - 1), lambda x: F.coalesce(F.try_element_at("_m", x), F.lit("00000000"))), "")).alias("rgba"))


def packed(image: bytes, colors: bytes | None = None) -> tuple[bytes, int]:
    """Data and encoding of a unit's RGBA bytes: tokens (1; of indices 3) if strictly smaller than raw (0; 2). `colors`: the palette, RGBA by index."""
    v = np.frombuffer(image, dtype=np.uint32)
    if colors is not None:
        table = np.frombuffer(colors, dtype=np.uint32)
        order = np.argsort(table, kind="stable")
        v = order[np.searchsorted(table[order], v)].astype(np.uint8)
    start = np.flatnonzero(np.append(len(v) > 0, v[1:] != v[:-1])) if len(v) else np.zeros(0, dtype=np.int64)
    n = np.diff(np.append(start, len(v)))
    k = -(-n // CAP)
    width = v.itemsize
    if (2 + width) * int(k.sum()) >= width * len(v):
        return v.tobytes(), 0 if colors is None else 2
    value = np.repeat(v[start], k)
    length = np.full(len(value), CAP, dtype="<u2")
    length[np.cumsum(k) - 1] = n - (k - 1) * CAP
    tokens = np.concatenate([length[:, None].view(np.uint8), value[:, None].view(np.uint8)], axis=1)
    return tokens.tobytes(), 1 if colors is None else 3


def unit_data(lines: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """`data` and `encoding` of each frame of `lines` (file_id, frame_index, y, rgba; with `colors`, the file's palette, as indices), or of its box (x, y, w, h). A frame's lines stream by in order; its data is one value of the file format."""
    if boxes is not None:
        b = boxes.select(*KEYS, F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("w").alias("_w"), F.col("h").alias("_h"))
        lines = lines.join(checked_broadcast(b), KEYS).filter("y >= _y AND y < _y + _h").withColumn("rgba", F.substring("rgba", F.col("_x") * 4 + 1, F.col("_w") * 4))
    colors = F.col("colors") if "colors" in lines.columns else F.lit(None).cast("binary")
    dealt = lines.select(*KEYS, "y", "rgba", colors.alias("colors")).repartition(*KEYS).sortWithinPartitions(*KEYS, "y")
    schema = T.StructType([*(lines.schema[c] for c in KEYS), *T._parse_datatype_string("data binary, encoding int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, unit, held, table, out = to_arrow_schema(schema), None, [], None, []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), kinds)], schema.names)
        for b in batches:
            for file, frame, _, rgba, colors_ in zip(*(c.to_pylist() for c in b.columns)):
                if (file, frame) != unit:
                    if held:
                        out.append((*unit, *packed(b"".join(held), table)))
                    unit, held, table = (file, frame), [], colors_
                held.append(rgba)
            if out:
                yield flush()
                out = []
        if held:
            out.append((*unit, *packed(b"".join(held), table)))
            yield flush()

    return dealt.mapInArrow(run, schema)
