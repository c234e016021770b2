"""Dense replay in bands of lines: the lines of a canvas don't depend on one another, so a long segment is spread over as many tasks as it has bands.

Frames are cut where a band ends while their data is still packed; bytes are
opened inside the task that replays them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Lines of a band, and bytes of canvases that a task hands over at a time.
BAND, DENSE_BYTES = 256, 64 << 20

#: Bytes of a value and of a run-length token, by encoding: raw colours, colour tokens, raw indices, index tokens.
_VALUE, _TOKEN = (4, 4, 1, 1), (0, 6, 0, 3)
_KEYS = ["file_id", "segment", "band"]


def _lengths(cells: np.ndarray) -> np.ndarray:
    """Lengths of tokens, 16 bits little-endian at their beginning."""
    return cells[:, :2].astype(np.int64) @ np.array([1, 256])


def cut_data(data: bytes, encoding: int, first: int, last: int) -> bytes:
    """The part of a unit's data for its values first .. last - 1, in the same encoding: tokens at the edges get shorter."""
    if not _TOKEN[encoding]:
        return data[first * _VALUE[encoding] : last * _VALUE[encoding]]
    k = _TOKEN[encoding]
    cells = np.frombuffer(data, dtype=np.uint8, count=len(data) // k * k).reshape(-1, k)
    n = _lengths(cells)
    ends = np.cumsum(n)
    a, b = np.searchsorted(ends, first, side="right"), np.searchsorted(ends, last, side="left")
    part = cells[a : b + 1].copy()
    left = np.minimum(ends[a : b + 1], last) - np.maximum(ends[a : b + 1] - n[a : b + 1], first)
    part[:, 0], part[:, 1] = left & 255, left >> 8
    return part.tobytes()


def open_data(data: bytes, encoding: int, colors: bytes | None) -> np.ndarray:
    """RGBA bytes of each value of a unit's data, four in a number. `colors`: the file's palette; an index beyond it is transparent, as rule `index_range` finds such frames."""
    if encoding == 0:
        return np.frombuffer(data, dtype=np.uint32, count=len(data) // 4)
    n = None
    if k := _TOKEN[encoding]:
        cells = np.frombuffer(data, dtype=np.uint8, count=len(data) // k * k).reshape(-1, k)
        n, data = _lengths(cells), np.ascontiguousarray(cells[:, 2:]).tobytes()
    if _VALUE[encoding] == 4:
        return np.repeat(np.frombuffer(data, dtype=np.uint32), n)
    table = np.zeros(256, dtype=np.uint32)
    known = np.frombuffer(colors or b"", dtype=np.uint32)[:256]
    table[: len(known)] = known
    values = table[np.frombuffer(data, dtype=np.uint8)]
    return values if n is None else np.repeat(values, n)


def cut_to_bands(writes: DataFrame, band_lines: int = BAND) -> DataFrame:
    """Writes (file_id, segment, frame_index, rect_index, x, y, w, h, encoding, data, canvas_height and what else they carry) with one row for each band they touch: `band`, y and h within the canvas, and that band's data. Lines below the canvas go."""
    names = writes.columns
    schema = T.StructType([*writes.schema.fields, T.StructField("band", T.IntegerType())])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for b in batches:
            for row in b.to_pylist():
                bottom = min(row["y"] + row["h"], row["canvas_height"])
                for band in range(row["y"] // band_lines, (bottom - 1) // band_lines + 1 if bottom > row["y"] else 0):
                    top, end = max(row["y"], band * band_lines), min(bottom, (band + 1) * band_lines)
                    first, last = (top - row["y"]) * row["w"], (end - row["y"]) * row["w"]
                    out.append(row | {"y": top, "h": end - top, "data": cut_data(row["data"], row["encoding"], first, last), "band": band})
                    held += 2_000 + len(out[-1]["data"])
                if held >= DENSE_BYTES:
                    yield pa.RecordBatch.from_pylist(out, kinds)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)

    return writes.filter("data IS NOT NULL AND w > 0 AND h > 0").select(*names).mapInArrow(run, schema)


def replay_bands(writes: DataFrame, frames: DataFrame, band_lines: int = BAND, carry: tuple[str, ...] = ()) -> DataFrame:
    """H3: each band of the canvas (file_id, frame_index, band, rgba raw, shown under the frame's alpha) at every frame.

    `frames`: file_id, segment, frame_index, alpha, canvas_width,
    canvas_height, all frames. `writes`: file_id, segment, frame_index,
    rect_index, x, y, w, h, encoding, data (packed), colors (the palette, RGBA
    by index, or null). Columns of `frames` named in `carry` come along. A task
    holds one band of one canvas and streams what is written to it in order, so
    neither a segment's length nor a canvas' height counts; one shuffle, of
    packed bytes, by (file, segment, band).
    """
    own = list(dict.fromkeys(["alpha", "canvas_width", "canvas_height", *carry]))
    size = frames.select("file_id", "segment", "frame_index", *own)
    last = F.floor((F.col("canvas_height") - 1) / band_lines).cast("int")
    every = size.filter("canvas_height > 0").withColumn("band", F.explode(F.sequence(F.lit(0), last)))
    heights = size.select("file_id", "canvas_height").distinct()
    cut = cut_to_bands(writes.join(heights, "file_id"), band_lines)
    rows = every.unionByName(cut.drop("canvas_height"), allowMissingColumns=True)
    order = ["frame_index", F.col("rect_index").asc_nulls_first()]  # a frame's own row comes before what it writes
    columns = [*_KEYS, "frame_index", "rect_index", *own, *"xywh", "encoding", "data", "colors"]
    # a number of partitions that adaptive planning leaves as it is: packed bytes don't tell how much work they hold
    n = int(writes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*columns).repartition(n, *_KEYS).sortWithinPartitions(*_KEYS, *order)
    schema = T.StructType([frames.schema["file_id"], *T._parse_datatype_string("frame_index int, band int, rgba binary, shown binary").fields, *(frames.schema[c] for c in carry)])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = []
        key = frame = canvas = None
        alpha, out = 255, []

        def close() -> None:
            plain = canvas.tobytes()
            shown = plain
            if alpha != 255:
                faded = canvas.copy().view(np.uint8).reshape(*canvas.shape, 4)
                faded[:, :, 3] = faded[:, :, 3].astype(np.int64) * alpha // 255
                shown = faded.tobytes()
            out.append((key[0], frame, key[2], plain, shown, *carried))

        def table() -> pa.RecordBatch:
            rows_ = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), kinds)], schema.names)
            out.clear()
            return rows_

        for b in batches:
            for row in b.to_pylist():
                at = (row["file_id"], row["segment"], row["band"])
                if at != key or row["frame_index"] != frame:
                    if canvas is not None:
                        close()
                        if len(out) * (8 * canvas.size + 500) >= DENSE_BYTES:
                            yield table()
                    if at != key:
                        key, canvas = at, np.zeros((min(band_lines, row["canvas_height"] - row["band"] * band_lines), row["canvas_width"]), dtype=np.uint32)
                    frame, alpha, carried = row["frame_index"], row["alpha"], [row[c] for c in carry]  # of the frame's own row, which comes first
                if row["data"] is not None:
                    x, w, h, y = row["x"], row["w"], row["h"], row["y"] - row["band"] * band_lines
                    canvas[y : y + h, x : x + w] = open_data(row["data"], row["encoding"], row["colors"])[: w * h].reshape(h, w)[:, : canvas.shape[1] - x]
        if canvas is not None:
            close()
        if out:
            yield table()

    return dealt.mapInArrow(run, schema)


def join_bands(bands: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Whole canvases (file_id, frame_index, rgba, shown, and what the bands carry) from their bands. A canvas is one value here, so of 2 GB at most; the bands themselves have no such limit."""
    cells = F.array_sort(F.collect_list(F.struct("band", "rgba", "shown")))
    whole = bands.groupBy("file_id", "frame_index").agg(cells.alias("_c"), *(F.first(c).alias(c) for c in carry))
    schema = T.StructType([bands.schema["file_id"], bands.schema["frame_index"], T.StructField("rgba", T.BinaryType()), T.StructField("shown", T.BinaryType()), *(bands.schema[c] for c in carry)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, int(b.num_rows * DENSE_BYTES / max(1, b.nbytes)))
            for k in range(0, b.num_rows, step):
                part = b.slice(k, step)
                cells = part.column(2).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([b"".join(x[n] for x in c) for c in cells], pa.binary()) for n in ("rgba", "shown")), *part.columns[3:]], schema.names)

    return whole.mapInArrow(run, schema)
