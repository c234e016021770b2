"""Replay in bands against replay on whole canvases, pixel by pixel."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import bands

COLORS = np.array([0x01020304, 0xFF0000FF, 0x00FF0080], dtype=">u4")


def _encoded(values, encoding):
    """Indices into COLORS as data of an encoding."""
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    n = np.diff(np.append(starts, len(values)))
    tokens = lambda body: b"".join(int(k).to_bytes(2, "little") + body(values[s]) for k, s in zip(n, starts))
    return [COLORS[values].tobytes(), tokens(lambda v: COLORS[[v]].tobytes()), values.astype(np.uint8).tobytes(), tokens(lambda v: bytes([v]))][encoding]


@pytest.mark.parametrize("encoding", range(4))
def test_cut_data_is_the_part(encoding):
    rng = np.random.default_rng(encoding)
    for _ in range(60):
        values = np.repeat(rng.integers(0, 3, size=20), rng.integers(1, 9, size=20))
        data = _encoded(values, encoding)
        a, b = sorted(rng.integers(0, len(values) + 1, size=2))
        if a < b:
            got = bands.open_data(bands.cut_data(data, encoding, int(a), int(b)), encoding, COLORS.tobytes())
            assert got.tobytes() == COLORS[values[a:b]].tobytes()
    long = np.zeros(65_535, dtype=np.int64)
    assert len(bands.open_data(bands.cut_data(_encoded(long, encoding), encoding, 300, 65_000), encoding, COLORS.tobytes())) == 64_700


def test_indices_beyond_the_palette_are_transparent():
    assert bands.open_data(bytes([0, 2, 9]), 2, COLORS[:2].tobytes()).tobytes() == COLORS[:1].tobytes() + bytes(8)
    assert bands.open_data(bytes([1]), 2, None).tolist() == [0]


@pytest.fixture(scope="module")
def movie(spark):
    """Two files of several segments; rects overlap, and some reach beyond the canvas' lower and right edge."""
    rng = np.random.default_rng(5)
    w, h, frames, writes, want = 9, 13, [], [], {}
    for f in "pq":
        canvas = None
        segment = 0
        for k in range(30):
            full = k % 11 == 0
            if full:
                segment, canvas = segment + 1, np.zeros((h, w), dtype=">u4")
            alpha = int(rng.choice([255, 255, 100]))
            frames.append((f, segment, k, alpha, w, h))
            for r in range(1 if full else int(rng.integers(0, 4))):
                x, y = (0, 0) if full else (int(rng.integers(0, w)), int(rng.integers(0, h)))
                rw, rh = (w, int(rng.integers(1, h + 1))) if full else (int(rng.integers(1, w + 1)), int(rng.integers(1, h + 3)))
                values, encoding = rng.integers(0, 3, size=rw * rh), int(rng.integers(0, 4))
                writes.append((f, segment, k, r, x, y, rw, rh, encoding, _encoded(values, encoding), COLORS.tobytes() if encoding > 1 else None))
                canvas[y : y + rh, x : x + rw] = COLORS[values].reshape(rh, rw)[: h - y, : w - x]
            shown = canvas.copy().view(np.uint8).reshape(h, w, 4)
            shown[:, :, 3] = shown[:, :, 3].astype(int) * alpha // 255
            want[f, k] = canvas.tobytes(), shown.tobytes()
    frames = spark.createDataFrame(frames, "file_id string, segment long, frame_index int, alpha int, canvas_width int, canvas_height int").repartition(3)
    writes = spark.createDataFrame(writes, "file_id string, segment long, frame_index int, rect_index int, x int, y int, w int, h int, encoding int, data binary, colors binary").repartition(4)
    return frames, writes, want


@pytest.mark.parametrize("lines", [1, 4, 13, 256])
def test_bands_give_whole_canvases(spark, movie, monkeypatch, lines):
    frames, writes, want = movie
    monkeypatch.setattr(bands, "DENSE_BYTES", 2_000)
    out = bands.replay_bands(writes, frames, lines)
    assert out.select("band").distinct().count() == -(-13 // lines)
    got = {(r.file_id, r.frame_index): (bytes(r.rgba), bytes(r.shown)) for r in bands.join_bands(out).collect()}
    assert got == want


def test_one_segment_goes_to_many_tasks(spark):
    """A file of one segment and 400 lines: its bands are dealt to several partitions; no frame is lost where nothing is written."""
    frames = spark.range(20).select(F.lit("f").alias("file_id"), F.lit(1).alias("segment"), F.col("id").cast("int").alias("frame_index"), F.lit(255).alias("alpha"), F.lit(3).alias("canvas_width"), F.lit(400).alias("canvas_height"))
    data = _encoded(np.ones(1_200, dtype=np.int64), 1)
    writes = spark.createDataFrame([("f", 1, 0, 0, 0, 0, 3, 400, 1, data, None)], "file_id string, segment int, frame_index int, rect_index int, x int, y int, w int, h int, encoding int, data binary, colors binary")
    out = bands.replay_bands(writes, frames, 16).withColumn("p", F.spark_partition_id())
    rows = out.collect()
    assert len(rows) == 20 * 25 and len({r.p for r in rows}) > 3
    assert {bytes(r.rgba) for r in rows} == {COLORS[1].tobytes() * 48}
    assert bands.join_bands(bands.replay_bands(writes.limit(0), frames.limit(0))).count() == 0
