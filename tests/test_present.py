"""Shown canvases against whole images that are scaled, turned and pasted."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.jobs import render
from framelake.operators import dense, present
from framelake.sources import media

ONE = 65536


def _pasted(image, px, py, alpha, sx, sy, rotation, method, turn_method):
    """The same by way of the whole transformed image."""
    h, w = image.shape[:2]
    out = np.zeros_like(image)
    if sx <= 0 or sy <= 0:
        return out
    nw, nh = max(1, round(w * sx / ONE)), max(1, round(h * sy / ONE))
    big = image if (nw, nh) == (w, h) else dense.resized(image, nw, nh, method)
    if rotation:
        big = dense.turned(big, rotation / ONE, turn_method)
    x, y = round(px / ONE), round(py / ONE)
    for j in range(big.shape[0]):
        for i in range(big.shape[1]):
            if 0 <= x + i < w and 0 <= y + j < h:
                out[y + j, x + i] = big[j, i]
    out[..., 3] = out[..., 3].astype(int) * max(0, min(255, alpha)) // 255
    return out


@pytest.mark.parametrize("method,turn_method", [("smooth", "nearest"), ("bicubic", "bicubic"), ("nearest", "nearest"), ("lanczos", "bicubic")])
def test_window_is_that_of_the_whole_image(method, turn_method):
    rng = np.random.default_rng(3)
    for _ in range(80):
        image = rng.integers(0, 256, size=(int(rng.integers(1, 12)), int(rng.integers(1, 12)), 4)).astype(np.uint8)
        image[rng.random(image.shape[:2]) < 0.3, 3] = 0
        px, py = (int(x) for x in rng.integers(-9 * ONE, 9 * ONE, size=2))
        sx, sy = (int(rng.choice([0, ONE // 3, ONE, int(rng.integers(1, 5 * ONE))], p=[0.05, 0.2, 0.25, 0.5])) for _ in range(2))
        args = px, py, int(rng.integers(0, 300)), sx, sy, int(rng.choice([0, 90, -45, 30.5, 400])  * ONE), method, turn_method
        assert (present.present(image, *args) == _pasted(image, *args)).all(), args


def test_smooth_taps():
    at, w = dense.axis_taps(8, 4, "smooth")
    assert [sorted((int(a), float(x)) for a, x in zip(p, q) if x) for p, q in zip(at, w)] == [[(2 * k, 0.5), (2 * k + 1, 0.5)] for k in range(4)]
    line = np.zeros((1, 2, 4), dtype=np.uint8)
    line[0, 1], line[..., 3] = (100, 100, 100, 255), 255
    assert dense.resized(line, 4, 1, "smooth")[0, :, 0].tolist() == [0, 25, 75, 100]
    for old, new in ((7, 3), (5, 9), (1, 6), (6, 1), (10, 7)):
        w = dense.axis_taps(old, new, "smooth")[1]
        assert np.allclose(w.sum(axis=1), 1) and (w >= 0).all()


def test_large_scales_stay_within_the_window():
    """A canvas at 2,000 times its size has 400 million pixels; what shows of it are 100."""
    image = np.arange(400, dtype=np.int64).reshape(10, 10, 4).astype(np.uint8)
    image[..., 3] = 255
    out = present.present(image, -5_000 * ONE, -9_000 * ONE, 255, 2_000 * ONE, 2_000 * ONE, 0)
    # place 5,000 is (5000.5 / 2000 - 0.5) = 2.0003 of the source, place 9,009 is 4.0048: less than half a level from pixel (2, 4)
    assert (out[..., :3] == image[4, 2, :3]).all()
    assert present.present(image, -5_000 * ONE, -9_000 * ONE, 255, 2_000 * ONE, 2_000 * ONE, 33 * ONE).shape == (10, 10, 4)


def _file(spark, frames):
    """A file of one-colour FULL frames and of TRANSFORM frames."""
    c = spark.createDataFrame(frames, "file_id string, frame_index int, frame_type int, transform_flags int, pos_x int, pos_y int, alpha int, scale_x int, scale_y int, rotation_deg int")
    c = c.withColumns({"duration_num": F.lit(1), "duration_den": F.lit(1), "encoding": F.lit(0), "width": F.lit(3), "height": F.lit(5), **{n: F.lit(None).cast("int") for n in "xywh"}})
    data = c.filter("frame_type = 1").select("file_id", "frame_index", F.unhex(F.repeat(F.lit("C8640AFF"), 15)).alias("data"))
    sizes = c.select("file_id").distinct().select("file_id", F.lit(0).alias("flags"), F.lit(3).alias("canvas_width"), F.lit(5).alias("canvas_height"), F.lit(1).alias("fps_num"), F.lit(1).alias("fps_den"))
    none = sizes.select("file_id", F.lit(0).alias("color_index"), F.lit(0).cast("long").alias("color")).filter("false")
    return media.assemble_files(sizes, none, media.frame_blobs(c, data, data.filter("false")))


@pytest.mark.parametrize("band_lines", [2, 256])
def test_states_of_a_segment(spark, band_lines):
    """Fields hold until a FULL frame; only flagged ones count; the background shows through."""
    plain = (0, 0, 255, ONE, ONE, 0)
    files = _file(spark, [
        ("f", 0, 1, 0, *plain), ("f", 1, 3, 1, ONE, 7 * ONE, 9, 0, 0, 5), ("f", 2, 3, 2 + 4, 9 * ONE, -ONE, 51, 0, 0, 5), ("f", 3, 3, 8 + 16, 0, 0, 0, ONE // 3, ONE, 0),
        ("f", 4, 3, 0, 5, 5, 5, 5, 5, 5), ("f", 5, 3, 8, 0, 0, 0, -1, 0, 0), ("f", 6, 1, 0, *plain), ("f", 7, 3, 32, 0, 0, 0, 0, 0, 90 * ONE),
    ])
    got = {r.frame_index: np.frombuffer(r.rgba, dtype=np.uint8).reshape(5, 3, 4) for r in render.show_animation(files, band_lines=band_lines).collect()}
    full = np.tile(np.array([200, 100, 10, 255], dtype=np.uint8), (5, 3, 1))
    want = {0: full, 6: full, 5: np.zeros_like(full)}
    want[1] = full.copy()
    want[1][:, 0] = 0
    want[2] = want[1].copy()
    want[2][4] = 0
    want[2][..., 3] = want[2][..., 3].astype(int) * 51 // 255
    want[3] = np.zeros_like(full)
    want[3][:4, 1] = (200, 100, 10, 51)
    want[4] = want[3]
    want[7] = np.zeros_like(full)
    want[7][:3] = full[:3]
    assert set(got) == set(want) and all((got[k] == want[k]).all() for k in want)
    over = {r.frame_index: np.frombuffer(r.rgba, dtype=np.uint8).reshape(5, 3, 4) for r in render.show_animation(files, background=(0, 50, 110), band_lines=band_lines).collect()}
    assert over[3][0, 1].tolist() == [40, 60, 90, 255] and over[3][4, 1].tolist() == over[5][0, 0].tolist() == [0, 50, 110, 255] and (over[0] == full).all()


def test_missing_values(spark):
    """A state that is null counts as its default; an empty canvas stays; no rows give no rows."""
    fields = ", ".join(f"{c} long" for c in present.STATE)
    df = spark.createDataFrame([(1, 1, 1, *[None] * 6, bytearray(b"abcd")), (2, 0, 0, *[5] * 6, bytearray()), (3, 1, 1, *[5] * 6, None)], f"id int, width int, height int, {fields}, rgba binary")
    assert {r.id: r.rgba and bytes(r.rgba) for r in present.present_frames(df, ["id"]).collect()} == {1: b"abcd", 2: bytearray(), 3: None}
    assert present.present_frames(df.limit(0), ["id"]).count() == 0
