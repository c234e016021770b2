"""Whole images warped and layered in their tasks against the forms with a row for each tap and pixel."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.jobs import render
from framelake.operators import dense
from framelake.operators.composite import composite
from framelake.operators.warp import resize_rasters, rotate_rasters


def _pixels(spark, seed, w, h, n=3):
    rng = np.random.default_rng(seed)
    rows = [(k, x, y, *map(int, rng.integers(0, 256, 3)), int(rng.choice([0, 90, 255]))) for k in range(n) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "k int, x int, y int, r int, g int, b int, a int").withColumns({"width": F.lit(w), "height": F.lit(h)}).repartition(4)


def _rows(df, columns):
    out = sorted(map(tuple, df.select(*columns).collect()))
    assert out
    return out


@pytest.mark.parametrize("method", ["nearest", "bicubic", "lanczos"])
def test_resizing_equals_tap_joins(spark, method):
    for seed, (w, h, nw, nh) in enumerate([(7, 5, 3, 11), (1, 1, 4, 2), (9, 4, 9, 2)]):
        px = _pixels(spark, seed, w, h).withColumns({"new_width": F.lit(nw), "new_height": F.lit(nh)})
        images = dense.images_of(px, ["k", "width", "height", "new_width", "new_height"])
        got = dense.pixels_of(dense.warp_images(images, ["k"], method), ["k"])
        assert _rows(got, ["k", "x", "y", *"rgba"]) == _rows(resize_rasters(px, ["k"], method), ["k", "x", "y", *"rgba"])


@pytest.mark.parametrize("method", ["nearest", "bicubic"])
def test_turning_equals_tap_joins(spark, method):
    px = _pixels(spark, 8, 5, 4, 6).withColumn("deg", (F.col("k") + 1) * 33.5)
    images = dense.images_of(px, ["k", "width", "height", "deg"]).withColumns({"new_width": F.col("width"), "new_height": F.col("height")})
    got = dense.pixels_of(dense.warp_images(images, ["k"], "nearest", method), ["k"])
    assert _rows(got, ["k", "x", "y", *"rgba"]) == _rows(rotate_rasters(px, ["k"], method=method), ["k", "x", "y", *"rgba"])


def test_hidden_colours_do_not_show(spark):
    """A red opaque pixel beside a green transparent one stays red when scaled."""
    px = spark.createDataFrame([(0, 0, 0, 255, 0, 0, 255), (0, 1, 0, 0, 255, 0, 0)], "k int, x int, y int, r int, g int, b int, a int").withColumns({"width": F.lit(2), "height": F.lit(1), "new_width": F.lit(6), "new_height": F.lit(1)})
    for out in (resize_rasters(px, ["k"], "bicubic"), dense.pixels_of(dense.warp_images(dense.images_of(px, ["k", "width", "height", "new_width", "new_height"]), ["k"], "bicubic"), ["k"])):
        assert {(r.r, r.g) for r in out.filter("a > 0").collect()} == {(255, 0)}


def test_layers_fold_like_pixels(spark):
    """Layers beyond every edge of the canvas, opaque and faded ones, blank lines."""
    rng, layers, px = np.random.default_rng(4), [], []
    for p in range(3):
        for z in range(6):
            w, h, x, y, alpha = int(rng.integers(1, 7)), int(rng.integers(1, 6)), int(rng.integers(-4, 9)), int(rng.integers(-4, 8)), int(rng.choice([255, 255, 77]))
            image = rng.integers(0, 256, size=(h, w, 4)).astype(np.uint8)
            image[..., 3] = rng.choice([0, 120, 255], size=(h, w))
            layers.append((p, z, x, y, alpha, w, h, image.tobytes(), 8, 20))
            px += [(p, z, x + i, y + j, *map(int, image[j, i, :3]), int(image[j, i, 3]) * alpha // 255) for j in range(h) for i in range(w) if 0 <= x + i < 8 and 0 <= y + j < 20]
    layers = spark.createDataFrame(layers, "p int, z int, x int, y int, alpha int, width int, height int, rgba binary, out_width int, out_height int").repartition(4)
    lines = dense.fold_lines(dense.layer_lines(layers, ["p"]), ["p"])
    got = dense.pixels_of(lines.withColumnRenamed("y", "line").withColumn("w", F.lit(8)), ["p", "line"], "w").filter("a > 0").drop("y").withColumnRenamed("line", "y")
    want = composite(spark.createDataFrame(px, "p int, z int, x int, y int, r int, g int, b int, a int"), ["p", "x", "y"]).filter("a > 0")
    assert _rows(got, ["p", "x", "y", *"rgba"]) == _rows(want, ["p", "x", "y", *"rgba"])
    assert lines.count() < 3 * 20 and lines.select(F.octet_length("rgba")).distinct().first()[0] == 32
    assert dense.fold_lines(dense.layer_lines(layers.limit(0), ["p"]), ["p"]).count() == 0


def test_export_makes_no_row_for_a_blank_pixel(spark):
    """Two frames of 300 x 200, one line of them not blank: lines go in, whole canvases come out."""
    line = bytes(4 * 10) + b"\x01\x02\x03\xff" + bytes(4 * 289)
    lines = spark.createDataFrame([(1, 1, 7, line)], "project_id int, frame_index long, y int, rgba binary")
    canvas = spark.createDataFrame([(1, 300, 200)], "project_id int, out_width int, out_height int")
    extent = spark.createDataFrame([(1, 2)], "project_id int, total_frames long")
    files = render.export_project(lines, canvas, extent, 25, 1)
    shown = {r.frame_index: bytes(r.rgba) for r in render.decode_animation(files).collect()}
    assert shown == {0: bytes(240_000), 1: bytes(1_200 * 7) + line + bytes(1_200 * 192)}
    assert len(bytes(files.first().content)) < 300
