"""Work on blocks and lines against the forms that have a row for each pixel."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions.scalars import rgba
from framelake.jobs import render
from framelake.operators import change, runs, scanlines
from framelake.sources import views as V


def same(got, want):
    columns = sorted(want.columns)
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    a, b = rows(got), rows(want)
    assert a and a == b


@pytest.mark.parametrize("cap", [1, 3, 7, 65_535])
def test_blocks_merge_to_runs(spark, cap):
    """Runs over many blocks, blocks of one run, blocks that are missing, null values and null units."""
    rng, data = random.Random(cap), []
    for unit in (None, 1, 2, 3):
        v = 0
        for i in range(400 if unit != 3 else 5):
            v = v if rng.random() < (0.97 if unit == 1 else 0.6) else rng.choice([0, 1, None])
            data.append((unit, i // 10 + (i // 100) * 3, i, v))
    df = spark.createDataFrame(data, "u int, b int, i int, v int").repartition(6)
    same(runs.runs_by_block(df, ["u"], "b", ["i"], "v", cap), runs.runs(df, ["u"], ["i"], "v", cap))
    assert runs.runs_by_block(df.limit(0), ["u"], "b", ["i"], "v", cap).count() == 0


def test_lines_merge_to_runs(spark):
    rng, pixels, lines = np.random.default_rng(3), [], []
    for u in range(3):
        at = 0
        for y in range(40):
            line = rng.choice([7, 1 << 31], p=[0.9, 0.1], size=int(rng.integers(0, 9)) if u else 8).astype(">u4")
            lines.append((u, y, line.tobytes()))
            pixels += [(u, at + k, int(c)) for k, c in enumerate(line)]
            at += len(line)
    lines = spark.createDataFrame([*lines, (9, 0, None)], "u int, y int, data binary").repartition(4)
    px = spark.createDataFrame(pixels, "u int, i int, color long")
    for cap in (2, 65_535):
        same(runs.merge_runs(runs.line_runs(lines, ["u"], "y", "data"), ["u"], "y", "color", cap), runs.runs(px, ["u"], ["i"], "color", cap))


def test_one_large_unit_is_spread(spark):
    """2,000 lines of 1,000 pixels: three runs in all, from 2,000 rows of lines."""
    n = 2_000
    lines = spark.range(n, numPartitions=8).select(F.lit(1).alias("u"), F.col("id").alias("y"), F.unhex(F.repeat(F.when(F.col("id") < n / 2, "0000000A").otherwise("0000000B"), 1_000)).alias("data"))
    local = runs.line_runs(lines, ["u"], "y", "data")
    assert local.count() == n
    got = runs.merge_runs(local, ["u"], "y", "color").groupBy("color").agg(F.sum("run_length").alias("n"), F.count("*").alias("k"), F.min("start").alias("s")).orderBy("color").collect()
    assert [tuple(r) for r in got] == [(10, 1_000_000, 16, 0), (11, 1_000_000, 16, 1_000_000)]


def _movie(spark, seed, width, height, frames=9, files=2):
    """Files with still, faded, slightly changed and new frames, and their pixels and lines."""
    rng, px = np.random.default_rng(seed), []
    for f in range(files):
        image = rng.integers(0, 3, size=(height, width, 4)) * 60
        for k in range(frames):
            kind = rng.integers(0, 5)
            if kind == 0:
                image = rng.integers(0, 3, size=(height, width, 4)) * 60
            elif kind == 1:
                image = image.copy()
                image[rng.integers(0, height), rng.integers(0, width)] = rng.integers(0, 256, size=4)
            elif kind == 2:
                image = image.copy()
                image[:, :, 3] = image[:, :, 3] * int(rng.integers(100, 256)) // 255
            px += [(f"f{f}", k, y * width + x, x, y, *map(int, image[y, x])) for y in range(height) for x in range(width)]
    px = spark.createDataFrame(px, "file_id string, frame_index int, pixel_index int, x int, y int, r int, g int, b int, a int").withColumn("color", rgba()).repartition(5)
    return px, scanlines.lines_of(px)


@pytest.mark.parametrize("seed,width,height", [(1, 7, 5), (2, 1, 1), (3, 12, 1), (4, 1, 12)])
def test_choices_from_lines(spark, monkeypatch, seed, width, height):
    px, lines = _movie(spark, seed, width, height)
    for every in (0, 4):
        same(scanlines.choose_frames_lines(lines, force_full_every=every), change.choose_frames(px, force_full_every=every))
        same(scanlines.choose_frames_lines(lines, force_full_every=every, editor=True), change.choose_export_frames(px, force_full_every=every))
    if seed == 1:
        same(scanlines.uniform_alpha_lines(lines), change.uniform_alpha(change.with_previous(px)))
        same(scanlines.change_bbox_lines(lines), change.change_bbox(change.diff_frames(px)).drop("n_changed"))


def test_choice_has_three_shuffles(spark):
    """Lines by file and line, their facts by frame, and facts of boxes by frame; the first two are written before the plan of the last is made."""
    from framelake.sources import stage

    plans = []
    real = stage.staged

    def spy(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    lines = V.fade_lines(spark, "/root/testdata/sf0.001")
    lines = real(lines)
    scanlines.staged, keep = spy, scanlines.staged
    try:
        out = scanlines.choose_frames_lines(lines)
    finally:
        scanlines.staged = keep
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    count = lambda p: p.count("Exchange hashpartitioning")
    assert len(plans) == 2 and sum(map(count, plans)) <= 3


def test_lines_of_other_length_are_an_error(spark):
    lines = spark.createDataFrame([("f", 0, 0, b"abcd"), ("f", 1, 0, b"abcdefgh")], "file_id string, frame_index int, y int, rgba binary")
    with pytest.raises(Exception, match="another length"):
        scanlines.line_facts(lines).collect()


@pytest.mark.parametrize("every,rgba_only", [(0, True), (3, True), (5, False)])
def test_absolute_fades_come_back(spark, every, rgba_only):
    """What a decoder shows is what was encoded, fades, rises and changes after a fade among it."""
    px, lines = _movie(spark, 7, 6, 4, frames=14)
    kinds = {r.frame_type for r in scanlines.choose_frames_absolute(lines, force_full_every=every).collect()}
    assert 3 in kinds and 1 in kinds
    sizes = px.select("file_id").distinct().select("file_id", F.lit(1).alias("flags"), F.lit(6).alias("canvas_width"), F.lit(4).alias("canvas_height"), F.lit(10).alias("fps_num"), F.lit(1).alias("fps_den"))
    files = render.encode_animation(px, sizes, editor=False, force_rgba=rgba_only, force_full_every=every, fade_mode="absolute")
    shown = {(r.file_id, r.frame_index): bytes(r.shown) for r in render.decode_animation(files).collect()}
    want = {}
    for r in lines.orderBy("y").collect():
        want[r.file_id, r.frame_index] = want.get((r.file_id, r.frame_index), b"") + bytes(r.rgba)
    assert shown == want


def test_exact_alpha():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = rng.integers(0, 256, size=4)
        alpha = int(rng.integers(0, 256))
        now = a * alpha // 255
        got = scanlines.exact_alpha(a.astype(np.int64), now.astype(np.int64))
        assert got is not None and (a * got // 255 == now).all()
    assert scanlines.exact_alpha(np.array([100]), np.array([120])) is None
    assert scanlines.exact_alpha(np.array([0x10064]), np.array([0x20064])) is None
    assert scanlines.exact_alpha(np.array([0]), np.array([0])) == 255
