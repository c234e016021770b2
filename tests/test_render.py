"""Registered projects against a brute-force render of all frames of a small table."""

import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from framelake.jobs import byte_queries, render
from framelake.operators import project as P


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """Ten files of 1, 8, 9 ... 16 frames."""
    d, rng = tmp_path_factory.mktemp("small"), random.Random(7)
    label = [k for k in range(10) for _ in range(k + 7 if k else 1)]
    e = [[rng.uniform(-0.6, 0.5) for _ in range(64)] for _ in label]
    pq.write_table(pa.table({"vec_id": pa.array(range(len(label)), pa.int64()), "label": pa.array(label, pa.int32()), "embedding": pa.array(e, pa.list_(pa.float32()))}), f"{d}/embeddings.parquet")
    frames = {}
    for k, v in zip(label, e):
        level = np.floor(np.float32(v).astype(float) * 5).astype(int) + 3
        frames.setdefault(k, []).append({(p % 8, p // 8): (x * 40, x * 30, x * 20, 255) for p, x in enumerate(level.tolist())})
    return str(d), frames


def _turned(img, w, h, deg):
    c, s = round(math.cos(math.radians(deg)), 9), round(math.sin(math.radians(deg)), 9)
    nw, nh = math.ceil(round(abs(w * c) + abs(h * s), 6)), math.ceil(round(abs(w * s) + abs(h * c), 6))
    out = {}
    for x in range(nw):
        for y in range(nh):
            dx, dy = x + 0.5 - nw / 2, y + 0.5 - nh / 2
            at = math.floor(round(dx * c + dy * s + w / 2, 6)), math.floor(round(-dx * s + dy * c + h / 2, 6))
            if at in img:
                out[x, y] = img[at]
    return out


def _brute(frames, project):
    """All frames of one project: {frame: {(x, y): rgba}}."""
    below, above = frames[(project + 1) % 10], frames[project]
    last, out = max(1, len(above) - 1), {}
    for f in range(max(len(below), len(above) + 2)):
        layers = [(below[f], 255)] if f < len(below) else []
        if 0 <= f - 2 < len(above):
            t = min(1.0, (f - 2) / last)
            img = {(x, y): above[f - 2][2 * x + 1, 2 * y + 1] for x in range(4) for y in range(4)}
            img = _turned(img, 4, 4, round(90 * t, 6)) if t > 0 else img
            layers.append(({(x + round(1 + 5 * t), y + round(1 + 2 * t)): p for (x, y), p in img.items()}, round(200 - 100 * t)))
        canvas = {}
        for img, opacity in layers:
            for (x, y), (*rgb, a) in img.items():
                if 0 <= x < 10 and 0 <= y < 8:
                    k, (*under, ua) = a * opacity // 255 / 255, canvas.get((x, y), (0.0, 0.0, 0.0, 0.0))
                    canvas[x, y] = [c * k + u * (1 - k) for c, u in zip(rgb, under)] + [k + ua * (1 - k)]
        out[f] = {at: tuple(round(round(c / p[3], 6)) for c in p[:3]) + (round(round(p[3] * 255, 6)),) for at, p in canvas.items() if p[3] > 0}
    return {f: canvas for f, canvas in out.items() if canvas}


def test_projects_show_all_frames(spark, small):
    d, frames = small
    loaded, keys, rasters, sources, canvas = byte_queries._project(spark, d)
    got = {}
    for r in render.render_project(P.active_clips(loaded), keys, rasters, sources, canvas, "nearest").collect():
        got.setdefault(r.project_id, {}).setdefault(r.frame_index, {})[r.x, r.y] = (r.r, r.g, r.b, r.a)
    assert got == {k: _brute(frames, k) for k in frames}


def test_bicubic_turns_by_sixteen_taps(spark):
    """Turned rasters with transparent pixels against a sum over 4 x 4 neighbours; a render by bicubic uses it."""
    from framelake.operators.warp import rotate_rasters

    rng, w, h = random.Random(3), 4, 3
    img = {(x, y): [rng.randrange(256) for _ in range(3)] + [rng.choice([0, 90, 255])] for x in range(w) for y in range(h)}
    df = spark.createDataFrame([(d, x, y, w, h, *p) for d in (0.0, 17.5, 90.0, 200.0) for (x, y), p in img.items()], "deg double, x int, y int, width int, height int, r int, g int, b int, a int")
    got = {(r.deg, r.x, r.y): (r.r, r.g, r.b, r.a) for r in rotate_rasters(df, ["deg"], method="bicubic").collect()}

    def cubic(t):
        t = abs(t)
        return t**3 - 2 * t**2 + 1 if t < 1 else -(t**3) + 5 * t**2 - 8 * t + 4 if t < 2 else 0

    want = {}
    for deg in (0.0, 17.5, 90.0, 200.0):
        c, s = round(math.cos(math.radians(deg)), 9), round(math.sin(math.radians(deg)), 9)
        nw, nh = math.ceil(round(abs(w * c) + abs(h * s), 6)), math.ceil(round(abs(w * s) + abs(h * c), 6))
        for x in range(nw):
            for y in range(nh):
                dx, dy, sums = x + 0.5 - nw / 2, y + 0.5 - nh / 2, [0.0] * 4
                px, py = round(dx * c + dy * s + w / 2, 6), round(-dx * s + dy * c + h / 2, 6)
                if 0 <= px < w and 0 <= py < h:
                    for i in range(-3, w + 3):
                        for j in range(-3, h + 3):
                            k = cubic(round(px - 0.5 - i, 6)) * cubic(round(py - 0.5 - j, 6))
                            *rgb, a = img[min(w - 1, max(0, i)), min(h - 1, max(0, j))]
                            sums = [q + k * v for q, v in zip(sums, [*(u * a for u in rgb), a])]
                level = lambda v: max(0, min(255, round(round(v, 6))))
                want[deg, x, y] = (*(level(v / sums[3]) for v in sums[:3]), level(sums[3])) if round(sums[3], 6) > 0 else (0, 0, 0, 0)
    assert got == want
    assert [got[0.0, x, y] for x, y in img] == [tuple(p) if p[3] else (0, 0, 0, 0) for p in img.values()]

    rasters = df.filter("deg = 0").selectExpr("1 AS source_id", "0L AS source_frame_index", "x", "y", "r", "g", "b", "a")
    sources = spark.createDataFrame([(1, w, h)], "source_id int, canvas_width int, canvas_height int")
    active = spark.createDataFrame([(1, 0, 0, 1, 0, 0)], "project_id int, frame_index long, clip_index int, source_id int, local_frame_index long, source_frame_index long")
    keys = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 1.0, 1.0, 17.5, 255)], "project_id int, clip_index int, frame_index long, x double, y double, scale_x double, scale_y double, rotation_deg double, alpha int")
    canvas = spark.createDataFrame([(1, 9, 9)], "project_id int, out_width int, out_height int")
    shown = {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in render.render_project(active, keys, rasters, sources, canvas, "bicubic").collect()}
    assert shown == {(x, y): p for (d, x, y), p in want.items() if d == 17.5 and p[3] > 0}
