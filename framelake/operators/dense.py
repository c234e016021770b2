"""Warping and layering of whole images: a binary column holds an image or a line, and no tap or blank pixel becomes a row.

The tap joins of `warp` and the pixel fold of `composite` say the same in long
form and stay as the check.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of images that a task hands over at a time.
DENSE_BYTES = 32 << 20


def images_of(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Images (keys, rgba) of pixels (x, y, r, g, b, a) that fill their frames."""
    cell = F.concat(*(F.lpad(F.hex(F.col(c).cast("long")), 2, "0") for c in "rgba"))
    cells = F.array_sort(F.collect_list(F.struct("y", "x", cell.alias("t"))))
    return pixels.groupBy(*keys).agg(F.unhex(F.array_join(F.transform(cells, lambda c: c["t"]), "")).alias("rgba"))


@lru_cache(maxsize=256)
def axis_taps(old: int, new: int, method: str, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The band of the matrix that makes `new` places of `old` ones, for the places first .. last - 1: source places and weights (places, taps); weights of a place sum to one."""
    places = np.arange(first, new if last is None else last)
    center = (places + 0.5) * old / new
    if method == "nearest":
        return np.minimum(old - 1, np.floor(center)).astype(np.int64)[:, None], np.ones((len(places), 1))
    if method == "smooth":
        return _smooth_taps(old, new, places)
    reach, scale = {"bicubic": 2.0, "lanczos": 3.0}[method], max(1.0, old / new)  # a filter grows when shrinking
    width = int(np.ceil(2 * reach * scale)) + 2
    at = np.floor(center - reach * scale).astype(np.int64)[:, None] + np.arange(width)
    t = np.abs((at + 0.5 - center[:, None]) / scale)
    if method == "bicubic":  # a = -0.5
        w = np.where(t < 1, (1.5 * t - 2.5) * t * t + 1, np.where(t < 2, ((-0.5 * t + 2.5) * t - 4) * t + 2, 0.0))
    else:
        x = np.pi * np.where(t < 1e-9, 1.0, t)
        w = np.where(t < 1e-9, 1.0, np.where(t < 3, np.sin(x) / x * np.sin(x / 3) / (x / 3), 0.0))
    w = np.where((at < 0) | (at >= old), 0.0, w)
    return np.clip(at, 0, old - 1), w / w.sum(axis=1, keepdims=True)


def _smooth_taps(old: int, new: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shrinking takes the mean of the area that a place covers, growing goes straight from one source place to the next."""
    if new < old:
        low, high = (places * old / new)[:, None], ((places + 1) * old / new)[:, None]
        at = np.floor(low).astype(np.int64) + np.arange(int(np.ceil(old / new)) + 1)
        w = np.clip(np.minimum(high, at + 1) - np.maximum(low, at), 0, None)
    else:
        at = np.floor((places + 0.5) * old / new - 0.5).astype(np.int64)[:, None] + np.arange(2)
        w = 1 - np.abs(at + 0.5 - ((places + 0.5) * old / new)[:, None])
    w = np.where((at < 0) | (at >= old), 0.0, w)
    return np.clip(at, 0, old - 1), w / w.sum(axis=1, keepdims=True)


def _along(image: np.ndarray, taps: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first axis of an image made anew, a tap of all places at a time."""
    at, w = taps
    out = np.zeros((at.shape[0], *image.shape[1:]))
    for k in range(at.shape[1]):
        out += image[at[:, k]] * w[:, k].reshape(-1, *[1] * (image.ndim - 1))
    return out


def _levels(weighted: np.ndarray) -> np.ndarray:
    """Bytes of an image whose colours are multiplied by alpha: colours are divided again, all is rounded half to even and held within 0 to 255."""
    a = weighted[..., 3:]
    seen = np.round(a, 6) > 0
    rgb = np.where(seen, weighted[..., :3] / np.where(seen, a, 1.0), 0.0)
    return np.clip(np.rint(np.round(np.concatenate([rgb, a], axis=-1), 6)), 0, 255).astype(np.uint8)


def _weighted(image: np.ndarray) -> np.ndarray:
    out = image.astype(np.float64)
    out[..., :3] *= out[..., 3:]
    return out


def resized(image: np.ndarray, width: int, height: int, method: str, part: tuple[int, int, int, int] | None = None) -> np.ndarray:
    """An image (height, width, 4) at another size, or the `part` (left, top, right, bottom) of the result. Colours are weighted by their alpha, but for `nearest`, which takes pixels as they are."""
    left, top, right, bottom = part or (0, 0, width, height)
    tx, ty = axis_taps(image.shape[1], width, method, left, right), axis_taps(image.shape[0], height, method, top, bottom)
    if method == "nearest":
        return image[ty[0][:, 0]][:, tx[0][:, 0]]
    wide = _along(_weighted(image).transpose(1, 0, 2), tx).transpose(1, 0, 2)
    return _levels(_along(wide, ty))


def _turn(width: int, height: int, deg: float) -> tuple[float, float, int, int]:
    """Cosine and sine of a turn, and the size of the canvas that holds all of the turned image."""
    c, s = round(float(np.cos(np.radians(deg))), 9), round(float(np.sin(np.radians(deg))), 9)
    return c, s, *(int(np.ceil(round(x, 6))) for x in (abs(width * c) + abs(height * s), abs(width * s) + abs(height * c)))


def _mapped_back(width: int, height: int, deg: float, part: tuple[int, int, int, int] | None) -> tuple[np.ndarray, np.ndarray]:
    """Where the places of a turned image, or of a part of it, come from."""
    c, s, tw, th = _turn(width, height, deg)
    left, top, right, bottom = part or (0, 0, tw, th)
    dx, dy = np.arange(left, right)[None, :] + 0.5 - tw / 2, np.arange(top, bottom)[:, None] + 0.5 - th / 2
    return np.round(dx * c + dy * s + width / 2, 6), np.round(-dx * s + dy * c + height / 2, 6)


def turned(image: np.ndarray, deg: float, method: str, part: tuple[int, int, int, int] | None = None, size: tuple[int, int] | None = None, at: tuple[int, int] = (0, 0)) -> np.ndarray:
    """An image turned by -deg degrees onto a canvas that holds all of it, transparent outside: each place is mapped back, to one pixel or to 4 x 4 (a = -1), those of the edge counted again beyond it.

    `part` asks for a part of the result; `image` may then be that piece of an
    image of `size` (width, height), from `at` (x, y) on, which the part needs.
    """
    w, h = size or (image.shape[1], image.shape[0])
    px, py = _mapped_back(w, h, deg, part)
    inside = (px >= 0) & (py >= 0) & (px < w) & (py < h)
    piece = lambda places, k: np.clip(places - at[k], 0, image.shape[1 - k] - 1).astype(np.int64)
    if method == "nearest":
        x, y = (piece(np.floor(p), k) for k, p in enumerate((px, py)))
        return np.where(inside[..., None], image[y, x], 0).astype(np.uint8)
    source, out = _weighted(image), np.zeros((*px.shape, 4))

    def taps(p: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        low = np.floor(p - 0.5)
        found = []
        for j in range(-1, 3):
            t = np.abs(np.round(p - 0.5 - low - j, 6))
            found.append((piece(np.clip(low + j, 0, (w, h)[k] - 1), k), np.where(t < 1, (t - 2) * t * t + 1, np.where(t < 2, ((5 - t) * t - 8) * t + 4, 0.0))))
        return found

    for y, wy in taps(py, 1):
        for x, wx in taps(px, 0):
            out += source[y, x] * (wx * wy)[..., None]
    return np.where(inside[..., None], _levels(out), 0).astype(np.uint8)


def _parts(rows: Iterator[tuple], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded size; the last columns hold the bytes that count."""
    kinds, out, size = to_arrow_schema(schema), [], 0
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), kinds)], schema.names)
    for r in rows:
        out.append(r)
        size += 100 + 40 * len(r) + sum(len(x) for x in r if isinstance(x, bytes))  # the tuple and its numbers, too
        if size >= DENSE_BYTES:
            yield flush()
            out, size = [], 0
    if out:
        yield flush()


def warp_images(images: DataFrame, keys: list[str], method: str = "bicubic", turn_method: str | None = None) -> DataFrame:
    """H4: images (keys, width, height, new_width, new_height, deg, rgba) scaled, then turned by -deg: keys, `width`, `height`, `rgba` of the result.

    One row in, one row out, within its task. `deg` may be missing (no turn).
    Methods: nearest, bicubic, lanczos, smooth (area means when shrinking, linear
    when growing); turns know nearest and bicubic, and take
    bicubic unless the method is nearest.
    """
    turn_method = turn_method or ("nearest" if method == "nearest" else "bicubic")
    deg = F.col("deg") if "deg" in images.columns else F.lit(0.0)
    used = images.select(*keys, *(F.col(c).cast("int").alias(f"_{c}") for c in ("width", "height", "new_width", "new_height")), deg.cast("double").alias("_deg"), "rgba")
    schema = T.StructType([*(images.schema[c] for c in keys), *T._parse_datatype_string("width int, height int, rgba binary").fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for *key, w, h, nw, nh, deg, rgba in zip(*(c.to_pylist() for c in b.columns)):
                image = np.frombuffer(rgba, dtype=np.uint8).reshape(h, w, 4)
                if (nw, nh) != (w, h) or method != "nearest":
                    image = resized(image, nw, nh, method)
                if deg:
                    image = turned(image, deg, turn_method)
                yield *key, image.shape[1], image.shape[0], image.tobytes()

    return used.mapInArrow(lambda batches: _parts(rows(batches), schema), schema)


def pixels_of(images: DataFrame, keys: list[str], width: str = "width") -> DataFrame:
    """A row for each pixel of images (keys, width, rgba): x, y, r, g, b, a."""
    schema = T.StructType([*(images.schema[c] for c in keys), *(T.StructField(c, T.IntegerType()) for c in ("x", "y", *"rgba"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.array([len(x) // 4 for x in b.column(b.num_columns - 1).to_pylist()])
            row = np.repeat(np.arange(b.num_rows), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            wide = np.asarray(b.column(len(keys)))[row]
            cells = np.frombuffer(b"".join(b.column(b.num_columns - 1).to_pylist()), dtype=np.uint8).reshape(-1, 4).astype(np.int32)
            columns = [c.take(pa.array(row)) for c in b.columns[: len(keys)]]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x.astype(np.int32)) for x in (at % np.maximum(wide, 1), at // np.maximum(wide, 1), *cells.T))], schema.names)

    return images.select(*keys, F.col(width).cast("int").alias("_w"), "rgba").mapInArrow(run, schema)


def layer_lines(layers: DataFrame, keys: list[str]) -> DataFrame:
    """Layers (keys, z, x, y, alpha, width, height, rgba, out_width, out_height) as lines of the canvas: keys, y, z, x, out_width, rgba. Clipped to the canvas and under the layer's alpha (a * alpha div 255); lines without a visible pixel are dropped."""
    used = layers.select(*keys, "z", *(F.col(c).cast("int").alias(f"_{c}") for c in ("x", "y", "alpha", "width", "height", "out_width", "out_height")), "rgba")
    schema = T.StructType([*(layers.schema[c] for c in keys), T.StructField("y", T.IntegerType()), layers.schema["z"], *T._parse_datatype_string("x int, out_width int, rgba binary").fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for *key, z, x, y, alpha, w, h, ow, oh, rgba in zip(*(c.to_pylist() for c in b.columns)):
                left, right, top, bottom = max(0, -x), min(w, ow - x), max(0, -y), min(h, oh - y)
                if left >= right or top >= bottom:
                    continue
                image = np.frombuffer(rgba, dtype=np.uint8).reshape(h, w, 4)[top:bottom, left:right].copy()
                image[..., 3] = image[..., 3].astype(np.int64) * alpha // 255
                for k in np.flatnonzero(image[..., 3].any(axis=1)).tolist():
                    yield *key, y + top + k, z, x + left, ow, image[k].tobytes()

    return used.mapInArrow(lambda batches: _parts(rows(batches), schema), schema)


def fold_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Source-over of all lines of a place in the order of z, on transparent: keys, y, rgba of a whole line. Places without a line have none: they are blank.

    The rule of `composite`: a fold in double precision, rounded once at the
    end. One shuffle, by (keys, y); lines stream by in order, so a task holds
    one line, whatever the number of layers.
    """
    by = [*keys, "y"]
    dealt = lines.select(*by, "z", "x", "out_width", "rgba").repartition(*by).sortWithinPartitions(*by, "z", "x")
    schema = T.StructType([*(lines.schema[c] for c in by), T.StructField("rgba", T.BinaryType())])

    def closed(line: np.ndarray) -> bytes:
        seen = line[:, 3:] > 0
        rgb = np.where(seen, line[:, :3] / np.where(seen, line[:, 3:], 1.0), 0.0)
        return np.rint(np.round(np.concatenate([rgb, line[:, 3:] * 255.0], axis=1), 6)).astype(np.uint8).tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, line = None, None
        for b in batches:
            for *key, _, x, ow, rgba in zip(*(c.to_pylist() for c in b.columns)):
                if key != at:
                    if line is not None:
                        yield *at, closed(line)
                    at, line = key, np.zeros((ow, 4))
                top = np.frombuffer(rgba, dtype=np.uint8).reshape(-1, 4).astype(np.float64)
                k = top[:, 3:] / 255.0
                below = line[x : x + len(top)]
                below[:, :3] = top[:, :3] * k + below[:, :3] * (1.0 - k)
                below[:, 3:] = k + below[:, 3:] * (1.0 - k)
        if line is not None:
            yield *at, closed(line)

    return dealt.mapInArrow(lambda batches: _parts(rows(batches), schema), schema)
