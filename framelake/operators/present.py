"""What a player shows of a canvas: scaled, turned, faded and moved by the six transform fields, within a window of the canvas' size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import dense
from .replay import FIELDS

#: The state columns of `replay_state`, and their values when nothing is transformed.
STATE = tuple(f"state_{n}" for n in FIELDS)
_PLAIN = tuple(default for _, default in FIELDS.values())
#: One, in 16.16.
ONE = 65536


def _needed(width: int, height: int, deg: float, part: tuple[int, int, int, int]) -> tuple[int, int, int, int] | None:
    """The piece of an image that a part of it turned is made of, with two places more on each side for taps; None where the part shows nothing of it."""
    px, py = dense._mapped_back(width, height, deg, part)
    inside = (px >= 0) & (py >= 0) & (px < width) & (py < height)
    if not inside.any():
        return None
    (left, top), (right, bottom) = ([int(f(p[inside])) for p in (px, py)] for f in (np.min, np.max))
    return max(0, left - 2), max(0, top - 2), min(width, right + 4), min(height, bottom + 4)


def present(image: np.ndarray, pos_x: int, pos_y: int, alpha: int, scale_x: int, scale_y: int, rotation: int, method: str = "smooth", turn_method: str = "nearest") -> np.ndarray:
    """The canvas (height, width, 4) as it shows: scaled, turned clockwise onto a canvas that holds all of it, under `alpha` (a * alpha div 255), its upper left corner at (pos_x, pos_y).

    Positions, scales and rotation are 16.16. Sizes and places are rounded half
    to even, sizes to one at least; a scale of zero or less shows nothing. Only
    what falls within the window is worked out, so no scale makes an image that
    is larger than a few windows.
    """
    h, w = image.shape[:2]
    window = np.zeros_like(image)
    if scale_x <= 0 or scale_y <= 0:
        return window
    nw, nh, x, y, deg = max(1, round(w * scale_x / ONE)), max(1, round(h * scale_y / ONE)), round(pos_x / ONE), round(pos_y / ONE), rotation / ONE
    tw, th = dense._turn(nw, nh, deg)[2:] if deg else (nw, nh)
    part = left, top, right, bottom = max(0, -x), max(0, -y), min(tw, w - x), min(th, h - y)
    if left >= right or top >= bottom:
        return window
    need = _needed(nw, nh, deg, part) if deg else part
    if need is None:
        return window
    shown = image[need[1] : need[3], need[0] : need[2]] if (nw, nh) == (w, h) else dense.resized(image, nw, nh, method, need)
    if deg:
        shown = dense.turned(shown, deg, turn_method, part, (nw, nh), need[:2])
    window[y + top : y + bottom, x + left : x + right] = shown
    if (alpha := max(0, min(255, alpha))) != 255:
        window[..., 3] = window[..., 3].astype(np.int64) * alpha // 255
    return window


def over(image: np.ndarray, background: tuple[int, int, int]) -> np.ndarray:
    """An image over an opaque colour, by the rule of `composite`: in double precision, rounded once."""
    k = image[..., 3:] / 255.0
    rgb = np.rint(np.round(image[..., :3] * k + np.array(background) * (1.0 - k), 6))
    return np.concatenate([rgb, np.full_like(k, 255)], axis=-1).astype(np.uint8)


def present_frames(canvases: DataFrame, keys: list[str], method: str = "smooth", turn_method: str = "nearest", background: tuple[int, int, int] | None = None) -> DataFrame:
    """Canvases (keys, width, height, rgba and the columns STATE of `replay_state`) as they show: keys, width, height, rgba.

    One row in, one row out, within its task; a missing value of the state
    counts as its default, canvases without pixels or bytes stay as they are.
    Colours are weighted by alpha when scaled, but for `nearest`.
    """
    used = canvases.select(*keys, *(canvases[c].cast("int").alias(c) for c in ("width", "height")), *(canvases[c].cast("long").alias(c) for c in STATE), "rgba")
    schema = T.StructType([*(canvases.schema[c] for c in keys), *T._parse_datatype_string("width int, height int, rgba binary").fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for *key, w, h, px, py, alpha, sx, sy, turn, rgba in zip(*(c.to_pylist() for c in b.columns)):
                state = tuple(d if v is None else v for v, d in zip((px, py, alpha, sx, sy, turn), _PLAIN))
                if rgba and (state != _PLAIN or background):
                    image = np.frombuffer(rgba, dtype=np.uint8).reshape(h, w, 4)
                    if state != _PLAIN:
                        image = present(image, *state, method, turn_method)
                    rgba = (over(image, background) if background else image).tobytes()
                yield *key, w, h, rgba

    return used.mapInArrow(lambda batches: dense._parts(rows(batches), schema), schema)
