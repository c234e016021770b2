"""What changed from one frame to the next, where, and which form of the frame is smallest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runs import encoded_sizes, runs

FULL, DELTA, TRANSFORM = 1, 2, 3


def diff_frames(pixels: DataFrame, color: str = "color") -> DataFrame:
    """Pixels that differ from the same pixel one frame before, with `prev` (the first frame has nothing before it and gives no row)."""
    w = Window.partitionBy("file_id", "pixel_index").orderBy("frame_index")
    return pixels.withColumns({"prev": F.lag(color).over(w), "_n": F.row_number().over(w)}).filter((F.col("_n") > 1) & ~F.col("prev").eqNullSafe(F.col(color))).drop("_n")


def diff_scanlines(lines: DataFrame) -> DataFrame:
    """The dense form: lines (file_id, frame_index, y, rgba binary) unequal to the line before, with `prev`. Equal lines go before any pixel is made."""
    w = Window.partitionBy("file_id", "y").orderBy("frame_index")
    return lines.withColumn("prev", F.lag("rgba").over(w)).filter("prev IS NOT NULL AND prev <> rgba")


def change_bbox(diff: DataFrame) -> DataFrame:
    """Box of the changed pixels of each frame: x, y, w, h. Frames without a change have no row."""
    return diff.groupBy("file_id", "frame_index").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), F.count(F.lit(1)).alias("n_changed"))


def crop(pixels: DataFrame, bbox: DataFrame) -> DataFrame:
    """Pixels inside each frame's box, with places of their own (`pixel_index`, `x`, `y` from the box's corner)."""
    b = bbox.select("file_id", "frame_index", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("w").alias("_w"), F.col("h").alias("_h"))
    inside = pixels.join(b, ["file_id", "frame_index"]).filter("x >= _x AND x < _x + _w AND y >= _y AND y < _y + _h")
    inside = inside.withColumns({"x": F.col("x") - F.col("_x"), "y": F.col("y") - F.col("_y")})
    return inside.withColumn("pixel_index", (F.col("y") * F.col("_w") + F.col("x")).cast("int")).drop("_x", "_y", "_w", "_h")


def with_previous(pixels: DataFrame) -> DataFrame:
    """Channels of the same pixel one frame before, as `pr`, `pg`, `pb`, `pa`; null for the first frame."""
    w = Window.partitionBy("file_id", "pixel_index").orderBy("frame_index")
    return pixels.withColumns({f"p{c}": F.lag(c).over(w) for c in "rgba"})


def _alpha_facts(seen: Column) -> list[Column]:
    """Aggregates from which `_alpha` tells whether one alpha factor explains a frame; `seen` marks pixels that had one before."""
    ratio = F.when(seen & (F.col("pa") != 0), F.col("a") / F.col("pa"))
    return [
        F.bool_and(F.when(seen, F.expr("r = pr AND g = pg AND b = pb"))).alias("_same"),
        F.bool_and(F.when(seen, F.expr("NOT (pa = 0 AND a <> 0)"))).alias("_none_appears"),
        F.min_by(ratio, F.when(ratio.isNotNull(), F.col("pixel_index"))).alias("_first"),
        F.min(ratio).alias("_low"),
        F.max(ratio).alias("_high"),
    ]


def _alpha() -> Column:
    first = F.col("_first")
    near = first.isNull() | ((F.col("_high") - first <= 1.0 / 255.0) & (first - F.col("_low") <= 1.0 / 255.0))
    value = F.when(first.isNull(), 255).otherwise(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), first)) * 255, 0).cast("int"))
    return F.when(F.col("_same") & F.col("_none_appears") & near, value)


def uniform_alpha(pairs: DataFrame) -> DataFrame:
    """`alpha` of each frame that one alpha factor explains against the frame before, else null.

    All colours must be equal, also where both are transparent; nothing may
    appear out of full transparency; every ratio must lie within 1/255 of the
    first in raster order. All transparent gives 255. Frames without a frame
    before give no row.
    """
    s = pairs.filter("pr IS NOT NULL").groupBy("file_id", "frame_index").agg(*_alpha_facts(F.lit(True)))
    return s.select("file_id", "frame_index", _alpha().alias("alpha"))


def _sizes(pixels: DataFrame, color: str, prefix: str, indexed: bool) -> DataFrame:
    s = encoded_sizes(runs(pixels, ["file_id", "frame_index"], ["pixel_index"], color), ["file_id", "frame_index"])
    kind = "index" if indexed else "rgba"
    return s.select("file_id", "frame_index", F.col(f"data_{kind}").alias(f"{prefix}_data"), F.col(f"{kind}_is_rle").alias(f"{prefix}_is_rle"))


def choose_frames(pixels: DataFrame, color: str = "color", *, indexed: bool = False, force_full_every: int = 0) -> DataFrame:
    """Type of each frame, and its payload bytes, from counts alone.

    The first frame, and every `force_full_every`-th, is FULL. A frame that one
    alpha factor explains is TRANSFORM (28 bytes). Else DELTA if its payload
    (4 + 20 + data of the box) is strictly smaller than that of FULL (16 +
    data). `pixels` has r, g, b, a beside `color`.
    """
    keys = ["file_id", "frame_index"]
    full = _sizes(pixels, color, "full", indexed)
    # the pixel before, once, for the box as well as for the alpha
    w = Window.partitionBy("file_id", "pixel_index").orderBy("frame_index")
    pairs = pixels.withColumns({"prev": F.lag(color).over(w), "_n": F.row_number().over(w), **{f"p{c}": F.lag(c).over(w) for c in "rgba"}})
    seen = F.col("_n") > 1
    at = lambda c: F.when(seen & ~F.col("prev").eqNullSafe(F.col(color)), F.col(c))
    facts = pairs.groupBy(*keys).agg(F.min(at("x")).alias("x"), F.min(at("y")).alias("y"), (F.max(at("x")) - F.min(at("x")) + 1).alias("w"), (F.max(at("y")) - F.min(at("y")) + 1).alias("h"), F.max(seen).alias("_seen"), *_alpha_facts(seen))
    facts = facts.select(*keys, *"xywh", F.when(F.col("_seen"), _alpha()).alias("alpha"))
    delta = _sizes(crop(pixels, facts.filter("w IS NOT NULL")), color, "delta", indexed)
    out = full.join(facts, keys, "left").join(delta, keys, "left")
    out = out.withColumns({"full_bytes": F.col("full_data") + 16, "delta_bytes": F.col("delta_data") + 24, "_first": F.col("frame_index") == F.min("frame_index").over(Window.partitionBy("file_id"))})
    return decide(out, force_full_every=force_full_every)


def decide(facts: DataFrame, *, force_full_every: int = 0, editor: bool = False) -> DataFrame:
    """Type and payload bytes of each frame from `_first`, `full_bytes`, `delta_bytes`, `alpha` and the box; the `editor` has no TRANSFORM, and an unchanged frame of its is a DELTA of 4 bytes."""
    forced = F.col("_first") | (F.col("frame_index") % force_full_every == 0) if force_full_every > 0 else F.col("_first")
    keys, delta = ["file_id", "frame_index"], F.col("delta_bytes")
    if editor:
        delta = F.coalesce(delta, F.lit(4).cast("long"))
    faded = F.lit(False) if editor else F.col("alpha").isNotNull()
    kind = F.when(forced, FULL).when(faded, TRANSFORM).when(delta < F.col("full_bytes"), DELTA).otherwise(FULL)
    out = facts.withColumn("frame_type", kind)
    size = F.when(F.col("frame_type") == TRANSFORM, F.lit(28).cast("long")).when(F.col("frame_type") == DELTA, delta).otherwise(F.col("full_bytes"))
    alpha = [] if editor else [F.when(F.col("frame_type") == TRANSFORM, F.col("alpha")).alias("alpha")]
    shown = F.when(~F.col("_first"), delta) if editor else delta
    return out.select(*keys, "frame_type", *alpha, "full_bytes", shown.alias("delta_bytes"), size.alias("payload_bytes"), *(F.when(F.col("frame_type") == DELTA, F.col(c)).alias(c) for c in "xywh"))


def choose_export_frames(pixels: DataFrame, color: str = "color", *, force_full_every: int = 0) -> DataFrame:
    """The editor's choice: colours only, no TRANSFORM. An unchanged frame is a DELTA without a box (4 bytes). The first frame, and every `force_full_every`-th, is FULL."""
    keys = ["file_id", "frame_index"]
    box = change_bbox(diff_frames(pixels, color))
    out = _sizes(pixels, color, "full", False).join(box, keys, "left").join(_sizes(crop(pixels, box), color, "delta", False), keys, "left")
    out = out.withColumns({"full_bytes": F.col("full_data") + 16, "delta_bytes": F.col("delta_data") + 24, "_first": F.col("frame_index") == F.min("frame_index").over(Window.partitionBy("file_id"))})
    return decide(out, force_full_every=force_full_every, editor=True)


def encoding_report(choice: DataFrame, pixels_per_frame: DataFrame) -> DataFrame:
    """Raw bytes, payload bytes, frame bytes (28 more each) and their ratio by file, and over all files (file_id null)."""
    per = choice.join(pixels_per_frame, ["file_id", "frame_index"]).rollup("file_id").agg(
        F.count(F.lit(1)).alias("n_frames"), F.sum(F.col("n_pixels") * 4).cast("long").alias("raw_bytes"), F.sum("payload_bytes").cast("long").alias("payload_bytes"), F.sum(F.col("payload_bytes") + 28).cast("long").alias("frame_bytes")
    )
    return per.withColumn("ratio", F.round(F.col("frame_bytes") / F.col("raw_bytes"), 6))
