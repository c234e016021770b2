"""Rule checks: each gives `errors`, an array of codes; `split_valid` parts good rows from the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def errors(rules: dict[str, Column]) -> Column:
    """Codes of the rules whose condition is true; a null condition gives no code."""
    return F.filter(F.array(*(F.when(bad, F.lit(code)) for code, bad in rules.items())), lambda e: e.isNotNull())


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without errors, and the quarantine."""
    return df.filter(F.size("errors") == 0).drop("errors"), df.filter(F.size("errors") > 0)


def validate_headers(headers: DataFrame, profile: str = "strict") -> DataFrame:
    """Animation headers (with `length`, the file's true size). The lenient profile leaves header size, canvas and frame count unchecked."""
    c = F.col
    rules = {"magic": ~c("magic").eqNullSafe("MIGIF"), "version": ~c("version_major").isin(1, 2), "fps_den": c("fps_den") == 0, "file_size": c("file_size") != c("length"), "frames_offset": c("frames_offset") > c("file_size"), "blocks_end": c("header_size") + c("blocks_size") > c("file_size")}
    if profile == "strict":
        rules |= {"header_size": c("header_size") < 49, "canvas": (c("canvas_width") == 0) | (c("canvas_height") == 0), "frame_count": c("frame_count") == 0}
    return headers.withColumn("errors", F.when(c("length") < 49, F.array(F.lit("too_short"))).otherwise(errors(rules)))


def validate_still_headers(headers: DataFrame) -> DataFrame:
    c = F.col
    rules = {"magic": ~c("magic").eqNullSafe("MII0"), "dimensions": (c("width") == 0) | (c("height") == 0), "format": c("format") != 1, "packed_size": c("packed_size") + 20 > c("length")}
    return headers.withColumn("errors", F.when(c("length") < 20, F.array(F.lit("too_short"))).otherwise(errors(rules)))


def validate_frames(frames: DataFrame) -> DataFrame:
    """Frame headers: `frame_size`, `payload_size`, `duration_den`, `frame_end`, `file_size`, `reserved`."""
    c = F.col
    return frames.withColumn("errors", errors({
        "frame_size_small": c("frame_size") < 28, "frame_size": c("frame_size") != c("payload_size") + 28, "duration_den": c("duration_den") == 0, "beyond_file": c("frame_end") > c("file_size"), "reserved": c("reserved") != 0,
    }))


def validate_payloads(frames: DataFrame, rects: DataFrame, palette: DataFrame) -> DataFrame:
    """Payload rules of each frame: type and encoding, raw sizes, boxes inside the canvas, palette there, alpha, no bytes left over.

    `frames` has frame_type, encoding, width, height, data_size, alpha, left_over, canvas_width, canvas_height (null where the type has none);
    `rects` has encoding, x, y, w, h, data_size, max_index.
    """
    c = F.col
    n_colors = palette.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_colors"))
    canvas = frames.select("file_id", "frame_index", "canvas_width", "canvas_height", c("encoding").alias("frame_encoding"))
    r = rects.join(canvas, ["file_id", "frame_index"]).join(n_colors, "file_id", "left")
    worst = r.groupBy("file_id", "frame_index").agg(
        F.bool_or((c("w") == 0) | (c("h") == 0)).alias("rect_empty"),
        F.bool_or((c("x") + c("w") > c("canvas_width")) | (c("y") + c("h") > c("canvas_height"))).alias("rect_outside"),
        F.bool_or(c("frame_encoding").isin(0, 2) & (c("data_size") != c("w") * c("h") * F.when(c("frame_encoding") == 0, 4).otherwise(1))).alias("rect_raw_size"),
        F.bool_or(F.coalesce(c("max_index") >= F.coalesce(c("n_colors"), F.lit(0)), F.lit(False))).alias("index_range"),
    )
    f = frames.join(n_colors, "file_id", "left").join(worst, ["file_id", "frame_index"], "left")
    no = lambda x: F.coalesce(x, F.lit(False))
    return f.withColumn("errors", errors({
        "frame_type": ~c("frame_type").isin(1, 2, 3), "encoding": no(~c("encoding").between(0, 3)), "palette_missing": no(c("encoding").isin(2, 3) & c("n_colors").isNull()),
        "full_size": no((c("frame_type") == 1) & ((c("width") > c("canvas_width")) | (c("height") > c("canvas_height")))),
        "raw_size": no((c("frame_type") == 1) & c("encoding").isin(0, 2) & (c("data_size") != c("width") * c("height") * F.when(c("encoding") == 0, 4).otherwise(1))),
        "alpha": no((c("frame_type") == 3) & (c("alpha") > 255)), "left_over": no(c("left_over") > 0), "rect_empty": no(c("rect_empty")), "rect_outside": no(c("rect_outside")), "rect_raw_size": no(c("rect_raw_size")), "index_range": no(c("index_range")),
    })).drop("n_colors", "rect_empty", "rect_outside", "rect_raw_size", "index_range")


def validate_runs(runs: DataFrame, expected: DataFrame, unit: list[str]) -> DataFrame:
    """Runs of each unit must not be empty and must cover `n_pixels`, given by `expected`."""
    s = runs.groupBy(*unit).agg(F.sum("run_length").alias("_sum"), F.min("run_length").alias("_min"))
    out = expected.join(s, unit, "left")
    return out.withColumn("errors", errors({"zero_run": F.coalesce(F.col("_min") == 0, F.lit(False)), "pixel_count": F.coalesce(F.col("_sum"), F.lit(0)) != F.col("n_pixels")})).drop("_sum", "_min")
