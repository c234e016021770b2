"""Dictionary encoding with first-seen ids and a limit on the number of values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LIMIT = 256


def build_palette(pixels: DataFrame, color: str = "color", limit: int = LIMIT, force_rgba: bool = False) -> DataFrame:
    """Distinct colours of each file in first-seen order (`color_index` from 0); a file of more than `limit` colours has none.

    Two steps keep a wide file cheap: colours are made distinct by frame first,
    and a file with a frame beyond the limit leaves before the wide grouping.
    """
    per_frame = pixels.groupBy("file_id", "frame_index", color).agg(F.min("pixel_index").alias("pixel_index"))
    wide = per_frame.groupBy("file_id", "frame_index").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("file_id").distinct()
    first = per_frame.join(wide, "file_id", "left_anti").groupBy("file_id", color).agg(F.min(F.struct("frame_index", "pixel_index")).alias("seen"))
    index = F.row_number().over(Window.partitionBy("file_id").orderBy("seen")) - 1
    out = first.withColumns({"color_index": index.cast("int"), "_n": F.count(F.lit(1)).over(Window.partitionBy("file_id"))}).filter(F.col("_n") <= limit)
    return (out.filter(F.lit(not force_rgba))).select("file_id", "color_index", color)


def to_indices(pixels: DataFrame, palette: DataFrame, color: str = "color") -> DataFrame:
    """Adds `color_index`. The palette has 256 rows a file at most; whether it is broadcast is left to the planner, which knows its size."""
    return pixels.join(palette, ["file_id", color])


def from_indices(pixels: DataFrame, palette: DataFrame, color: str = "color") -> DataFrame:
    """Index back to colour; an index outside the palette gives a null colour and the error `index_out_of_range`."""
    out = pixels.join(palette.select("file_id", "color_index", color), ["file_id", "color_index"], "left")
    return out.withColumn("error", F.when(F.col(color).isNull(), F.lit("index_out_of_range")))
