"""Layers over one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def composite(layers: DataFrame, keys: list[str], z: str = "z") -> DataFrame:
    """Source-over of all layers of each output pixel in order, on transparent: r, g, b, a from 0 to 255.

    Transparent layers are dropped, and so is all below the topmost opaque
    one, before anything is gathered. Each pixel's layers, as many as clips
    overlap there, are then folded in double precision and rounded half to
    even once at the end.
    """
    seen = layers.filter("a > 0")
    opaque = F.max(F.when(F.col("a") == 255, F.col(z))).over(Window.partitionBy(*keys))
    seen = seen.withColumn("_floor", opaque).filter(F.col("_floor").isNull() | (F.col(z) >= F.col("_floor")))
    stack = seen.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(z, "r", "g", "b", "a"))).alias("_s"))
    zero = F.struct(*(F.lit(0.0).alias(c) for c in "rgba"))

    def over(below: Column, top: Column) -> Column:
        k = top["a"] / 255.0
        return F.struct(*((top[c] * k + below[c] * (1.0 - k)).alias(c) for c in "rgb"), (k + below["a"] * (1.0 - k)).alias("a"))

    out = stack.withColumn("_o", F.aggregate("_s", zero, over))  # colours here are multiplied by their opacity
    level = lambda c: F.bround(F.round(F.col(f"_o.{c}") / F.col("_o.a"), 6), 0).cast("int").alias(c)
    return out.select(*keys, *(level(c) for c in "rgb"), F.bround(F.round(F.col("_o.a") * 255.0, 6), 0).cast("int").alias("a"))


def over_background(pixels: DataFrame, keys: list[str], cell: int = 12, light: int = 200, dark: int = 150) -> DataFrame:
    """Pixels over an opaque checkerboard (x, y among `keys`)."""
    from ..functions.scalars import checkerboard

    shade = F.when(checkerboard(F.col("x"), F.col("y"), cell) == 0, light).otherwise(dark)
    k = F.col("a") / 255.0
    return pixels.select(*keys, *(F.bround(F.round(F.col(c) * k + shade * (1.0 - k), 6), 0).cast("int").alias(c) for c in "rgb"), F.lit(255).alias("a"))
