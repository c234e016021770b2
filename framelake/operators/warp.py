"""Scaling and rotation of rasters in long form: destination pixels take weighted taps of source pixels by equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stage import checked_broadcast


def _kernel(method: str, t: Column) -> Column:
    """Weight of a tap at distance t from the sample, in units of the filter."""
    x = F.abs(t)
    if method == "bicubic":  # a = -0.5
        return F.when(x < 1, (1.5 * x - 2.5) * x * x + 1).when(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2).otherwise(0.0)
    pi = F.lit(3.141592653589793) * x  # Lanczos with three lobes
    return F.when(x < 1e-9, 1.0).when(x < 3, F.sin(pi) / pi * F.sin(pi / 3) / (pi / 3)).otherwise(0.0)


def taps(sizes: DataFrame, old: str, new: str, method: str) -> DataFrame:
    """(old, new, dst, src, weight) for each distinct pair of sizes: which source places a destination place is made of, weights summing to one."""
    s = sizes.select(F.col(old).alias("old"), F.col(new).alias("new")).distinct()
    d = s.withColumn("dst", F.explode(F.sequence(F.lit(0), F.col("new") - 1)))
    center = (F.col("dst") + 0.5) * F.col("old") / F.col("new")
    if method == "nearest":
        return d.select("old", "new", "dst", F.least(F.col("old") - 1, F.floor(center)).cast("int").alias("src"), F.lit(1.0).alias("weight"))
    reach = 2.0 if method == "bicubic" else 3.0
    scale = F.greatest(F.lit(1.0), F.col("old") / F.col("new"))  # a filter grows when shrinking
    d = d.withColumns({"_c": center, "_s": scale})
    low, high = F.greatest(F.lit(0), F.floor(F.col("_c") - reach * F.col("_s")).cast("int")), F.least(F.col("old") - 1, F.ceil(F.col("_c") + reach * F.col("_s")).cast("int"))
    d = d.withColumn("src", F.explode(F.sequence(low, high))).withColumn("_w", _kernel(method, (F.col("src") + 0.5 - F.col("_c")) / F.col("_s"))).filter("_w <> 0")
    total = d.groupBy("old", "new", "dst").agg(F.sum("_w").alias("_t"))
    return d.join(total, ["old", "new", "dst"]).select("old", "new", "dst", "src", (F.col("_w") / F.col("_t")).alias("weight"))


def _taps(px: DataFrame, old: str, new: str, at: str, method: str) -> DataFrame:
    """The taps of one axis under the names of that axis, written once. They have few keys, as many as an image has columns, so they are broadcast where their size allows it."""
    return checked_broadcast(taps(px, old, new, method).select(F.col("old").alias(old), F.col("new").alias(new), F.col("src").alias(at), F.col("dst").alias(f"_{at}"), "weight"), 40)


def resize_rasters(px: DataFrame, keys: list[str], method: str = "nearest") -> DataFrame:
    """Pixels of rasters scaled from (width, height) to (new_width, new_height), which `px` holds beside x, y and r, g, b, a.

    x first, then y, as the filters are separable. Channels are rounded half to even and held within 0 to 255.
    """
    tx, ty = _taps(px, "width", "new_width", "x", method), _taps(px, "height", "new_height", "y", method)
    if method == "nearest":
        out = px.join(tx.drop("weight"), ["width", "new_width", "x"]).join(ty.drop("weight"), ["height", "new_height", "y"])
        return out.select(*keys, F.col("_x").alias("x"), F.col("_y").alias("y"), *"rgba")
    # colours count by their alpha, so that what a transparent pixel hides doesn't show at edges
    weighted = px.withColumns({c: F.col(c) * F.col("a") for c in "rgb"})
    sums = lambda: (F.sum(F.col(c) * F.col("weight")).alias(c) for c in "rgba")
    wide = weighted.join(tx, ["width", "new_width", "x"]).groupBy(*keys, "height", "new_height", "y", "_x").agg(*sums())
    out = wide.join(ty, ["height", "new_height", "y"]).groupBy(*keys, "_x", "_y").agg(*sums())
    level = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), F.bround(F.round(c, 6), 0).cast("int")))
    seen = F.round("a", 6) > 0
    return out.select(*keys, F.col("_x").alias("x"), F.col("_y").alias("y"), *(level(F.when(seen, F.col(c) / F.col("a")).otherwise(0.0)).alias(c) for c in "rgb"), level(F.col("a")).alias("a"))


def rotate_rasters(px: DataFrame, keys: list[str], deg: str = "deg", method: str = "nearest") -> DataFrame:
    """Rasters (width, height) turned by -deg degrees onto a canvas that holds all of them; transparent outside.

    Each destination pixel is mapped back; the destination grid is made from the rasters' sizes, one row for each pixel.
    `nearest` takes the source pixel there, `bicubic` 4 x 4 of them with weights of the cubic kernel (a = -1, as usual
    for turning); beyond the edge the pixels of the edge count again. Colours are weighted by their alpha too. The taps of
    `bicubic` are worked out once for each size and angle, and one shuffle sums them by destination pixel.
    """
    shape = ["_w", "_h", "_c", "_s"]
    rad = F.radians(F.col(deg))
    px = px.withColumns({"_w": F.col("width"), "_h": F.col("height"), "_c": F.round(F.cos(rad), 9), "_s": F.round(F.sin(rad), 9)})
    frames = px.select(*keys, *shape).distinct()
    if method == "nearest":
        grid = _mapped_back(frames).select(*keys, "x", "y", F.floor("_px").cast("int").alias("_sx"), F.floor("_py").cast("int").alias("_sy"))
        src = px.select(*keys, F.col("x").alias("_sx"), F.col("y").alias("_sy"), *"rgba")
        # Spark guesses a frame's pixels to be as few as the frames, so nothing is broadcast by a guess
        return grid.join(src.hint("merge"), [*keys, "_sx", "_sy"], "left").select(*keys, "x", "y", *(F.coalesce(c, F.lit(0)).alias(c) for c in "rgba"))
    inside = _mapped_back(frames.select(*shape).distinct()).filter("_px >= 0 AND _py >= 0 AND _px < _w AND _py < _h")
    for p, size, at, weight in (("_px", "_w", "_sx", "_wx"), ("_py", "_h", "_sy", "_wy")):
        low = F.floor(F.col(p) - 0.5)
        inside = inside.withColumn("_k", F.explode(F.array(*map(F.lit, range(-1, 3)))))
        t = F.abs(F.round(F.col(p) - 0.5 - low - F.col("_k"), 6))
        inside = inside.withColumns({weight: F.when(t < 1, (t - 2) * t * t + 1).when(t < 2, ((5 - t) * t - 8) * t + 4).otherwise(0.0), at: F.greatest(F.lit(0), F.least(F.col(size) - 1, low + F.col("_k"))).cast("int")})
    taps = checked_broadcast(inside.filter("_wx <> 0 AND _wy <> 0").select(*shape, "_sx", "_sy", F.col("x").alias("_x"), F.col("y").alias("_y"), (F.col("_wx") * F.col("_wy")).alias("_k")), 80)
    src = px.select(*keys, *shape, F.col("x").alias("_sx"), F.col("y").alias("_sy"), *"rgba").join(taps, [*shape, "_sx", "_sy"])
    k = F.col("a") * F.col("_k")
    given = src.select(*keys, F.col("_x").alias("x"), F.col("_y").alias("y"), k.alias("_ka"), *((F.col(c) * k).alias(f"_k{c}") for c in "rgb"))
    blank = _grid(frames).select(*keys, "x", "y", *(F.lit(0.0).alias(f"_k{c}") for c in "argb"))
    sums = given.unionByName(blank).groupBy(*keys, "x", "y").agg(*(F.sum(f"_k{c}").alias(f"_k{c}") for c in "rgba"))
    level = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), F.bround(F.round(F.coalesce(c, F.lit(0.0)), 6), 0).cast("int")))
    seen = F.round("_ka", 6) > 0
    return sums.select(*keys, "x", "y", *(level(F.when(seen, F.col(f"_k{c}") / F.col("_ka"))).alias(c) for c in "rgb"), level(F.col("_ka")).alias("a"))


def _grid(turned: DataFrame) -> DataFrame:
    """A row for each place (x, y) of turned rasters (_w, _h, _c, _s)."""
    wide, high = (F.ceil(F.round(F.abs(F.col("_w") * F.col(a)) + F.abs(F.col("_h") * F.col(b)), 6)).cast("int") for a, b in (("_c", "_s"), ("_s", "_c")))
    sized = turned.withColumns({"_tw": wide, "_th": high})
    return sized.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("_tw") - 1))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("_th") - 1)))


def _mapped_back(turned: DataFrame) -> DataFrame:
    """The places and where they come from (_px, _py)."""
    dx, dy = F.col("x") + 0.5 - F.col("_tw") / 2.0, F.col("y") + 0.5 - F.col("_th") / 2.0
    sx, sy = F.round(dx * F.col("_c") + dy * F.col("_s") + F.col("_w") / 2.0, 6), F.round(-dx * F.col("_s") + dy * F.col("_c") + F.col("_h") / 2.0, 6)
    return _grid(turned).withColumns({"_px": sx, "_py": sy})
