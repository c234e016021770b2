"""Column functions for packed colours, durations, rates, paths and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Divisors of 1000, the denominator of every duration in milliseconds (fixed values).
DIVISORS = [1, 2, 4, 5, 8, 10, 20, 25, 40, 50, 100, 125, 200, 250, 500, 1000]


def rgba(r="r", g="g", b="b", a="a") -> Column:
    """Four channels as one BIGINT key, red highest."""
    return sum((F.col(c).cast("long") * m for c, m in ((r, 1 << 24), (g, 1 << 16), (b, 1 << 8), (a, 1))), F.lit(0).cast("long"))


def channels(color: Column) -> dict[str, Column]:
    """The four channels of a packed colour."""
    return {c: F.shiftright(color, s).bitwiseAND(255).cast("int") for c, s in (("r", 24), ("g", 16), ("b", 8), ("a", 0))}


def swap_channels(pixels: DataFrame) -> DataFrame:
    """RGBA to BGRA and back: red and blue change places."""
    return pixels.withColumns({"r": F.col("b"), "b": F.col("r")})


def swap_bytes(raster: Column) -> Column:
    """The same on a binary of four bytes a pixel."""
    n = (F.octet_length(raster) / 4).cast("int")
    px = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.substring(raster, i * 4 + 3, F.lit(1)), F.substring(raster, i * 4 + 2, F.lit(1)), F.substring(raster, i * 4 + 1, F.lit(1)), F.substring(raster, i * 4 + 4, F.lit(1))))
    return F.when(n > 0, F.unhex(F.array_join(F.transform(px, lambda p: F.hex(p)), ""))).otherwise(raster)


def force_opaque(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("a", F.lit(255))


def apply_alpha(pixels: DataFrame, alpha: str | Column) -> DataFrame:
    """a := a * alpha div 255, rounded down."""
    alpha = F.col(alpha) if isinstance(alpha, str) else alpha
    return pixels.withColumn("_alpha", alpha.cast("int")).withColumn("a", F.expr("cast(a * _alpha div 255 as int)")).drop("_alpha")


def duration_fraction(ms: Column) -> tuple[Column, Column]:
    """Milliseconds as a reduced fraction of a second; null, zero and less count as 100."""
    ms = F.when(ms > 0, ms).otherwise(100).cast("long")
    gcd = F.lit(1)
    for d in DIVISORS[1:]:
        gcd = F.when(ms % d == 0, d).otherwise(gcd)
    return (ms / gcd).cast("long"), (F.lit(1000) / gcd).cast("long")


def normalize_duration(frames: DataFrame, ms: str = "duration_ms") -> DataFrame:
    num, den = duration_fraction(F.col(ms))
    return frames.withColumns({"duration_num": num, "duration_den": den})


def reduce_fraction(num: Column, den: Column) -> tuple[Column, Column]:
    """Both divided by their greatest common divisor, found by Euclid's steps in an array fold."""
    start = F.struct(F.abs(num).cast("long").alias("a"), F.abs(den).cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0))).alias("b")))
    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(48)), start, step)["a"]
    return (num / gcd).cast("long"), (den / gcd).cast("long")


def file_fps(frames: DataFrame, ms: str = "duration_ms") -> DataFrame:
    """Frame rate of each file from its first frame's duration: 1000 / duration, reduced."""
    first = frames.groupBy("file_id").agg(F.min_by(ms, "frame_index").alias("first_ms"))
    num, den = duration_fraction(F.col("first_ms"))
    return first.select("file_id", den.alias("fps_num"), num.alias("fps_den"))


def parse_fps(c: Column) -> Column:
    """'30000/1001' or '25' as a struct (num, den), both above zero; anything else is null."""
    part = F.split(F.trim(c), "/")
    num, den = part[0].try_cast("long"), F.when(F.size(part) == 1, F.lit(1).cast("long")).otherwise(F.get(part, F.lit(1)).try_cast("long"))
    return F.when((F.size(part) <= 2) & (num > 0) & (den > 0), F.struct(num.alias("num"), den.alias("den")))


def parse_rgb(c: Column) -> Column:
    """'r,g,b' with three integers from 0 to 255 as a struct; anything else is null."""
    part = F.split(c, ",")
    v = [F.trim(F.get(part, F.lit(i))).try_cast("int") for i in range(3)]
    ok = F.size(part) == 3
    for x in v:
        ok = ok & x.between(0, 255)
    return F.when(ok, F.struct(*(x.alias(n) for x, n in zip(v, "rgb"))))


def fixed_to_double(c: Column) -> Column:
    """16.16 fixed point as a double."""
    return c / F.lit(65536.0)


def fixed_position(c: Column) -> Column:
    """16.16 fixed point rounded half to even."""
    return F.bround(c / F.lit(65536.0), 0).cast("int")


def output_path(c: Column, ext: str) -> Column:
    """The path with another suffix; a name without one gets it."""
    return F.concat(F.regexp_replace(c, r"(?<=[^/])\.[^./]*$", ""), F.lit(ext))


def source_path(project_path: Column, stored: Column) -> Column:
    """A stored path as it is if absolute, else under the project's folder."""
    return F.when(stored.startswith("/"), stored).otherwise(F.concat(F.regexp_replace(project_path, r"[^/]*$", ""), stored))


def relative_path(project_path: Column, path: Column) -> Column:
    """A path under the project's folder without that folder; any other as it is."""
    top = F.regexp_replace(project_path, r"[^/]*$", "")
    return F.when(path.startswith(top) & (top != ""), F.substring(path, F.length(top) + 1, F.length(path))).otherwise(path)


def fit_size(w: Column, h: Column, max_w: int, max_h: int) -> Column:
    """Largest size within the bounds, aspect kept, never enlarged, one pixel at least."""
    s = F.least(F.lit(max_w) / w, F.lit(max_h) / h, F.lit(1.0))
    return F.struct(F.greatest(F.lit(1), F.bround(w * s, 0).cast("int")).alias("width"), F.greatest(F.lit(1), F.bround(h * s, 0).cast("int")).alias("height"))


def checkerboard(x: Column, y: Column, cell: int = 12) -> Column:
    """0 or 1: the parity of the cell."""
    return F.pmod(F.floor(x / cell) + F.floor(y / cell), F.lit(2)).cast("int")
