"""When frames show: running sums of durations, rates, and as-of lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def presentation_times(frames: DataFrame, ms: str = "duration_ms") -> DataFrame:
    """`start_ms` and `end_ms` of each frame in whole milliseconds; null, zero and negative durations count as 100."""
    d = F.when(F.col(ms) > 0, F.col(ms)).otherwise(100).cast("long")
    w = Window.partitionBy("file_id").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    return frames.select("file_id", "frame_index", d.alias("_d")).withColumn("end_ms", F.sum("_d").over(w)).select("file_id", "frame_index", (F.col("end_ms") - F.col("_d")).alias("start_ms"), "end_ms")


def timeline_fps(frames: DataFrame, ms: str = "duration_ms") -> DataFrame:
    """Frames by total seconds; 0 for a file without duration."""
    d = F.when(F.col(ms) > 0, F.col(ms)).otherwise(100).cast("long")
    out = frames.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_frames"), F.sum(d).alias("total_ms"))
    return out.withColumn("timeline_fps", F.when(F.col("total_ms") > 0, F.col("n_frames") * 1000.0 / F.col("total_ms")).otherwise(0.0))


def frame_at(times: DataFrame, queries: DataFrame, loop: bool = True) -> DataFrame:
    """The frame that shows at `t_ms` of each query (file_id, query_id, t_ms): as-of by union and one window, no range join.

    Looping files wrap; others hold the last frame. Times before the start show the first frame.
    """
    total = times.groupBy("file_id").agg(F.max("end_ms").alias("_total"))
    q = queries.join(total, "file_id")
    at = F.pmod(F.col("t_ms"), F.col("_total")) if loop else F.greatest(F.lit(0), F.col("t_ms"))
    q = q.select("file_id", at.cast("long").alias("_t"), F.lit(1).alias("_q"), F.lit(None).cast("long").alias("frame_index"), "query_id", "t_ms")
    f = times.select("file_id", F.col("start_ms").alias("_t"), F.lit(0).alias("_q"), F.col("frame_index").cast("long").alias("frame_index"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("long").alias("t_ms"))
    w = Window.partitionBy("file_id").orderBy("_t", "_q", "frame_index").rowsBetween(Window.unboundedPreceding, 0)
    return f.unionByName(q).withColumn("frame_index", F.last("frame_index", ignorenulls=True).over(w)).filter("_q = 1").select("file_id", "query_id", "t_ms", "frame_index")


def stream_fps_batch(ticks: DataFrame) -> DataFrame:
    """Frames of each aligned half-second window by 0.5: the batch form of the streaming operator."""
    return ticks.groupBy("file_id", F.window("ts", "500 milliseconds").alias("w")).agg((F.count(F.lit(1)) / 0.5).alias("fps")).select("file_id", F.col("w.start").alias("window_start"), "fps")


def flag_columns(headers: DataFrame) -> DataFrame:
    """The flag bits of a header as `loop` and `has_palette`."""
    return headers.withColumns({"loop": F.col("flags").bitwiseAND(1) != 0, "has_palette": F.col("flags").bitwiseAND(2) != 0})


def inspect_media(frames: DataFrame, palette: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Frames, total time, rate and palette size of each file; null for files without a palette. `headers` add canvas, the header's rate and whether it loops."""
    p = palette.groupBy("file_id").agg(F.count(F.lit(1)).alias("palette_size"))
    out = timeline_fps(frames).join(p, "file_id", "left")
    if headers is None:
        return out
    h = flag_columns(headers).select("file_id", "canvas_width", "canvas_height", "fps_num", "fps_den", "loop", "has_palette")
    return out.join(h, "file_id", "left")
