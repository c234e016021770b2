"""Replay of snapshot, change and state logs: a FULL frame starts a segment, and segments are independent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import apply_alpha

#: Transform fields by flag bit, and their values after a FULL frame (fixed values).
FIELDS = {"pos_x": (1, 0), "pos_y": (2, 0), "alpha": (4, 255), "scale_x": (8, 65536), "scale_y": (16, 65536), "rotation_deg": (32, 0)}


def segments(frames: DataFrame) -> DataFrame:
    """Adds `segment`: FULL frames up to and with this one. Give it keys and types only, not payloads, as it shuffles by file."""
    w = Window.partitionBy("file_id").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("segment", F.sum(F.when(F.col("frame_type") == 1, 1).otherwise(0)).over(w))


def replay_state(frames: DataFrame) -> DataFrame:
    """The six transform fields at every frame: the last value whose flag bit was set in this segment, else the default.

    `frames` has frame_type, transform_flags and those of the six fields that the log holds.
    """
    f = segments(frames) if "segment" not in frames.columns else frames
    w = Window.partitionBy("file_id", "segment").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    sets = lambda name, bit: F.when((F.col("frame_type") == 3) & (F.col("transform_flags").bitwiseAND(bit) != 0), F.col(name))
    state = {f"state_{n}": F.coalesce(F.last(sets(n, bit), ignorenulls=True).over(w), F.lit(default)) for n, (bit, default) in FIELDS.items() if n in frames.columns}
    return f.withColumns(state)


def replay_cells(frames: DataFrame, writes: DataFrame) -> DataFrame:
    """Value of every cell at every frame from the segment's first write to it on: last writer wins by (frame, place in the frame).

    `frames`: file_id, frame_index, frame_type. `writes`: file_id, frame_index,
    cell, v and optionally rect_index. Cells not written yet in a segment have
    no row (transparent). This is the long form, as large as frames times
    cells; `snapshot_at` reads one frame, and the dense form keeps arrays.
    """
    seg = segments(frames.select("file_id", "frame_index", "frame_type"))
    order = "rect_index" if "rect_index" in writes.columns else "frame_index"
    last = writes.groupBy("file_id", "frame_index", "cell").agg(F.max_by("v", order).alias("v"))
    placed = last.join(seg.select("file_id", "frame_index", "segment"), ["file_id", "frame_index"])
    # each write holds until the next write to the cell, or to the segment's end
    end = seg.groupBy("file_id", "segment").agg(F.max("frame_index").alias("_end"))
    nxt = F.lead("frame_index").over(Window.partitionBy("file_id", "segment", "cell").orderBy("frame_index"))
    held = placed.withColumn("_next", nxt).join(end, ["file_id", "segment"])
    upto = F.coalesce(F.col("_next") - 1, F.col("_end"))
    return held.select("file_id", "segment", "cell", "v", F.explode(F.sequence("frame_index", upto)).alias("frame_index"))


def snapshot_at(frames: DataFrame, writes: DataFrame, at: DataFrame) -> DataFrame:
    """Cells of each file at one frame (`at`: file_id, at_frame), from that frame's segment only."""
    seg = segments(frames.select("file_id", "frame_index", "frame_type"))
    mine = seg.join(at, "file_id").filter("frame_index <= at_frame")
    mine = mine.join(mine.groupBy("file_id").agg(F.max("segment").alias("segment")), ["file_id", "segment"])
    w = writes.join(mine.select("file_id", "frame_index", "at_frame"), ["file_id", "frame_index"])
    order = F.struct("frame_index", "rect_index") if "rect_index" in writes.columns else F.struct("frame_index")
    return w.groupBy("file_id", "at_frame", "cell").agg(F.max_by("v", order).alias("v"))


def poster_frame(frames: DataFrame) -> DataFrame:
    """First FULL or DELTA frame of each file, to be applied alone on a clear canvas."""
    return frames.filter(F.col("frame_type").isin(1, 2)).groupBy("file_id").agg(F.min("frame_index").alias("frame_index"), F.min_by("frame_type", "frame_index").alias("frame_type"))


def render_source(replayed: DataFrame, state: DataFrame) -> DataFrame:
    """Pixels (with `a`) at each frame with the frame's state alpha applied, rounded down; other fields don't count here."""
    s = state.select("file_id", "frame_index", "state_alpha")
    return apply_alpha(replayed.join(s, ["file_id", "frame_index"]), "state_alpha").drop("state_alpha")
