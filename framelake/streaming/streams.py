"""Streaming forms: files as they land, state and changes on a live feed of frames, frame rates."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.replay import FIELDS
from ..operators.validate import split_valid, validate_headers
from ..sources.media import parse_headers, with_kind

_FILE = "path string, modificationTime timestamp, length long, content binary"
#: The state store that processors with maps need.
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Frames of a file that wait for one before them, at most: then that one counts as lost.
PENDING = 1_000


def stream_media(spark: SparkSession, path: str, glob: str = "*.migif") -> DataFrame:
    """Checked headers of animation files as they land in a folder."""
    files = spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", glob).load(path)
    files = with_kind(files.select(F.col("path").alias("file_id"), "path", "length", "content"))
    return validate_headers(parse_headers(files.filter("kind = 'animation'")))


def sink_media(checked: DataFrame, good: str, quarantine: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that writes sound rows to one folder and rows with errors to another, each file once.

    A micro-batch is written to folders of its own number and takes the place
    of what an earlier, broken run of it left there; both folders read as tables
    with a column batch_id. After a restart from `checkpoint` Spark runs the
    unfinished batch again under its old number.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.persist()
        for part, path in zip(split_valid(rows), (good, quarantine)):
            part.write.mode("overwrite").parquet(f"{path}/batch_id={batch}")
        rows.unpersist()

    return checked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class _InOrder(StatefulProcessor):
    """Frames of one key in the order of their index, however they arrive.

    What comes ahead of its turn waits in a map; what comes after its index was
    passed is late. Indices of a file count from 0 without gaps; if PENDING
    frames wait, the one they wait for counts as lost. State is dropped after
    `ttl_ms` without use, if that is given.
    """

    def __init__(self, pending: int, ttl_ms: int | None):
        self.pending, self.ttl = pending, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "i long, waiting long", self.ttl)
        self.wait = handle.getMapState("waiting", "i long", "frame string", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due, waiting = self.next.get() if self.next.exists() else (0, 0)
        out = []
        frames = pd.concat(list(rows)).sort_values("frame_index", kind="stable")
        for frame in json.loads(frames.drop(columns=self.keys, errors="ignore").to_json(orient="records")):
            i = int(frame["frame_index"])
            if i < due:
                out += self.late(key, frame)
            elif i > due:
                waiting += 0 if self.wait.containsKey((i,)) else 1
                self.wait.updateValue((i,), (json.dumps(frame),))
            else:
                out += self.take(key, frame)
                due += 1
            while waiting and (self.wait.containsKey((due,)) or waiting > self.pending):
                if not self.wait.containsKey((due,)):
                    due = min(k[0] for k in self.wait.keys())
                out += self.take(key, json.loads(self.wait.getValue((due,))[0]))
                self.wait.removeKey((due,))
                due, waiting = due + 1, waiting - 1
        self.next.update((due, waiting))
        self.close_rows()
        yield pd.DataFrame(out, columns=self.columns).astype(self.types)

    def close_rows(self) -> None:
        pass

    def close(self) -> None:
        pass


class _State(_InOrder):
    keys = ["file_id"]
    columns = ["file_id", "frame_index", "late", *FIELDS]
    types: dict = {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.fields = handle.getValueState("fields", ", ".join(f"{n} long" for n in FIELDS), self.ttl)
        self.values = None

    def _now(self) -> list[int]:
        if self.values is None:
            self.values = list(self.fields.get()) if self.fields.exists() else [d for _, d in FIELDS.values()]
        return self.values

    def take(self, key, frame) -> list[tuple]:
        if frame["frame_type"] == 1:
            self.values = [d for _, d in FIELDS.values()]
        elif frame["frame_type"] == 3:
            self.values = [int(frame[n]) if int(frame["transform_flags"]) & bit else v for v, (n, (bit, _)) in zip(self._now(), FIELDS.items())]
        return [(key[0], frame["frame_index"], False, *self._now())]

    def late(self, key, frame) -> list[tuple]:
        return [(key[0], frame["frame_index"], True, *self._now())]

    def close_rows(self) -> None:
        self.fields.update(tuple(self._now()))
        self.values = None


class _Changes(_InOrder):
    keys = ["file_id", "_band"]
    columns = ["file_id", "cell", "frame_index", "prev", "v"]
    types = {"prev": "Int64"}

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.cells = handle.getMapState("cells", "cell long", "v long", self.ttl)

    def take(self, key, frame) -> list[tuple]:
        if frame["frame_type"] == 1:  # clears the canvas
            self.cells.clear()
        out = []
        for cell, v in {int(c["cell"]): int(c["v"]) for c in frame["cells"] or []}.items():  # the last of repeated ones
            prev = self.cells.getValue((cell,))[0] if self.cells.containsKey((cell,)) else None
            if prev != v:
                out.append((key[0], cell, frame["frame_index"], prev, v))
                self.cells.updateValue((cell,), (v,))
        return out

    def late(self, key, frame) -> list[tuple]:
        return []


def _kept(grouped, processor: _InOrder, schema: str) -> DataFrame:
    """The processor's output. Forgetting by time needs Spark's processing-time mode, in which a query runs batches without end: so `availableNow` ends only without it."""
    grouped._df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    return grouped.transformWithStateInPandas(processor, schema, "Append", "None" if processor.ttl is None else "ProcessingTime")


def stream_state(frames: DataFrame, pending: int = PENDING, ttl_ms: int | None = None) -> DataFrame:
    """The six transform fields at each frame of a live feed, by file; FULL resets them.

    Frames come out in the order of frame_index (from 0, gapless), whatever
    batch they came in; a frame that comes after its index was passed, or
    again, comes out marked `late` with the state as it is. State: seven
    numbers a file and the frames that wait; with `ttl_ms`, idle files are
    forgotten. Sets the RocksDB state store.
    """
    fields = ", ".join(f"{n} long" for n in FIELDS)
    kind = frames.schema["file_id"].dataType.simpleString()
    used = frames.select("file_id", F.col("frame_index").cast("long").alias("frame_index"), "frame_type", "transform_flags", *(F.col(n).cast("long").alias(n) for n in FIELDS))
    return _kept(used.groupBy("file_id"), _State(pending, ttl_ms), f"file_id {kind}, frame_index long, late boolean, {fields}")


def stream_fps(ticks: DataFrame, delay: str = "2 seconds") -> DataFrame:
    """Frames of each aligned half-second window by 0.5, once the watermark has passed it."""
    w = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy("file_id", F.window("ts", "500 milliseconds").alias("w")).agg((F.count(F.lit(1)) / 0.5).alias("fps"))
    return w.select("file_id", F.col("w.start").alias("window_start"), "fps")


def stream_changes(frames: DataFrame, bands: int = 1, pending: int = PENDING, ttl_ms: int | None = None) -> DataFrame:
    """Cells that differ from their last value in the segment, with `prev` (null at first), in the order of frame_index.

    `frames`: one row a frame (file_id, frame_index, frame_type, `cells`: array
    of cell and v; the last of repeated cells counts). A FULL frame drops all
    cells. A canvas is one map of state, or `bands` of them, so that a large one
    spreads over tasks. Late and repeated frames change nothing; with `ttl_ms`,
    idle files are forgotten.
    """
    kind = frames.schema["file_id"].dataType.simpleString()
    used = frames.select("file_id", F.col("frame_index").cast("long").alias("frame_index"), "frame_type", "cells", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("_band"))
    mine = F.filter("cells", lambda c: F.pmod(c["cell"], F.lit(bands)) == F.col("_band"))
    used = used.withColumn("cells", mine)
    return _kept(used.groupBy("file_id", "_band"), _Changes(pending, ttl_ms), f"file_id {kind}, cell long, frame_index long, prev long, v long")


def changes(frames: DataFrame) -> DataFrame:
    """`stream_changes` over a whole log at once."""
    from pyspark.sql.window import Window

    from ..operators.replay import segments

    seg = segments(frames.select("file_id", "frame_index", "frame_type"))
    last = frames.select("file_id", "frame_index", F.posexplode("cells").alias("_at", "_c")).groupBy("file_id", "frame_index", F.col("_c.cell").alias("cell")).agg(F.max_by("_c.v", "_at").alias("v"))
    w = Window.partitionBy("file_id", "segment", "cell").orderBy("frame_index")
    out = last.join(seg, ["file_id", "frame_index"]).withColumns({"prev": F.lag("v").over(w), "_n": F.row_number().over(w)})
    return out.filter((F.col("_n") == 1) | (F.col("v") != F.col("prev"))).select("file_id", "cell", "frame_index", "prev", "v")
