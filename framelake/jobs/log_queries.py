"""Queries over frame logs: segments, replay, time axis, validation; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import change, palette, replay, timeaxis, validate
from ..sources import views as V

_LOG = V.with_views("log")
_SEG = _LOG + """,
seg AS (SELECT *, sum(CASE WHEN frame_type = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY frame_index) AS segment FROM log)"""


def segments(spark, d):
    return replay.segments(V.frame_log(spark, d).select("file_id", "frame_index", "frame_type"))


SEGMENTS = _LOG + """ SELECT a.file_id, a.frame_index, a.frame_type, (SELECT count(*) FROM log b WHERE b.file_id = a.file_id AND b.frame_index <= a.frame_index AND b.frame_type = 1) AS segment FROM log a"""


def _with_fields(log):
    return log.withColumns({"pos_x": F.col("v"), "pos_y": F.col("v") * 2, "scale_x": F.col("v") * 1000, "scale_y": F.col("v") * 500, "rotation_deg": F.col("alpha") * 65536})


def replay_state(spark, d):
    out = replay.replay_state(_with_fields(V.frame_log(spark, d)))
    return out.select("file_id", "frame_index", "segment", *(f"state_{f}" for f in replay.FIELDS))


def _state(field: str, value: str, bit: int, default: int) -> str:
    return f"coalesce(last_value(CASE WHEN frame_type = 3 AND (transform_flags & {bit}) <> 0 THEN {value} END IGNORE NULLS) OVER (PARTITION BY file_id, segment ORDER BY frame_index), {default}) AS state_{field}"


REPLAY_STATE = _SEG + " SELECT file_id, frame_index, segment, " + ", ".join(_state(f, v, *replay.FIELDS[f]) for f, v in (("pos_x", "v"), ("pos_y", "v * 2"), ("alpha", "alpha"), ("scale_x", "v * 1000"), ("scale_y", "v * 500"), ("rotation_deg", "alpha * 65536"))) + " FROM seg"


def replay_cells(spark, d):
    log = V.frame_log(spark, d)
    return replay.replay_cells(log, log.filter("frame_type IN (1, 2)").select("file_id", "frame_index", "cell", "v"))


REPLAY_CELLS = _SEG + """,
w AS (SELECT * FROM seg WHERE frame_type IN (1, 2))
SELECT s.file_id, s.segment, w.cell, arg_max(w.v, w.frame_index) AS v, s.frame_index FROM seg s JOIN w ON w.file_id = s.file_id AND w.segment = s.segment AND w.frame_index <= s.frame_index GROUP BY s.file_id, s.segment, s.frame_index, w.cell"""


def render_source(spark, d):
    """Cells at every frame as pixels whose opacity is the cell's value, under the replayed alpha."""
    log = V.frame_log(spark, d)
    cells = replay_cells(spark, d).select("file_id", "frame_index", "cell", F.pmod("v", F.lit(256)).alias("a"))
    return replay.render_source(cells, replay.replay_state(log))


RENDER_SOURCE = _SEG + ",\nst AS (SELECT file_id, frame_index, " + _state("alpha", "alpha", 4, 255) + """ FROM seg),
w AS (SELECT * FROM seg WHERE frame_type IN (1, 2)),
c AS (SELECT s.file_id, s.frame_index, w.cell, arg_max(w.v, w.frame_index) % 256 AS a FROM seg s JOIN w ON w.file_id = s.file_id AND w.segment = s.segment AND w.frame_index <= s.frame_index GROUP BY s.file_id, s.frame_index, w.cell)
SELECT c.file_id, c.frame_index, c.cell, (c.a * st.state_alpha) // 255 AS a FROM c JOIN st USING (file_id, frame_index)"""


def snapshot_at(spark, d):
    log = V.frame_log(spark, d)
    at = log.groupBy("file_id").agg(F.floor(F.max("frame_index") * 2 / 3).alias("at_frame"))
    return replay.snapshot_at(log, log.filter("frame_type IN (1, 2)").select("file_id", "frame_index", "cell", "v"), at)


SNAPSHOT_AT = _SEG + """,
q AS (SELECT file_id, max(frame_index) * 2 // 3 AS at_frame FROM log GROUP BY file_id),
s AS (SELECT seg.file_id, at_frame, max(segment) AS segment FROM seg JOIN q USING (file_id) WHERE frame_index <= at_frame GROUP BY ALL)
SELECT s.file_id, s.at_frame, seg.cell, arg_max(seg.v, seg.frame_index) AS v FROM seg JOIN s USING (file_id, segment) WHERE seg.frame_index <= s.at_frame AND seg.frame_type IN (1, 2) GROUP BY ALL"""


def poster_frame(spark, d):
    return replay.poster_frame(V.frame_log(spark, d))


POSTER_FRAME = _LOG + " SELECT file_id, frame_index, frame_type FROM log WHERE frame_type IN (1, 2) QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY frame_index) = 1"


def presentation_times(spark, d):
    return timeaxis.presentation_times(V.frame_log(spark, d))


_TIMES = """tm AS (SELECT file_id, frame_index, CASE WHEN duration_ms > 0 THEN duration_ms ELSE 100 END AS ms, sum(ms) OVER (PARTITION BY file_id ORDER BY frame_index)::BIGINT AS end_ms, end_ms - ms AS start_ms FROM log)"""
PRESENTATION_TIMES = _LOG + ",\n" + _TIMES + " SELECT file_id, frame_index, start_ms, end_ms FROM tm"


def timeline_fps(spark, d):
    return timeaxis.timeline_fps(V.frame_log(spark, d))


TIMELINE_FPS = _LOG + ",\n" + _TIMES + " SELECT file_id, count(*) AS n_frames, sum(ms)::BIGINT AS total_ms, count(*) * 1000.0 / sum(ms) AS timeline_fps FROM tm GROUP BY file_id"


def frame_at(spark, d):
    log = V.frame_log(spark, d)
    q = log.select("file_id", F.col("event_id").alias("query_id"), (F.col("event_id") * 7919 % 30000).alias("t_ms"))
    return timeaxis.frame_at(timeaxis.presentation_times(log), q)


FRAME_AT = _LOG + ",\n" + _TIMES + """,
tot AS (SELECT file_id, max(end_ms) AS total FROM tm GROUP BY file_id),
q AS (SELECT log.file_id, event_id AS query_id, event_id * 7919 % 30000 AS t_ms, t_ms % total AS t FROM log JOIN tot USING (file_id))
SELECT q.file_id, q.query_id, q.t_ms, tm.frame_index FROM q ASOF JOIN tm ON q.file_id = tm.file_id AND q.t >= tm.start_ms"""


def normalize_duration(spark, d):
    return S.normalize_duration(V.frame_log(spark, d)).select("file_id", "frame_index", "duration_num", "duration_den")


NORMALIZE_DURATION = _LOG + " SELECT file_id, frame_index, ms // gcd(ms, 1000) AS duration_num, 1000 // gcd(ms, 1000) AS duration_den FROM (SELECT *, CASE WHEN duration_ms > 0 THEN duration_ms ELSE 100 END AS ms FROM log)"


def file_fps(spark, d):
    return S.file_fps(V.frame_log(spark, d))


FILE_FPS = _LOG + " SELECT file_id, 1000 // gcd(ms, 1000) AS fps_num, ms // gcd(ms, 1000) AS fps_den FROM (SELECT *, CASE WHEN duration_ms > 0 THEN duration_ms ELSE 100 END AS ms FROM log WHERE frame_index = 0)"


def reduce_fraction(spark, d):
    o = V.table(spark, d, "orders")
    num, den = S.reduce_fraction(F.col("o_orderkey") * 6, F.col("o_custkey") * 4)
    return o.select("o_orderkey", num.alias("num"), den.alias("den"))


REDUCE_FRACTION = "SELECT o_orderkey, o_orderkey * 6 // gcd(o_orderkey * 6, o_custkey * 4) AS num, o_custkey * 4 // gcd(o_orderkey * 6, o_custkey * 4) AS den FROM orders"


def parse_values(spark, d):
    """Rates and colours read from text; bad ones are null."""
    o = V.table(spark, d, "orders")
    k = F.col("o_orderkey")
    fps = F.concat_ws("/", (k % 7).cast("string"), F.when(k % 3 != 0, (k % 5).cast("string")))
    rgb = F.concat_ws(",", (k % 300).cast("string"), (k % 11).cast("string"), F.when(k % 13 == 0, F.lit("x")).otherwise((k % 256).cast("string")))
    a, b = S.parse_fps(fps), S.parse_rgb(rgb)
    return o.select("o_orderkey", a["num"].alias("num"), a["den"].alias("den"), b["r"].alias("r"), b["g"].alias("g"), b["b"].alias("b"))


PARSE_VALUES = """SELECT o_orderkey, CASE WHEN f THEN o_orderkey % 7 END AS num, CASE WHEN f THEN CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 5 ELSE 1 END END AS den,
 CASE WHEN c THEN o_orderkey % 300 END AS r, CASE WHEN c THEN o_orderkey % 11 END AS g, CASE WHEN c THEN o_orderkey % 256 END AS b
FROM (SELECT o_orderkey, o_orderkey % 7 > 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 5 > 0) AS f, o_orderkey % 300 < 256 AND o_orderkey % 13 <> 0 AS c FROM orders)"""


def fixed_point(spark, d):
    log = V.frame_log(spark, d)
    raw = (F.col("v") * 32768).cast("int")
    return log.select("file_id", "frame_index", S.fixed_to_double(raw).alias("value"), S.fixed_position(raw).alias("position"))


FIXED_POINT = _LOG + " SELECT file_id, frame_index, v * 32768 / 65536.0 AS value, CAST(round_even(v * 32768 / 65536.0, 0) AS INTEGER) AS position FROM log"


def file_paths(spark, d):
    """Paths with another suffix, against a project's folder, and back."""
    p = V.table(spark, d, "part")
    proj = F.concat(F.lit("/data/p"), (F.col("p_partkey") % 10).cast("string"), F.lit("/main.proj"))
    stored = F.when(F.col("p_partkey") % 4 == 0, F.lit("/abs/a.gif")).otherwise(F.concat(F.lit("img/"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.lit(".v2.png"))))
    full = S.source_path(proj, stored)
    return p.select("p_partkey", full.alias("path"), S.output_path(full, ".miimg").alias("out"), S.relative_path(proj, full).alias("stored"))


FILE_PATHS = """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '/abs/a.gif' ELSE '/data/p' || p_partkey % 10 || '/' || s END AS path,
 CASE WHEN p_partkey % 4 = 0 THEN '/abs/a' WHEN p_partkey % 3 = 0 THEN path ELSE '/data/p' || p_partkey % 10 || '/img/' || p_partkey || '.v2' END || '.miimg' AS out, CASE WHEN p_partkey % 4 = 0 THEN '/abs/a.gif' ELSE s END AS stored
FROM (SELECT p_partkey, 'img/' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '.v2.png' END AS s FROM part)"""


def fit_size(spark, d):
    s = V.sources(spark, d)
    f = S.fit_size(F.col("canvas_width"), F.col("canvas_height"), 320, 64)
    return s.select("source_id", f["width"].alias("width"), f["height"].alias("height"))


FIT_SIZE = V.with_views("sources") + """ SELECT source_id, greatest(1, CAST(round_even(canvas_width * s, 0) AS INTEGER)) AS width, greatest(1, CAST(round_even(canvas_height * s, 0) AS INTEGER)) AS height
FROM (SELECT *, least(320 / canvas_width, 64 / canvas_height, 1.0::DOUBLE) AS s FROM sources)"""


def inspect_media(spark, d):
    px = V.rasters(spark, d)
    frames = px.select("file_id", "frame_index").distinct().withColumn("duration_ms", (F.col("frame_index") % 7).cast("int") * 10)
    return timeaxis.inspect_media(frames, palette.build_palette(px, "color", 7))


INSPECT_MEDIA = V.with_views("px") + """,
f AS (SELECT file_id, frame_index, CASE WHEN frame_index % 7 = 0 THEN 100 ELSE frame_index % 7 * 10 END AS ms FROM px WHERE pixel_index = 0),
p AS (SELECT file_id, count(DISTINCT color) AS n FROM px GROUP BY file_id)
SELECT f.file_id, count(*) AS n_frames, sum(ms)::BIGINT AS total_ms, count(*) * 1000.0 / sum(ms) AS timeline_fps, CASE WHEN any_value(n) <= 7 THEN any_value(n) END AS palette_size FROM f JOIN p USING (file_id) GROUP BY f.file_id"""


def validate_frames(spark, d):
    log = V.frame_log(spark, d)
    e = F.col("event_id")
    f = log.select("file_id", "frame_index", (F.col("cell") + 28 - F.when(e % 17 == 0, 30).otherwise(0) + F.when(e % 19 == 0, 1).otherwise(0)).alias("frame_size"), F.col("cell").alias("payload_size"), (e % 23).alias("duration_den"), (e % 1000).alias("frame_end"), F.lit(990).alias("file_size"), F.when(e % 29 == 0, 1).otherwise(0).alias("reserved"))
    good, bad = validate.split_valid(validate.validate_frames(f))
    return bad.select("file_id", "frame_index", F.array_join("errors", ",").alias("errors")).unionByName(good.select("file_id", "frame_index", F.lit("").alias("errors")))


VALIDATE_FRAMES = _LOG + """ SELECT file_id, frame_index, concat_ws(',', CASE WHEN s < 28 THEN 'frame_size_small' END, CASE WHEN s <> cell + 28 THEN 'frame_size' END, CASE WHEN event_id % 23 = 0 THEN 'duration_den' END, CASE WHEN event_id % 1000 > 990 THEN 'beyond_file' END, CASE WHEN event_id % 29 = 0 THEN 'reserved' END) AS errors
FROM (SELECT *, cell + 28 - CASE WHEN event_id % 17 = 0 THEN 30 ELSE 0 END + CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END AS s FROM log)"""


def stream_fps(spark, d):
    return timeaxis.stream_fps_batch(V.frame_log(spark, d)).select("file_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss.SSS").alias("window_start"), "fps")


STREAM_FPS = _LOG + " SELECT file_id, strftime(time_bucket(INTERVAL '500 milliseconds', ts), '%Y-%m-%d %H:%M:%S.%g') AS window_start, count(*) / 0.5 AS fps FROM log GROUP BY ALL"

QUERIES = {f.__name__: f for f in (
    segments, replay_state, replay_cells, render_source, snapshot_at, poster_frame, presentation_times, timeline_fps, frame_at, normalize_duration, file_fps, reduce_fraction, parse_values, fixed_point, file_paths, fit_size, inspect_media, validate_frames, stream_fps)}
ORACLE_SQL = {k: globals()[k.upper()] for k in QUERIES}
