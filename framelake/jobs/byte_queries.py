"""Queries over the binary formats: files made from the raster tables, read back and replayed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import project as P
from ..operators import runs, scanlines, timeaxis, validate
from ..sources import media
from ..sources import views as V
from ..sources.stage import staged
from . import render
from .project_queries import _tap_sql
from .raster_queries import _FEW, _few


def _pixels(spark, d):
    px = _few(V.rasters(spark, d))
    return px.select(F.col("file_id").cast("string").alias("file_id"), F.col("frame_index").cast("int").alias("frame_index"), "pixel_index", "x", "y", "color")


def _sizes(px, w=8, h=8):
    return px.select("file_id").distinct().select("file_id", F.lit(1).alias("flags"), F.lit(w).alias("canvas_width"), F.lit(h).alias("canvas_height"), F.lit(10).alias("fps_num"), F.lit(1).alias("fps_den"))


def animation_files(spark, d):
    px = _pixels(spark, d)
    return staged(render.encode_animation(px, _sizes(px)))


def parse_headers(spark, d):
    """Headers of encoded files, checked; every third file is cut by a byte."""
    files = animation_files(spark, d)
    cut = F.when(F.col("file_id").cast("int") % 3 == 0, F.substring("content", F.lit(1), (F.octet_length("content") - 1).cast("int"))).otherwise(F.col("content"))
    heads = validate.validate_headers(media.parse_headers(media.with_kind(files.withColumn("content", cut))))
    return heads.select("file_id", "magic", "version_major", "header_size", "canvas_width", "canvas_height", "frame_count", "fps_num", "fps_den", F.array_join("errors", ",").alias("errors"))


PARSE_HEADERS = V.with_views("px") + """ SELECT file_id::VARCHAR AS file_id, 'MIGIF' AS magic, 2 AS version_major, 49 AS header_size, 8 AS canvas_width, 8 AS canvas_height, count(*) AS frame_count, 10 AS fps_num, 1 AS fps_den,
 CASE WHEN file_id % 3 = 0 THEN 'file_size' ELSE '' END AS errors FROM px WHERE pixel_index = 0 GROUP BY file_id"""


def replay_dense(spark, d):
    """Files encoded with FULL and DELTA frames, decoded to canvases: the pixels they were made from."""
    out = render.decode_animation(animation_files(spark, d))
    return out.select("file_id", "frame_index", F.md5(F.hex("rgba")).alias("canvas_md5"))


REPLAY_DENSE = V.with_views("px") + ",\n" + _FEW + " SELECT file_id::VARCHAR AS file_id, frame_index, md5(string_agg(printf('%08X', color), '' ORDER BY pixel_index)) AS canvas_md5 FROM few GROUP BY file_id, frame_index"


def _coded(spark, d):
    """Fades; those of odd files are given more colours than a palette holds."""
    px = V.fades(spark, d)
    many = F.pmod(F.col("b") + F.col("pixel_index") * 3 + F.col("frame_index") * 7, F.lit(256))
    px = px.withColumn("color", F.when(F.col("file_id") % 2 == 1, F.shiftleft(F.shiftright("color", 16), 16) + many * 256 + F.col("a")).otherwise(F.col("color")))
    return px.select(F.col("file_id").cast("string").alias("file_id"), F.col("frame_index").cast("int").alias("frame_index"), "pixel_index", "x", "y", "color")


def coded_files(spark, d):
    px = _coded(spark, d)
    return staged(render.encode_animation(px, _sizes(px), editor=False, force_full_every=6))


_CODED = V.with_views("fades") + """,
few AS (SELECT * REPLACE ((b2 % 256) * 256 + (color // 65536) * 65536 + a AS color, b2 % 256 AS b) FROM (SELECT *, CASE WHEN file_id % 2 = 1 THEN b + pixel_index * 3 + frame_index * 7 ELSE b END AS b2 FROM fades)),
pal AS (SELECT file_id, count(DISTINCT color) <= 256 AS coded, count(DISTINCT color) AS n_colors FROM few GROUP BY file_id),
pair AS (SELECT c.file_id, c.frame_index, c.pixel_index, c.x, c.y, c.color <> p.color AS changed, c.r = p.r AND c.g = p.g AND c.b = p.b AS same, p.a = 0 AND c.a <> 0 AS appears, CASE WHEN p.a <> 0 THEN c.a / p.a END AS ratio
 FROM few c JOIN few p ON p.file_id = c.file_id AND p.pixel_index = c.pixel_index AND p.frame_index = c.frame_index - 1),
firstr AS (SELECT file_id, frame_index, arg_min(ratio, pixel_index) FILTER (ratio IS NOT NULL) AS f FROM pair GROUP BY ALL),
ua AS (SELECT pair.file_id, pair.frame_index, CASE WHEN bool_and(same) AND NOT bool_or(appears) AND coalesce(max(abs(ratio - f)), 0) <= 1/255.0::DOUBLE
   THEN CASE WHEN any_value(f) IS NULL THEN 255 ELSE CAST(round_even(least(1, greatest(0, any_value(f))) * 255, 0) AS INTEGER) END END AS alpha FROM pair JOIN firstr USING (file_id, frame_index) GROUP BY pair.file_id, pair.frame_index),
box AS (SELECT file_id, frame_index, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM pair WHERE changed GROUP BY ALL),
full_runs AS (SELECT file_id, frame_index, count(*) AS n, count(*) FILTER (is_new) AS r FROM (SELECT *, color IS DISTINCT FROM lag(color) OVER w OR row_number() OVER w = 1 AS is_new FROM few WINDOW w AS (PARTITION BY file_id, frame_index ORDER BY pixel_index)) GROUP BY ALL),
box_runs AS (SELECT file_id, frame_index, count(*) AS n, count(*) FILTER (is_new) AS r FROM (SELECT few.*, color IS DISTINCT FROM lag(color) OVER w OR row_number() OVER w = 1 AS is_new FROM few JOIN box USING (file_id, frame_index)
  WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 WINDOW w AS (PARTITION BY file_id, frame_index ORDER BY pixel_index)) GROUP BY ALL),
size AS (SELECT f.file_id, f.frame_index, coded, CASE WHEN coded THEN least(f.n, 3 * f.r) ELSE least(4 * f.n, 6 * f.r) END AS full_data, CASE WHEN coded THEN least(b.n, 3 * b.r) ELSE least(4 * b.n, 6 * b.r) END AS box_data,
  CASE WHEN coded THEN 3 * f.r < f.n ELSE 6 * f.r < 4 * f.n END AS full_rle, CASE WHEN coded THEN 3 * b.r < b.n ELSE 6 * b.r < 4 * b.n END AS box_rle
 FROM full_runs f JOIN pal USING (file_id) LEFT JOIN box_runs b USING (file_id, frame_index)),
choice AS (SELECT size.*, ua.alpha, x0, y0, x1, y1, CASE WHEN size.frame_index % 6 = 0 THEN 1 WHEN ua.alpha IS NOT NULL THEN 3 WHEN box_data + 24 < full_data + 16 THEN 2 ELSE 1 END AS frame_type
 FROM size LEFT JOIN ua USING (file_id, frame_index) LEFT JOIN box USING (file_id, frame_index)),
wrote AS (SELECT few.file_id, few.frame_index, pixel_index, CASE WHEN frame_type = 1 OR (frame_type = 2 AND few.x BETWEEN x0 AND x1 AND few.y BETWEEN y0 AND y1) THEN color END AS color FROM few JOIN choice USING (file_id, frame_index)),
canvas AS (SELECT file_id, frame_index, pixel_index, last_value(color IGNORE NULLS) OVER (PARTITION BY file_id, pixel_index ORDER BY frame_index) AS color FROM wrote),
state AS (SELECT file_id, frame_index, frame_type, CASE WHEN frame_type = 1 THEN 255 ELSE alpha END AS _a, coalesce(last_value(CASE WHEN frame_type = 1 THEN 255 WHEN frame_type = 3 THEN alpha END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY frame_index), 255) AS alpha FROM choice)"""


def coded_frames(spark, d):
    """Files with and without a palette, of all frame types, decoded: canvases and what shows of them under the alpha of TRANSFORM frames."""
    out = render.decode_animation(coded_files(spark, d))
    return out.select("file_id", "frame_index", F.md5(F.hex("rgba")).alias("canvas_md5"), F.md5(F.hex("shown")).alias("shown_md5"))


CODED_FRAMES = _CODED + """ SELECT canvas.file_id::VARCHAR AS file_id, canvas.frame_index, md5(string_agg(printf('%08X', color), '' ORDER BY pixel_index)) AS canvas_md5,
 md5(string_agg(printf('%08X', color - color % 256 + (color % 256) * alpha // 255), '' ORDER BY pixel_index)) AS shown_md5 FROM canvas JOIN state USING (file_id, frame_index) GROUP BY canvas.file_id, canvas.frame_index"""


def file_parts(spark, d):
    """Blobs of files put together in parts of 2,000 bytes, which joined again are the files."""
    files = coded_files(spark, d)
    frames, pal = media.walk_chunks(files, "frame"), media.explode_palette(files)
    heads = media.parse_headers(files).select("file_id", F.col("flags").bitwiseAND(1).alias("flags"), "canvas_width", "canvas_height", "fps_num", "fps_den")
    blobs = frames.select("file_id", F.col("position").alias("frame_index"), F.col("body").alias("blob"))
    parts = media.assemble_parts(heads, pal, blobs, 2_000)
    cells = F.array_sort(F.collect_list(F.struct("part", "offset", F.hex("content").alias("t"))))
    whole = parts.groupBy("file_id").agg(F.array_join(F.transform(cells, lambda c: c["t"]), "").alias("h"))
    same = whole.join(files.select(F.col("file_id").cast("string").alias("file_id"), "content"), "file_id")
    n = frames.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_frames"))
    return same.join(n, "file_id").select("file_id", "n_frames", (F.col("h") == F.hex("content")).alias("equal"))


FILE_PARTS = V.with_views("px") + " SELECT file_id::VARCHAR AS file_id, count(*) AS n_frames, true AS equal FROM px WHERE pixel_index = 0 GROUP BY file_id"


def banded_frames(spark, d):
    """The same files replayed in bands of three lines each."""
    out = render.decode_animation(coded_files(spark, d), band_lines=3)
    return out.select("file_id", "frame_index", F.md5(F.hex("rgba")).alias("canvas_md5"), F.md5(F.hex("shown")).alias("shown_md5"))


BANDED_FRAMES = CODED_FRAMES


def absolute_fades(spark, d):
    """Fades encoded against the last FULL or DELTA frame and decoded: what shows is what was encoded."""
    px = V.fades(spark, d).select(F.col("file_id").cast("string").alias("file_id"), "frame_index", "pixel_index", "x", "y", "color")
    files = staged(render.encode_animation(px, _sizes(px), editor=False, force_full_every=11, fade_mode="absolute"))
    return render.decode_animation(files).select("file_id", "frame_index", F.md5(F.hex("shown")).alias("shown_md5"))


ABSOLUTE_FADES = V.with_views("fades") + " SELECT file_id::VARCHAR AS file_id, frame_index, md5(string_agg(printf('%08X', color), '' ORDER BY pixel_index)) AS shown_md5 FROM fades GROUP BY file_id, frame_index"


def transformed_files(spark, d):
    """Every fifth fade as a FULL frame; the four after it move, scale, turn and fade it by TRANSFORM frames that set some of the six fields each."""
    lines = staged(V.fade_lines(spark, d).withColumn("file_id", F.col("file_id").cast("string")))
    i, one = F.col("frame_index"), 65536
    pick = lambda values, k: F.element_at(F.array(*(F.lit(v) for v in values)), (k + 1).cast("int"))
    data = scanlines.unit_data(lines.filter("frame_index % 5 = 0"))
    c = lines.select("file_id", "frame_index").distinct().withColumns({
        "frame_type": F.when(i % 5 == 0, 1).otherwise(3), "duration_num": F.lit(1), "duration_den": F.lit(10), "width": F.lit(8), "height": F.lit(8), **{n: F.lit(None).cast("int") for n in "xywh"},
        "transform_flags": i * 29 % 64, "pos_x": (i % 7 - 3) * one + 20_000, "pos_y": (i % 4 - 1) * one - one // 2, "alpha": i * 37 % 256,
        "scale_x": pick((one // 2, one, one * 3 // 2, one // 2, 0), i % 5), "scale_y": pick((one, one * 3 // 2, one // 2), i % 3), "rotation_deg": (i % 12 * 30 - 60) * one,
    })
    c = c.join(data.select("file_id", "frame_index", "encoding"), ["file_id", "frame_index"], "left")
    none = c.select("file_id", F.lit(0).alias("color_index"), F.lit(0).cast("long").alias("color")).filter("false")
    return staged(media.assemble_files(_sizes(c), none, media.frame_blobs(c, data, data.filter("false"))))


def shown_frames(spark, d):
    """Those files as a player shows them: canvases under all six transform fields."""
    out = render.show_animation(transformed_files(spark, d))
    return out.select("file_id", "frame_index", "width", "height", F.md5(F.hex("rgba")).alias("shown_md5"))


_STATE = ", ".join(f"coalesce(last_value(CASE WHEN frame_index % 5 <> 0 AND f & {bit} <> 0 THEN {n} END IGNORE NULLS) OVER w, {default}) AS {n}" for n, bit, default in (("px", 1, 0), ("py", 2, 0), ("alpha", 4, 255), ("sx", 8, 65536), ("sy", 16, 65536), ("turn", 32, 0)))
SHOWN_FRAMES = V.with_views("fades") + f""",
sent AS (SELECT file_id, frame_index, frame_index * 29 % 64 AS f, (frame_index % 7 - 3) * 65536 + 20000 AS px, (frame_index % 4 - 1) * 65536 - 32768 AS py, frame_index * 37 % 256 AS alpha,
  [32768, 65536, 98304, 32768, 0][frame_index % 5 + 1] AS sx, [65536, 98304, 32768][frame_index % 3 + 1] AS sy, (frame_index % 12 * 30 - 60) * 65536 AS turn FROM fades WHERE pixel_index = 0),
state AS (SELECT file_id, frame_index, {_STATE} FROM sent WINDOW w AS (PARTITION BY file_id, frame_index // 5 ORDER BY frame_index)),
placed AS (SELECT file_id, frame_index, alpha, sx > 0 AND sy > 0 AS seen, greatest(1, CAST(round_even(8 * sx / 65536.0::DOUBLE, 0) AS INTEGER)) AS nw, greatest(1, CAST(round_even(8 * sy / 65536.0::DOUBLE, 0) AS INTEGER)) AS nh,
  CAST(round_even(px / 65536.0::DOUBLE, 0) AS INTEGER) AS ox, CAST(round_even(py / 65536.0::DOUBLE, 0) AS INTEGER) AS oy, turn / 65536.0::DOUBLE AS deg, round(cos(radians(deg)), 9) AS c, round(sin(radians(deg)), 9) AS s FROM state),
grown AS (SELECT *, CASE WHEN deg = 0 THEN nw ELSE ceil(round(abs(nw * c) + abs(nh * s), 6)) END AS tw, CASE WHEN deg = 0 THEN nh ELSE ceil(round(abs(nw * s) + abs(nh * c), 6)) END AS th FROM placed),
spots AS (SELECT grown.*, wx, wy, wx - ox + 0.5::DOUBLE - tw / 2 AS u, wy - oy + 0.5::DOUBLE - th / 2 AS v FROM grown, (SELECT unnest(range(0, 8)) AS wx), (SELECT unnest(range(0, 8)) AS wy)),
back AS (SELECT *, floor(CASE WHEN deg = 0 THEN wx - ox ELSE round(u * c + v * s + nw / 2.0::DOUBLE, 6) END) AS qx, floor(CASE WHEN deg = 0 THEN wy - oy ELSE round(-u * s + v * c + nh / 2.0::DOUBLE, 6) END) AS qy FROM spots
  WHERE seen AND wx - ox BETWEEN 0 AND tw - 1 AND wy - oy BETWEEN 0 AND th - 1),
-- area means when shrinking, straight lines when growing
weight AS (SELECT n, dst, src, CASE WHEN n < 8 THEN least((dst + 1) * 8 / n::DOUBLE, src + 1) - greatest(dst * 8 / n::DOUBLE, src) ELSE 1 - abs(src + 0.5 - (dst + 0.5) * 8 / n::DOUBLE) END AS w
  FROM (SELECT unnest([4, 8, 12]) AS n) a, (SELECT unnest(range(0, 12)) AS dst) b, (SELECT unnest(range(0, 8)) AS src) c WHERE dst < n),
tap AS (SELECT n, dst, src, w / sum(w) OVER (PARTITION BY n, dst) AS w FROM weight WHERE w > 1e-12),
mixed AS (SELECT back.file_id, back.frame_index, wx, wy, nw = 8 AND nh = 8 AS plain, sum(r * a * tx.w * ty.w) AS zr, sum(g * a * tx.w * ty.w) AS zg, sum(b * a * tx.w * ty.w) AS zb, sum(a * tx.w * ty.w) AS za, max(r) AS r, max(g) AS g, max(b) AS b
  FROM back JOIN tap tx ON tx.n = nw AND tx.dst = qx JOIN tap ty ON ty.n = nh AND ty.dst = qy JOIN fades p ON p.file_id = back.file_id AND p.frame_index = back.frame_index // 5 * 5 AND p.x = tx.src AND p.y = ty.src GROUP BY ALL)
SELECT file_id::VARCHAR AS file_id, frame_index, 8 AS width, 8 AS height, md5(string_agg(printf('%02X%02X%02X%02X', cr, cg, cb, ca * alpha // 255), '' ORDER BY wy, wx)) AS shown_md5 FROM (
 SELECT spots.file_id, spots.frame_index, wx, wy, alpha, {", ".join(f"CASE WHEN plain THEN {c} WHEN round(za, 6) > 0 THEN CAST(round_even(round(z{c} / za, 6), 0) AS INTEGER) ELSE 0 END AS c{c}" for c in "rgb")}, coalesce(CAST(round_even(round(za, 6), 0) AS INTEGER), 0) AS ca
 FROM spots LEFT JOIN mixed USING (file_id, frame_index, wx, wy)) GROUP BY ALL"""


def coded_encodings(spark, d):
    """Type and encoding of each frame of those files, and its palette's size."""
    files = coded_files(spark, d)
    n = media.explode_palette(files).groupBy("file_id").agg(F.count(F.lit(1)).alias("n_colors"))
    return media.explode_frames(files).join(n, "file_id", "left").select("file_id", "frame_index", "frame_type", "encoding", "n_colors")


CODED_ENCODINGS = _CODED + """ SELECT file_id::VARCHAR AS file_id, frame_index, frame_type, CASE frame_type WHEN 1 THEN full_rle::INTEGER WHEN 2 THEN box_rle::INTEGER END + CASE WHEN coded THEN 2 ELSE 0 END AS encoding, CASE WHEN coded THEN n_colors END AS n_colors
FROM choice JOIN (SELECT file_id, n_colors FROM pal) USING (file_id)"""


def inspect_files(spark, d):
    """What a file says of itself: canvas, frames, time, rates, loop, palette."""
    files = coded_files(spark, d)
    frames = media.explode_frames(files).select("file_id", "frame_index", F.round(F.col("duration_num") * 1000 / F.col("duration_den")).cast("int").alias("duration_ms"))
    return timeaxis.inspect_media(frames, media.explode_palette(files), media.parse_headers(files).withColumn("file_id", F.col("file_id").cast("string")))


INSPECT_FILES = _CODED + """ SELECT file_id::VARCHAR AS file_id, count(*) AS n_frames, count(*) * 100 AS total_ms, 10.0::DOUBLE AS timeline_fps, CASE WHEN coded THEN any_value(n_colors) END AS palette_size, 8 AS canvas_width, 8 AS canvas_height, 10 AS fps_num, 1 AS fps_den, true AS loop, coded AS has_palette
FROM few JOIN pal USING (file_id) WHERE pixel_index = 0 GROUP BY file_id, coded"""


def check_payloads(spark, d):
    """Payloads of those files by all rules, after every third file's palette was cut to four colours."""
    files = coded_files(spark, d)
    frames = media.explode_frames(files)
    heads = media.parse_headers(files)
    colors = media.explode_palette(files).filter("NOT (file_id % 3 = 0 AND color_index >= 4)")
    out = validate.validate_payloads(*media.payload_facts(frames, media.explode_rects(frames), heads), colors)
    return out.select("file_id", "frame_index", F.array_join("errors", ",").alias("errors"))


CHECK_PAYLOADS = _CODED + """, firsts AS (SELECT file_id, color, row_number() OVER (PARTITION BY file_id ORDER BY min(frame_index * 64 + pixel_index)) - 1 AS i FROM few GROUP BY file_id, color),
top AS (SELECT wrote.file_id, wrote.frame_index, max(i) AS i FROM wrote JOIN firsts USING (file_id, color) GROUP BY ALL)
SELECT choice.file_id::VARCHAR AS file_id, choice.frame_index, CASE WHEN coded AND choice.file_id % 3 = 0 AND top.i >= 4 THEN 'index_range' ELSE '' END AS errors FROM choice LEFT JOIN top USING (file_id, frame_index)"""


def decode_still(spark, d):
    """Each frame as a still image in packets, read back to pixels."""
    px = V.rasters(spark, d).select(F.concat_ws("/", "file_id", "frame_index").alias("file_id"), "pixel_index", "color")
    packets = runs.packet_runs(px, ["file_id"], ["pixel_index"], "color")
    size = px.select("file_id").distinct().select("file_id", F.lit(8).alias("width"), F.lit(8).alias("height"))
    stills = media.encode_stills(packets, px, size)
    good, _ = validate.split_valid(validate.validate_still_headers(media.parse_still_headers(stills)))
    r = media.decode_packets(stills.join(good.select("file_id"), "file_id", "left_semi")).filter("error IS NULL")
    return runs.expand_runs(r, ["file_id"], "color").select("file_id", "pixel_index", "color")


DECODE_STILL = V.with_views("px") + " SELECT file_id || '/' || frame_index AS file_id, pixel_index, color FROM px"


def project_round_trip(spark, d):
    """Project files written from clips and keyframes, and read back."""
    clips = staged(V.clips(spark, d))
    ids = clips.select("project_id").distinct()
    projects = ids.select("project_id", F.lit(800).alias("out_width"), F.lit(600).alias("out_height"), F.lit(True).alias("loop"), F.lit(25).alias("preview_fps_num"), F.lit(1).alias("preview_fps_den"), F.lit(0).alias("total_frames"))
    sources = clips.select("project_id", "source_id").distinct().withColumn("path", F.concat(F.lit("s"), F.col("source_id").cast("string")))
    keys = clips.filter("clip_index % 2 = 0").select("project_id", "clip_index", F.lit(3).alias("frame_index"), F.lit(1.5).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("scale_x"), F.lit(1.0).alias("scale_y"), F.lit(0.0).alias("rotation_deg"), F.lit(200).alias("alpha"))
    files = staged(media.write_projects(projects, sources, clips.withColumn("clip_id", F.col("clip_index")), keys))
    _, _, back, k = media.parse_projects(files.withColumnRenamed("project_id", "file_id"))
    return back.join(k.select("project_id", "clip_index", F.col("frame_index").alias("key_frame"), "x", "alpha"), ["project_id", "clip_index"]).drop("clip_id")


PROJECT_ROUND_TRIP = V.with_views("clips") + """ SELECT project_id::VARCHAR AS project_id, clip_index, source_id, timeline_start_frame, source_start_frame, frame_count, name, CASE WHEN clip_index % 2 = 0 THEN 3 ELSE 0 END AS key_frame, CASE WHEN clip_index % 2 = 0 THEN 1.5 ELSE 0 END AS x, CASE WHEN clip_index % 2 = 0 THEN 200 ELSE 255 END AS alpha FROM clips"""


def _project(spark, d):
    """A project for each raster file: all its frames at half size and faded, two frames late, over all those of the next file.

    The half-size clip moves, turns and fades from its first frame to its last.
    """
    px = V.rasters(spark, d)
    n = px.groupBy(F.col("file_id").cast("long").alias("source_id")).agg((F.max("frame_index") + 1).alias("n_frames"))
    sources = n.withColumns({"canvas_width": F.lit(8), "canvas_height": F.lit(8), "path": F.concat(F.lit("r"), F.col("source_id").cast("string"))})
    clip = lambda i, shift, start: n.select(F.col("source_id").alias("project_id"), F.lit(i).alias("clip_index"), ((F.col("source_id") + shift) % 10).alias("source_id"), F.lit(start).alias("timeline_start_frame"), F.lit(0).alias("source_start_frame"), F.lit(0).alias("frame_count"), F.lit("").alias("name"))
    loaded, _, _ = P.resolve_clips(clip(0, 1, 0).unionByName(clip(1, 0, 2)), sources)
    key = lambda i, f, x, y, s, deg, a: n.select(F.col("source_id").alias("project_id"), F.lit(i).alias("clip_index"), f.cast("long").alias("frame_index"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(s).alias("scale_x"), F.lit(s).alias("scale_y"), F.lit(deg).alias("rotation_deg"), F.lit(a).alias("alpha"))
    first, last = F.lit(0), F.greatest(F.lit(1), F.col("n_frames") - 1)
    keys = key(0, first, 0.0, 0.0, 1.0, 0.0, 255).unionByName(key(1, first, 1.0, 1.0, 0.5, 0.0, 200)).unionByName(key(1, last, 6.0, 3.0, 0.5, 90.0, 100))
    rasters = px.select(F.col("file_id").cast("long").alias("source_id"), F.col("frame_index").cast("long").alias("source_frame_index"), "x", "y", *"rgba")
    canvas = n.select(F.col("source_id").alias("project_id"), F.lit(10).alias("out_width"), F.lit(8).alias("out_height"))
    return loaded, keys, rasters, sources, canvas


def render_project(spark, d):
    loaded, keys, rasters, sources, canvas = _project(spark, d)
    return render.render_project(P.active_clips(loaded), keys, rasters, sources, canvas, "bicubic")


def render_nearest(spark, d):
    """The same by nearest pixels, which SQL can follow."""
    loaded, keys, rasters, sources, canvas = _project(spark, d)
    return render.render_project(P.active_clips(loaded), keys, rasters, sources, canvas, "nearest")


# the upper layer: every second pixel, turned about its middle, moved and faded by how far its clip has gone
_RENDERED = V.with_views("px") + """,
n AS (SELECT file_id, max(frame_index) + 1 AS n FROM px GROUP BY file_id),
extent AS (SELECT a.file_id AS project_id, greatest(coalesce(b.n, 0), a.n + 2) AS total FROM n a LEFT JOIN n b ON b.file_id = (a.file_id + 1) % 10),
low AS (SELECT n.file_id AS project_id, px.frame_index, x, y, r, g, b, a FROM n JOIN px ON px.file_id = (n.file_id + 1) % 10),
t AS (SELECT n.file_id AS project_id, i, i / greatest(1, n.n - 1) AS t FROM n, LATERAL (SELECT unnest(range(0, n.n)) AS i)),
m AS (SELECT *, round(cos(radians(round(90 * t, 6))), 9) AS c, round(sin(radians(round(90 * t, 6))), 9) AS s, CAST(round_even(1.0::DOUBLE + 5.0::DOUBLE * t, 0) AS INTEGER) AS ox, CAST(round_even(1.0::DOUBLE + 2.0::DOUBLE * t, 0) AS INTEGER) AS oy,
  CAST(round_even(200 + -100 * t, 0) AS INTEGER) AS opacity FROM t),
w AS (SELECT *, ceil(round(4 * abs(c) + 4 * abs(s), 6))::INTEGER AS n FROM m),
g AS (SELECT w.*, dx, dy, floor(round((dx + 0.5 - n / 2.0) * c + (dy + 0.5 - n / 2.0) * s + 2, 6)) AS sx, floor(round(-(dx + 0.5 - n / 2.0) * s + (dy + 0.5 - n / 2.0) * c + 2, 6)) AS sy
  FROM w, (SELECT unnest(range(0, 6)) AS dx), (SELECT unnest(range(0, 6)) AS dy) WHERE dx < n AND dy < n),
high AS (SELECT g.project_id, g.i + 2 AS frame_index, dx + ox AS x, dy + oy AS y, r, px.g, b, a * opacity // 255 AS a FROM g JOIN px ON px.file_id = g.project_id AND px.frame_index = g.i AND px.x = 2 * sx + 1 AND px.y = 2 * sy + 1
  WHERE sx BETWEEN 0 AND 3 AND sy BETWEEN 0 AND 3 AND dx + ox BETWEEN 0 AND 9 AND dy + oy BETWEEN 0 AND 7),
met AS (SELECT project_id, frame_index, x, y, coalesce(h.a, 0) / 255.0::DOUBLE AS k, CASE WHEN l.a IS NULL THEN 0 ELSE 1 END AS under, h.r AS hr, h.g AS hg, h.b AS hb, l.r AS lr, l.g AS lg, l.b AS lb
  FROM low l FULL JOIN high h USING (project_id, frame_index, x, y)),
shown AS (SELECT *, k + under * (1 - k) AS o FROM met),
rendered AS (SELECT project_id, frame_index, x, y, """ + ", ".join(f"CAST(round_even(round((coalesce(h{c}, 0) * k + coalesce(l{c}, 0) * (1 - k)) / o, 6), 0) AS INTEGER) AS {c}" for c in "rgb") + """,
  CAST(round_even(round(o * 255, 6), 0) AS INTEGER) AS a FROM shown WHERE o > 0)"""
RENDER_NEAREST = _RENDERED + " SELECT * FROM rendered WHERE a > 0"
# the upper layer by sixteen taps of the image that was halved by cubic taps before; all pixels are opaque until then
_CUBIC = lambda t: f"CASE WHEN {t} < 1 THEN ({t} - 2) * {t} * {t} + 1 WHEN {t} < 2 THEN ((5 - {t}) * {t} - 8) * {t} + 4 ELSE 0 END"
_LEVEL = lambda c: f"greatest(0, least(255, CAST(round_even(round({c}, 6), 0) AS INTEGER)))"
RENDER_PROJECT = (
    _RENDERED[: _RENDERED.index("g AS (SELECT w.*")] + _tap_sql("t4", 4) + f""",
half AS (SELECT file_id, frame_index, tx.dst AS x, ty.dst AS y, {", ".join(f"{_LEVEL(f'sum({c} * tx.w * ty.w)')} AS {c}" for c in "rgb")} FROM px JOIN t4 tx ON tx.src = px.x JOIN t4 ty ON ty.src = px.y GROUP BY ALL),
spots AS (SELECT w.*, dx, dy, round((dx + 0.5 - n / 2.0) * c + (dy + 0.5 - n / 2.0) * s + 2, 6) AS mx, round(-(dx + 0.5 - n / 2.0) * s + (dy + 0.5 - n / 2.0) * c + 2, 6) AS my
  FROM w, (SELECT unnest(range(0, 6)) AS dx), (SELECT unnest(range(0, 6)) AS dy) WHERE dx < n AND dy < n AND mx >= 0 AND mx < 4 AND my >= 0 AND my < 4 AND dx + ox BETWEEN 0 AND 9 AND dy + oy BETWEEN 0 AND 7),
taps AS (SELECT project_id, i, dx + ox AS x, dy + oy AS y, opacity, greatest(0, least(3, floor(mx - 0.5) + jx)) AS sx, greatest(0, least(3, floor(my - 0.5) + jy)) AS sy, abs(round(mx - 0.5 - floor(mx - 0.5) - jx, 6)) AS tx, abs(round(my - 0.5 - floor(my - 0.5) - jy, 6)) AS ty
  FROM spots, (SELECT unnest(range(-1, 3)) AS jx), (SELECT unnest(range(-1, 3)) AS jy)),
weighed AS (SELECT *, ({_CUBIC("tx")}) * ({_CUBIC("ty")}) AS k FROM taps),
high AS (SELECT project_id, weighed.i + 2 AS frame_index, weighed.x, weighed.y, {", ".join(f"{_LEVEL(f'sum({c} * k) / sum(k)')} AS {c}" for c in "rgb")}, {_LEVEL("sum(255 * k)")} * opacity // 255 AS a
  FROM weighed JOIN half ON half.file_id = project_id AND half.frame_index = weighed.i AND half.x = sx AND half.y = sy GROUP BY project_id, weighed.i, weighed.x, weighed.y, opacity),
""" + _RENDERED[_RENDERED.index("met AS (SELECT") :] + " SELECT * FROM rendered WHERE a > 0"
)
EXPORT_PROJECT = _RENDERED + """ SELECT e.project_id::VARCHAR AS file_id, f AS frame_index, md5(string_agg(printf('%02X%02X%02X%02X', coalesce(r, 0), coalesce(g, 0), coalesce(b, 0), coalesce(a, 0)), '' ORDER BY py, ptx)) AS canvas_md5
FROM (SELECT project_id, unnest(range(0, total)) AS f FROM extent) e, (SELECT unnest(range(0, 10)) AS ptx), (SELECT unnest(range(0, 8)) AS py) LEFT JOIN rendered ON rendered.project_id = e.project_id AND rendered.frame_index = f AND rendered.x = ptx AND rendered.y = py GROUP BY e.project_id, f"""


def export_project(spark, d):
    """Rendered projects exported as files and decoded again: a digest of each canvas."""
    loaded, keys, rasters, sources, canvas = _project(spark, d)
    rendered = render.render_lines(P.active_clips(loaded), keys, rasters, sources, canvas, "nearest")
    files = render.export_project(staged(rendered), canvas, P.project_extent(loaded), 25, 1)
    return render.decode_animation(staged(files)).select("file_id", "frame_index", F.md5(F.hex("rgba")).alias("canvas_md5"))


QUERIES = {f.__name__: f for f in (parse_headers, replay_dense, coded_frames, file_parts, banded_frames, absolute_fades, shown_frames, coded_encodings, inspect_files, check_payloads, decode_still, project_round_trip, render_project, render_nearest, export_project)}
ORACLE_SQL = {k: globals()[k.upper()] for k in QUERIES if k.upper() in globals()}
