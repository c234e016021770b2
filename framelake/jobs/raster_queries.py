"""Queries over rasters and symbol streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import change, palette, runs, scanlines
from ..sources import views as V

UNIT, ORDER = ["file_id", "frame_index"], ["pixel_index"]


def runs_capped(spark, d):
    return runs.runs(V.rasters(spark, d), UNIT, ORDER, "level", cap=4)


_ISLANDS = """isl AS (SELECT file_id, frame_index, pixel_index, {v} AS v, pixel_index - row_number() OVER (PARTITION BY file_id, frame_index, {v} ORDER BY pixel_index) AS g FROM {t}),
grp AS (SELECT file_id, frame_index, v, g, min(pixel_index) AS s, count(*) AS n FROM isl GROUP BY ALL),
cut AS (SELECT file_id, frame_index, v, s + k * {cap} AS start, least({cap}, n - k * {cap}) AS run_length FROM grp, LATERAL (SELECT unnest(range(0, (n + {cap} - 1) // {cap})) AS k)),
runs AS (SELECT file_id, frame_index, row_number() OVER (PARTITION BY file_id, frame_index ORDER BY start) - 1 AS run_index, start, run_length, v FROM cut)"""


def _runs_sql(view: str, value: str, cap: int) -> str:
    return V.with_views(view) + ",\n" + _ISLANDS.format(v=value, t=view, cap=cap)


RUNS_CAPPED = _runs_sql("px", "level", 4) + " SELECT file_id, frame_index, run_index, start, run_length, v AS level FROM runs"


def _long(px):
    """A whole file as one long unit, so that runs go on over frames."""
    return px.withColumn("pixel_index", F.col("frame_index") * 64 + F.col("pixel_index")).withColumn("level", F.floor(F.col("level") / 3).cast("int"))


def merged_runs(spark, d):
    """Runs of whole files, each frame a block of its own."""
    return runs.runs_by_block(_long(V.rasters(spark, d)), ["file_id"], "frame_index", ["pixel_index"], "level", cap=5)


MERGED_RUNS = V.with_views("px") + ",\nlong AS (SELECT file_id, 0 AS frame_index, frame_index * 64 + pixel_index AS pixel_index, level // 3 AS level FROM px),\n" + _ISLANDS.format(v="level", t="long", cap=5) + " SELECT file_id, run_index, start, run_length, v AS level FROM runs"


def merged_line_runs(spark, d):
    """Runs of whole files from their lines at rest, in the order of frames and lines."""
    lines = V.raster_lines(spark, d).withColumn("line", F.col("frame_index") * 8 + F.col("y"))
    return runs.merge_runs(runs.line_runs(lines, ["file_id"], "line", "rgba"), ["file_id"], "line", "color", cap=3)


MERGED_LINE_RUNS = V.with_views("px") + ",\nlong AS (SELECT file_id, 0 AS frame_index, frame_index * 64 + pixel_index AS pixel_index, color FROM px),\n" + _ISLANDS.format(v="color", t="long", cap=3) + " SELECT file_id, run_index, start, run_length, v AS color FROM runs"


def packet_runs(spark, d):
    # runs and literals go on over frames and meet the packet limit
    return runs.packet_runs(_long(V.rasters(spark, d)), ["file_id"], ["pixel_index"], "level")


PACKET_RUNS = V.with_views("px") + """,
p AS (SELECT file_id, frame_index * 64 + pixel_index AS i, level // 3 AS v FROM px),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY file_id, v ORDER BY i) AS g FROM p),
grp AS (SELECT file_id, v, g, min(i) AS s, count(*) AS n FROM isl GROUP BY ALL),
cut AS (SELECT file_id, v, s + k * 128 AS s, least(128, n - k * 128) AS n FROM grp, LATERAL (SELECT unnest(range(0, (n + 127) // 128)) AS k)),
lit AS (SELECT file_id, s, row_number() OVER (PARTITION BY file_id ORDER BY s) AS o FROM cut WHERE n = 1),
seq AS (SELECT file_id, s, row_number() OVER (PARTITION BY file_id ORDER BY s) AS o FROM cut),
grouped AS (SELECT lit.file_id, lit.s, seq.o - lit.o AS grp FROM lit JOIN seq USING (file_id, s)),
placed AS (SELECT *, (row_number() OVER (PARTITION BY file_id, grp ORDER BY s) - 1) // 128 AS part FROM grouped),
packets AS (SELECT file_id, min(s) AS start, count(*) AS n, false AS is_repeat, NULL::INTEGER AS level FROM placed GROUP BY file_id, grp, part
  UNION ALL SELECT file_id, s, n, true, v FROM cut WHERE n > 1)
SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY start) - 1 AS packet_index, start, n, is_repeat, level FROM packets"""


def encoded_sizes(spark, d):
    return runs.encoded_sizes(runs.runs(V.rasters(spark, d), UNIT, ORDER, "color"), UNIT)


ENCODED_SIZES = _runs_sql("px", "color", 65535) + """
SELECT file_id, frame_index, count(*) AS n_runs, sum(run_length)::BIGINT AS n_values, n_values * 4 AS raw_rgba, n_runs * 6 AS rle_rgba, n_values AS raw_index, n_runs * 3 AS rle_index,
 least(raw_rgba, rle_rgba) AS data_rgba, least(raw_index, rle_index) AS data_index, rle_rgba < raw_rgba AS rgba_is_rle, rle_index < raw_index AS index_is_rle FROM runs GROUP BY file_id, frame_index"""


def text_runs(spark, d):
    return runs.text_runs(V.table(spark, d, "documents").withColumnRenamed("doc_id", "file_id"), ["file_id"], "text")


TEXT_RUNS = _runs_sql("sym", "v", 65535) + " SELECT file_id, run_index, start, run_length, v FROM runs"


def text_runs_sizes(spark, d):
    return runs.encoded_sizes(text_runs(spark, d), ["file_id"]).select("file_id", "n_runs", "n_values", "data_index", "index_is_rle")


TEXT_RUNS_SIZES = _runs_sql("sym", "v", 65535) + " SELECT file_id, count(*) AS n_runs, sum(run_length)::BIGINT AS n_values, least(n_values, n_runs * 3) AS data_index, n_runs * 3 < n_values AS index_is_rle FROM runs GROUP BY file_id"


def expand_runs(spark, d):
    r = runs.runs(V.rasters(spark, d), UNIT, ORDER, "level", cap=5)
    return runs.expand_runs(r, UNIT, "level", 8)


EXPAND_RUNS = V.with_views("px") + " SELECT file_id, frame_index, level, pixel_index, x, y FROM px"


def encode_decode_runs(spark, d):
    """Colour tokens made from runs and read back."""
    r = runs.runs(V.rasters(spark, d), UNIT, ORDER, "color")
    return runs.decode_fixed_runs(runs.encode_runs(r, UNIT, "color"), UNIT)


ENCODE_DECODE_RUNS = _runs_sql("px", "color", 65535) + " SELECT file_id, frame_index, run_index, start, run_length, v AS color FROM runs"


def validate_runs(spark, d):
    """Runs against the pixels they must cover; a third of the units lacks its first run, so that both codes occur."""
    from ..operators.validate import validate_runs as check

    r = runs.runs(V.rasters(spark, d), UNIT, ORDER, "level").filter("NOT (frame_index % 3 = 1 AND run_index = 0)")
    r = r.withColumn("run_length", F.when((F.col("frame_index") % 3 == 2) & (F.col("run_index") == 0), 0).otherwise(F.col("run_length")))
    expected = V.rasters(spark, d).groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n_pixels"))
    return check(r, expected, UNIT).select(*UNIT, F.array_join("errors", ",").alias("errors"))


VALIDATE_RUNS = _runs_sql("px", "level", 65535) + """,
bad AS (SELECT file_id, frame_index, CASE WHEN frame_index % 3 = 2 AND run_index = 0 THEN 0 ELSE run_length END AS n FROM runs WHERE NOT (frame_index % 3 = 1 AND run_index = 0)),
u AS (SELECT DISTINCT file_id, frame_index FROM px),
s AS (SELECT file_id, frame_index, sum(n) AS total, min(n) AS low FROM bad GROUP BY ALL)
SELECT u.file_id, u.frame_index, concat_ws(',', CASE WHEN low = 0 THEN 'zero_run' END, CASE WHEN coalesce(total, 0) <> 64 THEN 'pixel_count' END) AS errors FROM u LEFT JOIN s USING (file_id, frame_index)"""


def color_histogram(spark, d):
    return runs.color_histogram(runs.runs(V.rasters(spark, d), UNIT, ORDER, "color"), ["file_id"], "color")


COLOR_HISTOGRAM = V.with_views("px") + " SELECT file_id, color, count(*) AS n_pixels FROM px GROUP BY ALL"


def palette_first_seen(spark, d):
    return palette.build_palette(V.rasters(spark, d), "color", 7)


_PALETTE = """firsts AS (SELECT file_id, color, min(frame_index * 64 + pixel_index) AS seen FROM px GROUP BY ALL),
pal AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY seen) - 1 AS color_index, color FROM firsts QUALIFY count(*) OVER (PARTITION BY file_id) <= {n})"""
PALETTE_FIRST_SEEN = V.with_views("px") + ",\n" + _PALETTE.format(n=7) + " SELECT * FROM pal"


def palette_indices(spark, d):
    px = V.rasters(spark, d)
    return palette.to_indices(px, palette.build_palette(px)).select("file_id", "frame_index", "pixel_index", "color_index")


PALETTE_INDICES = V.with_views("px") + ",\n" + _PALETTE.format(n=256) + " SELECT file_id, frame_index, pixel_index, color_index FROM px JOIN pal USING (file_id, color)"


def palette_decode(spark, d):
    """Indices back to colours; every eleventh index is moved out of the palette, and says so."""
    px = V.rasters(spark, d)
    ix = palette.to_indices(px, palette.build_palette(px)).select("file_id", "frame_index", "pixel_index", F.when(F.col("pixel_index") % 11 == 10, F.col("color_index") + 300).otherwise(F.col("color_index")).alias("color_index"))
    return palette.from_indices(ix, palette.build_palette(px))


PALETTE_DECODE = V.with_views("px") + ",\n" + _PALETTE.format(n=256) + """ SELECT file_id, frame_index, pixel_index, CASE WHEN pixel_index % 11 = 10 THEN color_index + 300 ELSE color_index END AS color_index,
 CASE WHEN pixel_index % 11 = 10 THEN NULL ELSE color END AS color, CASE WHEN pixel_index % 11 = 10 THEN 'index_out_of_range' END AS error FROM px JOIN pal USING (file_id, color)"""


def frame_diff(spark, d):
    return change.diff_frames(V.rasters(spark, d)).select("file_id", "frame_index", "pixel_index", "x", "y", "prev", "color")


_DIFF = """diff AS (SELECT c.file_id, c.frame_index, c.pixel_index, c.x, c.y, p.color AS prev, c.color FROM {t} c JOIN {t} p ON p.file_id = c.file_id AND p.pixel_index = c.pixel_index AND p.frame_index = c.frame_index - 1 WHERE p.color <> c.color),
box AS (SELECT file_id, frame_index, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS n_changed FROM diff GROUP BY ALL),
crop AS (SELECT p.file_id, p.frame_index, (p.y - b.y) * b.w + p.x - b.x AS pixel_index, p.x - b.x AS x, p.y - b.y AS y, p.color FROM {t} p JOIN box b USING (file_id, frame_index) WHERE p.x BETWEEN b.x AND b.x + b.w - 1 AND p.y BETWEEN b.y AND b.y + b.h - 1)"""
FRAME_DIFF = V.with_views("px") + ",\n" + _DIFF.format(t="px") + " SELECT * FROM diff"


def _few(px):
    """Rasters with calm edges, so that boxes are smaller than the frame."""
    return px.withColumn("color", F.when((F.col("x") > F.pmod(F.col("frame_index"), F.lit(5)) + 1) | (F.col("y") > F.pmod(F.col("frame_index"), F.lit(3)) + 2), F.lit(1).cast("long")).otherwise(F.col("color")))


_FEW = "few AS (SELECT * REPLACE (CASE WHEN x > frame_index % 5 + 1 OR y > frame_index % 3 + 2 THEN 1 ELSE color END AS color) FROM px)"


def change_bbox(spark, d):
    return change.change_bbox(change.diff_frames(_few(V.rasters(spark, d))))


CHANGE_BBOX = V.with_views("px") + ",\n" + _FEW + ",\n" + _DIFF.format(t="few") + " SELECT * FROM box"


def crop_changed(spark, d):
    px = _few(V.rasters(spark, d))
    return change.crop(px, change.change_bbox(change.diff_frames(px))).select("file_id", "frame_index", "pixel_index", "x", "y", "color")


CROP_CHANGED = V.with_views("px") + ",\n" + _FEW + ",\n" + _DIFF.format(t="few") + " SELECT * FROM crop"


def export_choice(spark, d):
    return change.choose_export_frames(_few(V.rasters(spark, d)))


def _size_sql(t: str, name: str) -> str:
    return f"""{name} AS (SELECT file_id, frame_index, least(4 * count(*), 6 * (count(*) FILTER (is_new))) AS data FROM (
 SELECT *, color IS DISTINCT FROM lag(color) OVER (PARTITION BY file_id, frame_index ORDER BY pixel_index) OR row_number() OVER (PARTITION BY file_id, frame_index ORDER BY pixel_index) = 1 AS is_new FROM {t}) GROUP BY ALL)"""


EXPORT_CHOICE = V.with_views("px") + ",\n" + _FEW + ",\n" + _DIFF.format(t="few") + ",\n" + _size_sql("few", "fs") + ",\n" + _size_sql("crop", "ds") + """,
c AS (SELECT fs.file_id, fs.frame_index, fs.data + 16 AS full_bytes, CASE WHEN fs.frame_index > 0 THEN coalesce(ds.data + 24, 4) END AS delta_bytes, coalesce(delta_bytes < full_bytes, false) AS d, box.x, box.y, box.w, box.h
 FROM fs LEFT JOIN ds USING (file_id, frame_index) LEFT JOIN box USING (file_id, frame_index))
SELECT file_id, frame_index, CASE WHEN d THEN 2 ELSE 1 END AS frame_type, full_bytes, delta_bytes, CASE WHEN d THEN delta_bytes ELSE full_bytes END AS payload_bytes,
 CASE WHEN d THEN x END AS x, CASE WHEN d THEN y END AS y, CASE WHEN d THEN w END AS w, CASE WHEN d THEN h END AS h FROM c"""


def packet_sizes(spark, d):
    """Bytes of each frame as packets."""
    px = V.rasters(spark, d)
    return runs.packet_sizes(runs.packet_runs(px, UNIT, ORDER, "color"), UNIT)


PACKET_SIZES = _runs_sql("px", "color", 128) + """,
lit AS (SELECT *, run_index - row_number() OVER (PARTITION BY file_id, frame_index ORDER BY run_index) AS g FROM runs WHERE run_length = 1),
sizes AS (SELECT file_id, frame_index, count(*) AS n, ((count(*) + 127) // 128) + 4 * count(*) AS bytes FROM lit GROUP BY file_id, frame_index, g UNION ALL SELECT file_id, frame_index, run_length, 5 FROM runs WHERE run_length > 1)
SELECT file_id, frame_index, sum(n)::BIGINT AS n_pixels, sum(bytes)::BIGINT AS packed_bytes FROM sizes GROUP BY file_id, frame_index"""


def index_runs(spark, d):
    """Palette indices as tokens of three bytes, and back."""
    px = V.rasters(spark, d)
    ix = palette.to_indices(px, palette.build_palette(px))
    r = runs.runs(ix, UNIT, ORDER, "color_index")
    return runs.decode_fixed_runs(runs.encode_runs(r, UNIT, "color_index", True), UNIT, True).withColumnRenamed("color", "color_index")


INDEX_RUNS = V.with_views("px") + ",\n" + _PALETTE.format(n=256) + ",\nix AS (SELECT px.*, pal.color_index FROM px JOIN pal USING (file_id, color)),\n" + _ISLANDS.format(v="color_index", t="ix", cap=65535) + " SELECT file_id, frame_index, run_index, start, run_length, v AS color_index FROM runs"


def scanline_diff(spark, d):
    """Lines of rasters that differ from the line of the frame before, as bytes."""
    px = _few(V.rasters(spark, d))
    line = F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", F.lpad(F.hex("color"), 8, "0").alias("t")))), lambda x: x["t"]), ""))
    lines = px.groupBy(*UNIT, "y").agg(line.alias("rgba"))
    return change.diff_scanlines(lines).select(*UNIT, "y", F.hex("rgba").alias("line"), F.hex("prev").alias("prev"))


SCANLINE_DIFF = V.with_views("px") + ",\n" + _FEW + """,
lines AS (SELECT file_id, frame_index, y, string_agg(printf('%08X', color), '' ORDER BY x) AS line FROM few GROUP BY ALL)
SELECT c.file_id, c.frame_index, c.y, c.line, p.line AS prev FROM lines c JOIN lines p ON p.file_id = c.file_id AND p.y = c.y AND p.frame_index = c.frame_index - 1 WHERE p.line <> c.line"""


def forced_choice(spark, d):
    """The encoder's choice over palette indices, with every fourth frame FULL."""
    px = V.fades(spark, d)
    ix = palette.to_indices(px, palette.build_palette(px))
    return change.choose_frames(ix, "color_index", indexed=True, force_full_every=4)


def swap_channels(spark, d):
    return S.swap_channels(V.rasters(spark, d)).select("file_id", "frame_index", "pixel_index", "r", "g", "b", "a")


SWAP_CHANNELS = V.with_views("px") + " SELECT file_id, frame_index, pixel_index, b AS r, g, r AS b, a FROM px"


def force_opaque(spark, d):
    return S.force_opaque(V.fades(spark, d)).select("file_id", "frame_index", "pixel_index", "r", "g", "b", "a")


FORCE_OPAQUE = V.with_views("fades") + " SELECT file_id, frame_index, pixel_index, r, g, b, 255 AS a FROM fades"


def apply_alpha(spark, d):
    return S.apply_alpha(V.fades(spark, d), F.pmod(F.col("frame_index") * 37, F.lit(256))).select("file_id", "frame_index", "pixel_index", "a")


APPLY_ALPHA = V.with_views("fades") + " SELECT file_id, frame_index, pixel_index, (a * ((frame_index * 37) % 256)) // 255 AS a FROM fades"


def uniform_alpha(spark, d):
    return change.uniform_alpha(change.with_previous(V.fades(spark, d)))


_ALPHA = """pair AS (SELECT c.file_id, c.frame_index, c.pixel_index, c.r = p.r AND c.g = p.g AND c.b = p.b AS same, p.a = 0 AND c.a <> 0 AS appears, CASE WHEN p.a <> 0 THEN c.a / p.a END AS ratio
 FROM fades c JOIN fades p ON p.file_id = c.file_id AND p.pixel_index = c.pixel_index AND p.frame_index = c.frame_index - 1),
firstr AS (SELECT file_id, frame_index, arg_min(ratio, pixel_index) FILTER (ratio IS NOT NULL) AS f FROM pair GROUP BY ALL),
ua AS (SELECT pair.file_id, pair.frame_index, CASE WHEN bool_and(same) AND NOT bool_or(appears) AND coalesce(max(abs(ratio - f)), 0) <= 1/255.0::DOUBLE
   THEN CASE WHEN any_value(f) IS NULL THEN 255 ELSE CAST(round_even(least(1, greatest(0, any_value(f))) * 255, 0) AS INTEGER) END END AS alpha FROM pair JOIN firstr USING (file_id, frame_index) GROUP BY pair.file_id, pair.frame_index)"""
UNIFORM_ALPHA = V.with_views("fades") + ",\n" + _ALPHA + " SELECT * FROM ua"


def uniform_alpha_lines(spark, d):
    return scanlines.uniform_alpha_lines(V.fade_lines(spark, d))


UNIFORM_ALPHA_LINES = UNIFORM_ALPHA


def change_bbox_lines(spark, d):
    return scanlines.change_bbox_lines(V.fade_lines(spark, d))


CHANGE_BBOX_LINES = V.with_views("fades") + ",\n" + _DIFF.format(t="fades") + " SELECT file_id, frame_index, x, y, w, h FROM box"


def frame_choice(spark, d):
    """The encoder's choice from lines at rest."""
    return scanlines.choose_frames_lines(V.fade_lines(spark, d))


def frame_choice_pixels(spark, d):
    """The same from a row for each pixel."""
    return change.choose_frames(V.fades(spark, d))


FRAME_CHOICE = V.with_views("fades") + ",\n" + _ALPHA + ",\n" + _DIFF.format(t="fades") + ",\n" + _size_sql("fades", "fs") + ",\n" + _size_sql("crop", "ds") + """,
c AS (SELECT fs.file_id, fs.frame_index, fs.data + 16 AS full_bytes, ds.data + 24 AS delta_bytes, ua.alpha AS ua, CASE WHEN fs.frame_index = 0 THEN 1 WHEN ua.alpha IS NOT NULL THEN 3 WHEN ds.data + 24 < fs.data + 16 THEN 2 ELSE 1 END AS frame_type, box.x, box.y, box.w, box.h
 FROM fs LEFT JOIN ds USING (file_id, frame_index) LEFT JOIN box USING (file_id, frame_index) LEFT JOIN ua USING (file_id, frame_index))
SELECT file_id, frame_index, frame_type, CASE WHEN frame_type = 3 THEN ua END AS alpha, full_bytes, delta_bytes, CASE frame_type WHEN 3 THEN 28 WHEN 2 THEN delta_bytes ELSE full_bytes END AS payload_bytes,
 CASE WHEN frame_type = 2 THEN x END AS x, CASE WHEN frame_type = 2 THEN y END AS y, CASE WHEN frame_type = 2 THEN w END AS w, CASE WHEN frame_type = 2 THEN h END AS h FROM c"""


FORCED_CHOICE = (
    FRAME_CHOICE.replace("least(4 * count(*), 6 * (count(*) FILTER (is_new)))", "least(count(*), 3 * (count(*) FILTER (is_new)))").replace("WHEN fs.frame_index = 0 THEN 1", "WHEN fs.frame_index % 4 = 0 THEN 1")
)


FRAME_CHOICE_PIXELS = FRAME_CHOICE


def forced_choice_lines(spark, d):
    """The encoder's choice over palette indices, with every fourth frame FULL, from lines."""
    return scanlines.choose_frames_lines(V.fade_lines(spark, d), indexed=True, force_full_every=4)


FORCED_CHOICE_LINES = FORCED_CHOICE


def export_choice_lines(spark, d):
    """The editor's choice from lines."""
    return scanlines.choose_frames_lines(V.fade_lines(spark, d), editor=True)


EXPORT_CHOICE_LINES = EXPORT_CHOICE.replace(V.with_views("px") + ",\n" + _FEW, V.with_views("fades")).replace("FROM few", "FROM fades").replace("JOIN few", "JOIN fades")


def absolute_choice(spark, d):
    """Choices whose fades come back exactly, every eleventh frame FULL."""
    return scanlines.choose_frames_absolute(V.fade_lines(spark, d), force_full_every=11)


# all pairs of a frame and one before it in its segment, with their facts; the choices then walk along them
ABSOLUTE_CHOICE = V.with_views("fades").replace("WITH ", "WITH RECURSIVE ", 1) + """,
pair AS (SELECT c.file_id, p.frame_index AS k, c.frame_index AS i, c.pixel_index, c.x, c.y, c.color, p.color <> c.color AS changed, c.r = p.r AND c.g = p.g AND c.b = p.b AND (p.a > 0 OR c.a = 0) AS same, p.a AS pa, c.a AS ca
 FROM fades c JOIN fades p ON p.file_id = c.file_id AND p.pixel_index = c.pixel_index AND p.frame_index < c.frame_index AND p.frame_index // 11 = c.frame_index // 11),
facts AS (SELECT file_id, k, i, bool_and(same) AS same, coalesce(max((255 * ca + pa - 1) // nullif(pa, 0)) FILTER (pa > 0), 255) AS lo, coalesce(min(least(255, (255 * (ca + 1) + pa - 1) // nullif(pa, 0) - 1)) FILTER (pa > 0), 255) AS hi,
  coalesce(CAST(round_even(255 * (arg_min(ca / nullif(pa, 0), pixel_index) FILTER (pa > 0)), 0) AS INTEGER), 255) AS wanted,
  min(x) FILTER (changed) AS x, min(y) FILTER (changed) AS y, max(x) FILTER (changed) - min(x) FILTER (changed) + 1 AS w, max(y) FILTER (changed) - min(y) FILTER (changed) + 1 AS h FROM pair GROUP BY ALL),
inbox AS (SELECT p.file_id, p.k, p.i, p.color IS DISTINCT FROM lag(p.color) OVER (PARTITION BY p.file_id, p.k, p.i ORDER BY p.pixel_index) AS is_new FROM pair p JOIN facts f USING (file_id, k, i) WHERE p.x BETWEEN f.x AND f.x + f.w - 1 AND p.y BETWEEN f.y AND f.y + f.h - 1),
ds AS (SELECT file_id, k, i, least(4 * count(*), 6 * (count(*) FILTER (is_new))) + 24 AS delta_bytes FROM inbox GROUP BY ALL),
""" + _size_sql("fades", "fs") + """,
step AS (SELECT f.*, ds.delta_bytes, fs.data + 16 AS full_bytes, CASE WHEN same AND lo <= hi THEN least(greatest(wanted, lo), hi) END AS alpha FROM facts f LEFT JOIN ds USING (file_id, k, i) JOIN fs ON fs.file_id = f.file_id AND fs.frame_index = f.i),
walk AS (
 SELECT file_id, frame_index AS i, frame_index AS k, 255 AS held, 1 AS frame_type, NULL::INTEGER AS alpha, data + 16 AS full_bytes, NULL::BIGINT AS delta_bytes, NULL::BIGINT AS x, NULL::BIGINT AS y, NULL::BIGINT AS w, NULL::BIGINT AS h FROM fs WHERE frame_index % 11 = 0
 UNION ALL
 SELECT file_id, i, CASE WHEN t = 3 THEN k ELSE i END, CASE WHEN t = 3 THEN alpha ELSE 255 END, t, alpha, full_bytes, CASE WHEN alpha IS NULL AND held = 255 THEN delta_bytes END,
  CASE WHEN t = 2 THEN x END, CASE WHEN t = 2 THEN y END, CASE WHEN t = 2 THEN w END, CASE WHEN t = 2 THEN h END
 FROM (SELECT s.*, w.held, CASE WHEN s.alpha IS NOT NULL THEN 3 WHEN w.held = 255 AND s.delta_bytes < s.full_bytes THEN 2 ELSE 1 END AS t FROM walk w JOIN step s ON s.file_id = w.file_id AND s.k = w.k AND s.i = w.i + 1))
SELECT file_id, i AS frame_index, frame_type, alpha, full_bytes, delta_bytes, CASE frame_type WHEN 3 THEN 28 WHEN 2 THEN delta_bytes ELSE full_bytes END AS payload_bytes, x, y, w, h FROM walk"""


def encoding_report(spark, d):
    px = _few(V.rasters(spark, d))
    n = px.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n_pixels"))
    return change.encoding_report(change.choose_export_frames(px), n)


ENCODING_REPORT = V.with_views("px") + ",\n" + _FEW + ",\n" + _DIFF.format(t="few") + ",\n" + _size_sql("few", "fs") + ",\n" + _size_sql("crop", "ds") + """,
c AS (SELECT fs.file_id, CASE WHEN fs.frame_index > 0 AND coalesce(ds.data + 24, 4) < fs.data + 16 THEN coalesce(ds.data + 24, 4) ELSE fs.data + 16 END AS bytes FROM fs LEFT JOIN ds USING (file_id, frame_index))
SELECT file_id, count(*) AS n_frames, (count(*) * 256)::BIGINT AS raw_bytes, sum(bytes)::BIGINT AS payload_bytes, (sum(bytes) + 28 * count(*))::BIGINT AS frame_bytes, round((sum(bytes) + 28 * count(*)) / (count(*) * 256), 6) AS ratio FROM c GROUP BY ROLLUP (file_id)"""

QUERIES = {f.__name__: f for f in (
    runs_capped, merged_runs, merged_line_runs, packet_runs, encoded_sizes, text_runs, text_runs_sizes, expand_runs, encode_decode_runs, validate_runs, color_histogram, palette_first_seen, palette_indices, palette_decode,
    frame_diff, change_bbox, crop_changed, export_choice, swap_channels, force_opaque, apply_alpha, uniform_alpha, uniform_alpha_lines, change_bbox_lines, frame_choice, frame_choice_pixels, encoding_report,
    packet_sizes, index_runs, scanline_diff, forced_choice, forced_choice_lines, export_choice_lines, absolute_choice)}
ORACLE_SQL = {k: globals()[k.upper()] for k in QUERIES}
