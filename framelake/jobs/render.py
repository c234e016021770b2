"""Whole jobs: encode rasters to files, decode files to canvases, render a project."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import duration_fraction
from ..operators import bands, dense, palette, present, runs, scanlines, validate
from ..operators.project import interpolate_keyframes, place_layers, source_key
from ..operators.replay import replay_state, segments
from ..sources import media
from ..sources.stage import staged

UNIT = ["file_id", "frame_index"]


def _encoded(lines: DataFrame, choice: DataFrame, indexed: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The choice with each frame's encoding, and bytes of full frames and of boxes, made for the chosen form only."""
    choice = staged(choice)
    full = choice.filter("frame_type = 1").select(*UNIT)
    boxes = choice.filter("frame_type = 2 AND w IS NOT NULL").select(*UNIT, "x", "y", "w", "h")
    full_data, rect_data = staged(scanlines.unit_data(lines.join(full, UNIT, "left_semi"))), staged(scanlines.unit_data(lines, boxes))
    enc = full_data.select(*UNIT, "encoding").unionByName(rect_data.select(*UNIT, "encoding"))
    alpha = F.col("alpha") if "alpha" in choice.columns else F.lit(None).cast("int")
    c = choice.join(enc, UNIT, "left").select(*UNIT, "frame_type", alpha.alias("alpha"), "x", "y", "w", "h", F.coalesce("encoding", F.lit(2 if indexed else 0)).alias("encoding"))
    return c, full_data, rect_data


def encode_animation(frames: DataFrame, sizes: DataFrame, durations: DataFrame | None = None, *, editor: bool = True, force_rgba: bool = False, force_full_every: int = 0, fade_mode: str = "previous") -> DataFrame:
    """Animation files (file_id, content) from lines (file_id, frame_index, y, rgba) or from pixels (x, y, color). Bytes are made for the chosen form of each frame only.

    `editor` chooses frames as the editor's export does: RGBA, FULL or DELTA.
    Else as the encoder does: with a palette for each file of 256 colours at
    most (but for `force_rgba`), and TRANSFORM for what one alpha factor
    explains: against the frame before, or, with `fade_mode="absolute"`, against
    the last FULL or DELTA frame and to the last digit, so that what a decoder
    shows is what was encoded. `force_full_every` bounds a segment, which is
    what one task of the absolute mode works through. `sizes`: file_id, flags,
    canvas_width, canvas_height, fps_num, fps_den. `durations`: file_id,
    frame_index and either duration_num and duration_den or duration_ms (null:
    100).
    """
    lines = staged(frames if "rgba" in frames.columns else scanlines.lines_of(frames)).select(*UNIT, "y", "rgba")
    none = sizes.select("file_id", F.lit(0).alias("color_index"), F.lit(0).cast("long").alias("color")).filter("false")
    choose = {
        "previous": lambda p, i: scanlines.choose_frames_lines(p, indexed=i, force_full_every=force_full_every),
        "absolute": lambda p, i: scanlines.choose_frames_absolute(p, indexed=i, force_full_every=force_full_every),
    }[fade_mode]
    if editor:
        pal, parts = none, [_encoded(lines, scanlines.choose_frames_lines(lines, force_full_every=force_full_every, editor=True), False)]
    elif force_rgba:
        pal, parts = none, [_encoded(lines, choose(lines, False), False)]
    else:
        # colours in first-seen order straight from the runs of lines
        seen = runs.line_runs(lines, UNIT, "y", "rgba").withColumn("pixel_index", F.struct("y", "at"))
        pal = staged(palette.build_palette(seen))
        colors = pal.groupBy("file_id").agg(_palette_bytes().alias("colors"))
        plain, coded = lines.join(colors, "file_id", "left_anti"), lines.join(colors, "file_id")
        parts = [_encoded(plain, choose(plain, False), False), _encoded(coded, choose(coded, True), True)]
    c, full_data, rect_data = (reduce(DataFrame.unionByName, x) for x in zip(*parts))
    if durations is not None and "duration_num" in durations.columns:
        c = c.join(durations.select(*UNIT, "duration_num", "duration_den"), UNIT, "left")
    else:
        c = c.join(durations, UNIT, "left") if durations is not None else c.withColumn("duration_ms", F.lit(None).cast("int"))
        ms = c.select("duration_ms").distinct()  # few: the fractions are worked out once for each
        num, den = duration_fraction(F.col("duration_ms"))
        ms = ms.select(F.col("duration_ms").alias("_ms"), num.alias("duration_num"), den.alias("duration_den"))
        c = c.join(ms, F.col("duration_ms").eqNullSafe(F.col("_ms"))).drop("_ms")
    c = c.join(sizes.select("file_id", F.col("canvas_width").alias("width"), F.col("canvas_height").alias("height")), "file_id")
    return media.assemble_files(sizes, pal, media.frame_blobs(c, full_data, rect_data))


def _palette_bytes() -> Column:
    """RGBA of a palette's rows by index."""
    return F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("color_index", F.lpad(F.hex("color"), 8, "0").alias("t")))), lambda x: x["t"]), ""))


def decode_bands(files: DataFrame, band_lines: int = bands.BAND, carry: tuple[str, ...] = ()) -> DataFrame:
    """`decode_animation` as bands of lines (file_id, frame_index, band, rgba, shown), for canvases of any size.

    Segments are found from keys and types alone; data stays packed until the
    task that replays it. `carry` names columns of the transform state
    (`state_pos_x` and so on), `canvas_width` or `canvas_height` to come along.
    """
    frames = staged(media.explode_frames(files))
    state = replay_state(segments(frames.select(*UNIT, "frame_type")).join(media.parse_transforms(frames), UNIT, "left"))
    fields = [c for c in carry if c in state.columns]
    seg = state.select(*UNIT, "segment", F.col("state_alpha").cast("int").alias("alpha"), *fields)
    head = media.parse_headers(files).select(F.col("file_id").cast("string").alias("file_id"), F.col("canvas_width").cast("int").alias("canvas_width"), F.col("canvas_height").cast("int").alias("canvas_height"))
    colors = media.explode_palette(files).groupBy("file_id").agg(_palette_bytes().alias("colors"))
    zero = F.lit(0)
    full = frames.filter("frame_type = 1").select(*UNIT, zero.alias("rect_index"), zero.alias("x"), zero.alias("y"), F.col("width").alias("w"), F.col("height").alias("h"), "encoding", "data")
    rects = media.explode_rects(frames).filter("error IS NULL").select(*UNIT, "rect_index", "x", "y", "w", "h", "encoding", "data")
    writes = full.unionByName(rects).join(seg.drop("alpha", *fields), UNIT).join(colors, "file_id", "left")
    writes = writes.withColumn("colors", F.when(F.col("encoding") >= 2, F.col("colors")))
    return bands.replay_bands(writes, seg.join(head, "file_id"), band_lines, carry)


def decode_animation(files: DataFrame, band_lines: int = bands.BAND) -> DataFrame:
    """Canvases (file_id, frame_index, rgba, shown) of whole files, of all encodings and frame types.

    `rgba` is the canvas, `shown` the canvas under the alpha that TRANSFORM
    frames have set. Where no canvas has more than one band, bands are canvases.
    """
    tallest = media.parse_headers(files).agg(F.max("canvas_height")).first()[0] or 0
    out = decode_bands(files, band_lines)
    return out.drop("band") if tallest <= band_lines else bands.join_bands(out)


def show_animation(files: DataFrame, method: str = "smooth", turn_method: str = "nearest", background: tuple[int, int, int] | None = None, band_lines: int = bands.BAND) -> DataFrame:
    """What a player shows of whole files: images (file_id, frame_index, width, height, rgba) of the canvas' size, the canvas under all six transform fields (`present`), over `background` if one is given.

    The state comes along with the replayed canvases, so that showing them is
    one more step of the same task and moves nothing.
    """
    carry = (*present.STATE, "canvas_width", "canvas_height")
    tallest = media.parse_headers(files).agg(F.max("canvas_height")).first()[0] or 0
    out = decode_bands(files, band_lines, carry)
    if tallest > band_lines:
        out = bands.join_bands(out, carry)
    return present.present_frames(out.withColumnsRenamed({"canvas_width": "width", "canvas_height": "height"}), UNIT, method, turn_method, background)


def decode_folder(spark: SparkSession, path: str, profile: str = "strict") -> tuple[DataFrame, DataFrame]:
    """Canvases of the sound animation files of a folder, and the quarantine (file_id, errors): files with a broken header, chain of frames or payload."""
    files = media.read_media(spark, path)
    heads = validate.validate_headers(media.parse_headers(files.filter("kind = 'animation'")), profile)
    good, bad = validate.split_valid(heads)
    unknown = files.filter("kind IS NULL").select("file_id", F.array(F.lit("magic")).alias("errors"))
    files = files.join(good.select("file_id"), "file_id", "left_semi")
    chain = media.walk_chunks(files, "frame").filter("error IS NOT NULL").select("file_id", "error")
    frames = staged(media.explode_frames(files))
    rects = media.explode_rects(frames)
    checked = validate.validate_frames(media.frame_places(frames, good)).select("file_id", F.explode("errors").alias("error"))
    payloads = validate.validate_payloads(*media.payload_facts(frames, rects, good), media.explode_palette(files)).select("file_id", F.explode("errors").alias("error"))
    found = chain.unionByName(checked).unionByName(payloads).unionByName(rects.filter("error IS NOT NULL").select("file_id", "error"))
    broken = staged(found.groupBy("file_id").agg(F.sort_array(F.collect_set("error")).alias("errors")))
    canvases = decode_animation(files.join(broken.select("file_id"), "file_id", "left_anti"))
    return canvases, bad.select("file_id", "errors").unionByName(unknown).unionByName(broken)


def render_lines(active: DataFrame, keyframes: DataFrame, rasters: DataFrame, sources: DataFrame, canvas: DataFrame, method: str = "bicubic") -> DataFrame:
    """Lines (project_id, frame_index, y, rgba) of projects: placed, scaled, turned and faded layers over one another. Blank lines have no row.

    `active`: rows of `active_clips`. `keyframes`: project_id, clip_index,
    frame_index and values. `rasters`: source_id, source_frame_index and rgba
    (a whole image), or x, y, r, g, b, a. `sources`: source_id, canvas_width,
    canvas_height; with project_id in it the numbers count within each project,
    and `rasters` has it too. `canvas`: project_id, out_width, out_height.
    Equal (source frame, scale, rotation) are warped once, whole images within
    their tasks, as keyframes often hold. Layers are clipped to the canvas and
    meet line by line.
    """
    key = F.concat_ws("/", "project_id", "clip_index")
    act = active.withColumn("clip_key", key)
    at = interpolate_keyframes(keyframes.withColumn("clip_key", key), act.select("clip_key", F.col("local_frame_index").alias("frame_index")))
    placed = place_layers(act, at, sources).join(act.select("project_id", "frame_index", "clip_index", "source_id", "source_frame_index"), ["project_id", "frame_index", "clip_index"])
    placed = placed.withColumn("deg", F.when(F.abs("rotation_deg") > 1e-6, F.round("rotation_deg", 6)).otherwise(0.0))
    source = source_key(sources)
    form = [*source, "source_frame_index", "new_width", "new_height", "deg"]
    placed = staged(placed.withColumnsRenamed({"width": "new_width", "height": "new_height"}))
    images = rasters if "rgba" in rasters.columns else dense.images_of(rasters, [*source, "source_frame_index"])
    sized = images.join(sources.select(*source, F.col("canvas_width").alias("width"), F.col("canvas_height").alias("height")), source).join(placed.select(*form).distinct(), [*source, "source_frame_index"])
    keyed = sized.withColumns({"_form_w": F.col("new_width"), "_form_h": F.col("new_height"), "_form_deg": F.col("deg")})
    warped = dense.warp_images(keyed, [*source, "source_frame_index", "_form_w", "_form_h", "_form_deg"], method).withColumnsRenamed({"_form_w": "new_width", "_form_h": "new_height", "_form_deg": "deg"})
    # both sides are written, so that nothing but the join stands behind its exchanges and a popular image can be split there
    layers = placed.withColumn("z", F.col("clip_index")).join(staged(warped), form).join(canvas.select("project_id", "out_width", "out_height"), "project_id")
    return dense.fold_lines(dense.layer_lines(layers, ["project_id", "frame_index"]), ["project_id", "frame_index"])


def render_project(active: DataFrame, keyframes: DataFrame, rasters: DataFrame, sources: DataFrame, canvas: DataFrame, method: str = "bicubic") -> DataFrame:
    """`render_lines` as visible pixels (project_id, frame_index, x, y, r, g, b, a). Frames without a visible pixel have no row."""
    lines = render_lines(active, keyframes, rasters, sources, canvas, method).withColumnRenamed("y", "_line").withColumn("_wide", F.lit(1 << 30))
    px = dense.pixels_of(lines, ["project_id", "frame_index", "_line"], "_wide").filter("a > 0")
    return px.select("project_id", "frame_index", "x", F.col("_line").alias("y"), *"rgba")


def export_project(rendered: DataFrame, canvas: DataFrame, extent: DataFrame, fps_num: int, fps_den: int, force_full_every: int = 0) -> DataFrame:
    """Animation files of rendered projects (lines, or visible pixels): every timeline frame, also empty ones, with the constant duration fps_den / fps_num, kept as a fraction. A blank line is one row, blank pixels are none."""
    if "rgba" not in rendered.columns:
        rendered = scanlines.sparse_lines(rendered, canvas, ["project_id", "frame_index"])
    c = canvas.join(extent, "project_id").filter("total_frames > 0").withColumn("frame_index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total_frames") - 1)))
    grid = c.select("project_id", "frame_index", "out_width", F.explode(F.sequence(F.lit(0), F.col("out_height") - 1)).alias("y"))
    blank = F.unhex(F.repeat(F.lit("00000000"), F.col("out_width")))
    lines = grid.join(rendered, ["project_id", "frame_index", "y"], "left").select(F.col("project_id").cast("string").alias("file_id"), "frame_index", "y", F.coalesce("rgba", blank).alias("rgba"))
    sizes = canvas.select(F.col("project_id").cast("string").alias("file_id"), F.lit(1).alias("flags"), F.col("out_width").alias("canvas_width"), F.col("out_height").alias("canvas_height"), F.lit(fps_num).alias("fps_num"), F.lit(fps_den).alias("fps_den"))
    times = c.select(F.col("project_id").cast("string").alias("file_id"), "frame_index", F.lit(fps_den).alias("duration_num"), F.lit(fps_num).alias("duration_den"))
    return encode_animation(lines, sizes, times, force_full_every=force_full_every)
