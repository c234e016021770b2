"""Golden bytes, rules of the formats, and edges."""

import pytest
from pyspark.sql import functions as F

from framelake.functions import scalars as S
from framelake.jobs import render
from framelake.operators import change, project, replay, runs, validate
from framelake.operators.composite import composite
from framelake.sources import media

STILL = bytes.fromhex("4d49493003000000010000000100000 00a000000811e140aff0003020180".replace(" ", ""))
ANIMATION = bytes.fromhex(
    "4d49474946020031030200000001000000030000000a000000010000001800000049000000e40000000000000000000000"
    "504c54451800000002000000000000000a141eff01020380"
    "2e00000001000000010000000a000000120000000000000000000000020000000200000001000000020000000001"
    "3500000002000000010000000a00000019000000000000000000000002000100010000000000000001000000010000000100000000"
    "380000000300000001000000140000001c000000000000000000000004000000000000000000000080000000000001000000010000000000"
)
A, B = 0x0A141EFF, 0x01020380


def files(spark, *contents):
    return spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(contents)], "file_id string, content binary")


def test_golden_still(spark):
    f = files(spark, STILL)
    h = validate.validate_still_headers(media.parse_still_headers(f)).first()
    assert (h.width, h.height, h.format, h.packed_size, h.errors) == (3, 1, 1, 10, [])
    assert sorted((r.start, r.run_length, r.color) for r in media.decode_packets(f).collect()) == [(0, 2, A), (2, 1, B)]
    px = spark.createDataFrame([("f0", i, c) for i, c in enumerate((A, A, B))], "file_id string, pixel_index int, color long")
    packets = runs.packet_runs(px, ["file_id"], ["pixel_index"], "color")
    size = spark.createDataFrame([("f0", 3, 1)], "file_id string, width int, height int")
    assert bytes(media.encode_stills(packets, px, size).first().content) == STILL


def test_golden_animation(spark):
    f = files(spark, ANIMATION)
    h = validate.validate_headers(media.parse_headers(f)).first()
    assert (h.canvas_width, h.canvas_height, h.frame_count, h.fps_num, h.file_size, h.errors) == (2, 1, 3, 10, len(ANIMATION), [])
    assert [(r.color_index, r.color) for r in media.explode_palette(f).orderBy("color_index").collect()] == [(0, A), (1, B)]
    fr = media.explode_frames(f).orderBy("frame_index").collect()
    assert [(r.frame_type, r.duration_num, r.duration_den) for r in fr] == [(1, 1, 10), (2, 1, 10), (3, 1, 20)]
    assert bytes(fr[0].data) == b"\x00\x01" and fr[0].encoding == 2
    r = media.explode_rects(media.explode_frames(f)).first()
    assert (r.x, r.y, r.w, r.h, bytes(r.data)) == (1, 0, 1, 1, b"\x00")
    t = media.parse_transforms(media.explode_frames(f)).first()
    assert (t.transform_flags, t.alpha, t.scale_x, t.rotation_deg) == (4, 128, 65536, 0)


@pytest.mark.parametrize("at, new, code", [(4, b"X", "magic"), (5, b"\x03", "version"), (25, b"\0\0\0\0", "fps_den"), (9, b"\0\0\0\0", "canvas"), (7, b"\x10", "header_size")])
def test_bad_headers(spark, at, new, code):
    bad = ANIMATION[:at] + new + ANIMATION[at + len(new) :]
    assert code in validate.validate_headers(media.parse_headers(files(spark, bad))).first().errors
    lenient = validate.validate_headers(media.parse_headers(files(spark, bad)), "lenient").first().errors
    assert (code in lenient) == (code not in ("canvas", "header_size"))


def test_cut_files(spark):
    e = {r.file_id: r.errors for r in validate.validate_headers(media.parse_headers(files(spark, ANIMATION[:-1], b"", ANIMATION[:20]))).collect()}
    assert e["f0"] == ["file_size"] and e["f1"] == e["f2"] == ["too_short"]
    assert [r.error for r in media.walk_chunks(files(spark, ANIMATION[:-1]), "frame").filter("position < 0").collect()] == ["frame_size"]


@pytest.mark.parametrize("n, want", [(1, [(1, False)]), (2, [(2, True)]), (128, [(128, True)]), (129, [(128, True), (1, False)]), (256, [(128, True)] * 2), (257, [(128, True)] * 2 + [(1, False)])])
def test_packets_of_one_run(spark, n, want):
    df = spark.range(n).select(F.lit("u").alias("u"), F.col("id").alias("i"), F.lit(7).alias("v"))
    assert [(r.n, r.is_repeat) for r in runs.packet_runs(df, ["u"], ["i"], "v").orderBy("packet_index").collect()] == want


def test_long_run_is_cut(spark):
    df = spark.range(65536).select(F.lit("u").alias("u"), F.col("id").alias("i"), F.lit(None).cast("int").alias("v"))
    assert [(r.start, r.run_length) for r in runs.runs(df, ["u"], ["i"], "v").orderBy("run_index").collect()] == [(0, 65535), (65535, 1)]


def pixels(spark, *frames):
    rows = [("f", i, p, p, 0, *c) for i, fr in enumerate(frames) for p, c in enumerate(fr)]
    df = spark.createDataFrame(rows, "file_id string, frame_index int, pixel_index int, x int, y int, r int, g int, b int, a int")
    return df.withColumn("color", S.rgba())


def test_identical_frames_are_transforms(spark):
    """Unchanged frames, also fully transparent ones, give alpha 255; a colour change where both are transparent doesn't."""
    c, t = (1, 2, 3, 200), (1, 2, 3, 0)
    got = change.choose_frames(pixels(spark, [c, c], [c, c])).orderBy("frame_index").collect()
    assert [(r.frame_type, r.alpha) for r in got] == [(1, None), (3, 255)]
    alpha = lambda *f: change.uniform_alpha(change.with_previous(pixels(spark, *f))).first().alpha
    assert alpha([t, t], [t, t]) == 255
    assert alpha([t, t], [t, (9, 2, 3, 0)]) is None
    assert alpha([t, c], [c, c]) is None
    assert alpha([c, c], [(1, 2, 3, 100), (1, 2, 3, 101)]) is None or alpha([c, c], [(1, 2, 3, 100), (1, 2, 3, 100)]) == 128
    assert alpha([(1, 2, 3, 100)], [(1, 2, 3, 200)]) == 255  # held at one


def test_later_rects_win(spark):
    frames = spark.createDataFrame([("f", 0, 1), ("f", 1, 2), ("f", 2, 2)], "file_id string, frame_index int, frame_type int")
    w = spark.createDataFrame([("f", 0, 0, 1, 10), ("f", 1, 0, 1, 20), ("f", 1, 1, 1, 30)], "file_id string, frame_index int, rect_index int, cell int, v int")
    assert sorted((r.frame_index, r.v) for r in replay.replay_cells(frames, w).collect()) == [(0, 10), (1, 30), (2, 30)]


def test_encode_decode(spark):
    c, d, e = (1, 2, 3, 255), (4, 5, 6, 255), (0, 0, 0, 0)
    px = pixels(spark, [c] * 8, [c] * 7 + [d], [c] * 7 + [d], [e] * 8)
    sizes = spark.createDataFrame([("f", 1, 8, 1, 10, 1)], "file_id string, flags int, canvas_width int, canvas_height int, fps_num int, fps_den int")
    canvas = {r.frame_index: bytes(r.rgba) for r in render.decode_animation(render.encode_animation(px, sizes)).collect()}
    want = {r[0]: bytes.fromhex("".join(f"{x:08x}" for x in r[1])) for r in px.groupBy("frame_index").agg(F.transform(F.sort_array(F.collect_list(F.struct("pixel_index", "color"))), lambda x: x["color"])).collect()}
    assert canvas == want


def test_golden_canvases(spark):
    """Palette indices, a DELTA and a TRANSFORM of the golden file."""
    got = {r.frame_index: (bytes(r.rgba), bytes(r.shown)) for r in render.decode_animation(files(spark, ANIMATION)).collect()}
    ab, aa, faded = (bytes.fromhex(x) for x in ("0a141eff01020380", "0a141eff0a141eff", "0a141e800a141e80"))
    assert got == {0: (ab, ab), 1: (aa, aa), 2: (aa, faded)}


def test_encoders_choice(spark):
    """The encoder's choice: palette indices and a TRANSFORM for faded pixels; with `force_rgba` and every second frame FULL, tokens of colours."""
    a, b = (10, 20, 30, 255), (1, 2, 3, 128)
    sizes = spark.createDataFrame([("f", 1, 2, 1, 10, 1)], "file_id string, flags int, canvas_width int, canvas_height int, fps_num int, fps_den int")
    px = pixels(spark, [a, b], [a, a], [(10, 20, 30, 128), (10, 20, 30, 128)])
    out = bytes(render.encode_animation(px, sizes, editor=False).first().content)
    frames = media.explode_frames(files(spark, out)).orderBy("frame_index").collect()
    assert [(r.frame_type, r.encoding) for r in frames] == [(1, 2), (1, 2), (3, None)]
    assert media.parse_transforms(media.explode_frames(files(spark, out))).first().alpha == 128
    plain = bytes(render.encode_animation(px, sizes, editor=False, force_rgba=True, force_full_every=2).first().content)
    assert [(r.frame_type, r.encoding) for r in media.explode_frames(files(spark, plain)).orderBy("frame_index").collect()][2] == (1, 1)


def test_folder_with_broken_files(spark, tmp_path):
    """Sound files are decoded; others stand in the quarantine with their reasons."""
    cut_rect = bytearray(ANIMATION)
    cut_rect[73 + 46 + 28 + 20 : 73 + 46 + 28 + 24] = (9).to_bytes(4, "little")  # a box that claims more bytes than there are
    index = bytearray(ANIMATION)
    index[73 + 45] = 2  # beyond the palette of two colours
    alpha = bytearray(ANIMATION)
    alpha[73 + 46 + 53 + 28 + 12 : 73 + 46 + 53 + 28 + 16] = (256).to_bytes(4, "little")
    named = {"good": ANIMATION, "short": ANIMATION[:-1], "magic": b"XXXXX" + ANIMATION[5:], "rect": bytes(cut_rect), "index": bytes(index), "alpha": bytes(alpha)}
    for n, c in named.items():
        (tmp_path / f"{n}.migif").write_bytes(c)
    (tmp_path / "still.miimg").write_bytes(STILL)
    canvases, bad = render.decode_folder(spark, str(tmp_path))
    short = lambda p: p.rsplit("/", 1)[1].split(".")[0]
    assert sorted((short(r.file_id), r.frame_index) for r in canvases.collect()) == [("good", 0), ("good", 1), ("good", 2)]
    got = {short(r.file_id): set(r.errors) for r in bad.collect()}
    assert set(got) == set(named) - {"good"} and got["short"] == {"file_size"} and got["magic"] == {"magic"} and "rect_cut" in got["rect"] and got["index"] == {"index_range"} and got["alpha"] == {"alpha"}
    kinds = {short(r.file_id): r.kind for r in media.read_media(spark, str(tmp_path)).collect()}
    assert kinds["still"] == "still" and kinds["good"] == "animation" and kinds["magic"] is None


def test_cut_packets(spark):
    rows = media.decode_packets(files(spark, STILL[:-1])).collect()
    assert [(r.start, r.run_length, r.color, r.error) for r in rows] == [(0, 2, A, None), (None, None, None, "packet_cut")]


def test_frame_tables(spark, tmp_path):
    media.write_frame_tables(media.explode_frames(files(spark, ANIMATION)), str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t")).collect()
    assert [(r.file_id, r.frame_index, r.frame_type) for r in back] == [("f0", 0, 1), ("f0", 1, 2), ("f0", 2, 3)]


def test_text_runs(spark):
    df = spark.createDataFrame([(1, "aab\n\n"), (2, ""), (3, None), (4, "x" * 65536), (5, "é日日")], "i int, t string")
    got = sorted((r.i, r.run_index, r.start, r.run_length, r.v) for r in runs.text_runs(df, ["i"], "t").collect())
    assert got == [(1, 0, 0, 2, "a"), (1, 1, 2, 1, "b"), (1, 2, 3, 2, "\n"), (4, 0, 0, 65535, "x"), (4, 1, 65535, 1, "x"), (5, 0, 0, 1, "é"), (5, 1, 1, 2, "日")]


@pytest.mark.parametrize("num, den", [(24, 1), (30, 1), (30000, 1001)])
def test_exact_durations(spark, num, den):
    canvas = spark.createDataFrame([(7, 2, 1)], "project_id long, out_width int, out_height int")
    extent = spark.createDataFrame([(7, 3)], "project_id long, total_frames long")
    rendered = spark.createDataFrame([(7, 1, 0, 0, 1, 2, 3, 255)], "project_id long, frame_index long, x int, y int, r int, g int, b int, a int")
    f = media.explode_frames(render.export_project(rendered, canvas, extent, num, den)).collect()
    assert {(r.duration_num, r.duration_den) for r in f} == {(den, num)} and len(f) == 3


def test_sources_of_each_project(spark):
    """Three projects of one clip each, all with a source 0 of their own."""
    clips = spark.createDataFrame([(p, 0, 0, None, 0, 0, "") for p in range(3)], "project_id long, clip_index int, source_id long, timeline_start_frame int, source_start_frame int, frame_count int, name string")
    sources = spark.createDataFrame([(p, 0, f"d/s{p}.gif", p + 1, 8, 8) for p in range(3)], "project_id long, source_id long, path string, n_frames int, canvas_width int, canvas_height int")
    loaded = project.resolve_clips(clips, sources)[0]
    assert sorted((r.project_id, r.length) for r in loaded.collect()) == [(0, 1), (1, 2), (2, 3)]
    assert sorted((r.project_id, r.label) for r in project.clip_listing(loaded, sources).collect()) == [(p, f"s{p}.gif") for p in range(3)]
    rasters = spark.createDataFrame([(p, 0, f, x, 0, 10 * p, f, x, 255) for p in range(3) for f in range(p + 1) for x in range(2)], "project_id long, source_id long, source_frame_index long, x int, y int, r int, g int, b int, a int")
    sources = sources.withColumns({"canvas_width": F.lit(2), "canvas_height": F.lit(1)})
    canvas = sources.select("project_id", F.lit(2).alias("out_width"), F.lit(1).alias("out_height"))
    none = spark.createDataFrame([], "project_id long, clip_index int, frame_index long, x double, y double, scale_x double, scale_y double, rotation_deg double, alpha int")
    got = sorted((r.project_id, r.frame_index, r.x, r.r, r.g, r.b) for r in render.render_project(project.active_clips(loaded), none, rasters, sources, canvas, "nearest").collect())
    assert got == [(p, f, x, 10 * p, f, x) for p in range(3) for f in range(p + 1) for x in range(2)]


def test_interpolation_at_a_keyframe(spark):
    k = spark.createDataFrame([("c", 0, 0.0, 0), ("c", 10, 5.0, 255)], "clip_key string, frame_index int, x double, alpha int")
    for n in ("y", "scale_x", "scale_y", "rotation_deg"):
        k = k.withColumn(n, F.lit(1.0))
    q = spark.createDataFrame([("c", 0), ("c", 1), ("c", 5), ("c", 10), ("c", 50), ("d", 3)], "clip_key string, frame_index int")
    got = {(r.clip_key, r.frame_index): (r.x, r.alpha) for r in project.interpolate_keyframes(k, q).collect()}
    assert got == {("c", 0): (0.0, 0), ("c", 1): (0.5, 26), ("c", 5): (2.5, 128), ("c", 10): (5.0, 255), ("c", 50): (5.0, 255), ("d", 3): (0.0, 255)}


def test_one_opaque_layer(spark):
    px = pixels(spark, [(9, 8, 7, 255), (1, 1, 1, 0)]).withColumn("z", F.lit(0))
    assert [tuple(r) for r in composite(px, ["x"]).collect()] == [(0, 9, 8, 7, 255)]


def test_values(spark):
    df = spark.createDataFrame([("30000/1001",), ("25",), ("0/1",), ("a/2",), ("1/2/3",)], "s string").select(S.parse_fps(F.col("s")).alias("f"))
    assert [r.f and tuple(r.f) for r in df.collect()] == [(30000, 1001), (25, 1), None, None, None]
    df = spark.createDataFrame([("1,2,3",), ("1,2",), ("256,0,0",)], "s string").select(S.parse_rgb(F.col("s")).alias("c"))
    assert [r.c and tuple(r.c) for r in df.collect()] == [(1, 2, 3), None, None]
    swapped = spark.createDataFrame([(bytes([1, 2, 3, 4, 5, 6, 7, 8]),)], "b binary").select(S.swap_bytes(F.col("b")).alias("b")).first().b
    assert bytes(swapped) == bytes([3, 2, 1, 4, 7, 6, 5, 8])


@pytest.mark.parametrize("n", [1, 7, 64])
def test_same_for_any_partitioning(spark, sf, n):
    from framelake.jobs.queries import QUERIES

    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        got = sorted(map(tuple, QUERIES["frame_choice"](spark, sf).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == sorted(map(tuple, QUERIES["frame_choice"](spark, sf).collect()), key=str)


def test_frame_tables_remember_their_files(spark, tmp_path):
    """Segments and line changes over a bucketed table need no shuffle."""
    from framelake.operators.change import diff_scanlines
    from framelake.operators.replay import segments

    df = spark.range(200).selectExpr("CAST(id % 7 AS STRING) AS file_id", "CAST(id DIV 7 AS INT) AS frame_index", "IF(id % 5 = 0, 1, 2) AS frame_type", "0 AS y", "unhex(lpad(hex(id DIV 14), 8, '0')) AS rgba")
    media.write_frame_tables(df, f"{tmp_path}/t", table="frame_rows", buckets=4)
    try:
        held = spark.table("frame_rows")
        for make in (segments, diff_scanlines):
            out = make(held)
            assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(str, out.collect())) == sorted(map(str, make(df).collect())) and out.count() > 50
    finally:
        spark.sql("DROP TABLE frame_rows")


@pytest.mark.parametrize("size", [60, 100, 1 << 20])
def test_parts_are_the_file(spark, size):
    headers = spark.createDataFrame([("f", 1, 4, 3, 10, 1), ("g", 0, 4, 3, 10, 1)], "file_id string, flags int, canvas_width int, canvas_height int, fps_num int, fps_den int")
    palette = spark.createDataFrame([("f", 0, 255), ("f", 1, 7)], "file_id string, color_index int, color long")
    blobs = spark.createDataFrame([(f, k, bytes([k]) * (10 + 13 * (k % 4))) for f in "fg" for k in range(9)], "file_id string, frame_index int, blob binary").repartition(3)
    whole = {r.file_id: bytes(r.content) for r in media.assemble_files(headers, palette, blobs).collect()}
    got, place = {}, {}
    for r in media.assemble_parts(headers, palette, blobs, size).orderBy("file_id", "part").collect():
        assert r.offset == len(got.get(r.file_id, b""))
        got[r.file_id] = got.get(r.file_id, b"") + bytes(r.content)
        place[r.file_id] = place.get(r.file_id, 0) + 1
    assert got == whole and len(whole) == 2 and (size > 1_000 or min(place.values()) > 1)
