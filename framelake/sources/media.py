"""The two media formats and project files as tables: reading, walking, assembling."""

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.binary import i32, pack, text, u32, unsigned
from .stage import staged

#: Fixed values of the formats: magics and record sizes.
STILL, ANIMATION, PROJECT = "MII0", "MIGIF", "MIPRJ"
HEADER, FRAME, FULL_HEAD, RECT_HEAD = 49, 28, 16, 20
#: Names of the ten u32 fields from byte 9 on.
_FIELDS = ["canvas_width", "canvas_height", "frame_count", "fps_num", "fps_den", "blocks_size", "frames_offset", "file_size", "reserved0", "reserved1"]


def read_media(spark: SparkSession, path: str, glob: str = "*.{miimg,migif,proj}") -> DataFrame:
    """Files as rows: file_id, path, length, content, and `kind` by magic (null: none of the three)."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return with_kind(f.select(F.col("path").alias("file_id"), "path", "length", "content"))


def with_kind(files: DataFrame) -> DataFrame:
    m = text(F.col("content"), 0, 5)
    return files.withColumn("kind", F.when(m == ANIMATION, "animation").when(m == PROJECT, "project").when(F.substring(m, 1, 4) == STILL, "still"))


def parse_headers(files: DataFrame) -> DataFrame:
    """Animation headers. Fields that a cut file lacks are null."""
    c = F.col("content")
    return files.select("file_id", text(c, 0, 5).alias("magic"), unsigned(c, 5, 1).cast("int").alias("version_major"), unsigned(c, 6, 1).cast("int").alias("version_minor"), unsigned(c, 7, 1).cast("int").alias("header_size"), unsigned(c, 8, 1).cast("int").alias("flags"), *(u32(c, 9 + 4 * i).alias(n) for i, n in enumerate(_FIELDS)), F.octet_length(c).cast("long").alias("length"))


def parse_still_headers(files: DataFrame) -> DataFrame:
    c = F.col("content")
    return files.select("file_id", text(c, 0, 4).alias("magic"), *(u32(c, 4 + 4 * i).alias(n) for i, n in enumerate(("width", "height", "format", "packed_size"))), F.octet_length(c).cast("long").alias("length"))


def parse_transforms(frames: DataFrame) -> DataFrame:
    """Payloads of TRANSFORM frames as columns; positions, scales and rotation are signed 16.16."""
    p = F.col("payload")
    return frames.filter("frame_type = 3").select("file_id", "frame_index", u32(p, 0).cast("int").alias("transform_flags"), i32(p, 4).alias("pos_x"), i32(p, 8).alias("pos_y"), u32(p, 12).alias("alpha"), i32(p, 16).alias("scale_x"), i32(p, 20).alias("scale_y"), i32(p, 24).alias("rotation_deg"))


_CHUNK = "file_id string, kind string, position int, body binary, error string"


#: Bytes of chunks that a task hands over at a time.
WALK_BYTES = 8 << 20


def _walk(batches, kind: str):
    """Chunks of each file in one linear pass, as each offset depends on the sizes before it. Those of many small files are handed over together."""
    out, held = [], 0
    table = lambda: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int32(), pa.binary(), pa.string()))], names=["file_id", "kind", "position", "body", "error"])
    for b in batches:
        for i, content in zip(b.column("file_id").to_pylist(), b.column("content").to_pylist()):
            rows, error = [], None
            head = struct.unpack_from("<5sBBBB10I", content) if len(content) >= HEADER else None
            if head is None:
                rows, error = [], "too_short"
            elif kind == "block":
                at, end, k = head[3], min(len(content), head[3] + head[10]), 0
                while at + 8 <= end:
                    size = int.from_bytes(content[at + 4 : at + 8], "little")
                    if size < 8 or at + size > end:
                        error = "block_size"
                        break
                    rows.append((k, content[at : at + size]))
                    at, k = at + size, k + 1
            else:
                at = head[11]
                for k in range(head[7]):
                    size = int.from_bytes(content[at : at + 4], "little") if at + FRAME <= len(content) else 0
                    if size < FRAME or at + size > len(content):
                        error = "frame_size"
                        break
                    rows.append((k, content[at : at + size]))
                    at += size
            out += [(i, kind, k, x, None) for k, x in rows]
            if error:
                out.append((i, kind, -1, None, error))
            held += 200 * (len(rows) + 1) + sum(len(x) for _, x in rows)
            if held >= WALK_BYTES:
                if out:
                    yield table()
                out, held = [], 0
    if out:
        yield table()


def walk_chunks(files: DataFrame, kind: str) -> DataFrame:
    """H1: blocks or frames of each file as rows; a broken chain ends in a row of position -1 with its `error`."""
    return files.select(F.col("file_id").cast("string").alias("file_id"), "content").mapInArrow(lambda batches: _walk(batches, kind), _CHUNK)


def explode_palette(files: DataFrame) -> DataFrame:
    """Palette rows (file_id, color_index, color); unknown blocks are passed over, the last palette block wins."""
    b = walk_chunks(files, "block").filter(text(F.col("body"), 0, 4) == "PLTE")
    last = b.groupBy("file_id").agg(F.max_by("body", "position").alias("body"))
    body = F.hex("body")
    colors = F.transform(F.sequence(F.lit(0), F.least(u32(F.col("body"), 8), ((F.octet_length("body") - 16) / 4).cast("long")).cast("int") - 1), lambda i: F.conv(F.substring(body, 33 + i * 8, F.lit(8)), 16, 10).cast("long"))
    return last.filter(u32(F.col("body"), 8) > 0).select("file_id", F.posexplode(colors).alias("color_index", "color"))


def explode_frames(files: DataFrame) -> DataFrame:
    """Frame rows: type, flags, duration, payload, and for FULL frames encoding, size and data."""
    f = walk_chunks(files, "frame").filter("position >= 0")
    c, p = F.col("body"), F.substring("body", FRAME + 1, 1 << 30)
    f = f.select("file_id", F.col("position").alias("frame_index"), u32(c, 0).alias("frame_size"), unsigned(c, 4, 2).cast("int").alias("frame_type"), unsigned(c, 6, 2).cast("int").alias("frame_flags"), u32(c, 8).alias("duration_num"), u32(c, 12).alias("duration_den"), u32(c, 16).alias("payload_size"), (u32(c, 20) + u32(c, 24)).alias("reserved"), p.alias("payload"))
    full = lambda v: F.when(F.col("frame_type") == 1, v)
    p = F.col("payload")
    return f.withColumns({"encoding": F.when(F.col("frame_type").isin(1, 2), unsigned(p, 0, 2).cast("int")), "width": full(u32(p, 4)).cast("int"), "height": full(u32(p, 8)).cast("int"), "data": full(F.substring("payload", FULL_HEAD + 1, 1 << 30))})


def _walk_rects(batches):
    for b in batches:
        cols = {n: [] for n in ("file_id", "frame_index", "rect_index", "encoding", "x", "y", "w", "h", "data", "error")}
        put = lambda *row: [cols[n].append(v) for n, v in zip(cols, row)]  # noqa: B023, E731
        for i, f, p in zip(*(b.column(n).to_pylist() for n in ("file_id", "frame_index", "payload"))):
            encoding, count = struct.unpack_from("<HH", p) if len(p) >= 4 else (0, 1)
            at = 4
            for k in range(count):
                x, y, w, h, n = struct.unpack_from("<5I", p, at) if at + RECT_HEAD <= len(p) else (0, 0, 0, 0, -1)
                if n < 0 or at + RECT_HEAD + n > len(p):
                    put(i, f, k, encoding, None, None, None, None, None, "rect_cut")
                    break
                put(i, f, k, encoding, x, y, w, h, p[at + RECT_HEAD : at + RECT_HEAD + n], None)
                at += RECT_HEAD + n
        kinds = [pa.string(), *[pa.int32()] * 3, *[pa.int32()] * 4, pa.binary(), pa.string()]
        yield pa.record_batch([pa.array(v, t) for v, t in zip(cols.values(), kinds)], names=list(cols))


def explode_rects(frames: DataFrame) -> DataFrame:
    """Boxes of DELTA frames, in order; a payload that ends too early gives a row with the `error` rect_cut where it does."""
    d = frames.filter("frame_type = 2").select("file_id", "frame_index", "payload")
    return d.mapInArrow(_walk_rects, "file_id string, frame_index int, rect_index int, encoding int, x int, y int, w int, h int, data binary, error string")


def frame_places(frames: DataFrame, headers: DataFrame) -> DataFrame:
    """Frames with what `validate_frames` asks for: where each one ends, the file's size, and its reserved fields."""
    upto = F.sum("frame_size").over(Window.partitionBy("file_id").orderBy("frame_index"))
    h = headers.select(F.col("file_id").cast("string").alias("file_id"), "file_size", "frames_offset")
    slim = frames.select("file_id", "frame_index", "frame_size", "payload_size", "duration_den", "reserved", upto.alias("_upto"))
    return slim.join(h, "file_id").withColumn("frame_end", F.col("frames_offset") + F.col("_upto")).drop("_upto", "frames_offset")


def _highest_index(data, encoding):
    """Highest palette index in the data of an indexed unit, else null."""
    h = F.hex(data)
    step = F.when(encoding == 2, 1).when(encoding == 3, 3)
    places = F.sequence(step, (F.floor(F.octet_length(data) / step) * step).cast("int"), step)
    return F.when(step.isNotNull() & (F.octet_length(data) >= step), F.array_max(F.transform(places, lambda i: F.conv(F.substring(h, 2 * i - 1, F.lit(2)), 16, 10).cast("int"))))


def payload_facts(frames: DataFrame, rects: DataFrame, headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What `validate_payloads` asks for of frames and boxes. A FULL frame counts as its one box."""
    h = headers.select(F.col("file_id").cast("string").alias("file_id"), "canvas_width", "canvas_height")
    boxes = rects.filter("error IS NULL").groupBy("file_id", "frame_index").agg(F.sum(F.octet_length("data") + RECT_HEAD).alias("_boxes"))
    size, kind = F.octet_length("payload"), F.col("frame_type")
    said = u32(F.col("payload"), 12)
    left = F.when(kind == 1, size - FULL_HEAD - said).when(kind == 2, size - 4 - F.coalesce("_boxes", F.lit(0))).when(kind == 3, size - FRAME)
    f = frames.join(h, "file_id").join(boxes, ["file_id", "frame_index"], "left")
    f = f.select("file_id", "frame_index", "frame_type", "encoding", "width", "height", F.when(kind == 1, said).alias("data_size"), F.when(kind == 3, u32(F.col("payload"), 12)).alias("alpha"), left.alias("left_over"), "canvas_width", "canvas_height")
    cells = lambda df, *c: df.select("file_id", "frame_index", *c, F.octet_length("data").cast("long").alias("data_size"), _highest_index(F.col("data"), F.col("encoding")).alias("max_index"))
    whole = cells(frames.filter("frame_type = 1"), "encoding", F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("width").alias("w"), F.col("height").alias("h"))
    return f, whole.unionByName(cells(rects.filter("error IS NULL"), "encoding", "x", "y", "w", "h"))


def _walk_packets(batches):
    for b in batches:
        for i, content in zip(b.column("file_id").to_pylist(), b.column("content").to_pylist()):
            at, lengths, colors, error = 20, [], [], None
            while at < len(content):
                c = content[at]
                n = 1 if c >= 128 else c + 1  # pixels that the packet spells out
                if at + 1 + 4 * n > len(content):
                    error = "packet_cut"
                    break
                colors.append(np.frombuffer(content, dtype=np.uint8, count=4 * n, offset=at + 1).reshape(n, 4))
                lengths.append(np.full(n, c - 127 if c >= 128 else 1, dtype=np.int64))
                at += 1 + 4 * n
            px = np.concatenate([np.zeros((0, 4), dtype=np.uint8), *colors]).astype(np.int64)
            length = np.concatenate([np.zeros(0, dtype=np.int64), *lengths])
            color = px[:, 2] << 24 | px[:, 1] << 16 | px[:, 0] << 8 | px[:, 3]
            rows, end = len(length), [None] if error else []
            columns = [np.arange(rows), np.cumsum(length) - length, length, color]
            yield pa.record_batch(
                [pa.array([i] * (rows + len(end)), pa.string()), *(pa.array([*c.tolist(), *end], pa.int64()) for c in columns), pa.array([None] * rows + [error] * len(end), pa.string())], names=["file_id", "run_index", "start", "run_length", "color", "error"]
            )


def decode_packets(stills: DataFrame) -> DataFrame:
    """H2: packets of still images as runs of colours (a literal pixel is a run of one). A file that ends within a packet gives a last row with the `error` packet_cut and nothing else."""
    return stills.select(F.col("file_id").cast("string").alias("file_id"), "content").mapInArrow(_walk_packets, "file_id string, run_index long, start long, run_length long, color long, error string")


def encode_stills(packets: DataFrame, pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Still files from packets (file_id, packet_index, start, n, is_repeat, color), the pixels of literal packets, and (file_id, width, height)."""
    bgra = lambda c: F.concat(*(F.lpad(F.hex(F.shiftright(c, s).bitwiseAND(255)), 2, "0") for s in (8, 16, 24, 0)))
    lit = packets.filter("NOT is_repeat").select("file_id", "packet_index", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pixel_index"))
    lit = lit.join(pixels.select("file_id", F.col("pixel_index").cast("long").alias("pixel_index"), "color"), ["file_id", "pixel_index"])
    lit = lit.groupBy("file_id", "packet_index").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pixel_index", bgra(F.col("color")).alias("t")))), lambda x: x["t"]), "").alias("px"))
    both = packets.join(lit, ["file_id", "packet_index"], "left")
    head = F.lpad(F.hex(F.when(F.col("is_repeat"), F.col("n") + 127).otherwise(F.col("n") - 1)), 2, "0")
    data = both.groupBy("file_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("packet_index", F.concat(head, F.when(F.col("is_repeat"), bgra(F.col("color"))).otherwise(F.col("px"))).alias("t")))), lambda x: x["t"]), "").alias("d"))
    out = data.join(sizes, "file_id")
    return out.select("file_id", F.unhex(F.concat(F.hex(F.lit(STILL).cast("binary")), pack((F.col("width"), 4), (F.col("height"), 4), (F.lit(1), 4), ((F.length("d") / 2), 4)), "d")).alias("content"))


def frame_blobs(choice: DataFrame, full_data: DataFrame, rect_data: DataFrame) -> DataFrame:
    """Bytes of each frame (`blob`) from the choice of its type.

    `choice`: file_id, frame_index, frame_type, duration_num, duration_den, alpha, x, y, w, h, encoding, width, height;
    `full_data`, `rect_data`: the frame's own bytes and those of its box. TRANSFORM
    frames set what `transform_flags` says, with pos_x, pos_y, scale_x, scale_y
    and rotation_deg in 16.16; a choice without `transform_flags` sets alpha alone.
    """
    keys = ["file_id", "frame_index"]
    c = choice.join(full_data.select(*keys, F.hex("data").alias("_f")), keys, "left").join(rect_data.select(*keys, F.hex("data").alias("_r")), keys, "left")
    size = lambda h: F.length(h) / 2
    full = F.concat(pack((F.col("encoding"), 2), (F.lit(0), 2), (F.col("width"), 4), (F.col("height"), 4), (size("_f"), 4)), F.col("_f"))
    delta = F.when(F.col("w").isNull(), pack((F.col("encoding"), 2), (F.lit(0), 2))).otherwise(F.concat(pack((F.col("encoding"), 2), (F.lit(1), 2), (F.col("x"), 4), (F.col("y"), 4), (F.col("w"), 4), (F.col("h"), 4), (size("_r"), 4)), F.col("_r")))
    field = lambda name, default: F.coalesce(name, F.lit(default)) if name in c.columns else F.lit(default)
    flags = F.coalesce("transform_flags", F.lit(0)) if "transform_flags" in c.columns else F.when(F.col("alpha").isNull(), 0).otherwise(4)
    turn = pack((flags, 4), *((field(n, default), 4) for n, default in (("pos_x", 0), ("pos_y", 0), ("alpha", 255), ("scale_x", 65536), ("scale_y", 65536), ("rotation_deg", 0))))
    c = c.withColumn("_p", F.when(F.col("frame_type") == 1, full).when(F.col("frame_type") == 2, delta).otherwise(turn))
    head = pack((size("_p") + FRAME, 4), (F.col("frame_type"), 2), (F.lit(0), 2), (F.col("duration_num"), 4), (F.col("duration_den"), 4), (size("_p"), 4), (F.lit(0), 4), (F.lit(0), 4))
    return c.select(*keys, F.unhex(F.concat(head, "_p")).alias("blob"))


def _palette_block(palette: DataFrame) -> DataFrame:
    """The palette block of each file (`b`, hex)."""
    p = palette.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("color_index", F.lpad(F.hex("color"), 8, "0").alias("t")))), lambda x: x["t"]), "").alias("c"))
    return p.select("file_id", F.concat(F.hex(F.lit("PLTE").cast("binary")), pack((F.col("n") * 4 + 16, 4), (F.col("n"), 4), (F.lit(0), 4)), F.col("c")).alias("b"))


def _file_head(frame_bytes: Column) -> Column:
    """The header of a file in hex, from its row, its palette block `b` and the bytes of its frames."""
    blocks = F.length("b") / 2
    flags = F.col("flags").bitwiseOR(F.when(F.length("b") > 0, 2).otherwise(0))
    return F.concat(F.hex(F.lit(ANIMATION).cast("binary")), pack((F.lit(2), 1), (F.lit(0), 1), (F.lit(HEADER), 1), (flags, 1), (F.col("canvas_width"), 4), (F.col("canvas_height"), 4), (F.col("frame_count"), 4), (F.col("fps_num"), 4), (F.col("fps_den"), 4), (blocks, 4), (F.lit(HEADER) + blocks, 4), (F.lit(HEADER) + blocks + frame_bytes, 4), (F.lit(0), 4), (F.lit(0), 4)))


def assemble_files(headers: DataFrame, palette: DataFrame, blobs: DataFrame) -> DataFrame:
    """Whole animation files: header, palette block, frames in order. Only encoded bytes move; frame tables stay the main sink.

    `headers`: file_id, flags, canvas_width, canvas_height, fps_num, fps_den. A
    file is one value here, of 1 GB at most; `assemble_parts` has no such limit.
    """
    f = blobs.groupBy("file_id").agg(F.count(F.lit(1)).alias("frame_count"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("frame_index", F.hex("blob").alias("t")))), lambda x: x["t"]), "").alias("f"))
    a = headers.join(f, "file_id").join(_palette_block(palette), "file_id", "left").withColumn("b", F.coalesce("b", F.lit("")))
    return a.select("file_id", F.unhex(F.concat(_file_head(F.length("f") / 2), "b", "f")).alias("content"))


#: Bytes from which the next frame of a file starts another part.
PART_BYTES = 64 << 20


def assemble_parts(headers: DataFrame, palette: DataFrame, blobs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The same files in parts: `part` (ascending), `offset` of its first byte, `content`; put together in order they are the file.

    Places come from running sums over the lengths of frames, which alone are
    dealt by file; a part's bytes meet by (file, part). Header and palette are
    part 0, so are the first frames. The format's own sizes have 32 bits.
    """
    w = Window.partitionBy("file_id").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, -1)
    length = blobs.select("file_id", "frame_index", F.octet_length("blob").cast("long").alias("n"))
    placed = length.withColumn("at", F.coalesce(F.sum("n").over(w), F.lit(0)))
    total = length.groupBy("file_id").agg(F.count(F.lit(1)).alias("frame_count"), F.sum("n").alias("f"))
    head = headers.join(total, "file_id").join(_palette_block(palette), "file_id", "left").withColumn("b", F.coalesce("b", F.lit("")))
    head = head.select("file_id", F.unhex(F.concat(_file_head(F.col("f")), "b")).alias("blob"))
    lead = head.select("file_id", F.octet_length("blob").cast("long").alias("lead"))
    pieces = blobs.select("file_id", "frame_index", "blob").join(placed, ["file_id", "frame_index"]).join(lead, "file_id")
    pieces = pieces.select("file_id", F.floor((F.col("at") + F.col("lead")) / part_bytes).alias("part"), (F.col("at") + F.col("lead")).alias("offset"), "blob")
    pieces = pieces.unionByName(head.select("file_id", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("offset"), "blob"))
    cells = F.array_sort(F.collect_list(F.struct("offset", F.hex("blob").alias("t"))))
    return pieces.groupBy("file_id", "part").agg(F.min("offset").alias("offset"), F.unhex(F.array_join(F.transform(cells, lambda x: x["t"]), "")).alias("content"))


def write_frame_tables(df: DataFrame, path: str, table: str | None = None, buckets: int = 64) -> None:
    """Frame rows laid out for replay: a file's rows together, in frame order.

    With `table`, the folder is registered as a table of `buckets` buckets by
    file, which Spark remembers: windows and joins by file over
    `spark.table(table)` don't shuffle any more.
    """
    if table is None:
        df.repartition("file_id").sortWithinPartitions("file_id", "frame_index").write.mode("overwrite").parquet(path)
    else:
        df.repartition(buckets, "file_id").write.mode("overwrite").bucketBy(buckets, "file_id").sortBy("file_id", "frame_index").option("path", path).saveAsTable(table)


_KEYFRAME = "frame_index int, x double, y double, scale_x double, scale_y double, rotation_deg double, alpha int"
_PROJECT = f"out_width int, out_height int, loop boolean, preview_fps_num long, preview_fps_den long, sources array<struct<source_id: long, path: string>>, clips array<struct<clip_id: long, source_id: long, timeline_start_frame: int, source_start_frame: int, frame_count: int, name: string, keyframes: array<struct<{_KEYFRAME.replace(' ', ': ').replace(',:', ',')}>>>>"


def parse_projects(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Project files as projects, sources, clips and keyframes; missing keys take the header's values or fixed defaults. The last JSON block counts. Files are read and their JSON is parsed once, whatever of the four is used."""
    heads = parse_headers(files).select(F.col("file_id").cast("string").alias("project_id"), "magic", *(F.col(o).alias(n) for o, n in zip(_FIELDS, ("h_width", "h_height", "total_frames", "h_fps_num", "h_fps_den"))))
    b = walk_chunks(files, "block").filter(text(F.col("body"), 0, 4) == "JSON")
    last = b.groupBy(F.col("file_id").alias("project_id")).agg(F.max_by("body", "position").alias("body"))
    j = last.select("project_id", F.from_json(F.decode(F.substring("body", 9, 1 << 30), "UTF-8"), _PROJECT).alias("j")).join(heads.filter(F.col("magic") == PROJECT).hint("merge"), "project_id")
    j = staged(j)
    projects = j.select("project_id", F.coalesce("j.out_width", "h_width").cast("int").alias("out_width"), F.coalesce("j.out_height", "h_height").cast("int").alias("out_height"), F.coalesce("j.loop", F.lit(False)).alias("loop"), F.coalesce("j.preview_fps_num", "h_fps_num").alias("preview_fps_num"), F.coalesce("j.preview_fps_den", "h_fps_den").alias("preview_fps_den"), "total_frames")
    s = j.select("project_id", F.posexplode("j.sources").alias("position", "s"))
    first = F.row_number().over(Window.partitionBy("project_id", "s.source_id").orderBy("position"))  # of repeated ids the first counts
    sources = s.withColumn("_n", first).filter("_n = 1").select("project_id", "s.source_id", "s.path")
    c = j.select("project_id", F.posexplode("j.clips").alias("clip_index", "c"))
    zero = lambda n: F.coalesce(f"c.{n}", F.lit(0)).alias(n)
    clips = c.select("project_id", "clip_index", F.coalesce("c.clip_id", F.col("clip_index").cast("long")).alias("clip_id"), "c.source_id", "c.timeline_start_frame", zero("source_start_frame"), zero("frame_count"), F.coalesce("c.name", F.lit("")).alias("name"))
    default = F.array(F.struct(F.lit(0).alias("frame_index"), *(F.lit(v).alias(n) for n, v in (("x", 0.0), ("y", 0.0), ("scale_x", 1.0), ("scale_y", 1.0), ("rotation_deg", 0.0), ("alpha", 255)))))
    k = c.select("project_id", "clip_index", F.explode(F.when(F.size("c.keyframes") > 0, F.col("c.keyframes")).otherwise(default)).alias("k"))
    return projects, sources, clips, k.select("project_id", "clip_index", "k.*")


def write_projects(projects: DataFrame, sources: DataFrame, clips: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Project files (project_id, content): header and one JSON block. Sources stand in the order of a column `position`, if there is one, else by id; of repeated ids the first counts when read."""
    ordered = lambda df, keys, order, fields, name: df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, F.struct(*fields).alias("v")))), lambda x: x["v"]).alias(name))
    k = ordered(keyframes, ["project_id", "clip_index"], "frame_index", ["frame_index", "x", "y", "scale_x", "scale_y", "rotation_deg", "alpha"], "keyframes")
    c = ordered(clips.join(k, ["project_id", "clip_index"], "left"), ["project_id"], "clip_index", ["clip_id", "source_id", "timeline_start_frame", "source_start_frame", "frame_count", "name", "keyframes"], "clips")
    s = ordered(sources, ["project_id"], "position" if "position" in sources.columns else "source_id", ["source_id", "path"], "sources")
    p = projects.join(s, "project_id", "left").join(c, "project_id", "left")
    body = F.hex(F.to_json(F.struct("out_width", "out_height", "loop", "preview_fps_num", "preview_fps_den", "sources", "clips")).cast("binary"))
    p = p.withColumn("_b", F.concat(F.hex(F.lit("JSON").cast("binary")), pack((F.length(body) / 2 + 8, 4)), body))
    size = F.length("_b") / 2
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    head = F.concat(F.hex(F.lit(PROJECT).cast("binary")), pack((F.lit(1), 1), (F.lit(0), 1), (F.lit(HEADER), 1), (F.col("loop").cast("int"), 1), (F.col("out_width"), 4), (F.col("out_height"), 4), (F.col("total_frames"), 4), (F.col("preview_fps_num"), 4), (F.col("preview_fps_den"), 4), (size, 4), (F.lit(HEADER), 4), (F.lit(HEADER) + size, 4), (count("sources"), 4), (count("clips"), 4)))
    return p.select("project_id", F.unhex(F.concat(head, "_b")).alias("content"))
