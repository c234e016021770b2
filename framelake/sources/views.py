"""Raster, frame-log, clip and keyframe tables derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import rgba


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Vectors whose numbers are counted together.
BLOCK = 4_096


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for each vector, numbered from 0 in the file of its label: file_id, frame_index, embedding.

    Numbers come from counts by blocks of ids, so that no label is one task.
    """
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("file_id"), "vec_id", "embedding").withColumn("_block", F.floor(F.col("vec_id") / BLOCK))
    keys = ["file_id", "_block"]
    before = Window.partitionBy("file_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offset = e.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    placed = e.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id")) - 1).join(offset, keys)
    return placed.select("file_id", (F.col("_nth") + F.col("_offset")).cast("int").alias("frame_index"), "embedding")


def held_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames with each fourth one held for four."""
    held = Window.partitionBy("file_id", F.floor(F.col("frame_index") / 4)).orderBy("frame_index")
    return frames(spark, sf_dir).withColumn("embedding", F.first("embedding").over(held))


def _level(v: Column) -> Column:
    return (F.floor(v.cast("double") * 5) + 3).cast("int")


def _pixels(f: DataFrame) -> DataFrame:
    px = f.select("file_id", "frame_index", F.posexplode("embedding").alias("pixel_index", "_v"))
    return px.withColumns({"x": F.pmod("pixel_index", F.lit(8)), "y": F.floor(F.col("pixel_index") / 8).cast("int"), "level": _level(F.col("_v"))}).drop("_v")


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 rasters: a file for each label, a frame for each vector, a level 0 to 5 or so for each pixel, and its colour."""
    px = _pixels(frames(spark, sf_dir))
    return px.withColumns({"r": F.col("level") * 40, "g": F.col("level") * 30, "b": F.col("level") * 20, "a": F.lit(255)}).withColumn("color", rgba())


def fades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rasters with each fourth one held for four frames while its alpha falls; level 1 is transparent."""
    px = _pixels(held_frames(spark, sf_dir))
    px = px.withColumns({"r": F.col("level") * 40, "g": F.col("level") * 30, "b": F.col("level") * 20, "a": F.when(F.col("level") == 1, 0).otherwise(240 - 60 * (F.col("frame_index") % 4))})
    return px.withColumn("color", rgba()).drop("level")


def _falling(level: Column) -> Column:
    return F.when(level == 1, 0).otherwise(240 - 60 * (F.col("frame_index") % 4))


def _images(f: DataFrame, alpha) -> DataFrame:
    """The pixels of each frame in hex, straight from the vectors."""
    parts = lambda level: (level * 40, level * 30, level * 20, alpha(level))
    cell = lambda v: F.concat(*(F.lpad(F.hex(c.cast("long")), 2, "0") for c in parts(_level(v))))
    return f.select("file_id", "frame_index", F.array_join(F.transform("embedding", cell), "").alias("_h"))


def _lines(f: DataFrame, alpha) -> DataFrame:
    """Lines at rest (file_id, frame_index, y, rgba), eight pixels a line."""
    hexed = _images(f, alpha)
    lines = hexed.select("file_id", "frame_index", "_h", F.explode(F.sequence(F.lit(0), F.floor((F.length("_h") - 1) / 64).cast("int"))).alias("y"))
    return lines.select("file_id", "frame_index", "y", F.unhex(F.substring("_h", F.col("y") * 64 + 1, F.lit(64))).alias("rgba"))


def raster_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`rasters` as whole images (file_id, frame_index, rgba)."""
    return _images(frames(spark, sf_dir), lambda level: F.lit(255)).select("file_id", "frame_index", F.unhex("_h").alias("rgba"))


def fade_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`fades` as whole images."""
    return _images(held_frames(spark, sf_dir), _falling).select("file_id", "frame_index", F.unhex("_h").alias("rgba"))


def raster_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`rasters` as lines."""
    return _lines(frames(spark, sf_dir), lambda level: F.lit(255))


def fade_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`fades` as lines."""
    return _lines(held_frames(spark, sf_dir), _falling)


def frame_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of FULL, DELTA and TRANSFORM frames per user."""
    e = table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    e = e.withColumn("frame_index", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    v = F.floor("value").cast("int")
    return e.select(
        F.col("user_id").alias("file_id"), "frame_index", F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", 3).otherwise(2).alias("frame_type"),
        ((F.col("event_id") % 20).cast("int") * 10).alias("duration_ms"), (F.col("k") % 64).alias("transform_flags"), (F.col("k") % 16).alias("cell"), v.alias("v"), F.pmod(v, F.lit(256)).alias("alpha"), "ts", "event_id",
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every character of every document, in order."""
    d = table(spark, sf_dir, "documents").filter("length(text) > 0")
    return d.select(F.col("doc_id").alias("file_id"), F.lit(0).alias("frame_index"), F.posexplode(F.split("text", "")).alias("pixel_index", "v")).filter("v <> ''")


_CLIP_ORDER = "l_linenumber l_partkey l_suppkey l_shipdate l_extendedprice l_quantity l_discount l_tax l_returnflag l_linestatus".split()


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of a project; starts may be missing, counts zero and names empty.

    Numbered before they are named: what is shuffled is the same for all readers,
    who share it, and clips stay dealt by project.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *_CLIP_ORDER)
    li = li.withColumn("clip_index", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_CLIP_ORDER)) - 1)
    return li.select(
        F.col("l_orderkey").alias("project_id"), "clip_index", F.col("l_partkey").alias("source_id"),
        F.when(F.col("l_returnflag") != "N", (F.col("l_suppkey") % 64).cast("int")).alias("timeline_start_frame"), (F.col("l_linenumber") - 1).cast("int").alias("source_start_frame"),
        F.when(F.col("l_linestatus") == "O", 0).otherwise(F.col("l_quantity").cast("int")).alias("frame_count"), F.when(F.col("l_linenumber") == 7, "").otherwise(F.concat(F.lit("clip"), F.col("l_linenumber").cast("string"))).alias("name"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources; every tenth is missing."""
    p = table(spark, sf_dir, "part").filter("p_partkey % 10 <> 0")
    return p.select(F.col("p_partkey").alias("source_id"), F.col("p_name").alias("path"), F.col("p_size").cast("int").alias("n_frames"), (64 + F.col("p_partkey") % 1000).cast("int").alias("canvas_width"), (48 + F.col("p_size")).cast("int").alias("canvas_height"))


def local_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clips with the number that their source has in its own project."""
    return clips(spark, sf_dir).withColumn("source_id", (F.col("source_id") % 4).cast("long"))


def local_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three sources of each project, numbered from 0 in each."""
    o = table(spark, sf_dir, "orders").withColumn("source_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("o_orderkey") % 3)))
    i = F.col("o_orderkey") * 7 + F.col("source_id") * 13
    return o.select(F.col("o_orderkey").alias("project_id"), "source_id", F.concat_ws("/", F.lit("p"), "o_orderkey", "source_id").alias("path"), (i % 50).cast("int").alias("n_frames"), (600 + i % 400).cast("int").alias("canvas_width"), (500 + i % 300).cast("int").alias("canvas_height"))


def keyframe_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyframe upserts per clip; the highest `seq` wins."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").alias("clip_key"), (k % 97).cast("int").alias("frame_index"), k.alias("seq"), (F.col("o_totalprice").cast("double") / 1000).alias("x"), (k % 50).cast("double").alias("y"),
        (1.0 + (k % 4).cast("double") / 4).alias("scale_x"), F.lit(1.0).alias("scale_y"), (k % 360).cast("double").alias("rotation_deg"), (k % 256).cast("int").alias("alpha"),
    )


#: The same views as SQL for DuckDB.
SQL = {
    "px": """px AS (SELECT *, level*40 AS r, level*30 AS g, level*20 AS b, 255 AS a, (level*40)::BIGINT*16777216 + level*30*65536 + level*20*256 + 255 AS color FROM (
 SELECT e.label AS file_id, e.frame_index, u.i - 1 AS pixel_index, (u.i - 1) % 8 AS x, (u.i - 1) // 8 AS y, CAST(FLOOR(CAST(e.embedding[u.i] AS DOUBLE) * 5) + 3 AS INTEGER) AS level
 FROM (SELECT label, embedding, ROW_NUMBER() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_index FROM embeddings) e, LATERAL (SELECT unnest(range(1, len(e.embedding) + 1)) AS i) u))""",
    "fades": """fades AS (SELECT *, r::BIGINT*16777216 + g*65536 + b*256 + a AS color FROM (
 SELECT p.file_id, p.frame_index, p.pixel_index, p.x, p.y, q.level*40 AS r, q.level*30 AS g, q.level*20 AS b, CASE WHEN q.level = 1 THEN 0 ELSE 240 - 60 * (p.frame_index % 4) END AS a
 FROM px p JOIN px q ON p.file_id = q.file_id AND p.pixel_index = q.pixel_index AND q.frame_index = p.frame_index - p.frame_index % 4))""",
    "log": """log AS (SELECT user_id AS file_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index,
 CASE WHEN event_type IN ('signup') THEN 1 WHEN event_type = 'error' THEN 3 ELSE 2 END AS frame_type, CAST(event_id % 20 AS INTEGER) * 10 AS duration_ms,
 CAST(k % 64 AS INTEGER) AS transform_flags, CAST(k % 16 AS INTEGER) AS cell, CAST(FLOOR(value) AS INTEGER) AS v, CAST(FLOOR(value) AS INTEGER) % 256 AS alpha, ts, event_id
 FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events))""",
    "sym": """sym AS (SELECT d.doc_id AS file_id, 0 AS frame_index, i.p - 1 AS pixel_index, substr(d.text, i.p, 1) AS v FROM documents d, LATERAL (SELECT unnest(range(1, length(d.text) + 1)) AS p) i)""",
    "clips": f"""clips AS (SELECT l_orderkey AS project_id, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_CLIP_ORDER)}) - 1 AS clip_index, l_partkey AS source_id,
 CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_suppkey % 64 AS INTEGER) END AS timeline_start_frame, l_linenumber - 1 AS source_start_frame,
 CASE WHEN l_linestatus = 'O' THEN 0 ELSE CAST(l_quantity AS INTEGER) END AS frame_count, CASE WHEN l_linenumber = 7 THEN '' ELSE 'clip' || l_linenumber END AS name FROM lineitem)""",
    "sources": """sources AS (SELECT p_partkey AS source_id, p_name AS path, p_size AS n_frames, 64 + CAST(p_partkey % 1000 AS INTEGER) AS canvas_width, 48 + p_size AS canvas_height FROM part WHERE p_partkey % 10 <> 0)""",
    "own_clips": "own_clips AS (SELECT * REPLACE (source_id % 4 AS source_id) FROM clips)",
    "own_sources": """own_sources AS (SELECT project_id, source_id, 'p/' || project_id || '/' || source_id AS path, i % 50 AS n_frames, 600 + i % 400 AS canvas_width, 500 + i % 300 AS canvas_height
 FROM (SELECT project_id, source_id, project_id * 7 + source_id * 13 AS i FROM (SELECT o_orderkey AS project_id, unnest(range(0, o_orderkey % 3 + 1)) AS source_id FROM orders)))""",
    "kf": """kf AS (SELECT o_custkey AS clip_key, CAST(o_orderkey % 97 AS INTEGER) AS frame_index, o_orderkey AS seq, o_totalprice / 1000 AS x, CAST(o_orderkey % 50 AS DOUBLE) AS y,
 1.0 + CAST(o_orderkey % 4 AS DOUBLE) / 4 AS scale_x, CAST(1.0 AS DOUBLE) AS scale_y, CAST(o_orderkey % 360 AS DOUBLE) AS rotation_deg, CAST(o_orderkey % 256 AS INTEGER) AS alpha FROM orders)""",
}


def with_views(*names: str) -> str:
    """A WITH clause of the named views, open for more."""
    need = list(dict.fromkeys(n for name in names for n in (["px", name] if name == "fades" else [name])))
    return "WITH " + ",\n".join(SQL[n] for n in need)
