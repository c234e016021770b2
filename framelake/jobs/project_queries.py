"""Queries over projects, keyframes and layers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import composite as C
from ..operators import project as P
from ..operators import dense, warp
from ..sources import views as V

_BASE = V.with_views("clips", "sources")
_LOADED = _BASE + """,
len AS (SELECT c.*, s.path, s.n_frames, s.canvas_width, s.canvas_height, CASE WHEN c.frame_count <= 0 THEN greatest(0, s.n_frames - c.source_start_frame) ELSE least(greatest(0, s.n_frames - c.source_start_frame), c.frame_count) END AS length FROM clips c JOIN sources s USING (source_id)),
loaded AS (SELECT *, greatest(0, coalesce(timeline_start_frame, sum(length) OVER (PARTITION BY project_id ORDER BY clip_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM len)"""
_ACTIVE = _LOADED + """,
act AS (SELECT project_id, start + i AS frame_index, clip_index, source_id, i AS local_frame_index, source_start_frame + i AS source_frame_index FROM loaded, LATERAL (SELECT unnest(range(0, length)) AS i))"""


def _clips(spark, d):
    return V.clips(spark, d), V.sources(spark, d)


def clip_lengths(spark, d):
    return P.clip_lengths(*_clips(spark, d)).select("project_id", "clip_index", "length")


CLIP_LENGTHS = _LOADED + " SELECT project_id, clip_index, length FROM len"


def resolve_clips(spark, d):
    return P.resolve_clips(*_clips(spark, d))[0].select("project_id", "clip_index", "source_id", "start", "length")


RESOLVE_CLIPS = _LOADED + " SELECT project_id, clip_index, source_id, start, length FROM loaded"


def clip_warnings(spark, d):
    _, lost, empty = P.resolve_clips(*_clips(spark, d))
    return lost.unionByName(empty.select("project_id", F.lit(None).cast("int").alias("clip_index"), F.lit(None).cast("string").alias("clip_name"), F.lit(None).cast("long").alias("source_id"), F.col("error").alias("reason")))


CLIP_WARNINGS = _BASE + """ SELECT project_id, clip_index, name AS clip_name, source_id, 'missing source' AS reason FROM clips c WHERE NOT EXISTS (SELECT 1 FROM sources s WHERE s.source_id = c.source_id)
UNION ALL SELECT project_id, NULL, NULL, NULL, 'no loadable clip' FROM (SELECT project_id, count(s.source_id) AS n FROM clips LEFT JOIN sources s USING (source_id) GROUP BY project_id) WHERE n = 0"""


def active_clips(spark, d):
    return P.active_clips(P.resolve_clips(*_clips(spark, d))[0])


ACTIVE_CLIPS = _ACTIVE + " SELECT * FROM act"


def active_at(spark, d):
    """Clips at a few frames of each project, by the bucketed range join."""
    loaded = P.resolve_clips(*_clips(spark, d))[0]
    frames = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("project_id"), F.explode(F.array(*(F.lit(i).cast("long") for i in (0, 17, 40, 100)))).alias("frame_index"))
    return P.active_at(loaded, frames, 16)


ACTIVE_AT = _ACTIVE + " SELECT project_id, frame_index, clip_index, source_id, local_frame_index, source_frame_index FROM act WHERE frame_index IN (0, 17, 40, 100) AND project_id IN (SELECT o_orderkey FROM orders)"


def project_extent(spark, d):
    return P.project_extent(P.resolve_clips(*_clips(spark, d))[0])


PROJECT_EXTENT = _LOADED + " SELECT project_id, greatest(0, max(start + length)) AS total_frames FROM loaded GROUP BY project_id"


def canvas_size(spark, d):
    return P.canvas_size(*_clips(spark, d))


CANVAS_SIZE = _LOADED + " SELECT project_id, greatest(800, max(canvas_width)) AS out_width, greatest(600, max(canvas_height)) AS out_height FROM len GROUP BY project_id"


def append_sources(spark, d):
    clips, sources = _clips(spark, d)
    new = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("project_id"), (F.col("o_custkey") * 10 + 1).alias("source_id"), F.concat(F.lit("dir/s"), F.col("o_custkey").cast("string"), F.lit(".gif")).alias("path"), (F.col("o_orderkey") % 50).alias("n_frames"), (F.col("o_orderkey") % 90 - 20).alias("start"))
    return P.append_sources(clips, new)


APPEND_SOURCES = _BASE + """, have AS (SELECT project_id, count(*) AS n FROM clips GROUP BY project_id)
SELECT project_id, clip_index, source_id, timeline_start_frame, source_start_frame, frame_count, name FROM clips
UNION ALL SELECT o_orderkey, coalesce(n, 0), o_custkey * 10 + 1, greatest(0, o_orderkey % 90 - 20), 0, o_orderkey % 50, 's' || o_custkey FROM orders LEFT JOIN have ON have.project_id = o_orderkey"""


def _edits(clips):
    i = F.col("project_id") + F.col("clip_index")
    return clips.filter(i % 3 == 0).select("project_id", "clip_index", F.when(i % 2 == 0, (i % 40 - 5).cast("int")).alias("new_start"), (i % 30 - 2).cast("int").alias("new_source_start"), (i % 25 - 1).cast("int").alias("new_count"), F.when(i % 5 == 0, F.lit("  edited ")).alias("new_name"))


def update_clips(spark, d):
    clips, sources = _clips(spark, d)
    return P.update_clips(clips, _edits(clips), sources)[0]


_EDIT = _BASE + """, e AS (SELECT c.project_id, c.clip_index, CASE WHEN s.source_id IS NULL THEN 'unknown source' WHEN i % 30 - 2 < 0 OR i % 30 - 2 >= n_frames THEN 'source start out of range' WHEN i % 25 - 1 < 0 THEN 'negative count' WHEN i % 25 - 1 > n_frames - (i % 30 - 2) THEN 'count beyond source' END AS error,
 greatest(0, coalesce(CASE WHEN i % 2 = 0 THEN i % 40 - 5 END, timeline_start_frame, 0)) AS st, i % 30 - 2 AS ss, i % 25 - 1 AS fc, CASE WHEN i % 5 = 0 THEN 'edited' ELSE path END AS nm
 FROM (SELECT *, project_id + clip_index AS i FROM clips) c LEFT JOIN sources s USING (source_id) WHERE i % 3 = 0)"""
UPDATE_CLIPS = _EDIT + """ SELECT c.project_id, c.clip_index, c.source_id, CASE WHEN ok THEN st ELSE timeline_start_frame END AS timeline_start_frame, CASE WHEN ok THEN ss ELSE source_start_frame END AS source_start_frame, CASE WHEN ok THEN fc ELSE frame_count END AS frame_count, CASE WHEN ok THEN nm ELSE name END AS name
FROM clips c LEFT JOIN (SELECT *, error IS NULL AS ok FROM e WHERE error IS NULL) e USING (project_id, clip_index)"""


def rejected_edits(spark, d):
    clips, sources = _clips(spark, d)
    return P.update_clips(clips, _edits(clips), sources)[1]


REJECTED_EDITS = _EDIT + " SELECT project_id, clip_index, error FROM e WHERE error IS NOT NULL"


def clip_listing(spark, d):
    clips, sources = _clips(spark, d)
    return P.clip_listing(P.resolve_clips(clips, sources, labels=True)[0], sources)


CLIP_LISTING = _LOADED + " SELECT project_id, clip_index + 1 AS position, coalesce(nullif(name, ''), path) AS label, start, length FROM loaded"


def active_label(spark, d):
    return P.active_label(P.resolve_clips(*_clips(spark, d), labels=True)[0])


ACTIVE_LABEL = _ACTIVE + """, t AS (SELECT act.project_id, act.frame_index, coalesce(nullif(l.name, ''), l.path) || ':' || local_frame_index AS t, row_number() OVER w AS i, count(*) OVER (PARTITION BY act.project_id, act.frame_index) AS n
 FROM act JOIN loaded l USING (project_id, clip_index) WINDOW w AS (PARTITION BY act.project_id, act.frame_index ORDER BY clip_index))
SELECT project_id, frame_index, string_agg(t, ', ' ORDER BY i) || CASE WHEN max(n) > 3 THEN ' +' || (max(n) - 3) || ' more' ELSE '' END AS active FROM t WHERE i <= 3 GROUP BY project_id, frame_index"""


def distinct_warnings(spark, d):
    _, lost, _ = P.resolve_clips(*_clips(spark, d))
    return P.distinct_warnings(lost.select("project_id", F.col("clip_name").alias("text"), F.col("clip_index").alias("pos")))


DISTINCT_WARNINGS = _BASE + " SELECT project_id, name AS text, min(clip_index) AS first_pos FROM clips WHERE source_id NOT IN (SELECT source_id FROM sources) GROUP BY project_id, name"


def upsert_keyframes(spark, d):
    return P.upsert_keyframes(V.keyframe_updates(spark, d))


_KF = V.with_views("kf") + ", k AS (SELECT * EXCLUDE (seq) FROM kf QUALIFY row_number() OVER (PARTITION BY clip_key, frame_index ORDER BY seq DESC) = 1)"
UPSERT_KEYFRAMES = _KF + " SELECT clip_key, frame_index, x, y, scale_x, scale_y, rotation_deg, least(255, greatest(0, alpha)) AS alpha FROM k"


def delete_keyframes(spark, d):
    k = upsert_keyframes(spark, d)
    return P.delete_keyframes(k, k.filter("frame_index % 4 = 1"))


DELETE_KEYFRAMES = _KF + " SELECT * FROM k WHERE frame_index % 4 <> 1"


def _kf_frames(spark, d):
    c = V.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("clip_key"), F.explode(F.sequence(F.lit(0), F.lit(96), F.lit(8))).alias("frame_index"))


def interpolate_keyframes(spark, d):
    return P.interpolate_keyframes(upsert_keyframes(spark, d), _kf_frames(spark, d))


def _lerp(c: str, default: str) -> str:
    return f"CASE WHEN l.f IS NOT NULL AND r.f IS NOT NULL THEN l.{c} + (r.{c} - l.{c}) * CASE WHEN r.f = l.f THEN 0.0::DOUBLE ELSE (q.frame_index - l.f) / (r.f - l.f) END ELSE coalesce(l.{c}, r.{c}, {default}) END"


_AT = _KF + """, q AS (SELECT c_custkey AS clip_key, unnest(range(0, 97, 8)) AS frame_index FROM customer), kk AS (SELECT *, frame_index AS f FROM k),
l AS (SELECT q.clip_key, q.frame_index AS qi, max(f) AS f FROM q JOIN kk ON kk.clip_key = q.clip_key AND f <= q.frame_index GROUP BY ALL),
r AS (SELECT q.clip_key, q.frame_index AS qi, min(f) AS f FROM q JOIN kk ON kk.clip_key = q.clip_key AND f >= q.frame_index GROUP BY ALL),
kat AS (SELECT q.clip_key, q.frame_index, """ + ", ".join(f"{_lerp(c, v)} AS {c}" for c, v in (("x", "0"), ("y", "0"), ("scale_x", "1"), ("scale_y", "1"), ("rotation_deg", "0"))) + ", CAST(round_even(" + _lerp("alpha", "255") + """, 0) AS INTEGER) AS alpha
 FROM q LEFT JOIN l AS lx ON lx.clip_key = q.clip_key AND lx.qi = q.frame_index LEFT JOIN kk l ON l.clip_key = q.clip_key AND l.f = lx.f LEFT JOIN r AS rx ON rx.clip_key = q.clip_key AND rx.qi = q.frame_index LEFT JOIN kk r ON r.clip_key = q.clip_key AND r.f = rx.f)"""
INTERPOLATE_KEYFRAMES = _AT + " SELECT * FROM kat"


def _round6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def place_layers(spark, d):
    """Each clip key as a layer of its own project, shown at its keyframed frames over a source of the same number."""
    at = interpolate_keyframes(spark, d)
    active = at.select(F.col("clip_key").alias("project_id"), F.col("frame_index"), F.lit(0).alias("clip_index"), "clip_key", F.col("frame_index").alias("local_frame_index"), F.col("clip_key").alias("source_id"))
    return _round6(P.place_layers(active, at, V.sources(spark, d)), "rotation_deg")


PLACE_LAYERS = _AT + ", " + V.SQL["sources"] + """ SELECT clip_key AS project_id, frame_index, 0 AS clip_index, greatest(1, CAST(round_even(canvas_width * greatest(0.001, scale_x), 0) AS INTEGER)) AS width, greatest(1, CAST(round_even(canvas_height * greatest(0.001, scale_y), 0) AS INTEGER)) AS height,
 round(rotation_deg, 6) AS rotation_deg, CAST(round_even(x, 0) AS INTEGER) AS x, CAST(round_even(y, 0) AS INTEGER) AS y, alpha FROM kat JOIN sources ON source_id = clip_key"""


def composite_layers(spark, d):
    """Frames of each raster file as layers over one another, four at a time; alpha comes from the level."""
    px = V.rasters(spark, d).withColumn("a", F.when(F.col("level") == 5, 255).otherwise(F.col("level") * 50))
    return C.composite(px.withColumn("z", F.col("frame_index") % 4).withColumn("group", F.floor(F.col("frame_index") / 4)), ["file_id", "group", "x", "y"])


COMPOSITE_LAYERS = V.with_views("px") + """, la AS (SELECT file_id, frame_index // 4 AS "group", x, y, frame_index % 4 AS z, r, g, b, CASE WHEN level = 5 THEN 255 ELSE level * 50 END / 255.0::DOUBLE AS k FROM px WHERE level > 0),
wt AS (SELECT *, k * coalesce(product(1 - k) OVER (PARTITION BY file_id, "group", x, y ORDER BY z ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1) AS w FROM la)
SELECT file_id, "group", x, y, CAST(round_even(round(sum(r * w) / sum(w), 6), 0) AS INTEGER) AS r, CAST(round_even(round(sum(g * w) / sum(w), 6), 0) AS INTEGER) AS g, CAST(round_even(round(sum(b * w) / sum(w), 6), 0) AS INTEGER) AS b, CAST(round_even(round(sum(w) * 255, 6), 0) AS INTEGER) AS a FROM wt GROUP BY ALL"""


def checkerboard_over(spark, d):
    return C.over_background(V.fades(spark, d), ["file_id", "frame_index", "x", "y"], cell=3)


def _over(c: str) -> str:
    return f"CAST(round_even(round({c} * (a / 255.0::DOUBLE) + s * (1 - a / 255.0::DOUBLE), 6), 0) AS INTEGER) AS {c}"


CHECKERBOARD_OVER = V.with_views("fades") + f" SELECT file_id, frame_index, x, y, {_over('r')}, {_over('g')}, {_over('b')}, 255 AS a FROM (SELECT *, CASE WHEN (x // 3 + y // 3) % 2 = 0 THEN 200 ELSE 150 END AS s FROM fades)"


def _sized(spark, d):
    return V.rasters(spark, d).withColumns({"width": F.lit(8), "height": F.lit(8), "new_width": F.lit(12), "new_height": F.lit(5)})


def resize_nearest(spark, d):
    return warp.resize_rasters(_sized(spark, d), ["file_id", "frame_index"], "nearest")


RESIZE_NEAREST = V.with_views("px") + """ SELECT p.file_id, p.frame_index, dx AS x, dy AS y, r, g, b, a FROM (SELECT unnest(range(0, 12)) AS dx) t1, (SELECT unnest(range(0, 5)) AS dy) t2, px p
WHERE p.x = least(7, floor((dx + 0.5) * 8 / 12)) AND p.y = least(7, floor((dy + 0.5) * 8 / 5))"""


def resize_bicubic(spark, d):
    return warp.resize_rasters(_sized(spark, d), ["file_id", "frame_index"], "bicubic")


def _tap_sql(name: str, new: int) -> str:
    return f"""{name} AS (SELECT dst, src, w / sum(w) OVER (PARTITION BY dst) AS w FROM (SELECT dst, src, CASE WHEN t < 1 THEN (1.5 * t - 2.5) * t * t + 1 WHEN t < 2 THEN ((-0.5 * t + 2.5) * t - 4) * t + 2 ELSE 0 END AS w
 FROM (SELECT dst, src, abs((src + 0.5 - (dst + 0.5) * 8 / {new}::DOUBLE) / greatest(1.0, 8 / {new}::DOUBLE)) AS t FROM (SELECT unnest(range(0, {new})) AS dst) a, (SELECT unnest(range(0, 8)) AS src) b)) WHERE w <> 0)"""


def _lev(c: str) -> str:
    return f"greatest(0, least(255, CAST(round_even(round(sum({c} * tx.w * ty.w), 6), 0) AS INTEGER))) AS {c}"


RESIZE_BICUBIC = V.with_views("px") + ", " + _tap_sql("tx", 12) + ", " + _tap_sql("ty", 5) + f" SELECT file_id, frame_index, tx.dst AS x, ty.dst AS y, {_lev('r')}, {_lev('g')}, {_lev('b')}, {_lev('a')} FROM px JOIN tx ON tx.src = px.x JOIN ty ON ty.src = px.y GROUP BY file_id, frame_index, tx.dst, ty.dst"


def rotate_nearest(spark, d):
    px = V.rasters(spark, d).withColumns({"width": F.lit(8), "height": F.lit(8), "deg": (F.col("frame_index") % 12 * 30).cast("double")})
    return warp.rotate_rasters(px, ["file_id", "frame_index"])


ROTATE_NEAREST = V.with_views("px") + """, f AS (SELECT file_id, frame_index, round(cos(radians(frame_index % 12 * 30)), 9) AS c, round(sin(radians(frame_index % 12 * 30)), 9) AS s, ceil(round(8 * abs(c) + 8 * abs(s), 6))::INTEGER AS n FROM px WHERE pixel_index = 0),
g AS (SELECT f.*, dx, dy, dx + 0.5 - n / 2.0 AS u, dy + 0.5 - n / 2.0 AS v FROM f, (SELECT unnest(range(0, 12)) AS dx) a, (SELECT unnest(range(0, 12)) AS dy) b WHERE dx < n AND dy < n)
SELECT g.file_id, g.frame_index, dx AS x, dy AS y, coalesce(r, 0) AS r, coalesce(px.g, 0) AS g, coalesce(b, 0) AS b, coalesce(a, 0) AS a FROM g LEFT JOIN px ON px.file_id = g.file_id AND px.frame_index = g.frame_index AND px.x = floor(round(u * c + v * s + 4, 6)) AND px.y = floor(round(-u * s + v * c + 4, 6))"""

def rotate_bicubic(spark, d):
    px = V.rasters(spark, d).withColumns({"width": F.lit(8), "height": F.lit(8), "deg": (F.col("frame_index") % 12 * 30).cast("double")})
    return warp.rotate_rasters(px, ["file_id", "frame_index"], method="bicubic")


def _turn_tap(p: str) -> str:
    """Weight of the source place `i` for the place `p` of a row of 8, places beyond the edges counted at them."""
    return f"(SELECT sum(CASE WHEN t < 1 THEN t * t * t - 2 * t * t + 1 WHEN t < 2 THEN -t * t * t + 5 * t * t - 8 * t + 4 ELSE 0 END) FROM (SELECT abs(round({p} - 0.5 - j, 6)) AS t FROM (SELECT unnest(range(-2, 11)) AS j) WHERE greatest(0, least(7, j)) = i))"


ROTATE_BICUBIC = ROTATE_NEAREST[: ROTATE_NEAREST.index("SELECT g.file_id")].rstrip() + f""",
m AS (SELECT DISTINCT n, dx, dy, c, s, round(u * c + v * s + 4, 6) AS mx, round(-u * s + v * c + 4, 6) AS my FROM g),
pl AS (SELECT DISTINCT mx AS p FROM m UNION SELECT DISTINCT my FROM m),
w AS (SELECT p, i, {_turn_tap("p")} AS w FROM pl, (SELECT unnest(range(0, 8)) AS i) WHERE p >= 0 AND p < 8),
t AS (SELECT m.*, wx.i AS sx, wy.i AS sy, wx.w * wy.w AS w FROM m JOIN w wx ON wx.p = mx JOIN w wy ON wy.p = my WHERE wx.w <> 0 AND wy.w <> 0),
z AS (SELECT px.file_id, px.frame_index, dx, dy, sum(px.r * px.a * w) AS zr, sum(px.g * px.a * w) AS zg, sum(px.b * px.a * w) AS zb, sum(px.a * w) AS za
 FROM f JOIN t ON t.n = f.n AND t.c = f.c AND t.s = f.s JOIN px ON px.file_id = f.file_id AND px.frame_index = f.frame_index AND px.x = sx AND px.y = sy GROUP BY ALL)
SELECT g.file_id, g.frame_index, g.dx AS x, g.dy AS y, {", ".join(f"greatest(0, least(255, CAST(round_even(round(coalesce(z{c} / za, 0), 6), 0) AS INTEGER))) AS {c}" for c in "rgb")}, greatest(0, least(255, CAST(round_even(round(coalesce(za, 0), 6), 0) AS INTEGER))) AS a
FROM g LEFT JOIN z ON z.file_id = g.file_id AND z.frame_index = g.frame_index AND z.dx = g.dx AND z.dy = g.dy"""


def _own(spark, d):
    return V.local_clips(spark, d), V.local_sources(spark, d)


_OWN = V.with_views("clips", "own_clips", "own_sources") + """,
len AS (SELECT c.*, s.path, CASE WHEN c.frame_count <= 0 THEN greatest(0, s.n_frames - c.source_start_frame) ELSE least(greatest(0, s.n_frames - c.source_start_frame), c.frame_count) END AS length FROM own_clips c JOIN own_sources s USING (project_id, source_id)),
loaded AS (SELECT *, greatest(0, coalesce(timeline_start_frame, sum(length) OVER (PARTITION BY project_id ORDER BY clip_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM len)"""


def local_sources_resolved(spark, d):
    """Clips of projects that number their own sources, with their labels."""
    return P.resolve_clips(*_own(spark, d), labels=True)[0].select("project_id", "clip_index", "source_id", "start", "length", "label")


LOCAL_SOURCES_RESOLVED = _OWN + " SELECT project_id, clip_index, source_id, start, length, coalesce(nullif(name, ''), regexp_replace(path, '^.*/', '')) AS label FROM loaded"


def local_sources_missing(spark, d):
    return P.resolve_clips(*_own(spark, d))[1].select("project_id", "clip_index", "source_id")


LOCAL_SOURCES_MISSING = _OWN + " SELECT project_id, clip_index, source_id FROM own_clips WHERE NOT EXISTS (SELECT 1 FROM own_sources s WHERE s.project_id = own_clips.project_id AND s.source_id = own_clips.source_id)"


def local_canvas_size(spark, d):
    return P.canvas_size(*_own(spark, d))


LOCAL_CANVAS_SIZE = _OWN + " SELECT project_id, greatest(800, max(canvas_width)) AS out_width, greatest(600, max(canvas_height)) AS out_height FROM own_sources GROUP BY project_id"


def local_update_clips(spark, d):
    clips, sources = _own(spark, d)
    return P.update_clips(clips, _edits(clips), sources)[0]


LOCAL_UPDATE_CLIPS = (
    _EDIT.replace(V.SQL["sources"], ",\n".join(V.SQL[n] for n in ("own_clips", "own_sources"))).replace("FROM clips) c LEFT JOIN sources s USING (source_id)", "FROM own_clips) c LEFT JOIN own_sources s USING (project_id, source_id)")
    + UPDATE_CLIPS[len(_EDIT) :].replace("FROM clips c", "FROM own_clips c")
)


def resize_lanczos(spark, d):
    return warp.resize_rasters(_sized(spark, d), ["file_id", "frame_index"], "lanczos")


def _lanczos_sql(name: str, new: int) -> str:
    return f"""{name} AS (SELECT dst, src, w / sum(w) OVER (PARTITION BY dst) AS w FROM (SELECT dst, src, CASE WHEN t < 1e-9 THEN 1 WHEN t < 3 THEN sin(pi() * t) / (pi() * t) * sin(pi() * t / 3) / (pi() * t / 3) ELSE 0 END AS w
 FROM (SELECT dst, src, abs((src + 0.5 - (dst + 0.5) * 8 / {new}::DOUBLE) / greatest(1.0, 8 / {new}::DOUBLE)) AS t FROM (SELECT unnest(range(0, {new})) AS dst) a, (SELECT unnest(range(0, 8)) AS src) b)) WHERE w <> 0)"""


RESIZE_LANCZOS = V.with_views("px") + ", " + _lanczos_sql("tx", 12) + ", " + _lanczos_sql("ty", 5) + f" SELECT file_id, frame_index, tx.dst AS x, ty.dst AS y, {_lev('r')}, {_lev('g')}, {_lev('b')}, {_lev('a')} FROM px JOIN tx ON tx.src = px.x JOIN ty ON ty.src = px.y GROUP BY file_id, frame_index, tx.dst, ty.dst"

def _fades_sized(spark, d):
    return V.fades(spark, d).withColumns({"width": F.lit(8), "height": F.lit(8), "new_width": F.lit(12), "new_height": F.lit(5)})


def resize_fades(spark, d):
    """Rasters with transparent pixels, whose colours must not show."""
    return warp.resize_rasters(_fades_sized(spark, d), ["file_id", "frame_index"], "bicubic")


def _byte(c: str) -> str:
    return f"greatest(0, least(255, CAST(round_even(round({c}, 6), 0) AS INTEGER)))"


RESIZE_FADES = V.with_views("fades") + ", " + _tap_sql("tx", 12) + ", " + _tap_sql("ty", 5) + f""",
z AS (SELECT file_id, frame_index, tx.dst AS x, ty.dst AS y, sum(r * a * tx.w * ty.w) AS zr, sum(g * a * tx.w * ty.w) AS zg, sum(b * a * tx.w * ty.w) AS zb, sum(a * tx.w * ty.w) AS za FROM fades JOIN tx ON tx.src = fades.x JOIN ty ON ty.src = fades.y GROUP BY ALL)
SELECT file_id, frame_index, x, y, {", ".join(f"CASE WHEN round(za, 6) > 0 THEN {_byte(f'z{c} / za')} ELSE 0 END AS {c}" for c in "rgb")}, {_byte("za")} AS a FROM z"""


def _dense(images, method, deg=None):
    """Images of 8 x 8 pixels warped whole, as pixels."""
    keys = ["file_id", "frame_index"]
    size = (12, 5) if deg is None else (8, 8)
    sized = images.withColumns({"width": F.lit(8), "height": F.lit(8), "new_width": F.lit(size[0]), "new_height": F.lit(size[1]), "deg": F.lit(0.0) if deg is None else deg})
    # turns alone leave the size as it is, for which nearest is exact
    out = dense.warp_images(sized, keys, method if deg is None else "nearest", None if deg is None else method)
    return dense.pixels_of(out, keys)


def resize_nearest_dense(spark, d):
    return _dense(V.raster_images(spark, d), "nearest")


def resize_bicubic_dense(spark, d):
    return _dense(V.raster_images(spark, d), "bicubic")


def resize_lanczos_dense(spark, d):
    return _dense(V.raster_images(spark, d), "lanczos")


def resize_fades_dense(spark, d):
    return _dense(V.fade_images(spark, d), "bicubic")


def rotate_nearest_dense(spark, d):
    return _dense(V.raster_images(spark, d), "nearest", (F.col("frame_index") % 12 * 30).cast("double"))


def rotate_bicubic_dense(spark, d):
    return _dense(V.raster_images(spark, d), "bicubic", (F.col("frame_index") % 12 * 30).cast("double"))


RESIZE_NEAREST_DENSE, RESIZE_BICUBIC_DENSE, RESIZE_LANCZOS_DENSE, RESIZE_FADES_DENSE = RESIZE_NEAREST, RESIZE_BICUBIC, RESIZE_LANCZOS, RESIZE_FADES
ROTATE_NEAREST_DENSE, ROTATE_BICUBIC_DENSE = ROTATE_NEAREST, ROTATE_BICUBIC

QUERIES = {f.__name__: f for f in (
    clip_lengths, resolve_clips, clip_warnings, active_clips, active_at, project_extent, canvas_size, append_sources, update_clips, rejected_edits, clip_listing, active_label, distinct_warnings,
    upsert_keyframes, delete_keyframes, interpolate_keyframes, place_layers, composite_layers, checkerboard_over, resize_nearest, resize_bicubic, resize_lanczos, resize_fades, rotate_nearest, rotate_bicubic,
    resize_nearest_dense, resize_bicubic_dense, resize_lanczos_dense, resize_fades_dense, rotate_nearest_dense, rotate_bicubic_dense,
    local_sources_resolved, local_sources_missing, local_canvas_size, local_update_clips)}
ORACLE_SQL = {k: globals()[k.upper()] for k in QUERIES}
