"""Projects: clips on a timeline, keyframes, layer geometry."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

#: Values of a clip without keyframes (fixed values).
DEFAULTS = {"x": 0.0, "y": 0.0, "scale_x": 1.0, "scale_y": 1.0, "rotation_deg": 0.0, "alpha": 255}
_CLIP = ["project_id", "clip_index"]


def source_key(sources: DataFrame) -> list[str]:
    """What names a source: its project and its number there. A table without `project_id` is a pool that all projects share."""
    return ["project_id", "source_id"] if "project_id" in sources.columns else ["source_id"]


def _label(path: str) -> Column:
    """A clip's name, or its source's file name."""
    return F.coalesce(F.nullif("name", F.lit("")), F.regexp_replace(path, "^.*/", ""))


def clip_lengths(clips: DataFrame, sources: DataFrame, labels: bool = False) -> DataFrame:
    """Frames that each clip of a known source can show: what its source has after its start, or the count asked for if smaller. With `labels` also its `label`, by the same join."""
    available = F.greatest(F.lit(0), F.col("n_frames") - F.col("source_start_frame"))
    length = F.when(F.col("frame_count") <= 0, available).otherwise(F.least(available, F.col("frame_count")))
    key = source_key(sources)
    used = sources.select(*key, "n_frames", *([F.col("path").alias("_path")] if labels else []))
    out = clips.join(used, key).withColumn("length", length.cast("long")).drop("n_frames")
    return out.withColumn("label", _label("_path")).drop("_path") if labels else out


def resolve_clips(clips: DataFrame, sources: DataFrame, labels: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Loaded clips with `start` and `length`; a warning for each clip without a source; projects with nothing to load.

    A missing start is the sum of the lengths of all loaded clips before it,
    also of those with a start of their own. `labels`: loaded clips also have
    their `label`.
    """
    loaded = clip_lengths(clips, sources, labels)
    before = Window.partitionBy("project_id").orderBy("clip_index").rowsBetween(Window.unboundedPreceding, -1)
    loaded = loaded.withColumn("start", F.greatest(F.lit(0), F.coalesce(F.col("timeline_start_frame").cast("long"), F.sum("length").over(before), F.lit(0))))
    lost = clips.join(sources.select(*source_key(sources)), source_key(sources), "left_anti").select(*_CLIP, F.col("name").alias("clip_name"), "source_id", F.lit("missing source").alias("reason"))
    empty = clips.select("project_id").distinct().join(loaded.select("project_id").distinct(), "project_id", "left_anti").withColumn("error", F.lit("no loadable clip"))
    return loaded, lost, empty


def active_clips(loaded: DataFrame) -> DataFrame:
    """One row for each timeline frame that a clip covers: `frame_index`, `local_frame_index`, `source_frame_index`. Linear: each clip makes its own frames."""
    out = loaded.filter("length > 0").withColumn("local_frame_index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)))
    out = out.withColumns({"frame_index": F.col("start") + F.col("local_frame_index"), "source_frame_index": F.col("source_start_frame") + F.col("local_frame_index")})
    return out.filter("source_frame_index >= 0").select("project_id", "frame_index", "clip_index", "source_id", "local_frame_index", "source_frame_index")


def active_at(loaded: DataFrame, frames: DataFrame, span: int = 64) -> DataFrame:
    """Clips that cover given frames (project_id, frame_index): both sides are cut in spans, joined on (project, span), then checked."""
    s = loaded.filter("length > 0").withColumn("_span", F.explode(F.sequence(F.floor(F.col("start") / span), F.floor((F.col("start") + F.col("length") - 1) / span))))
    q = frames.withColumn("_span", F.floor(F.col("frame_index") / span))
    hit = q.join(s, ["project_id", "_span"]).filter("frame_index >= start AND frame_index < start + length")
    return hit.select("project_id", "frame_index", "clip_index", "source_id", (F.col("frame_index") - F.col("start")).alias("local_frame_index"), (F.col("frame_index") - F.col("start") + F.col("source_start_frame")).alias("source_frame_index"))


def project_extent(loaded: DataFrame) -> DataFrame:
    return loaded.groupBy("project_id").agg(F.greatest(F.lit(0), F.max(F.col("start") + F.col("length"))).cast("long").alias("total_frames"))


def canvas_size(clips: DataFrame, sources: DataFrame) -> DataFrame:
    """Largest source of each project, 800 by 600 at least. All sources of a project count; of a shared pool, those that its clips use."""
    s = sources if "project_id" in sources.columns else clips.join(sources, "source_id")
    return s.groupBy("project_id").agg(F.greatest(F.max("canvas_width"), F.lit(800)).alias("out_width"), F.greatest(F.max("canvas_height"), F.lit(600)).alias("out_height"))


def append_sources(clips: DataFrame, new: DataFrame) -> DataFrame:
    """`clips` and a default clip for each new source (project_id, source_id, path, n_frames, start): all of it, start zero at least, places after the clips there are."""
    have = clips.groupBy("project_id").agg(F.count(F.lit(1)).alias("_have"))
    order = F.row_number().over(Window.partitionBy("project_id").orderBy("source_id")) - 1
    added = new.join(have, "project_id", "left").select(
        "project_id", (F.coalesce("_have", F.lit(0)) + order).cast("long").alias("clip_index"), "source_id", F.greatest(F.lit(0), F.col("start")).cast("long").alias("timeline_start_frame"), F.lit(0).cast("long").alias("source_start_frame"),
        F.col("n_frames").cast("long").alias("frame_count"), F.regexp_replace(F.regexp_replace("path", "^.*/", ""), r"\.[^.]*$", "").alias("name"),
    )
    return clips.select(*(F.col(c).cast("long").alias(c) if c != "name" else F.col(c) for c in added.columns)).unionByName(added)


def upsert_keyframes(updates: DataFrame, key: str = "clip_key") -> DataFrame:
    """One keyframe for each (clip, frame): the update of the highest `seq`; alpha is held within 0 to 255."""
    last = updates.groupBy(key, "frame_index").agg(F.max_by(F.struct("x", "y", "scale_x", "scale_y", "rotation_deg", "alpha"), "seq").alias("k"))
    return last.select(key, "frame_index", "k.x", "k.y", "k.scale_x", "k.scale_y", "k.rotation_deg", F.greatest(F.lit(0), F.least(F.lit(255), F.col("k.alpha"))).alias("alpha"))


def delete_keyframes(keyframes: DataFrame, keys: DataFrame, key: str = "clip_key") -> DataFrame:
    return keyframes.join(keys.select(key, "frame_index").distinct(), [key, "frame_index"], "left_anti")


def interpolate_keyframes(keyframes: DataFrame, frames: DataFrame, key: str = "clip_key") -> DataFrame:
    """State of each clip at given frames: held outside the keyframes, linear between them, defaults where a clip has none.

    Keyframes are the edges of spans that know both their ends, and a frame
    takes the last span before it: a union and one window, sorted once. A span
    without a left end stands before a clip's first keyframe. At a keyframe its
    own values hold. Alpha is rounded half to even.
    """
    fields = list(DEFAULTS)
    k = keyframes.select(key, F.col("frame_index").cast("long").alias("frame_index"), F.struct(F.col("frame_index").cast("long").alias("f"), *fields).alias("_l")).repartition(key)
    order = Window.partitionBy(key).orderBy("frame_index")
    spans = k.withColumns({"_r": F.lead("_l").over(order), "_first": F.row_number().over(order) == 1})
    none = F.lit(None).cast(k.schema["_l"].dataType)
    edge = lambda f, left, right: F.struct(f.alias("at"), left.alias("l"), right.alias("r"))
    edges = F.array(edge(F.col("frame_index"), F.col("_l"), F.col("_r")), edge(F.lit(None).cast("long"), none, F.col("_l")))
    spans = spans.select(key, F.explode(F.slice(edges, 1, F.when(F.col("_first"), 2).otherwise(1))).alias("_e")).select(key, F.col("_e.at").alias("frame_index"), F.lit(0).alias("_q"), F.struct("_e.l", "_e.r").alias("_s"))
    q = frames.select(key, F.col("frame_index").cast("long").alias("frame_index")).distinct().withColumns({"_q": F.lit(1), "_s": F.lit(None).cast(spans.schema["_s"].dataType)})
    w = Window.partitionBy(key).orderBy(F.col("frame_index").asc_nulls_first(), "_q")
    both = spans.unionByName(q).withColumn("_s", F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_q = 1")
    both = both.select(key, "frame_index", F.col("_s.l").alias("_l"), F.when(F.col("_s.l.f") == F.col("frame_index"), F.col("_s.l")).otherwise(F.col("_s.r")).alias("_r"))
    span = F.col("_r.f") - F.col("_l.f")
    t = F.when(F.coalesce(span, F.lit(0)) == 0, 0.0).otherwise((F.col("frame_index") - F.col("_l.f")) / span)
    value = lambda c: F.coalesce(F.col(f"_l.{c}") + (F.col(f"_r.{c}") - F.col(f"_l.{c}")) * t, F.col(f"_l.{c}"), F.col(f"_r.{c}"), F.lit(DEFAULTS[c]))
    return both.select(key, "frame_index", *((F.bround(value(c), 0).cast("int") if c == "alpha" else value(c)).alias(c) for c in fields))


def update_clips(clips: DataFrame, edits: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clips after checked edits, and the edits that were turned down with their `error`.

    `edits`: project_id, clip_index, new_start, new_source_start, new_count, new_name (null: keep).

    Clips and edits are dealt together, once, and meet in a window; edited clips
    alone then move to their source, and nothing comes back. Clips without a key
    have no edit. The dealing is asked for: left to Spark, which takes a union of
    tables dealt alike to be dealt like them, some edits missed their clips.
    """
    shown = [*_CLIP, "source_id", "timeline_start_frame", "source_start_frame", "frame_count", "name"]
    has_key = F.col("project_id").isNotNull() & F.col("clip_index").isNotNull()
    new = edits.filter(has_key).select(*_CLIP, F.struct("new_start", "new_source_start", "new_count", "new_name").alias("_edit"))
    both = clips.filter(has_key).select(*shown).unionByName(new, allowMissingColumns=True).repartition(*_CLIP)
    met = both.withColumn("_edits", F.collect_list("_edit").over(Window.partitionBy(*_CLIP))).filter("_edit IS NULL").drop("_edit")
    met = met.withColumns({c: F.col(c).cast(clips.schema[c].dataType) for c in _CLIP})

    def check(e: Column) -> Column:
        start, count, n = F.coalesce(e["new_source_start"], "source_start_frame"), F.coalesce(e["new_count"], "frame_count"), F.col("n_frames")
        error = F.when(n.isNull(), "unknown source").when((start < 0) | (start >= n), "source start out of range").when(count < 0, "negative count").when(count > n - start, "count beyond source")
        name = F.coalesce(F.nullif(F.trim(e["new_name"]), F.lit("")), F.col("path"))
        return F.struct(error.alias("error"), F.greatest(F.lit(0), F.coalesce(e["new_start"], "timeline_start_frame", F.lit(0))).alias("s"), start.alias("ss"), count.alias("c"), name.alias("n"))

    key = source_key(sources)
    edited = met.filter(F.size("_edits") > 0).join(sources.select(*key, "n_frames", "path").hint("merge"), key, "left").withColumn("_edits", F.transform("_edits", check))
    good = edited.withColumn("_e", F.explode_outer(F.filter("_edits", lambda e: e["error"].isNull())))
    pick = lambda old, new: F.when(F.col("_e").isNotNull(), F.col(f"_e.{new}")).otherwise(F.col(old)).alias(old)
    good = good.select(*shown[:3], pick("timeline_start_frame", "s"), pick("source_start_frame", "ss"), pick("frame_count", "c"), pick("name", "n"))
    out = good.unionByName(met.filter(F.size("_edits") == 0).select(*shown)).unionByName(clips.filter(~has_key).select(*shown))
    bad = edited.withColumn("_e", F.explode(F.filter("_edits", lambda e: e["error"].isNotNull())))
    return out, bad.select(*_CLIP, "_e.error")


def place_layers(active: DataFrame, keyframes_at: DataFrame, sources: DataFrame, key: str = "clip_key") -> DataFrame:
    """Size, place, rotation and opacity of each active layer: size and place rounded half to even, one pixel at least.

    All sides grow with the clips, and Spark guesses frames that clips make to
    be as few as the clips, so nothing is broadcast by a guess.
    """
    at = keyframes_at.withColumnRenamed("frame_index", "local_frame_index")
    a = active.join(at.hint("merge"), [key, "local_frame_index"]).join(sources.select(*source_key(sources), "canvas_width", "canvas_height").hint("merge"), source_key(sources))
    scaled = lambda w, s: F.greatest(F.lit(1), F.bround(F.col(w) * F.greatest(F.lit(0.001), F.col(s)), 0).cast("int"))
    return a.select("project_id", "frame_index", "clip_index", scaled("canvas_width", "scale_x").alias("width"), scaled("canvas_height", "scale_y").alias("height"), "rotation_deg", F.bround("x", 0).cast("int").alias("x"), F.bround("y", 0).cast("int").alias("y"), "alpha")


def clip_listing(loaded: DataFrame, sources: DataFrame) -> DataFrame:
    """Position (from 1), label (name, or the source's file name), start and length of each clip. Clips that have their `label` need no source."""
    if "label" not in loaded.columns:
        key = source_key(sources)
        loaded = loaded.join(sources.select(*key, F.col("path").alias("_path")), key).withColumn("label", _label("_path"))
    return loaded.select("project_id", (F.col("clip_index") + 1).alias("position"), "label", "start", "length")


def active_label(loaded: DataFrame, n: int = 3) -> DataFrame:
    """First `n` active clips of each frame as text, and how many more there are. `loaded`: clips of `resolve_clips` with their `label`.

    What is active changes only where a clip begins or ends: a project's clips
    are swept in the order of their starts, and the stretches between make their
    own frames last of all. One shuffle, of clips, by project; a task holds the
    clips that are active at one time, and no frame is sorted or moved.
    """
    stretches = active_stretches(loaded, n).withColumn("frame_index", F.explode(F.sequence("_from", F.col("_to") - 1)))
    text = F.concat_ws(", ", *(F.concat(f"_label{k}", F.lit(":"), (F.col("frame_index") - F.col(f"_start{k}")).cast("string")) for k in range(n)))
    return stretches.select("project_id", "frame_index", F.when(F.col("_n") > n, F.concat(text, F.lit(" +"), (F.col("_n") - n).cast("string"), F.lit(" more"))).otherwise(text).alias("active"))


def active_stretches(loaded: DataFrame, n: int) -> DataFrame:
    """Stretches of frames (project_id, _from .. _to - 1) over which the same `_n` clips are active, with label and start of the first `n` of them (_label0, _start0, ...): two at most for each clip."""
    first = F.col("start") + F.greatest(F.lit(0), -F.col("source_start_frame"))  # frames before the source's first don't count
    used = loaded.filter("length > 0 AND project_id IS NOT NULL AND clip_index IS NOT NULL").select("project_id", first.cast("long").alias("_from"), (F.col("start") + F.col("length")).cast("long").alias("_to"), "clip_index", "start", "label")
    dealt = used.filter("_from < _to").repartition("project_id").sortWithinPartitions("project_id", "_from", "clip_index")
    schema = T.StructType([loaded.schema["project_id"], *(T.StructField(c, T.LongType()) for c in ("_from", "_to", "_n")), *(T.StructField(f"_{c}{k}", kind) for k in range(n) for c, kind in (("label", T.StringType()), ("start", T.LongType())))])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, at, nth, out = None, 0, 0, []
        active, ends, known = [], [], {}  # keys in the order of clips, (end, key) by end, label and start of each key

        def stretch(end: int) -> None:
            nonlocal at
            if active and end > at:
                top = [x for key in active[:n] for x in known[key]]
                out.append((project, at, end, len(active), *top, *[None] * (2 * n - len(top))))
            at = end

        def until(frame: int | None) -> None:
            while ends and (frame is None or ends[0][0] <= frame):
                end, key = heappop(ends)
                stretch(end)
                del active[bisect_left(active, key)], known[key]

        for b in batches:
            for p, start_at, end, clip, start, label in zip(*(c.to_pylist() for c in b.columns)):
                if p != project:
                    until(None)
                    project, at = p, start_at
                until(start_at)
                stretch(start_at)
                nth += 1
                key = (clip, nth)
                insort(active, key)
                heappush(ends, (end, key))
                known[key] = (label, start)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out), kinds)], schema.names)
                out.clear()
        until(None)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out), kinds)], schema.names)

    return dealt.mapInArrow(run, schema)


def distinct_warnings(warnings: DataFrame, text: str = "text") -> DataFrame:
    """Warnings without repeats, each with the place where it was first seen."""
    return warnings.groupBy("project_id", text).agg(F.min("pos").alias("first_pos"))
