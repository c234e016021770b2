"""Plans and work of queries that failed on large tables."""

import random
import struct

import pyarrow as pa

from framelake.jobs.queries import QUERIES
from framelake.operators import bands, project, warp
from framelake.sources import media


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_layers_are_not_broadcast_by_a_guess(spark, sf):
    assert "Broadcast" not in _plan(QUERIES["place_layers"](spark, sf))


def test_labels_make_frames_last(spark, sf):
    """Nothing is dealt or sorted after frames were made: they stand above all exchanges."""
    plan = _plan(QUERIES["active_label"](spark, sf))
    assert plan.index("explode(sequence") < min(plan.index(x) for x in ("Exchange", "Sort", "Window"))


def test_labels_of_each_frame(spark):
    """Overlapping, equal, touching and cut clips against a look at every frame."""
    rng = random.Random(5)
    rows = [(p, i, rng.randint(0, 12), rng.randint(0, 9), rng.choice((-3, -1, 0, 2)), rng.choice(("a", "b", None, ""))) for p in range(30) for i in range(rng.randint(1, 9))]
    got = {(r.project_id, r.frame_index): r.active for r in project.active_label(spark.createDataFrame(rows, "project_id long, clip_index long, start long, length long, source_start_frame int, label string")).collect()}
    want = {}
    for p in range(30):
        for f in range(30):
            here = [r for r in rows if r[0] == p and r[2] <= f < r[2] + r[3] and r[4] + f - r[2] >= 0]
            if here:
                want[p, f] = ", ".join(f"{r[5]}:{f - r[2]}" for r in here[:3] if r[5] is not None) + (f" +{len(here) - 3} more" if len(here) > 3 else "")
    assert got == want


def test_turned_pixels_are_not_broadcast_by_a_guess(spark):
    """Of a bicubic turn the counted taps alone are sent to all tasks."""
    px = spark.range(16).selectExpr("1 AS k", "int(id % 4) AS x", "int(id div 4) AS y", "4 AS width", "4 AS height", "30.0D AS deg", "int(id) AS r", "0 AS g", "0 AS b", "255 AS a")
    assert "Broadcast" not in _plan(warp.rotate_rasters(px, ["k"]))
    plan = _plan(warp.rotate_rasters(px, ["k"], method="bicubic"))
    assert plan.count("BroadcastExchange") == 1 and "staged-" in plan[plan.index("BroadcastExchange") :][:2000]


def test_projects_are_written_and_parsed_once(spark, sf):
    """Clips and keyframes read the same parsed table: no file is written or parsed again for either."""
    plan = _plan(QUERIES["project_round_trip"](spark, sf))
    assert "from_json" not in plan and "to_json" not in plan and "lineitem" not in plan


def test_small_files_share_a_batch():
    """A batch for each file cost far more than reading it."""
    block = b"JSON" + struct.pack("<I", 12) + b"abcd"
    file = struct.pack("<5sBBBB10I", b"MIPRJ", 1, 0, 49, 0, *[0] * 5, len(block), 49 + len(block), 0, 0, 0) + block
    files = pa.record_batch([pa.array([str(k) for k in range(500)]), pa.array([file] * 499 + [b"MIPRJ"], pa.binary())], names=["file_id", "content"])
    out = list(media._walk([files, files], "block"))
    assert len(out) == 1 and out[0].num_rows == 1000
    assert out[0].slice(0, 1).to_pylist() == [{"file_id": "0", "kind": "block", "position": 0, "body": block, "error": None}]
    assert out[0].slice(999).to_pylist() == [{"file_id": "499", "kind": "block", "position": -1, "body": None, "error": "too_short"}]


def test_interpolation_sorts_frames_once(spark):
    """One sort of keyframes and one of keyframes and frames; values as by the two keyframes around each frame."""
    rng = random.Random(2)
    keys = {(c, f): float(rng.randint(-9, 9)) for c in range(6) for f in rng.sample(range(40), c)}
    k = spark.createDataFrame([(c, f, x, x, 1.0, 1.0, 0.0, 100) for (c, f), x in keys.items()], "clip_key long, frame_index int, x double, y double, scale_x double, scale_y double, rotation_deg double, alpha int")
    out = project.interpolate_keyframes(k, spark.range(6).selectExpr("id AS clip_key", "explode(sequence(0, 40)) AS frame_index"))
    assert _plan(out).count("Sort [") == 2
    for r in out.collect():
        here = sorted(f for c, f in keys if c == r.clip_key)
        left, right = [f for f in here if f <= r.frame_index][-1:], [f for f in here if f >= r.frame_index][:1]
        ends = [keys[r.clip_key, f] for f in left + right]
        t = (r.frame_index - left[0]) / (right[0] - left[0]) if left and right and left != right else 0.0
        assert r.x == (ends[0] + (ends[-1] - ends[0]) * t if ends else 0.0) and r.alpha == (100 if ends else 255)


def test_small_writes_share_a_batch(spark):
    """Writes to many small frames leave the cutting together, not in a batch for each."""
    writes = spark.range(300, numPartitions=1).selectExpr("'f' AS file_id", "0L AS segment", "int(id) AS frame_index", "0 AS rect_index", "0 AS x", "0 AS y", "2 AS w", "2 AS h", "0 AS encoding", "unhex(repeat('0A', 16)) AS data", "2 AS canvas_height")
    cut = bands.cut_to_bands(writes, 1)
    sizes = cut.mapInArrow(lambda batches: (pa.record_batch([pa.array([b.num_rows], pa.int32())], names=["n"]) for b in batches), "n int").collect()
    assert [r.n for r in sizes] == [600]


def _shuffles(df):
    """What a run of `df` shuffled, those it used again left out."""
    df.collect()
    lines = [x.strip(" :+-") for x in _plan(df).split("== Initial Plan ==")[0].splitlines()]
    return [x.split("(", 1)[1].split(", 8)")[0].split("#")[0] for x in lines if x.startswith("Exchange hashpartitioning")]


def test_own_clips_are_shuffled_twice(spark, sf):
    """Once to be numbered, once to meet their edits; those without a project, of which there are none, apart."""
    dealt = _shuffles(QUERIES["local_update_clips"](spark, sf))
    assert dealt.count("l_orderkey") <= 2 and dealt.count("project_id") <= 3 and len(dealt) <= 5


def test_pooled_clips_are_shuffled_twice(spark, sf):
    """As clips of projects with own sources; edited ones move to their source, and nothing comes back."""
    dealt = _shuffles(QUERIES["update_clips"](spark, sf))
    assert dealt.count("l_orderkey") <= 2 and dealt.count("project_id") == 1 and dealt.count("source_id") <= 2 and len(dealt) <= 5


def test_edits_meet_their_clips(spark):
    """Clips and edits dealt alike or not, in many parts: no edit, several, sound and bad ones, without key, without clip, without source."""
    rng = random.Random(4)
    clips = [(p, c, rng.randint(0, 4), rng.choice((None, 3)), rng.randint(0, 3), rng.randint(0, 5), f"n{c}") for p in range(150) for c in range(rng.randint(0, 5))] + [(None, 0, 1, 1, 1, 1, "no project"), (1, None, 1, 1, 1, 1, "no place")]
    edits = [(rng.choice((None, *range(160))), rng.choice((None, *range(6))), rng.choice((None, -4, 7)), rng.choice((None, -1, 2, 9)), rng.choice((None, -1, 1, 6)), rng.choice((None, " ", " new "))) for _ in range(900)]
    sources = {(p, s): (rng.randint(0, 9), f"p{p}/{s}") for p in range(150) for s in range(4)}

    def checked(p, c, s, ts, ss, fc, name, e):
        n, path = sources.get((p, s), (None, None))
        start, count = ss if e[3] is None else e[3], fc if e[4] is None else e[4]
        error = "unknown source" if n is None else "source start out of range" if start < 0 or start >= n else "negative count" if count < 0 else "count beyond source" if count > n - start else None
        return error, (p, c, s, max(0, next(x for x in (e[2], ts, 0) if x is not None)), start, count, (e[5] or "").strip() or path)

    want, bad = [], []
    for row in clips:
        done = [checked(*row, e) for e in edits if e[:2] == row[:2] and None not in row[:2]]
        want += [new for error, new in done if error is None] or [row]
        bad += [(*row[:2], error) for error, _ in done if error]
    c = spark.createDataFrame(clips, "project_id long, clip_index int, source_id long, timeline_start_frame int, source_start_frame int, frame_count int, name string")
    e = spark.createDataFrame(edits, "project_id long, clip_index long, new_start int, new_source_start int, new_count int, new_name string")
    s = spark.createDataFrame([(*k, *v) for k, v in sources.items()], "project_id long, source_id long, n_frames int, path string")
    plain = lambda rows: sorted((tuple(r) for r in rows), key=str)
    assert len(bad) > 100 and len(want) > len(clips)
    for left, right in ((c, e), (c.repartition("project_id"), e.repartition("project_id")), (c.repartition(7, "project_id"), e.repartition(7, "project_id")), (c.repartition(7, "project_id"), e)):
        out, rejected = project.update_clips(left, right, s)
        assert out.dtypes == c.dtypes and plain(out.collect()) == plain(want) and plain(rejected.collect()) == plain(bad)
