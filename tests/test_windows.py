"""Window building, sampling, reports: the small published cases."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanweave.functions.intervals import edge_demote, reference_coverage
from spanweave.operators import metrics as me
from spanweave.operators import sampling as sm
from spanweave.operators import selection as sel
from spanweave.operators import store
from spanweave.operators import tiles as tl
from spanweave.plans import windows as wn

SEG = "video_id string, kind string, start_sec double, end_sec double"
LABELS = [
    ("negative", 0, 18), ("negative", 0, 10), ("positive", 18, 22), ("negative", 22, 40), ("uncertain", 40, 42),
    ("negative", 42, 62), ("positive", 62, 64), ("negative", 64, 80),
]


@pytest.fixture
def eighty(spark):
    videos = spark.createDataFrame([("v", "d", 80.0, "train")], "video_id string, drama_id string, duration_sec double, split string")
    seg = spark.createDataFrame([("v", k, float(a), float(b)) for k, a, b in LABELS], SEG)
    talk = spark.createDataFrame([("v", 0.0, 2.0, "hello", "asr"), ("v", 30.0, 33.0, "x", "ocr")], "video_id string, start_sec double, end_sec double, text string, source string")
    return videos, seg, talk


def test_window_counts(eighty):
    videos, seg, _ = eighty
    full = rows(wn.window_counts(wn.classify_tiles(videos, seg, wn.WindowOptions(20, 15, 90))))
    assert full == [("train", 4, 1, 0, 3, 2, 1)]
    none = rows(wn.window_counts(wn.classify_tiles(videos, seg, wn.WindowOptions(20, 0, 90))))
    assert none[0][1:5] == (4, 1, 1, 2)


def test_window_content(eighty):
    out = {r.sample_id: r for r in wn.build_windows(*eighty, wn.WindowOptions(20, 15, 90)).collect()}
    assert sorted(out) == ["v:0-20", "v:20-40", "v:60-80"]
    second = out["v:20-40"]
    assert (second.read_start, second.detect_range.start_sec, second.detect_range.end_sec) == (5.0, 15.0, 35.0)
    assert [(s.start_sec, s.end_sec) for s in second.segments] == [(13.0, 17.0)]
    assert second.dialogue[0].start_sec == -5.0
    assert [(s.start_sec, s.end_sec) for s in out["v:60-80"].segments] == [(17.0, 19.0)]
    assert out["v:0-20"].outcome == "empty"


def test_history_and_focus(spark, eighty):
    videos, seg, _ = eighty
    past = spark.createDataFrame([("v", 30.0, 34.0), ("v", 31.0, 35.0), ("v", 19.0, 21.0), ("v", 39.0, 41.0)], "video_id string, start_sec double, end_sec double")
    regions = wn.history_regions(seg, past)
    assert rows(regions) == [("v", 30.0, 35.0)]
    assert rows(wn.focus_windows(wn.build_windows(*eighty), regions), "sample_id") == [("v:20-40",)]


def test_windows_match_cells(spark):
    """Counts of the fixture over whole seconds, tile by tile."""
    import random

    rng = random.Random(3)
    labels = [(f"v{rng.randrange(4)}", rng.choice(["positive", "negative", "uncertain"]), float(s), float(s + rng.randint(3, 15))) for s in [rng.randrange(48) for _ in range(60)]]
    videos = spark.createDataFrame([(f"v{i}", "d", 63.0, "train") for i in range(4)], "video_id string, drama_id string, duration_sec double, split string")
    seg = spark.createDataFrame(labels, SEG)
    for w, c in ((10, 10), (7, 0), (5, 2)):
        want = {"unknown": 0, "incomplete_core": 0, "positive": 0, "empty": 0}
        for v in {f"v{i}" for i in range(4)}:
            own = [x for x in labels if x[0] == v]
            known = {t for _, k, s, e in own if k != "uncertain" for t in range(int(s), int(e))}
            for i in range(-(-63 // w)):
                a, b = i * w, min(63, (i + 1) * w)
                pos = [(s, e) for _, k, s, e in own if k == "positive" and a <= (s + e) / 2 < b]
                if not set(range(a, b)) <= known:
                    want["unknown"] += 1
                elif any(s < max(0, a - c) or e > min(63, b + c) for s, e in pos):
                    want["incomplete_core"] += 1
                else:
                    want["positive" if pos else "empty"] += 1
        r = wn.window_counts(wn.classify_tiles(videos, seg, wn.WindowOptions(w, c, 0))).collect()[0]
        assert {k: r[k] for k in want} == want


def test_quotas_and_focus(spark):
    counts = {"empty": 12, "single": 8, "multiple": 4}
    items = [(f"{k}{i:02d}", f"d{i % 3}", k) for k, n in counts.items() for i in range(n)]
    df = spark.createDataFrame(items, "sample_id string, drama_id string, category string")
    assert rows(sm.quotas(df, 8), "category", "quota") == [("empty", 4), ("multiple", 1), ("single", 3)]
    focus = spark.createDataFrame([("empty00",), ("single03",)], "sample_id string")
    chosen = sm.focus_stratified(df, focus, 8, 42)
    got = rows(chosen, "sample_id", "category", "drama_id")
    assert {"empty00", "single03"} <= {g[0] for g in got} and len(got) == 8
    assert rows(chosen, "sample_id") == rows(sm.focus_stratified(df, focus, 8, 42), "sample_id")
    # the three regular empty rows come from three different groups
    assert len({g[2] for g in got if g[1] == "empty" and g[0] != "empty00"}) == 3
    with pytest.raises(ValueError, match="focus_exceeds_quota"):
        sm.focus_stratified(df, focus, 1, 42)
    with pytest.raises(ValueError, match="foreign_focus"):
        sm.focus_stratified(df, spark.createDataFrame([("other",)], "sample_id string"), 8, 42)
    with pytest.raises(ValueError, match="invalid_size"):
        sm.focus_stratified(df, focus, 25, 42)


def test_snapshot_report(spark):
    videos = spark.createDataFrame(
        [(f"v{i}", f"d{i}", 40.0, "ready", "model_reviewed", "train") for i in range(3)],
        "video_id string, drama_id string, duration_sec double, status string, source string, split string",
    )
    seg = spark.createDataFrame([(f"v{i}", k, s, e) for i in range(3) for k, s, e in (("positive", 10.0, 20.0), ("negative", 0.0, 5.0))], SEG)
    r = me.snapshot_report(videos, seg).collect()[0]
    assert (r.total_sec, r.supervised_sec, r.highlight_sec, r.unknown_sec, r.longest_highlight_sec, r.highlight_ratio) == (120.0, 45.0, 30.0, 75.0, 10.0, 0.25)


def test_feedback_priority(spark):
    videos = spark.createDataFrame([("v", "ready", True), ("u", "unresolved", False)], "video_id string, status string, labelled boolean")
    span = "video_id string, start_sec double, end_sec double"
    targets = spark.createDataFrame([("v", 10.0, 20.0)], span)
    p = spark.createDataFrame([("v", 30.0, 35.0), ("u", 1.0, 2.0), ("u", 1.0, 2.0)], span)
    assert rows(store.feedback_priority(videos, targets, p, 0.5)) == [("u", 2, "unresolved", "queued"), ("v", 2, "ready", "review")]
    hit = spark.createDataFrame([("v", 10.0, 19.0)], span)
    assert rows(store.feedback_priority(videos, targets, hit, 0.5)) == [("v", 0, "ready", "ready")]


def test_edge_demote(spark):
    df = spark.createDataFrame([(5.0, 8.0), (29.0, 34.0), (32.0, 35.0), (34.0, 36.0)], "s double, e double").withColumns({"k": F.lit("positive"), "r": F.lit("x")})
    kind, _, violation = edge_demote("k", "r", "s", "e", F.lit(0.0), F.lit(35.0), F.lit(100.0))
    got = [tuple(r) for r in df.orderBy("s").select(kind.alias("k2"), violation.alias("v")).collect()]
    assert got == [("positive", False), ("positive", False), ("uncertain", False), ("positive", True)]


def test_compact_tail(spark):
    pages = spark.createDataFrame([("v", 0.0, 30.0, 35.0), ("v", 30.0, 60.0, 60.5), ("v", 60.0, 60.5, 60.5)], "k string, core_start_sec double, core_end_sec double, read_end_sec double")
    videos = spark.createDataFrame([("v", 60.5)], "k string, duration_sec double")
    assert rows(tl.compact_tail(pages, videos, ["k"]), "core_start_sec", "core_end_sec") == [(0.0, 30.0), (30.0, 60.5)]


def test_reference_coverage(spark):
    v = spark.range(1).select(reference_coverage(F.lit(20.5), F.lit(36.0), F.lit(27.0), F.lit(31.5)).alias("c")).collect()[0].c
    assert v == 1.0


def test_generated_windows_are_not_sent_out_whole(spark):
    """The planner takes generated rows to be as few as those they are made from, so it would send these out."""
    grid = tl.tiles(spark.range(5).select(F.col("id").alias("video_id"), F.lit(40.0).alias("duration_sec")), 10.0, 10.0)
    lines = spark.range(3).selectExpr("id AS video_id", "12D AS start_sec", "14D AS end_sec", "'asr' AS source", "'x' AS text")
    out = wn.window_dialogue(grid, lines, wn.WindowOptions(10.0, 10.0, 20.0))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.video_id, r.tile_no) for r in out.filter(F.size("dialogue") > 0).collect()) == [(v, t) for v in range(3) for t in range(4)]


def test_frames_are_made_from_packets_that_were_read_once(spark):
    """Neither frames nor ends join, sort and group the packets again."""
    packets = spark.createDataFrame(
        [("a", 0, 1.0, 0.5, "K_"), ("a", 1, 3.0, 0.5, "K_"), ("a", 2, 3.0, None, "K_"), ("a", 3, 4.0, 0.5, "_D"), ("a", 4, 0.0, 0.5, "K_"), ("b", 5, 700.0, 2.0, None), ("b", 6, 5.0, 0.0, "K_"), ("c", 7, None, 1.0, "K_")],
        "job string, packet_no long, pts double, hold_sec double, flags string",
    )
    streams = spark.createDataFrame([("a", 1.0, 9.0, 25.0), ("b", None, None, 25.0), ("c", 0.0, 1.0, 25.0)], "job string, declared_start double, declared_duration double, fps double")
    frames, ends = tl.frame_timeline(packets, streams, ["job"])
    assert rows(frames) == [("a", 0, 0.0), ("a", 1, 2.0), ("b", 0, 0.0), ("b", 1, 695.0)]
    assert rows(ends) == [("a", 1.0, 9.0), ("b", 5.0, 697.0)]
    for made in (frames, ends):
        assert "packet_no" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_an_evaluation_set_is_checked_by_sums(spark):
    """Each table is one row per video before it is joined, so no task holds the joined events."""
    manifest = spark.createDataFrame(
        [("a", 10.0), ("b", 10.0), ("b", 5.0), ("c", None), ("d", float("nan")), ("e", 0.0), ("f", 9.0), (None, 9.0)], "video_id string, duration_sec double"
    )
    annotations = spark.createDataFrame(
        [(v, "ok") for v in "abcde"] + [("a", "draft"), ("f", "draft"), ("x", "ok"), ("x", None), (None, "ok"), ("y", None)], "video_id string, annotation_status string"
    )
    events = spark.createDataFrame(
        [("a", 1, 2.0, 10.1), ("a", None, 0.0, 1.0), ("a", None, 0.0, 1.0), ("b", 1, 0.0, 6.0), ("b", 1, 0.0, 4.0), ("c", 1, 0.0, 1.0), ("d", 1, 0.0, 99.0), ("e", 1, 0.0, None), ("f", 1, 5.0, 4.0), ("f", 1, 5.0, 4.0), ("x", 1, 5.0, 4.0)],
        "video_id string, event_id int, start_sec double, end_sec double",
    )
    out = store.eval_dataset_violations(manifest, annotations, events, ["ok"])
    assert rows(out) == sorted([
        ("a", "duplicate_annotation"), ("x", "duplicate_annotation"), ("b", "duplicate_video"), ("x", "missing_from_manifest"), (None, "missing_from_manifest"),
        ("c", "invalid_duration"), ("d", "invalid_duration"), ("e", "invalid_duration"), ("b", "invalid_interval"), ("c", "invalid_interval"), ("e", "invalid_interval"),
        ("b", "duplicate_event_id"),
    ], key=repr)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3


def test_regions_are_made_once_for_the_windows(spark, eighty):
    """Neither the regions nor windows of videos without any are made again for the count and the join."""
    _, seg, _ = eighty
    past = spark.createDataFrame([("v", 30.0, 34.0), ("v", 31.0, 35.0), ("v", 31.0, 35.0), (None, 31.0, 35.0), ("v", None, 35.0)], "video_id string, start_sec double, end_sec double")
    videos = spark.createDataFrame([("v", 80.0), ("w", 80.0), (None, 80.0)], "video_id string, duration_sec double")
    out = wn.focus_windows(tl.tiles(videos, 10.0), wn.history_regions(seg, past))
    assert rows(out, "video_id", "tile_no") == [("v", 3)]
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_decisions_meet_their_plans_once(spark):
    """Plans and decisions are not joined again for each check."""
    plans = spark.createDataFrame(
        [(1, "a", 0.0, 9.0, "ready"), (1, "b", 8.0, 20.0, "ready"), (1, "b", 8.0, 20.0, "ready"), (2, "a", 0.0, 5.0, "infeasible_duration"), (2, "b", 0.0, 5.0, "infeasible_duration"), (None, "a", 0.0, 1.0, "ready"), (3, "a", 0.0, 1.0, None)],
        "job_id int, event_id string, start_sec double, end_sec double, status string",
    )
    decisions = spark.createDataFrame(
        [(1, "a", True, None), (1, "b", True, "a"), (2, "a", True, "b"), (2, "b", False, None), (2, "c", True, None), (3, "a", None, None), (3, "a", True, "a")],
        "job_id int, event_id string, selected boolean, duplicate_of string",
    )
    budgets = spark.createDataFrame([(1, 2, 30.0, False), (2, 2, 4.0, True), (3, None, None, None)], "job_id int, max_count int, max_seconds double, allow_overlap boolean")
    out = sel.decision_violations(plans, decisions, budgets)
    assert rows(out) == sorted([
        (1, "count_budget"), (1, "seconds_budget"), (1, "overlap"), (2, "infeasible_selected"), (2, "duplicate_of_unselected"), (2, "seconds_budget"),
        (2, "decisions_do_not_cover"), (3, "decisions_do_not_cover"), (None, "decisions_do_not_cover"),
    ], key=repr)
    assert "FullOuter" not in out._jdf.queryExecution().optimizedPlan().toString()
