"""Run logs, search, edits and their streaming forms."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanweave.operators import editing as ed
from spanweave.operators import metrics as me
from spanweave.operators import search as se
from spanweave.operators import telemetry as tm
from spanweave.streaming import sinks
from spanweave.streaming import metrics as sm
from spanweave.streaming import progress as sp

LOG = "run long, pos long, step long, training boolean, key string, value double"
STEPS = [(0, 1, 30.0, 0.0, 0.9), (1, 2, 37.0, 0.2, 0.8), (2, 1, 400.0, 0.0, 0.7), (3, 2, 408.0, 0.2, 0.6)]


def metric_log(spark):
    out = []
    for pos, step, elapsed, epoch, loss in STEPS:
        out += [(1, pos, step, True, k, v) for k, v in (("elapsed_sec", elapsed), ("epoch", epoch), ("loss", loss))]
    out.append((1, 4, 2, False, "eval_loss", 0.25))
    return spark.createDataFrame(out, LOG)


def test_metric_merge_and_speed(spark):
    log = metric_log(spark)
    merged = {(r.step, r.key): r.value for r in tm.merge_metrics(log.unionByName(tm.training_speed(log, 100.0))).collect()}
    assert merged[(1, "loss")] == 0.7 and merged[(2, "loss")] == 0.6 and merged[(2, "eval_loss")] == 0.25
    assert merged[(2, "speed/seconds_per_update")] == 8.0
    assert merged[(2, "speed/windows_per_second")] == pytest.approx(0.2 * 100 / 8)
    assert (1, "speed/seconds_per_update") not in merged


def stream_of(spark, df, path, parts):
    """The rows as files of several micro-batches, in order of ``parts``."""
    for i, part in enumerate(parts):
        df.filter(part).coalesce(1).write.parquet(f"{path}/in/b={i}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")


def test_metric_stream_equals_batch(spark, tmp_path):
    log = metric_log(spark)
    source = stream_of(spark, log, str(tmp_path), ["pos < 2", "pos = 2", "pos > 2"])
    sinks.drain(sm.merge_metrics_stream(source), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = sinks.newest_groups(spark, f"{tmp_path}/out", sm.MERGED, ["run", "step"])
    assert rows(got, "step", "key", "value") == rows(tm.merge_metrics(log), "step", "key", "value")


def test_metric_stream_drops_keys_of_replaced_steps(spark, tmp_path):
    first = [(5, 0, 3, True, "norm", 4.0), (5, 0, 3, True, "cost", 2.5), (5, 0, 4, True, "cost", 2.0)]
    again = [(5, 7, 3, True, "cost", 1.5), (5, 8, 3, False, "probe", 0.5)]
    log = spark.createDataFrame(first + again, LOG)
    source = stream_of(spark, log, str(tmp_path), ["pos < 5", "pos >= 5"])
    sinks.drain(sm.merge_metrics_stream(source), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = sinks.newest_groups(spark, f"{tmp_path}/out", sm.MERGED, ["run", "step"])
    assert rows(got, "step", "key", "value") == rows(tm.merge_metrics(log), "step", "key", "value") == [(3, "cost", 1.5), (3, "probe", 0.5), (4, "cost", 2.0)]


def test_a_second_run_over_the_same_files_sends_nothing(spark, tmp_path):
    log = metric_log(spark)
    later = log.filter("pos = 4").withColumns({"pos": F.col("pos") + 10, "value": F.col("value") + 1})
    out = sinks.run_in_parts([log.filter("pos < 3"), log.filter("pos >= 3"), log, later], sm.merge_metrics_stream, str(tmp_path))
    batches = sinks.read_batches(spark, out, sm.MERGED)
    # the third part holds the rows of the first two again; the fourth changes one step
    assert sorted(r["batch"] for r in batches.select("batch").distinct().collect()) == [0, 1, 3]
    assert {r["step"] for r in batches.filter("batch = 3").collect()} == {2}
    now = sinks.newest_groups(spark, out, sm.MERGED, ["run", "step"])
    assert rows(now, "step", "key", "value") == rows(tm.merge_metrics(log.unionByName(later)), "step", "key", "value")


def test_a_replayed_batch_is_written_once(spark, tmp_path):
    """The sink got a batch, but the query did not note it: the same batch comes again after the restart."""
    out = sinks.run_in_parts([metric_log(spark)], sm.merge_metrics_stream, str(tmp_path))
    before = rows(sinks.read_batches(spark, out, sm.MERGED))
    (tmp_path / "checkpoint" / "commits" / "0").unlink()
    (tmp_path / "checkpoint" / "commits" / ".0.crc").unlink(missing_ok=True)
    source = spark.readStream.schema(metric_log(spark).schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    sinks.drain(sm.merge_metrics_stream(source), out, f"{tmp_path}/checkpoint")
    assert rows(sinks.read_batches(spark, out, sm.MERGED)) == before


def test_later_files_win_whenever_they_come(spark, tmp_path):
    schema = "run long, file string, pos long, step long, key string, value double"
    log = spark.createDataFrame([(1, "b", 0, 1, "reward", 0.7), (1, "a", 9, 1, "reward", 0.5), (1, "a", 1, 1, "validation/x", float("nan")), (1, "c", 0, 1, "secret", 1.0)], schema)
    out = sinks.run_in_parts([log.filter("file >= 'b'"), log.filter("file = 'a'")], lambda x: sm.allowed_metrics_stream(x, ["reward"]), str(tmp_path))
    got = sinks.newest_groups(spark, out, sm.MERGED, ["run", "step"])
    assert rows(got, "key", "value") == rows(tm.allowed_metrics(log, ["reward"]), "key", "value") == [("reward", 0.7)]


def test_allowlist(spark):
    log = spark.createDataFrame(
        [(1, "a", 0, 1, "reward", 0.5), (1, "a", 1, 1, "validation/x", float("nan")), (1, "b", 0, 1, "reward", 0.7), (1, "b", 1, 1, "secret", 1.0), (1, "b", 2, 1, "validation/y", 2.0)],
        "run long, file string, pos long, step long, key string, value double",
    )
    assert rows(tm.allowed_metrics(log, ["reward"]), "key", "value") == [("reward", 0.7), ("validation/y", 2.0)]


FACTS = [(1, 1, "pending"), (1, 2, "supported"), (1, 3, "pending"), (1, 4, "supported"), (1, 4, "pending"), (2, 1, "a"), (2, 5, None)]


def test_stagnation_batch(spark):
    facts = spark.createDataFrame(FACTS, "run long, step long, fact string")
    batch = tm.stagnation(facts.select("run", "step").distinct(), facts.filter("fact IS NOT NULL"))
    assert rows(batch, "run", "step", "new_facts", "stagnant_steps") == STAGNANT


STAGNANT = [(1, 1, 1, 0), (1, 2, 1, 0), (1, 3, 0, 1), (1, 4, 0, 2), (2, 1, 1, 0), (2, 5, 0, 1)]


def test_timers_close_steps(spark, tmp_path):
    """Rows of a step come apart and out of order; a step is told when the watermark passes its end, and rows behind it count no more."""
    timed = spark.createDataFrame([(r, s * 10 + 1, f) for r, s, f in FACTS], "run long, sec long, fact string")
    rows_at = lambda df: df.select("run", F.timestamp_seconds("sec").alias("ts"), "fact")
    more = spark.createDataFrame([(1, 48, "supported"), (1, 15, "pending"), (1, 39, None)], timed.schema)
    late = spark.createDataFrame([(1, 12, "too late")], timed.schema)
    end = lambda sec: spark.createDataFrame([(0, sec, None)], timed.schema)
    parts = [timed.filter("sec >= 40"), timed.filter("sec < 40").unionByName(more), end(300), late, end(10_000)]
    out = sinks.run_in_parts([rows_at(p) for p in parts], lambda x: sm.stagnation_stream(x, 10.0, "60 seconds"), str(tmp_path))
    told = sinks.read_batches(spark, out, sm.STAGNANT).filter("run > 0")
    assert rows(told.drop("batch")) == STAGNANT
    assert min(r["batch"] for r in told.collect()) >= 2


def test_merging_spans_keeps_them_disjoint():
    import random

    draw = random.Random(4)
    for _ in range(200):
        starts, ends, seen = [], [], set()
        for _ in range(draw.randint(1, 25)):
            a = draw.randint(0, 60)
            b = a + draw.randint(0, 9)
            sp.merge_span(starts, ends, float(a), float(b), 0.0)
            seen |= {2 * x for x in range(a, b + 1)} | {2 * x + 1 for x in range(a, b)}  # points and the lengths between them
            want = sorted(x for x in seen if x - 1 not in seen)
            assert [2 * s for s in starts] == want and [2 * e for e in ends] == sorted(x for x in seen if x + 1 not in seen)


def test_scan_progress_stream(spark, tmp_path):
    schema = "video_id long, observation_id long, start_sec double, end_sec double, delivered boolean"
    made = [(1, 1, 0.0, 12.0), (1, 2, 12.0, 31.0), (1, 3, 25.0, 47.0), (2, 4, 5.0, 1300.0), (2, 5, 0.0, 5.0), (1, 6, float("nan"), 3.0)]
    told = lambda ids, delivered: spark.createDataFrame([(*m, delivered) for m in made if m[1] in ids], schema)
    pages = spark.createDataFrame([(v, f"p{i}", i * 10.0, i * 10.0 + 10) for v, n in ((1, 5), (2, 130)) for i in range(n)], "video_id long, page_id string, core_start_sec double, core_end_sec double")
    videos = spark.createDataFrame([(1, 50.0), (2, 1300.0)], "video_id long, duration_sec double")
    parts = [told({2, 4}, True).unionByName(told({1}, False)), told({1, 5}, True).unionByName(told({2, 3, 4, 5}, False))]
    out = sinks.run_in_parts(parts, sp.watched_stream, str(tmp_path))
    got = sp.progress_of(sinks.newest_groups(spark, out, sp.WATCHED, ["video_id", "slice"]), pages, videos)
    cols = ["video_id", "completed_page_count", "page_count", "next_page", "pending_observation_count", "pending_page_count"]
    assert rows(got, *cols) == [(1, 3, 5, "p3", 1, 2), (2, 130, 130, None, 0, 0)]
    # a slice holds its gaps, not its reads
    assert sinks.newest_groups(spark, out, sp.WATCHED, ["video_id", "slice"]).filter("video_id = 2").count() == 3


def test_trace_stream_counts_copies_and_late_rows_apart(spark, tmp_path):
    made = [("request_error", None, False, False, 600), ("model", 2.0, True, False, 700), ("tool", None, False, True, 9600), ("model", 1.0, False, False, 5000), ("model", 9.0, False, False, 100)]
    trace = spark.createDataFrame([(7, i, *m) for i, m in enumerate(made)], "job long, id long, kind string, elapsed_sec double, calls_empty boolean, error boolean, sec long")
    trace = trace.withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
    # the last row is behind the watermark when it comes, and so is the copy of the first; the other copy is not
    parts = [trace.filter("id < 3"), trace.filter("id >= 3").unionByName(trace.filter("id IN (0, 2)"))]
    out = sinks.run_in_parts(parts, lambda x: sm.trace_counts_stream(x, 5000.0, F.lit(0)), str(tmp_path))
    hours = sinks.newest_groups(spark, out, sm.TRACED, ["job", "part", "hour"])
    sums = [c for c in sm.TRACED.names if c not in ("job", "part", "hour")]
    got = hours.agg(*[F.sum(c).alias(c) for c in sums]).collect()[0].asDict()
    assert got == {"request_errors": 1, "invalid_tool_requests": 1, "missing_tool_calls": 1, "requests": 2, "request_sec": 3.0, "repeated": 1, "late": 2}
    assert rows(tm.trace_counts(trace.filter("id < 4"), ["job"])) == [(7, 1, 1, 1, 2, 3.0)]


def test_runtime(spark):
    attempts = spark.createDataFrame(
        [("a", 0, 12.0, "failed"), ("a", 1, 3.0, "complete"), ("b", 0, None, "failed"), ("b", 1, 3.0, "complete")],
        "job string, attempt_no int, elapsed_sec double, status string",
    )
    trace = spark.createDataFrame([("a", "model", float(i), False, False) for i in range(1, 11)], "job string, kind string, elapsed_sec double, calls_empty boolean, error boolean")
    items = me.item_runtime(attempts, trace, ["job"])
    got = {r.job: r for r in items.collect()}
    assert got["a"].elapsed_sec == 15.0 and got["b"].elapsed_sec is None
    assert (got["a"].request_median_sec, got["a"].request_p90_sec, got["a"].request_max_sec) == (5.5, 9.0, 10.0)
    run = me.run_runtime(items).collect()[0]
    assert (run.elapsed_total_sec, run.timed_videos, run.videos_with_multiple_attempts, run.elapsed_median_sec) == (None, 1, 2, 15.0)


def test_all_and_completed(spark):
    items = spark.createDataFrame([(True, 1, 2, 1), (False, 0, 0, 1)], "complete boolean, hits int, predictions int, targets int")
    got = {r.scope: r for r in me.rates(me.all_and_completed(items)).collect()}
    assert (got["all"].completion_rate, got["all"].precision, got["all"].recall, got["completed_only"].recall) == (0.5, 0.5, 0.5, 1.0)


def test_search_pages_and_coverage(spark):
    cues = spark.createDataFrame([("0", 0.0, 1.0, "Hello there"), ("1", 2.0, 3.0, "well, HELLO"), ("2", 9.0, 10.0, "bye")], "row_id string, start_sec double, end_sec double, text string")
    hits = se.exact_matches(cues, "hello", 0.0, 5.0)
    assert rows(se.page_info(hits, 0, 1)) == [(2, 1)]
    assert rows(se.page(hits, ["row_id"], 1, 1), "row_id") == [("1",)]
    reads = spark.createDataFrame([("j", "q", 0, "b", 2), ("j", "q", 1, "a", 2), ("j", "q", 2, "a", 2)], "job string, query string, pos int, row_id string, total int")
    assert rows(se.read_coverage(reads), "rows_read", "complete") == [(2, True)]
    assert rows(se.new_rows(reads), "pos", "new_rows") == [(0, 1), (1, 1)]


def test_vector_topk_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    m, q = rng.normal(size=(60, 8)), rng.normal(size=(5, 8))
    m[3] = 0
    mat = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "row_no long, embedding array<double>").repartition(4)
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<double>")
    monkeypatch.setattr(se, "MAX_BROADCAST_QUERIES", 2)
    got = rows(se.vector_topk(mat, qs, 3), "query_id", "rank", "row_no")
    norms = np.linalg.norm(m, axis=1)
    sims = np.where(norms > 0, (q @ m.T) / np.linalg.norm(q, axis=1)[:, None] / np.where(norms > 0, norms, 1), -9)
    want = [(i, r + 1, int(j)) for i in range(5) for r, j in enumerate(np.argsort(-sims[i])[:3])]
    assert got == sorted(want, key=repr)


HIGHLIGHT = "job_id long, highlight_id string, start_sec double, end_sec double, score double, highlight_type string, description string, reason string, clip_url string, review_status string"
HL = [(1, "a", 0.0, 10.0, 0.5, "t1", "A", "ra", "u", "pending"), (1, "b", 10.0, 20.0, 0.9, "t2", "B", "rb", "u", "pending"), (1, "c", 30.0, 40.0, 0.1, "t3", "C", "rc", "u", "pending"), (2, "z", 0.0, 5.0, 0.1, "t", "Z", "rz", "u", "pending")]
def test_children_of_one_family_get_ids_of_their_own(spark):
    stem = "x" * 70
    rows_ = [(1, stem + "a", 0.0, 30.0), (1, stem + "b", 30.0, 60.0), (1, "x" * 68 + "_split_2", 60.0, 70.0), (1, "q", 70.0, 80.0)]
    h = spark.createDataFrame([(*r, 0.5, "t", "d", "r", "", "pending", 100.0) for r in rows_], HIGHLIGHT + ", duration_sec double")
    cuts = spark.createDataFrame([(1, stem + "a", 10.0), (1, stem + "b", 40.0), (1, "q", 75.0)], "job_id long, highlight_id string, split_sec double")
    after, rejected = ed.split_highlights(h, cuts)
    ids = sorted(r.highlight_id for r in after.collect())
    assert rejected.count() == 0 and len(ids) == len(set(ids)) == 7
    assert {"x" * 68 + "_split", "x" * 68 + "_split_3", "q_split"} < set(ids)


def test_bulk_edits_are_all_or_nothing(spark):
    h = spark.createDataFrame(HL, HIGHLIGHT).withColumn("duration_sec", F.lit(40.0))
    c = spark.createDataFrame(
        [(1, 1, "move_end", "a", 5.0, None, None), (1, 1, "move_end", "b", -9.8, None, None), (1, 2, "move_end", "c", 99.0, None, None), (2, 3, "set_range", "q", None, 1.0, 2.0)],
        "job_id long, command_no int, operation string, highlight_id string, delta_sec double, start_sec double, end_sec double",
    )
    edited, rejected = ed.edit_ranges(h, c)
    assert rows(edited, "highlight_id", "end_sec") == [("c", 40.0)]
    assert rows(rejected, "command_no", "error") == [(1, "too_short"), (3, "unknown_highlight")]


def test_children_of_a_large_family_take_free_numbers(spark):
    """Hundreds of parents share a base; the used numbers have holes, and some lie far away."""
    base = "h" * 68
    used = [base + "_split", *(f"{base}_split_{n}" for n in (2, 3, 7, 8, 40, 41, 5000, 99_999_999))]
    parents = [(1, base + f"x{i:04d}") for i in range(300)] + [(2, "a"), (2, "b")]
    rows_ = parents + [(1, u) for u in used] + [(2, "a_split"), (2, "a_split_03")]
    highlights = spark.createDataFrame([(j, h, 0.0, 10.0, "text", "none", 64.0) for j, h in rows_], "job_id long, highlight_id string, start_sec double, end_sec double, description string, review_status string, duration_sec double")
    commands = spark.createDataFrame([(j, h, 5.0) for j, h in parents], "job_id long, highlight_id string, split_sec double")
    out, rejected = ed.split_highlights(highlights.repartition(5), commands)
    new = {(r.job_id, r.highlight_id) for r in out.collect()} - set(rows_)
    taken = {1, 2, 3, 7, 8, 40, 41, 5000, 99_999_999}
    free = [n for n in range(1, 400) if n not in taken][:300]
    assert new == {(1, f"{base}_split_{n}") for n in free} | {(2, "a_split_2"), (2, "b_split")}
    assert rejected.collect() == []


def test_numbers_of_a_family_are_read_once(spark):
    """The ids are not taken apart again for each count over them."""
    h = spark.createDataFrame(HL, HIGHLIGHT).withColumn("duration_sec", F.lit(40.0))
    cuts = spark.createDataFrame([(1, "a", 5.0), (1, "b", 15.0)], "job_id long, highlight_id string, split_sec double")
    after, _ = ed.split_highlights(h, cuts)
    assert rows(after, "highlight_id") == [("a",), ("a_split",), ("b",), ("b_split",), ("c",), ("z",)]
    assert "regexp_extract" not in after._jdf.queryExecution().optimizedPlan().toString()


class Kept:
    """A map state in memory that counts its calls."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def getValue(self, key):
        self.calls += 1
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.rows[key] = value

    def removeKey(self, key):
        self.calls += 1
        self.rows.pop(key, None)


def test_remembered_texts_take_few_calls():
    """Few texts are one value; many are slices, of which a batch reads and writes those of its texts."""
    state, want, slices, count = Kept(), {}, 1, 0
    for turn in range(60):
        held = sm._Remembered(state, slices, count)
        texts = {f"t{i}": float(turn) for i in range(turn * 90, turn * 90 + 100)}
        known = held.read(texts)
        assert known.keys() <= want.keys() and all(want[t] == n for t, n in known.items())
        fresh = {t: n for t, n in texts.items() if t not in known}
        gone = [t for t in sorted(known)[:5] if t not in fresh]
        before = state.calls
        held.write(known, fresh, gone)
        assert turn or state.calls - before == 1
        want = {t: n for t, n in (want | fresh).items() if t not in gone}
        slices, count = held.slices, held.count
        assert count == len(want) <= sm._Remembered.SIZE * slices
    assert slices >= 16 and sm._Remembered(state, slices, count).read() == want


def test_a_step_of_a_metric_stream_is_one_value():
    """Two calls of the state store for a step, however many keys it has."""
    import pandas as pd

    class Value:
        value, calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

    class Handle:
        def getValueState(self, *_):
            return Value()

    merge = sm.MetricMerge()
    merge.init(Handle())
    batch = pd.DataFrame({"file": "", "pos": range(300), "training": False, "key": [f"k{i}" for i in range(300)], "value": 1.0})
    assert [len(x) for x in merge.handleInputRows((1, 2), iter([batch]), None)] == [300] and merge.step.calls == 2
    assert list(merge.handleInputRows((1, 2), iter([batch]), None)) == [] and merge.step.calls == 3


def test_many_steps_of_a_metric_stream_share_a_value():
    """Two calls of the state store for a slot, however many steps it has; only steps that change are told, whole."""
    import pandas as pd

    state = Kept()
    state.get, state.update = lambda: state.getValue(0), lambda value: state.updateValue(0, value)
    merge = sm.MetricMerge()
    merge.init(type("Handle", (), {"getValueState": lambda *_: state}))
    made = [(run, step, "", 10 * step + i, i == 1, name, float(run)) for run in range(20) for step in range(30) for i, name in enumerate((None, "b", "c"))]
    frames = lambda rows_: iter([pd.DataFrame(rows_[i : i + 500], columns=["run", "step", "file", "pos", "training", "key", "value"]) for i in range(0, len(rows_), 500)])
    tell = lambda rows_: sorted(tuple(r) for out in merge.handleInputRows((7,), frames(rows_), None) for r in out.itertuples(index=False))
    # the training row at place 1 of each step replaces that of place 0
    assert tell(made) == [(run, step, name, float(run)) for run in range(20) for step in range(30) for name in "bc"]
    assert state.calls == 2
    assert tell(made) == [] and state.calls == 3
    more = [(3, 4, "", 99, False, "a", 0.5), (5, 6, "", 60, False, "b", 9.0), (5, 7, "", 72, False, "c", 5.0)]
    assert tell(more) == [(3, 4, "a", 0.5), (3, 4, "b", 3.0), (3, 4, "c", 3.0)] and state.calls == 5


def test_metric_stream_takes_rows_without_run_step_or_key(spark, tmp_path):
    big = 1 << 60
    log = spark.createDataFrame(
        [(big + 1, 0, 1, True, "a", 1.0), (big + 1, 1, 1, True, None, 2.0), (big, 2, None, True, "a", 3.0), (big, 3, None, True, "b", 4.0), (None, 4, 1, True, "a", 5.0),
         (None, 5, None, None, None, 6.0), (big, 6, 1, None, "a", None), (big, 7, 1, None, None, 7.0), (0, 8, 0, True, "a", 8.0), (None, 9, 1, True, "b", 9.0)], LOG,
    )
    out = sinks.run_in_parts([log.filter("pos % 2 = 1"), log.filter("pos % 2 = 0")], sm.merge_metrics_stream, str(tmp_path))
    got = sinks.newest_groups(spark, out, sm.MERGED, ["run", "step"])
    cols = ["run", "step", "key", "value"]
    assert rows(got, *cols) == rows(tm.merge_metrics(log), *cols)
    assert rows(got.filter(f"run = {big + 1}"), *cols) == [(big + 1, 1, None, 2.0)] and got.filter("run IS NULL").count() == 3
