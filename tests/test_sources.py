"""Files: manifests, journals, subtitles, run folders, snapshots."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanweave.functions.scalars import folded_contains
from spanweave.sources import artifacts, journal, manifest, snapshot, subtitles, tables
from spanweave.sources.progress import clean_progress


def test_manifest(spark, tmp_path):
    lines = [
        {"video_id": "a", "drama_id": "d", "duration_sec": 3.5, "extra": 1}, {"video_id": " ", "drama_id": "d", "duration_sec": 3.5},
        {"video_id": "b", "drama_id": "d", "duration_sec": 0}, {"video_id": "c", "drama_id": "d"},
    ]
    (tmp_path / "m.jsonl").write_text("\n".join(json.dumps(x) for x in lines) + "\nnot json\n")
    good, bad = manifest.split_manifest(manifest.read_manifest(spark, str(tmp_path / "m.jsonl")))
    assert rows(good, "video_id") == [("a",)]
    assert sorted(r.reject_reason for r in bad.collect()) == ["blank_id", "invalid_duration", "invalid_duration", "unreadable"]


def test_journal(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n{"id": 2')
    (tmp_path / "b.jsonl").write_text('{"id": 3}\nbroken\n{"id": 4}\n')
    (tmp_path / "c.jsonl").write_text('{"id": 5')
    for reader in (journal.read_journal, journal.read_large_journal):
        good, bad = reader(spark, str(tmp_path))
        ids = sorted(r.i for r in good.select(F.try_variant_get("record", "$.id", "int").alias("i")).collect())
        assert ids == [1, 3, 4]
        assert bad.count() == 1


def test_large_journals_end_at_their_last_newline(spark, tmp_path):
    """An unterminated last line is ignored even if it is whole JSON; a terminated one counts, across splits and with a byte order mark."""
    long = "".join(json.dumps({"id": i, "pad": "é" * (i % 50)}) + "\n" for i in range(4000))
    files = {"whole": long, "open": long + '{"id": -1}', "mark": "\ufeff" + '{"id": 1}\n{"id": 2}', "marked": "\ufeff" + '{"id": 3}\n', "none": "", "blank": "\n\n", "cr": '{"id": 4}\r\n{"id": 5}\r\n', "lone": '{"id": 6}'}
    for name, text in files.items():
        (tmp_path / f"{name}.jsonl").write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        good, bad = journal.read_large_journal(spark, str(tmp_path))
        got = {}
        for r in good.select("file", F.try_variant_get("record", "$.id", "int").alias("i")).collect():
            got.setdefault(r.file.rsplit("/", 1)[1].split(".")[0], []).append(r.i)
        assert bad.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {k: sorted(v) for k, v in got.items()} == {"whole": list(range(4000)), "open": list(range(4000)), "mark": [1], "marked": [3], "cr": [4, 5]}


def test_subtitles(spark, tmp_path):
    srt = "1\r\n00:00:01,500 --> 00:00:02,250\r\n<i>Hello</i>\r\nagain\r\n\r\n2\r\n00:00:09,000 --> 00:00:08,000\r\nbackwards\r\n"
    vtt = "WEBVTT\n\nNOTE 00:01.000 --> 00:02.000 remark\n\nid\n01:02:03.004 --> 01:02:04.5 align:start\ncue\n"
    (tmp_path / "a.srt").write_text(srt)
    (tmp_path / "b.vtt").write_text(vtt)
    got = rows(subtitles.read_subtitles(spark, str(tmp_path)), "start_sec", "end_sec", "text")
    assert got == [(1.5, 2.25, "Hello\nagain"), (3723.004, 3724.5, "cue")]


def test_pairing(spark):
    v = spark.createDataFrame([(1, "A.mp4"), (2, "a.mp4"), (2, "b.mov"), (3, "c.mp4"), (3, "d.mp4")], "batch int, name string")
    s = spark.createDataFrame([(1, "other.srt"), (2, "A.srt"), (2, "a.vtt"), (3, "C.srt"), (3, "x.srt")], "batch int, name string")
    pairs, problems = subtitles.pair_files(v, s)
    assert rows(pairs) == sorted([(1, "A.mp4", "other.srt"), (2, "b.mov", None), (3, "c.mp4", "C.srt"), (3, "d.mp4", None)], key=repr)
    assert rows(problems) == [(2, "a.mp4", "ambiguous"), (3, "x.srt", "unmatched")]


def test_run_folder(spark, tmp_path):
    job = tmp_path / "jobs" / "j1"
    job.mkdir(parents=True)
    (job / "result.json").write_text(json.dumps({"schema_version": "1.0", "job_id": "j1", "video": {"video_id": "v"}, "highlights": []}, indent=1))
    (job / "execution.json").write_text(json.dumps({"attempts": [{"status": "failed", "elapsed_sec": 1.0}, {"status": "complete"}]}))
    (job / "trace.jsonl").write_text('{"kind": "model", "calls": []}\n{"kind": "tool", "error": true}\n')
    run = artifacts.read_run(spark, str(tmp_path))
    items = spark.createDataFrame([("j1",), ("j2",)], "job string")
    got = rows(artifacts.items_with_artifacts(items, run))
    assert got == [("j1", "complete", 2, 0, 2), ("j2", None, 0, 0, 0)]
    assert run["results"].select("analysis.stop_reason").first()[0] == artifacts.LEGACY_STOP_REASON
    assert rows(run["trace"], "kind", "calls_empty") == [("model", True), ("tool", False)]


def test_snapshot(spark, tmp_path):
    target = str(tmp_path / "v1")
    df = spark.range(100).withColumn("split", F.when(F.col("id") % 5 == 0, "val").otherwise("train"))
    assert rows(snapshot.publish({"t": df}, target, {"t": ["split"]}), "table", "rows") == [("t", 100)]
    assert snapshot.read_published(spark, target, "t").count() == 100
    with pytest.raises(FileExistsError):
        snapshot.publish({"t": df}, target)
    spark.range(1).withColumn("id", F.lit(7).cast("long")).write.mode("append").parquet(f"{target}/t/split=train")
    with pytest.raises(ValueError, match="does not match"):
        snapshot.read_published(spark, target, "t")


def test_progress(spark):
    doc = {"model_calls": True, "turn": 3.0, "page_count": 2.5, "event_count": -1, "duration_sec": 0, "scan_coverage": 1.5,
           "ready_event_ids": ["a", "a", 3], "next_page": {"core_start_sec": 1, "core_end_sec": 2}}
    r = clean_progress(spark.createDataFrame([(json.dumps(doc),), ("broken",)], "p string"), "p").collect()
    assert (r[0].model_calls, r[0].turn, r[0].page_count, r[0].event_count, r[0].duration_sec, r[0].scan_coverage) == (None, 3, None, None, None, None)
    assert (r[0].ready_clip_count, r[0].next_start_sec, r[0].next_end_sec) == (1, 1.0, 2.0)
    assert r[1].turn is None and r[1].ready_clip_count is None


def test_upsert_writes_only_touched_partitions(spark, tmp_path):
    schema, table = "video_id long, model_id string, payload double", str(tmp_path / "predictions")
    start = spark.createDataFrame([(v, m, float(v)) for v in range(200) for m in "ab"], schema)
    tables.write_predictions(start, table, parts=16)

    def files():
        return {p: p.stat().st_mtime_ns for p in (tmp_path / "predictions").glob("part=*/*.parquet")}

    before = files()
    change = spark.createDataFrame([(3, "a", 99.0), (5, "b", 5.0), (1000, "a", 1.0), (7, "a", None)], schema)
    got = tables.merge_predictions(change, table, parts=16)
    assert sorted(map(tuple, got.collect())) == [(3, "a", "updated"), (5, "b", "unchanged"), (7, "a", "updated"), (1000, "a", "inserted")]
    after = files()
    assert 0 < len({p.parent for p in before if p in after}) and len({p.parent for p in after if p not in before}) <= 3
    now = {(r["video_id"], r["model_id"]): r["payload"] for r in spark.read.parquet(table).collect()}
    want = {(v, m): float(v) for v in range(200) for m in "ab"} | {(3, "a"): 99.0, (1000, "a"): 1.0, (7, "a"): None}
    assert now == want
    again = tables.merge_predictions(change, table, parts=16)
    assert {r["outcome"] for r in again.collect()} == {"unchanged"} and files() == after


def test_a_log_batch_that_comes_twice_adds_nothing(spark, tmp_path):
    log = spark.createDataFrame([(1, "accepted"), (2, "rejected")], "no long, status string")
    for batch, rows_ in (("b1", log), ("b2", log.filter("no = 2")), ("b1", log)):
        tables.append_batch(rows_, str(tmp_path / "log"), batch)
    got = sorted(map(tuple, tables.read_log(spark, str(tmp_path / "log"), log.schema).collect()))
    assert got == [(1, "accepted", "b1"), (2, "rejected", "b1"), (2, "rejected", "b2")]


def test_registration_is_all_or_nothing(spark, tmp_path):
    table, schema = str(tmp_path / "videos"), "pos long, video_id long, drama_id string, sha256 string"
    spark.createDataFrame([(1, "d1", "h1", "train")], tables.VIDEOS).write.parquet(f"{table}/first")
    rows_ = [(0, 2, "d1", "h2"), (1, 2, "d1", "h2"), (2, 1, "d1", "h1"), (3, 3, "d2", "h1")]

    def attempt(some):
        out = tables.register_videos(spark.createDataFrame(some, schema), table)
        return {r["pos"]: r["outcome"] for r in out.collect()}, {r["video_id"] for r in tables.read_videos(spark, table).collect()}

    # one hash in two groups: the whole delivery is refused
    assert attempt(rows_) == ({0: "added", 1: "duplicate", 2: "conflict", 3: "conflict"}, {1})
    assert attempt([(0, 2, "d1", "other"), (1, 2, "d1", "h2")])[1] == {1}
    assert attempt(rows_[:3]) == ({0: "added", 1: "duplicate", 2: "duplicate"}, {1, 2})
    assert attempt(rows_[:3]) == ({0: "duplicate", 1: "duplicate", 2: "duplicate"}, {1, 2})
    assert {r["split"] for r in tables.read_videos(spark, table).collect()} <= {"train", "val", "test"}


def test_folding_ignores_case_of_any_letter(spark):
    pairs = [("STRASSE", "straße"), ("Straße", "SS"), ("İstanbul", "i̇s"), ("ﬁn", "FI"), ("ΟΔΟΣ", "οδος"), ("ŉa", "ʼN"), ("kelvin", "Kelvin"), ("ısı", "ISI"), ("abc", "d"), ("Ꭰꭰ", "ꭰᎠ")]
    df = spark.createDataFrame(pairs, "text string, needle string")
    got = [r["hit"] for r in df.select(folded_contains("text", "needle").alias("hit")).collect()]
    assert got == [n.casefold() in t.casefold() for t, n in pairs] and got[7] is False


def test_generated_names_are_not_sent_out_whole(spark):
    """The planner takes generated rows to be as few as those they are made from, so it would send these out."""
    names = lambda prefix: F.concat(F.lit(prefix), F.col("n").cast("string"), F.lit(".x")).alias("name")
    many = spark.range(20).select(F.col("id").alias("batch"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("n"))
    v, s = many.filter("n < 6").select("batch", names("V")), many.filter("n > 3").select("batch", names("v"))
    pairs, problems = subtitles.pair_files(v, s)
    for df in (pairs, problems):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert pairs.filter("subtitle IS NOT NULL").count() == 40
    assert problems.groupBy("problem").count().collect() == [("unmatched", 80)]
