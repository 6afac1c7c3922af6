"""Commits, exports that fail half-way, streams that are retried, reviews with revisions."""

import random
import time

import pytest
from pyspark.sql import functions as F

from ethogrid.operators import kinematics, labeling, revision
from ethogrid.sources import commits
from ethogrid.sources.store import Store, stream_export
from ethogrid.streaming import live, rolling

FRAMES = "video_id string, frame_idx int, t_sec double, state string, source string, value int"
STATES = ["Controlled Swim", "Freezing/Drift", "Erratic Movement"]


def frames(spark, ids, value=1, n=20):
    rng = random.Random(value)
    return spark.createDataFrame([(v, i, i * 0.5, rng.choice(STATES), "auto", value) for v in ids for i in range(n)], FRAMES)


def manifest(spark, ids, status="AUTO", note="a"):
    return spark.createDataFrame([(v, status, note) for v in ids], "video_id string, review_status string, note string")


def boxes(spark, ids):
    return spark.createDataFrame([(v, 0, 0.9) for v in ids], "video_id string, frame_idx int, score double")


def segs(f):
    return labeling.segments(f).drop("segment")


def state(store):
    """What a reader sees: value by subject, segments' length, subjects with detections, notes."""
    m = store.manifests()
    if m is None:
        return None
    f, s, d = (store.part(p) for p in ("frames", "segments", "detections"))
    return (
        {r.video_id: (r.v, r.n) for r in f.groupBy("video_id").agg(F.max("value").alias("v"), F.count("*").alias("n")).collect()},
        {r.video_id: r.s for r in s.groupBy("video_id").agg(F.sum("duration_s").alias("s")).collect()},
        sorted(r.video_id for r in d.collect()) if d is not None else [], {r.video_id: r.note for r in m.collect()},
    )


@pytest.mark.parametrize("at", ["frames", "segments", "detections", "manifests", "commit"])
def test_a_failure_between_any_two_writes_leaves_what_was_there(spark, tmp_path, at):
    store = Store(spark, f"file://{tmp_path}/s")
    f = frames(spark, ["a", "b"])
    assert store.export(f, segs(f), manifest(spark, ["a", "b"]), boxes(spark, ["a", "b"])) == 1
    before = state(store)

    def fail(step):
        if step == at:
            raise RuntimeError("killed")

    g = frames(spark, ["b", "c"], 2)
    with pytest.raises(RuntimeError, match="killed"):
        store.export(g, segs(g), manifest(spark, ["b", "c"], note="b"), boxes(spark, ["b", "c"]), step=fail)
    assert state(store) == before
    catalog = spark.createDataFrame([("a",), ("b",), ("c",)], "video_id string")
    assert [r.video_id for r in store.pending(catalog).collect()] == ["c"]
    assert (at == "frames") == (store.vacuum() == [])
    assert state(store) == before
    assert store.export(g, segs(g), manifest(spark, ["b", "c"], note="b")) == 2  # the run goes on
    now = state(store)
    assert now[0] == {"a": (1, 20), "b": (2, 20), "c": (2, 20)} and now[3] == {"a": "a", "b": "b", "c": "b"}
    assert now[2] == ["a"]  # b's detections of the earlier run are gone with it
    assert store.pending(catalog).collect() == []


def test_reviewed_subjects_stay(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    f = frames(spark, ["a", "b", "c"])
    ms = manifest(spark, ["a"], "EDITED").union(manifest(spark, ["b"], "ACCEPTED")).union(manifest(spark, ["c"], "REJECTED"))
    store.export(f, segs(f), ms)
    g = frames(spark, ["a", "b", "c"], 2)
    store.export(g, segs(g), manifest(spark, ["a", "b", "c"], note="z"))
    assert {k: v[0] for k, v in state(store)[0].items()} == {"a": 1, "b": 1, "c": 2}
    catalog = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "video_id string")
    assert sorted(r.video_id for r in store.pending(catalog, force=True).collect()) == ["c", "d"]
    store.export(g, segs(g), manifest(spark, ["a", "b", "c"], note="z"), force=True)
    assert {k: v[0] for k, v in state(store)[0].items()} == {"a": 2, "b": 2, "c": 2}
    gone = store.vacuum()
    assert len(gone) == 4 and not any(g.startswith("manifests") for g in gone)
    assert {k: v[0] for k, v in state(store)[0].items()} == {"a": 2, "b": 2, "c": 2}


def test_an_empty_store_and_an_empty_run(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    catalog = spark.createDataFrame([("a",)], "video_id string")
    assert store.manifests() is None and store.part("frames") is None and store.vacuum() == []
    assert [r.video_id for r in store.pending(catalog).collect()] == ["a"]
    f = frames(spark, [])
    assert store.export(f, segs(f), manifest(spark, [])) == 1
    assert store.manifests().collect() == [] and store.part("frames") is None


def test_commits_conflict_and_broken_ones_are_passed_over(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    assert commits.append(spark, folder, 0, {"x": 1}) == 1
    with pytest.raises(commits.Conflict):
        commits.append(spark, folder, 0, {"x": 2})
    (tmp_path / "c/commits/00000002.json").write_text('{"x": ')
    assert commits.entries(spark, folder) == [(1, {"x": 1})] and commits.last_number(spark, folder) == 2
    assert commits.append(spark, folder, 2, {"x": 3}) == 3
    assert [n for n, _ in commits.entries(spark, folder)] == [1, 3]


def test_a_retried_batch_of_a_stream_is_exported_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    schema = "video_id string, frame_idx int, t_sec double, state string, source string, value int"
    for k, ids in enumerate((["a", "b"], ["c"])):
        frames(spark, ids, k + 1).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    label = lambda b: (b, segs(b), b.select("video_id").distinct().withColumn("review_status", F.lit("AUTO")).withColumn("note", F.lit("s")))
    run = stream_export(store, label)
    failed = []

    def flaky(batch, n):
        run(batch, n)
        if n == 0 and not failed:
            failed.append(n)
            raise RuntimeError("killed after the commit")

    def start(f):
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return src.writeStream.foreachBatch(f).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()

    with pytest.raises(Exception, match="killed after the commit"):
        start(flaky).awaitTermination()
    start(flaky).awaitTermination()
    assert [c["name"] for _, c in store.runs()] == ["batch-0", "batch-1"]
    assert state(store)[0] == {"a": (1, 20), "b": (1, 20), "c": (2, 20)}


# --- revisions ---------------------------------------------------------------------------------------


def asked(spark, log, store, ids):
    base = {r.video_id: r.baseline for r in revision.baselines(store.part("frames")).collect()}
    have = {r.video_id: r.revision for r in (log.revisions().collect() if log.revisions() is not None else [])}
    return spark.createDataFrame([(v, have.get(v, 0), base.get(v, "")) for v in ids], "video_id string, revision long, baseline string")


def edit(spark, *rows):
    return spark.createDataFrame(list(rows), "video_id string, edit_no int, start_s double, end_s double, new_state string")


@pytest.fixture
def reviewed(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    f = frames(spark, ["a", "b", "c"])
    store.export(f, segs(f), manifest(spark, ["a", "b", "c"]))
    return store, revision.EditLog(spark, f"file://{tmp_path}/log")


def files_of(store):
    import os

    root = store.folder.removeprefix("file://")
    return {os.path.join(d, x): os.path.getmtime(os.path.join(d, x)) for d, _, xs in os.walk(root) for x in xs if x.endswith(".parquet")}


def test_an_edit_reruns_its_subject_only(spark, reviewed):
    store, log = reviewed
    before, rows = files_of(store), {(r.video_id, r.frame_idx): r.state for r in store.part("frames").collect()}
    got = log.submit(asked(spark, log, store, ["b"]), edit(spark, ("b", 1, 2.0, 4.0, "Surface Breach"), ("b", 2, 3.0, 3.6, "Listing/LORR")), store.part("frames"), "r").collect()
    assert [(r.video_id, r.revision, r.refused) for r in got] == [("b", 1, None)]
    assert revision.rerun(store, log) == 2 and revision.rerun(store, log) is None
    want = {k: "Listing/LORR" if k[0] == "b" and k[1] in (6, 7) else "Surface Breach" if k[0] == "b" and 4 <= k[1] < 8 else s for k, s in rows.items()}
    assert {(r.video_id, r.frame_idx): r.state for r in store.part("frames").collect()} == want
    after = files_of(store)
    assert all(after[p] == t for p, t in before.items())  # nothing that was there is touched
    assert {r.video_id: (r.review_status, r.revision) for r in store.manifests().collect()} == {"a": ("AUTO", None), "b": ("EDITED", 1), "c": ("AUTO", None)}
    manual = {r.video_id for r in store.part("segments").where("source = 'manual'").collect()}
    assert manual == {"b"}


def test_taking_edits_back_restores_the_automatic_states(spark, reviewed):
    store, log = reviewed
    rows = {(r.video_id, r.frame_idx): (r.state, r.source) for r in store.part("frames").collect()}
    log.submit(asked(spark, log, store, ["a"]), edit(spark, ("a", 1, 0.0, 5.0, "Surface Breach")), store.part("frames"))
    revision.rerun(store, log)
    log.submit(asked(spark, log, store, ["a"]), edit(spark, ("b", 1, 0.0, 1.0, "Dead")), store.part("frames"))
    revision.rerun(store, log)
    assert {(r.video_id, r.frame_idx): (r.state, r.source) for r in store.part("frames").collect()} == rows
    assert {r.video_id: r.revision for r in log.revisions().collect()} == {"a": 2}


def test_stale_changed_and_unknown_submissions_are_refused(spark, reviewed):
    store, log = reviewed
    first = asked(spark, log, store, ["a", "b", "nobody"]).cache()
    first.count()
    one = {r.video_id: r.refused for r in log.submit(first, edit(spark, ("a", 1, 0.0, 1.0, "Surface Breach")), store.part("frames")).collect()}
    assert one == {"a": None, "b": None, "nobody": "unknown subject"}
    two = {r.video_id: r.refused for r in log.submit(first.where("video_id = 'a'"), edit(spark, ("a", 1, 0.0, 9.0, "Erratic Movement")), store.part("frames")).collect()}
    assert two == {"a": "stale revision"}
    old = spark.createDataFrame([("c", 0, "20-0-0")], first.schema)
    assert [r.refused for r in log.submit(old, edit(spark, ("c", 1, 0.0, 1.0, "Surface Breach")), store.part("frames")).collect()] == ["changed baseline"]
    assert [(r.video_id, r.end_s) for r in log.edits().collect()] == [("a", 1.0)]


def test_of_two_writers_at_once_one_is_refused(spark, reviewed):
    store, log = reviewed
    start = asked(spark, log, store, ["a", "b"]).cache()
    start.count()
    other = []

    def meanwhile():  # another writer commits between this one's check and its commit
        if not other:
            other.append(log.submit(start.where("video_id = 'a'"), edit(spark, ("a", 1, 0.0, 1.0, "Surface Breach")), store.part("frames")).collect())

    mine = {r.video_id: (r.revision, r.refused) for r in log.submit(start, edit(spark, ("a", 1, 0.0, 2.0, "Listing/LORR"), ("b", 1, 0.0, 2.0, "Listing/LORR")), store.part("frames"), before_commit=meanwhile).collect()}
    assert [(r.video_id, r.refused) for r in other[0]] == [("a", None)]
    assert mine == {"a": (0, "stale revision"), "b": (1, None)}
    assert {(r.video_id, r.end_s, r.new_state) for r in log.edits().collect()} == {("a", 1.0, "Surface Breach"), ("b", 2.0, "Listing/LORR")}


def test_an_edit_that_ends_death_leaves_the_subject_as_it_is(spark, reviewed):
    store, log = reviewed
    log.submit(asked(spark, log, store, ["a", "b"]), edit(spark, ("a", 1, 0.0, 2.0, "Dead"), ("b", 1, 4.0, 99.0, "Dead")), store.part("frames"))
    revision.rerun(store, log)
    assert {r.video_id: r.review_status for r in store.manifests().collect()} == {"a": "AUTO", "b": "EDITED", "c": "AUTO"}


# --- streams -----------------------------------------------------------------------------------------

TRACK = "video_id string, frame_idx int, t_sec double, x double, y double, detected boolean, ts timestamp"


def track_rows(seed=1):
    import datetime

    rng = random.Random(seed)
    rows = []
    for v in "ab":
        idx = 0
        for _ in range(50):
            idx += 1 if rng.random() < 0.9 else 3
            t = idx * 0.5
            rows.append((v, idx, t, rng.uniform(0, 10), rng.uniform(0, 10), rng.random() < 0.9, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=t)))
    return rows


def put(spark, rows, path):
    spark.createDataFrame(rows, TRACK).coalesce(1).write.mode("append").parquet(path)
    time.sleep(1.1)


def test_rolling_windows_of_a_stream_equal_the_batch_with_late_rows(spark, tmp_path):
    import datetime

    rolling.use_state_store(spark)
    rng, rows = random.Random(3), track_rows()
    came = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 4))  # up to four seconds late
    for k in range(3):
        put(spark, came[k * 34 : k * 34 + 34], f"{tmp_path}/in")
    put(spark, [("end", 1, 0.0, 0.0, 0.0, False, datetime.datetime(2030, 1, 1))], f"{tmp_path}/in")
    put(spark, [("a", 999, 1.0, 1.0, 1.0, True, datetime.datetime(2024, 1, 1)), ("end", 2, 0.0, 0.0, 0.0, False, datetime.datetime(2031, 1, 1))], f"{tmp_path}/in")  # older than the watermark: dropped
    src = spark.readStream.schema(TRACK).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = rolling.stream_rolling(src, 5, 12.0, 3, "5 seconds", 60.0).writeStream.option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    seen = lambda df: {(r.video_id, r.frame_idx): (round(r.velocity, 6), r.velocity_valid, round(r.meander, 6), r.is_immobile) for r in df.collect() if r.video_id != "end"}
    df = spark.createDataFrame(rows, TRACK)
    want = seen(kinematics.immobility(kinematics.meander(kinematics.velocity(df), 5), 12.0, 3))
    assert seen(spark.read.schema(rolling.OUTPUT).parquet(f"{tmp_path}/out")) == want
    state = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert state[-1] < max(state)  # idle subjects lost their state


def test_late_rows_of_bins_are_dropped_behind_the_watermark(spark, tmp_path):
    import datetime

    day = datetime.datetime(2024, 1, 1)
    at = lambda s: day + datetime.timedelta(seconds=s)
    schema = "video_id string, ts timestamp, state string"
    for rows in ([("a", at(1), STATES[0]), ("a", at(12), STATES[0])], [("a", at(9), STATES[1]), ("a", at(40), STATES[0])], [("a", at(31), STATES[1]), ("a", at(100), STATES[0])], [("a", at(2), STATES[2]), ("a", at(500), STATES[0])]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = live.stream_bins(src, "10 seconds", "10 seconds").writeStream.outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.start - day).seconds: r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {0: 2, 10: 1, 30: 1, 40: 1, 100: 1}  # the row of second 9 was late but in time, that of second 2 was too late
