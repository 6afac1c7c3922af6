"""Operators against plain loops, and their edge cases."""

import hashlib
import itertools
import json
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ethogrid.functions import scalars as fn
from ethogrid.operators import audit, calibrate, catalog, design, features, flags, islands, kinematics, labeling, models, review, stats
from ethogrid.plans import tools
from ethogrid.schemas import CONTROLLED, DEAD, ERRATIC, FREEZING, LISTING, SURFACE, UNDETERMINED
from ethogrid.sources import files, readers, writers
from ethogrid.streaming import live

COLUMNS = "video_id string, frame_idx int, t_sec double, x double, y double, orientation_deg double, y_from_frame_top double, detected boolean"


def random_tracks(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for v in ("a", "b", "c"):
        idx, t = -1, 0.0
        for _ in range(n):
            idx += 1 if rng.random() < 0.93 else 3
            t += rng.choice([0.0, 1.0, 1.0, 1.5])
            seen = rng.random() < 0.85
            still = rng.random() < 0.6
            x = (5.0 if still else rng.uniform(0, 60)) if seen else 0.0
            y = (5.0 if still else rng.uniform(0, 60)) if seen else 0.0
            rows.append((v, idx, t, x, y, rng.uniform(0, 179) if seen and rng.random() < 0.9 else None, y if seen else None, seen))
    rows += [("single", 0, 0.0, 1.0, 1.0, 90.0, 1.0, True), ("blind", 0, 0.0, 0.0, 0.0, None, None, False), ("blind", 1, 1.0, 0.0, 0.0, None, None, False)]
    return rows


@pytest.fixture(scope="module", params=[1, 2])
def tracks(request, spark):
    rows = random_tracks(request.param)
    return spark.createDataFrame(rows, COLUMNS), rows


def by_video(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return out


def loop_features(rows, window=5):
    """run length, velocity, meander, immobility (window 3, floor 12) of one video."""
    out, run = [], 0
    for i, r in enumerate(rows):
        prev = rows[i - 1] if i else None
        run = 0 if not r[7] else run + 1 if prev and prev[7] and r[1] == prev[1] + 1 else 1
        dt = r[2] - prev[2] if prev else 0
        dist = math.hypot(r[3] - prev[3], r[4] - prev[4]) if run >= 2 else 0.0
        ok = run >= 2 and dt > 0
        head = math.degrees(math.atan2(r[4] - prev[4], r[3] - prev[3])) if run >= 2 else None
        turn = abs((head - out[-1]["head"] + 180) % 360 - 180) if run >= 3 else None
        out.append({"run": run, "v": dist / dt if ok else 0.0, "ok": ok, "head": head, "turn": turn, "dist": dist})
        part = out[max(0, i - window + 1, i - run + 1):]
        total = sum(p["dist"] for p in part) if run else 0.0
        out[-1]["meander"] = sum(p["turn"] or 0 for p in part) / total if run and total > 1e-9 else 0.0
        last = out[-3:]
        out[-1]["still"] = len(last) == 3 and all(p["ok"] and p["v"] <= 12 for p in last)
    return out


def test_features_equal_a_loop(tracks):
    df, rows = tracks
    got = {(r.video_id, r.frame_idx): r for r in kinematics.features(df, 5, 12.0, 3).collect()}
    for v, own in by_video(rows).items():
        for r, w in zip(own, loop_features(own), strict=True):
            g = got[v, r[1]]
            assert (g.run_length, g.velocity_valid, g.is_immobile) == (w["run"], w["ok"], w["still"])
            assert g.velocity == pytest.approx(w["v"]) and g.meander == pytest.approx(w["meander"])


def loop_speed(rows, lag_s):
    gaps = sorted(b[2] - a[2] for a, b in zip(rows, rows[1:], strict=False) if b[1] == a[1] + 1 and b[2] > a[2])
    if not gaps:
        return [None] * len(rows)
    lag = max(1, round(lag_s / gaps[len(gaps) // 2]))
    out = []
    for i, r in enumerate(rows):
        best = None
        for j in (i - lag, i + lag):
            if best is None and r[7] and 0 <= j < len(rows) and rows[j][7]:
                a, b = (rows[j], r) if j < i else (r, rows[j])
                if b[1] - a[1] == lag and b[2] > a[2]:
                    best = math.hypot(b[3] - a[3], b[4] - a[4]) / (b[2] - a[2])
        out.append(best)
    return out


def test_smoothed_speed_equals_a_loop(tracks):
    df, rows = tracks
    got = {(r.video_id, r.frame_idx): (r.speed if r.speed_valid else None) for r in kinematics.smoothed_speed(df, 3.0).collect()}
    for v, own in by_video(rows).items():
        for r, w in zip(own, loop_speed(own, 3.0), strict=True):
            assert (got[v, r[1]] is None) == (w is None) and (w is None or got[v, r[1]] == pytest.approx(w))


def loop_states(rows, speeds):
    n = len(rows)
    still = [s is not None and s <= 3 for s in speeds]

    def runs(hold, least):
        out, i = [False] * n, 0
        while i < n:
            j = i
            while hold[i] and j + 1 < n and hold[j + 1] and rows[j + 1][1] == rows[j][1] + 1:
                j += 1
            if hold[i] and rows[j][2] - rows[i][2] >= least:
                out[i : j + 1] = [True] * (j + 1 - i)
            i = j + 1
        return out

    freeze = runs(still, 2.0)
    tilt = runs([r[7] and r[5] is not None and abs(r[5] - 90) >= 40 for r in rows], 1.0)
    dead = [False] * n
    i = n - 1
    while i >= 0 and still[i] and (i == n - 1 or rows[i + 1][1] == rows[i][1] + 1):
        i -= 1
    if i < n - 1 and rows[-1][2] - rows[i + 1][2] >= 1.0:
        dead[i + 1 :] = [True] * (n - 1 - i)
    out = []
    for k, r in enumerate(rows):
        out.append(
            UNDETERMINED if not r[7] else DEAD if dead[k] else SURFACE if r[6] is not None and r[6] <= 2 else LISTING if tilt[k] else FREEZING if freeze[k]
            else UNDETERMINED if speeds[k] is None else ERRATIC if speeds[k] >= 6 else CONTROLLED
        )
    return out


def test_states_equal_a_loop(tracks):
    df, rows = tracks
    got = labeling.classify(kinematics.smoothed_speed(df, 1.0), 3.0, 2.0, 6.0, 2.0, 1.0, 40.0, 1.0)
    found = {(r.video_id, r.frame_idx): r.state for r in got.collect()}
    for v, own in by_video(rows).items():
        assert [found[v, r[1]] for r in own] == loop_states(own, loop_speed(own, 1.0)), v
    with pytest.raises(ValueError):
        labeling.classify(df, 6.0, 1.0, 6.0, 1.0, 1.0)


def states(spark, rows):
    return spark.createDataFrame([("v", i, float(t), s, src) for i, t, s, src in rows], "video_id string, frame_idx int, t_sec double, state string, source string")


def test_votes_ties_and_surface(spark):
    def winner(*names):
        return labeling.consolidate_bins(states(spark, [(i, i / 100, s, "auto") for i, s in enumerate(names)]), 1.0, 0.5).first().state

    assert winner(CONTROLLED, ERRATIC) == ERRATIC and winner(FREEZING, ERRATIC, DEAD) == DEAD and winner(LISTING, FREEZING) == LISTING
    assert winner(SURFACE, CONTROLLED, CONTROLLED, CONTROLLED) == SURFACE and winner(SURFACE, DEAD) == DEAD
    assert winner(SURFACE, UNDETERMINED, UNDETERMINED, UNDETERMINED) == UNDETERMINED
    assert winner(UNDETERMINED) == UNDETERMINED and winner(CONTROLLED, UNDETERMINED) == CONTROLLED and winner(SURFACE) == SURFACE


def test_segments_split_on_state_source_and_gap(spark):
    df = states(spark, [(0, 0, CONTROLLED, "auto"), (1, 1, CONTROLLED, "auto"), (2, 2, CONTROLLED, "manual"), (4, 4, CONTROLLED, "manual"), (5, 5, DEAD, "auto")])
    got = [(r.start_s, r.end_s, r.state) for r in labeling.segments(df).orderBy("start_s").collect()]
    assert got == [(0, 2, CONTROLLED), (2, 4, CONTROLLED), (4, 5, CONTROLLED), (5, 6, DEAD)]
    assert labeling.segments(df, False).count() == 3
    assert labeling.bouts(labeling.segments(df)).count() == 2
    assert labeling.segments(df.limit(0)).count() == 0
    assert labeling.dead_violations(df).count() == 0
    one = states(spark, [(0, 3, DEAD, "auto"), (1, 4, CONTROLLED, "auto")])
    assert labeling.dead_violations(one).count() == 1
    back = labeling.segments_to_frames(labeling.segments(df), df).orderBy("frame_idx").collect()
    assert [(r.state, r.source) for r in back] == [(r.state, r.source) for r in df.orderBy("frame_idx").collect()]


def test_edits_last_one_wins_and_checks(spark):
    df = states(spark, [(i, i, CONTROLLED, "auto") for i in range(6)])
    edits = spark.createDataFrame([("v", 1, 1.0, 4.0, DEAD), ("v", 2, 2.0, 3.0, SURFACE), ("v", 3, 10.0, 11.0, DEAD), ("v", 4, 3.0, 2.0, DEAD), ("v", 5, float("nan"), 2.0, DEAD)], "video_id string, edit_no int, start_s double, end_s double, new_state string")
    got = review.apply_edits(df, edits.where("edit_no < 3")).orderBy("frame_idx").collect()
    assert [r.state for r in got] == [CONTROLLED, DEAD, SURFACE, DEAD, CONTROLLED, CONTROLLED] and [r.source for r in got].count("manual") == 3
    assert {r.edit_no: r.error for r in review.check_edits(edits, df).collect()} == {3: "covers no row", 4: "not ordered", 5: "not finite"}
    pieces = review.overlay_edits(labeling.segments(df), edits.where("edit_no < 3")).orderBy("start_s").collect()
    assert [(r.start_s, r.end_s, r.state) for r in pieces] == [(0, 1, CONTROLLED), (1, 2, DEAD), (2, 3, SURFACE), (3, 4, DEAD), (4, 6, CONTROLLED)]


def test_flags(spark):
    s = spark.createDataFrame([("v", float(t), 0.9) for t in (0, 1, 2.5, 4.5, 9)] + [("v", 5.0, 0.1)], "video_id string, t double, score double")
    assert [(r.start_s, r.end_s, r.n_samples) for r in flags.session_flags(s, 0.5, 1.0).orderBy("start_s").collect()] == [(0.0, 3.0, 3), (4.0, 5.0, 1), (8.5, 9.5, 1)]
    assert flags.session_flags(s, 0.5, 1.0, 2).count() == 1
    d = spark.createDataFrame([("v", i, float(i), 0.0, 0.0, None, None, i % 4 > 0) for i in range(9)], COLUMNS)
    assert [(r.start_pos, r.length) for r in flags.undetected_gaps(d).orderBy("start_pos").collect()] == [(0, 1), (4, 1), (8, 1)]
    assert islands.run_length(d).where("detected").agg(F.max("run_length")).first()[0] == 3


def test_expand_strided(spark):
    s = spark.createDataFrame([("v", 0, 0.0, 0.0, True), ("v", 4, 8.0, 4.0, True), ("v", 8, 0.0, 0.0, False)], "video_id string, frame_idx int, x double, y double, detected boolean")
    got = flags.strided_expand(s, 4).orderBy("frame_idx").collect()
    assert [r.x for r in got] == [0, 2, 4, 6, 8, 8, 8, 8, 0] and [r.detected for r in got] == [True] * 8 + [False]


def test_scalars(spark):
    one = spark.range(1).select(
        fn.circular_diff(F.lit(170.0), F.lit(-20.0), 360.0).alias("d"), fn.circular_diff(F.lit(5.0), F.lit(175.0), 180.0).alias("a"), fn.slug(F.lit("Freezing/Drift")).alias("s"),
        fn.parse_yymmdd(F.lit(240230)).alias("bad"), fn.parse_yymmdd(F.lit(50102)).alias("day"), fn.mmss(F.lit(125.9)).alias("m"), fn.time_bin(F.lit(0.3), 0.1).alias("b"),
        fn.same_label(F.lit("1"), F.lit("1.0")).alias("n"), fn.same_label(F.lit(None).cast("string"), F.lit(" ")).alias("blank"), fn.number_text(F.lit(3.0)).alias("t"),
        fn.numbers_in(F.lit("about 1,234.5 and -3")).alias("x"), fn.from_unit(F.lit(0.5), 1.0, 100.0, True).alias("g"), fn.subject_key(F.lit("M"), F.lit("7")).alias("k"),
        fn.box_iou(F.array(*map(F.lit, (0.0, 0.0, 2.0, 2.0))), F.array(*map(F.lit, (1.0, 1.0, 3.0, 3.0)))).alias("iou"), fn.epoch_of(F.lit("2024-02-01"), ["2024-01-01", "2024-03-01"]).alias("e"),
    ).first()
    assert (one.d, one.a, one.s, one.bad, str(one.day), one.m, one.b) == (-170.0, 10.0, "freezing_drift", None, "2005-01-02", "02:05", 3)
    assert (one.n, one.blank, one.t, one.x, one.k, one.e) == (True, True, "3", [1234.5, -3.0], "M_0007", 2) and one.g == pytest.approx(10) and one.iou == pytest.approx(1 / 7)


def test_effect_and_exact_p(spark):
    a, b = [5.1, 6.2, 7.3, 8.4], [1.0, 2.0, 3.0]
    rows = spark.createDataFrame([("f", True, v) for v in a] + [("f", False, v) for v in b] + [("g", True, 1.0), ("g", False, 1.0), ("g", True, 1.0), ("g", False, 1.0)], "feature string, is_group boolean, value double")
    got = {r.feature: r for r in stats.effects(rows, ["feature"]).collect()}
    assert set(got) == {"f"} and got["f"].u == 12 and got["f"].hedges_g > 2
    assert got["f"].p_method == "exact" and got["f"].p_value == pytest.approx(2 / 35)
    assert math.erfc(1.3 / math.sqrt(2)) == pytest.approx(spark.range(1).select(stats.normal_tail2(F.lit(1.3))).first()[0], rel=1e-6)


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.8]
    got = stats.benjamini_hochberg(spark.createDataFrame([("a", f"f{i}", x) for i, x in enumerate(p)], "k string, feature string, p_value double"), ["k"])
    assert {r.feature: round(r.q_value, 6) for r in got.collect()} == {"f0": 0.025, "f1": 0.05, "f2": 0.05, "f3": 0.025, "f4": 0.8}


def test_exact_p_equals_enumeration(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for m, n in [(2, 2), (2, 9), (4, 3), (5, 5), (8, 8), (8, 9), (9, 9), (3, 3)]:
        values = rng.sample(range(1000), m + n)
        values = [v // 500 for v in values] if (m, n) == (3, 3) else values  # ties
        name = f"{m}x{n}"
        rows += [(name, i < m, float(v)) for i, v in enumerate(values)]
        if min(m, n) <= 8 and (m, n) != (3, 3):
            order = sorted(values)
            u = sum(order.index(v) for v in values[:m]) - m * (m - 1) / 2
            us = [sum(c) - m * (m - 1) / 2 for c in itertools.combinations(range(m + n), m)]
            want[name] = min(1.0, 2 * sum(x >= max(u, m * n - u) for x in us) / len(us))
    got = {r.feature: r for r in stats.effects(spark.createDataFrame(rows, "feature string, is_group boolean, value double"), ["feature"]).collect()}
    assert {k: got[k].p_value for k in want} == pytest.approx(want)
    assert {k for k, r in got.items() if r.p_method == "exact"} == set(want)


def test_candidates_equal_the_slow_greedy(spark):
    rng = random.Random(6)
    videos = {f"v{i}": (rng.choice("ABC"), rng.choice(["train", "test", "none"]), rng.choice([10.0, 30.0])) for i in range(25)}
    scanned = []
    for v, (c, split, fps) in videos.items():
        for f in sorted(rng.sample(range(4000), 40)):
            scanned.append((v, f, fps, c, split, rng.choice([0.3, 0.5, 0.9]), rng.choice([float("nan"), None, 120.0, 100.0, 99.5, 60.0, rng.uniform(0, 180)])))
    annotated = [(v, rng.randrange(4000)) for v in videos for _ in range(3)]
    quotas = {"train": (9, 12), "test": (40, 3)}

    taken, want = defaultdict(list), []
    for split, both in quotas.items():
        for reason, quota in zip(("tilted", "unsure"), both, strict=True):
            pool = [s for s in scanned if s[4] == split and s[5] >= 0.5 and s[6] is not None and not math.isnan(s[6])]
            pool = [s for s in pool if not any(w == s[0] and abs(g - s[1]) <= 2 * s[2] for w, g in annotated)]
            if reason == "tilted":
                pool = sorted((s for s in pool if s[6] >= 100), key=lambda s: (-s[6], s[0], s[1]))
            else:
                pool = sorted((s for s in pool if 60 <= s[6] < 100), key=lambda s: (hashlib.sha256(f"7:{split}:{s[0]}:{s[1]}".encode()).hexdigest(), s[0]))  # noqa: B023
            queues, picked, going = defaultdict(list), 0, True
            for s in pool:
                queues[s[3]].append(s)
            while going and picked < quota:
                going = False
                for c in sorted(queues):
                    while queues[c] and picked < quota:
                        s = queues[c].pop(0)
                        if len(taken[s[0]]) < 4 and all(abs(s[1] - t) >= 20 * s[2] for t in taken[s[0]]):
                            taken[s[0]].append(s[1])
                            want.append((s[0], s[1], split, reason))
                            picked, going = picked + 1, True
                            break
    schema = "video_id string, frame_idx int, fps double, compound string, split string, box_score double, tilt double"
    df, seen = spark.createDataFrame(scanned, schema).repartition(3), spark.createDataFrame(annotated, "video_id string, frame_idx int")
    got = [tuple(r)[:4] for r in design.select_candidates(df, seen, quotas, 7).collect()]
    assert len(want) > 30 and sorted(got) == sorted(want)
    assert design.select_candidates(df.where("false"), seen, quotas, 7).collect() == []


def test_few_videos_are_gone_through_for_candidates(spark, monkeypatch):
    """Of many videos only those whose best row is among the quota's best go row by row, and the picks are those of a loop over all rows."""
    rng = random.Random(8)
    scanned, annotated = [], []
    for i in range(400):
        v, c, split, fps = f"v{i:03}", "AB"[i % 2], ["train", "test"][i // 2 % 2], rng.choice([5.0, 10.0, 30.0])
        scanned += [(v, f, fps, c, split, 0.9, float(rng.randrange(50, 130))) for f in rng.sample(range(120), 8)]
        annotated += [(v, rng.randrange(120)) for _ in range(rng.choice([0, 0, 1, 3]))]
    annotated += annotated[:50]
    quotas, taken, want, guards = {"train": (7, 9), "test": (3, 11)}, defaultdict(list), [], defaultdict(list)
    for v, f in annotated:
        guards[v].append(f)
    for split, both in quotas.items():
        for reason, quota in zip(("tilted", "unsure"), both, strict=True):
            pool = [s for s in scanned if s[4] == split and (s[6] >= 100 if reason == "tilted" else 60 <= s[6] < 100) and all(abs(g - s[1]) > 2 * s[2] for g in guards[s[0]])]
            pool.sort(key=lambda s: (-s[6], s[0], s[1]) if reason == "tilted" else hashlib.sha256(f"7:{s[4]}:{s[0]}:{s[1]}".encode()).hexdigest())  # noqa: B023
            turns = defaultdict(list)
            for s in pool:
                if len(turns[s[3]]) < quota and len(taken[s[0]]) < 2 and all(abs(s[1] - t) >= 0.5 * s[2] for t in taken[s[0]]):
                    taken[s[0]].append(s[1])
                    turns[s[3]].append(s)
            picked = sorted((n, c, s) for c, own in turns.items() for n, s in enumerate(own, 1))
            for _, _, s in picked[quota:]:
                taken[s[0]].remove(s[1])
            want += [(s[0], s[1], split, reason, s[6], n) for n, _, s in picked[:quota]]
    sizes, free = [], design._free_picks
    monkeypatch.setattr(design, "_free_picks", lambda found, *rest: sizes.append(found.select("video_id").distinct().count()) or free(found, *rest))
    df = spark.createDataFrame(scanned, "video_id string, frame_idx int, fps double, compound string, split string, box_score double, tilt double").repartition(3)
    seen = spark.createDataFrame(annotated, "video_id string, frame_idx int")
    got = [tuple(r) for r in design.select_candidates(df, seen, quotas, 7, gap_s=0.5, per_video=2).collect()]
    assert len(want) == 30 and sorted(got) == sorted(want)
    assert sizes[0] <= 2 * (7 + 3) and sizes[1] <= 2 * (7 + 9 + 3 + 11) + 7 + 3


def test_parameter_sets_equal_a_loop(tracks):
    df, rows = tracks
    names = sorted({r[0] for r in rows})
    grp = {v: "g1" if i % 2 else "g2" for i, v in enumerate(names)}
    with_speed = kinematics.smoothed_speed(df, 3.0).withColumn("grp", F.when(F.col("video_id").isin(*[v for v in names if grp[v] == "g1"]), "g1").otherwise("g2"))
    kept = [CONTROLLED, FREEZING, ERRATIC, DEAD]
    share = {"g1": [0.5, 0.25, 0.15, 0.3], "g2": [0.1, 0.2, 0.3, 0.4]}
    spark = df.sparkSession
    targets = spark.createDataFrame([(g, s, q) for g, qs in share.items() for s, q in zip(kept, qs, strict=True)], "grp string, state string, proportion double")
    sets = [{"freeze": 3.0, "erratic": 6.0, "min_freeze_s": 2.0, "surface_depth": 2.0, "min_dead_s": 1.0}, {"freeze": 6.0, "erratic": 5.0}, {"freeze": 1.0, "erratic": 9.0, "min_freeze_s": 0.5, "surface_depth": 5.0}]
    for width in (None, 2.0):
        got = {(r.set_no, r.grp): r for r in calibrate.score_sets(with_speed, targets, sets, kept, width).collect()}
        assert {k[0] for k in got} == {0, 2}
        means = calibrate.mean_distance(calibrate.score_sets(with_speed, targets, sets, kept, width), 3)
        assert means[1] == 1.0
        for n in (0, 2):
            p = {**calibrate.DEFAULTS, **sets[n]}
            one = labeling.classify(with_speed, p["freeze"], p["min_freeze_s"], p["erratic"], p["surface_depth"], p["min_dead_s"])
            one = labeling.consolidate(one, width, 0.5) if width else one
            states = [(grp[r.video_id], r.state) for r in one.select("video_id", "state").collect()]
            tvs = []
            for g in sorted(set(grp.values())):
                own = [s for v, s in states if v == g]
                k = [s for s in own if s in kept]
                q = [x / sum(share[g]) for x in share[g]]
                tv = 0.5 * sum(abs(k.count(s) / len(k) - x) for s, x in zip(kept, q, strict=True)) if k else 1.0
                r = got[n, g]
                assert (r.tv, r.coverage, r.scored) == (pytest.approx(tv), pytest.approx(1 - own.count(UNDETERMINED) / len(own)), len(k))
                tvs.append(tv)
            assert means[n] == pytest.approx(sum(tvs) / len(tvs))
    with pytest.raises(Exception, match="no target for group g2"):
        calibrate.score_sets(with_speed, targets.where("grp = 'g1'"), sets, kept).collect()
    with pytest.raises(ValueError, match="unknown parameters: speed"):
        calibrate.score_sets(with_speed, targets, [{"speed": 1.0}], kept)
    assert calibrate.score_sets(with_speed, targets, sets[1:2], kept).collect() == []


def test_search_is_never_worse_than_its_start_and_keeps_to_ranges():
    seen = []

    def objective(batch):
        seen.extend(batch)
        return [abs(math.log(b["a"] / 5)) + (b["b"] - 2) ** 2 for b in batch]

    start = {"a": 5.0, "b": 2.01}
    best, score = calibrate.search(objective, {"a": (0.1, 100.0), "b": (-5.0, 5.0)}, 10, 8, 3, ("a",), start)
    assert score <= 0.0001 + 1e-9 and all(0.1 <= b["a"] <= 100.0001 and -5 <= b["b"] <= 5 for b in seen)
    assert seen[0] == start


def test_greedy_sample_is_spaced(spark):
    rows = spark.createDataFrame([("v", p, "x") for p in range(50)] + [("w", 1, "x")], "video_id string, pos long, reason string")
    got = defaultdict(list)
    for r in design.greedy_sample(rows, 5, 4, 1).collect():
        got[r.video_id].append(r.pos)
    assert len(got["v"]) == 5 and len(got["w"]) == 1 and all(abs(p - q) >= 4 for p in got["v"] for q in got["v"] if p != q)
    assert design.spaced_out(rows, rows.where("pos = 10"), 3).where("video_id = 'v'").count() == 43


def test_search_finds_a_minimum():
    best, score = calibrate.search(lambda batch: [(b["a"] - 3) ** 2 + (b["b"] + 1) ** 2 for b in batch], {"a": (0, 10), "b": (-5, 5)}, 30, 40)
    assert score < 0.01 and best["a"] == pytest.approx(3, abs=0.2)


def test_match_and_exceptions(spark):
    t = spark.createDataFrame([("k", 1), ("k", 2), ("m", 3)], "k string, trial long")
    v = spark.createDataFrame([("k", "p1"), ("k", "p2"), ("n", "p3")], "k string, path string")
    got = {(r.trial, r.video, r.status) for r in catalog.match_first(t, v, ["k"], "trial", "path").collect()}
    assert got == {(1, "p1", "matched"), (2, None, "ambiguous"), (3, None, "unmatched_trial"), (None, "p2", "duplicate_video"), (None, "p3", "unmatched_video")}
    paths = spark.createDataFrame([("/x/Drug A (old)/M_0007.MP4",), ("/x/Drug A/readme.txt",)], "path string")
    assert [tuple(r) for r in catalog.parse_videos(paths).collect()] == [("/x/Drug A (old)/M_0007.MP4", "M", 7, "druga")]
    assert catalog.exceptions(("a", t), ("b", v)).groupBy("kind").count().count() == 2
    inv = catalog.inventory(v.select("path"), v.limit(1).select("path"), spark.createDataFrame([("zz",)], "path string"))
    assert inv.count() == 4


def test_setups_and_preprocess(spark):
    rows = spark.createDataFrame([("2024-01-01", 0.0, 10.0), ("2024-01-02", 5.0, 50.0), ("2024-01-03", 1.0, 11.0), ("2024-01-04", 2.0, 12.0)], "date string, lo double, hi double")
    assert [s for _, s in audit.setups(rows, 1.0)] == [1, 2, 1, 1]
    t = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0), ("d", float("nan"))], "video_id string, f double")
    fitted = audit.fit_preprocess(t, ["f"]).first()
    assert (fitted.fill, fitted.mean) == (2.0, 2.0) and fitted.sd == pytest.approx(math.sqrt(0.5))
    assert [r["column"] for r in audit.missing(t, ["f", "video_id"]).collect()] == ["f"]


def test_tools_answer_errors_as_values(spark):
    rows = [(f"F_{i}", "VEH" if i % 2 else "drug  x", "1", f"2024-01-0{1 + i % 3}", "F", True, float(i % 7), None if i % 5 == 0 else float(i)) for i in range(60)]
    table = spark.createDataFrame(rows, "video_id string, compound string, concentration_mM string, date string, sex string, reviewed boolean, f_a double, f_b double")
    data = tools.ResearchData(table, {"f_a": "first measure", "f_b": "second measure"}, "VEH")
    assert {s["function"]["name"] for s in tools.schemas()} >= {"list_compounds", "top_differences", "subject_timeline", "model_results"}
    for name, args in (("nope", {}), ("compare_to_vehicle", {"feature": "f_zz", "compound": "x"}), ("top_differences", "{bad"), ("top_differences", {"compound": "none"}), ("subject_timeline", {"video_id": "F_1"}), ("find_features", {"wrong": 1})):
        assert "error" in tools.call(data, name, args)
    got = tools.call(data, "top_differences", json.dumps({"compound": "Drug x", "n": 1}))
    assert got["tested"] == 2 and len(got["features"]) == 1 and 0 <= got["features"][0]["q_value"] <= 1
    assert tools.call(data, "compare_to_vehicle", {"feature": "f_a", "compound": "DRUG X"})["group"]["n"] == 30
    assert tools.call(data, "find_features", {"search": "SECOND"})["matches"] == 1
    assert json.dumps(tools.call(data, "subject_profile", {"video_id": "F_4"}))
    assert tools.verdicts([{"model": m, "scheme": "A", "balanced_accuracy_mean": s, "balanced_accuracy_sd": 0.01} for m, s in (("majority", 0.2), ("date_only", 0.3), ("good", 0.5), ("bad", 0.305))])[0]["verdict"] == "not useful"


def test_folders_round_trip(spark, tmp_path):
    rows = [("v1", 0, 0.5, CONTROLLED), ("v1", 1, 1.5, DEAD), ("v2", 0, 0.5, UNDETERMINED)]
    base = spark.createDataFrame(rows, "video_id string, frame_idx int, t_sec double, state string").selectExpr(
        "*", "0D x", "0D y", "null orientation_deg", "null depth_from_surface", "0D velocity", "0D acceleration", "0D angular_velocity", "0D meander", "false is_immobile", "true detected", "'auto' source", "null confidence"
    )
    m = spark.createDataFrame([("v2", "ACCEPTED")], "video_id string, review_status string")
    out = f"{tmp_path}/frames"
    assert [r.video_id for r in writers.export_frames(base, m, out).collect()] == ["v2"]
    assert readers.frames(spark, out).select("video_id").distinct().count() == 1
    assert readers.frames_between(spark, out, "v1", 1.0, 2.0).count() == 1
    with pytest.raises(ValueError):
        spark.range(3).selectExpr("id video_id", "id frame_idx").write.parquet(f"{tmp_path}/bad")
        readers.frames(spark, f"{tmp_path}/bad")
    for v, text in (("m1", json.dumps({"subject_id": "1", "sex": "M", "compound": "A", "review_status": "ACCEPTED"}, indent=1)), ("m2", "{not json"), ("m3", "[1]")):
        (tmp_path / "gold" / v).mkdir(parents=True)
        (tmp_path / "gold" / v / "manifest.json").write_text(text)
    found = {r.video_id: r for r in readers.manifests(spark, f"{tmp_path}/gold/*/manifest.json").collect()}
    assert found["m1"].problem is None and found["m1"].review_flags == [] and found["m2"].problem and found["m3"].problem == "not a JSON object"
    index = spark.createDataFrame([("m1", "1", "M", "A"), ("m2", "2", "M", "A"), ("m4", "4", "M", "A")], "video_id string, subject_id string, sex string, compound string")
    frames = spark.createDataFrame([("m1", CONTROLLED)], "video_id string, state string")
    got = {r.video_id: r.reason for r in readers.accepted(index, readers.manifests(spark, f"{tmp_path}/gold/*/manifest.json"), frames).collect()}
    assert got["m1"] is None and got["m2"] and got["m4"] == "missing manifest"
    with pytest.raises(readers.GoldDataError):
        readers.accepted(index.unionByName(index), readers.manifests(spark, f"{tmp_path}/gold/*/manifest.json"), frames)
    writers.write_table(frames, str(tmp_path / "t"), {"columns": []})
    assert readers.training_table(spark, str(tmp_path / "t"))[1]["format"] == 1
    writers.write_table(frames, str(tmp_path / "t"), {"columns": ["x"]})
    assert readers.training_table(spark, str(tmp_path / "t"))[1] == {"format": 1, "columns": ["x"]}
    with pytest.raises(readers.GoldDataError):
        readers.training_table(spark, str(tmp_path / "none"))
    writers.create_profile(spark, str(tmp_path / "p.json"), {"a": 1})
    with pytest.raises(FileExistsError):
        writers.create_profile(spark, str(tmp_path / "p.json"), {"a": 2})
    assert files.read(spark, str(tmp_path / "p.json")).split() == ["{", '"a":', "1", "}"]
    assert readers.config({"a": {"b": 1}, "c": True}, {"a": {"b": 2}}, {"ETHO_A__B": "3", "ETHO_C": "no"}) == {"a": {"b": 3}, "c": False}


def test_segments_round_trip(spark, tmp_path):
    rows = [("F_1", 0.0, 2.0, 2.0, CONTROLLED, "auto"), ("F_1", 2.0, 3.0, 1.0, DEAD, "manual"), ("M 2", 0.0, 1.0, 1.0, LISTING, "auto"), ("a+b", 0.0, 1.0, 1.0, DEAD, "auto")]
    segs = spark.createDataFrame(rows, "video_id string, start_s double, end_s double, duration_s double, state string, source string")
    writers.write_segments(segs, f"{tmp_path}/out")
    back = readers.segments(spark, f"{tmp_path}/out").select(*segs.columns).collect()
    assert sorted(map(tuple, back)) == rows
    segs.where("video_id = 'F_1'").drop("video_id").coalesce(1).write.option("header", True).csv(f"{tmp_path}/plain/F_1")
    assert {r.video_id for r in readers.segments(spark, f"{tmp_path}/plain").collect()} == {"F_1"}


def test_small_files(spark, tmp_path):
    path = f"{tmp_path}/x/y.json"
    with pytest.raises(FileNotFoundError):
        files.read(spark, path)
    for text in ("one", "zwölf\nlines", ""):
        files.replace(spark, path, text)
        assert files.read(spark, path) == text
    with pytest.raises(FileExistsError):
        files.write_new(spark, path, "other")
    assert files.read(spark, path) == ""


def test_upsert_and_index(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "video_id string, n int")
    assert sorted(map(tuple, review.upsert(old, old.where("n = 1").withColumn("n", F.lit(9))).collect())) == [("a", 9), ("b", 2)]
    m = spark.createDataFrame([("a", "ACCEPTED", None), ("b", "AUTO", "x")], "video_id string, review_status string, strain string")
    prev = spark.createDataFrame([("a", "wild")], "video_id string, strain string")
    assert [(r.video_id, r.strain) for r in review.rebuild_index(m, prev, ["strain"]).collect()] == [("a", "wild")]
    ch = spark.createDataFrame([("a", "AUTO", "ACCEPTED"), ("b", "ACCEPTED", "AUTO")], "video_id string, old_status string, new_status string")
    assert [r.allowed for r in review.allowed_transitions(ch).orderBy("video_id").collect()] == [True, False]


def test_coco(spark):
    rows = [("a.png", "train", 10, 10, "v", 1, True, [0.0, 0.0, 2.0, 3.0], {"nose": (1.0, 1.0, 2)}), ("b.png", "train", 10, 10, "v", 2, False, None, None), ("c.png", "test", 10, 10, "v", 3, True, [0.0] * 4, None)]
    df = spark.createDataFrame(rows, "image string, split string, width int, height int, video_id string, frame_idx int, visible boolean, box array<double>, points map<string,struct<x:double,y:double,v:int>>")
    got = writers.coco(df, ["nose", "tail"], "train").collect()
    assert Counter(r.kind for r in got) == {"image": 2, "annotation": 1}
    a = json.loads(next(r.json for r in got if r.kind == "annotation"))
    assert a["bbox"] == [0, 0, 2, 3] and a["area"] == 6 and a["keypoints"] == [1, 1, 2, 0, 0, 0]


def test_stateful_tracker_gives_batch_result_over_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [("v", i, None if rng.random() < 0.2 else rng.uniform(0, 20), rng.uniform(0, 20)) for i in range(60)]
    schema = "video_id string, frame_idx int, x double, y double"
    want = {r.frame_idx: (r.x, r.detected) for r in live.reject_jumps(spark.createDataFrame(rows, schema), 6.0, 3).collect()}
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = live.stream_reject_jumps(src, 6.0, 3).writeStream.format("memory").queryName("jumps").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.frame_idx: (r.x, r.detected) for r in spark.table("jumps").collect()} == want


def test_models_predict_every_class(spark):
    rng = random.Random(1)
    rows = [(f"v{i}", "ab"[i % 2], f"2024-01-{1 + i % 4:02d}", float(i % 2) + rng.uniform(-0.2, 0.2)) for i in range(60)]
    t = spark.createDataFrame(rows, "video_id string, label string, date string, f double").withColumn("date", F.col("date").cast("date"))
    train, test = models.standardised(t.where("video_id < 'v4'"), t.where("video_id >= 'v4'"), ["f"])
    for name in ("majority", "date_only", "logistic", "forest"):
        got = models.MODELS[name](train, test).groupBy("video_id").agg(F.sum("p").alias("s"), F.max_by("cls", "p").alias("c"), F.first("label").alias("l")).collect()
        assert all(r.s == pytest.approx(1) for r in got), name
        assert name in ("majority", "date_only") or all(r.c == r.l for r in got), name


def test_rare_class_weighs_as_much(spark):
    """Where classes overlap, a rare one is predicted about as often as a common one at equal weights; without weights hardly ever."""
    rng = random.Random(4)
    rows = [(f"v{i:03d}", "b" if i % 10 == 0 else "a", "2024-01-01", 0.7 * (i % 10 == 0) + rng.gauss(0, 0.5)) for i in range(600)]
    t = spark.createDataFrame(rows, "video_id string, label string, date string, f double").withColumn("date", F.col("date").cast("date"))
    assert models.repeated(models.with_weights(t)).groupBy("label").count().where("label = 'b'").first()["count"] == 60 * 20
    train, test = models.standardised(t.where("video_id < 'v300'"), t.where("video_id >= 'v300'"), ["f"])
    for name in ("boosting", "network"):
        got = models.MODELS[name](train, test).groupBy("video_id").agg(F.sum("p").alias("s"), F.max_by("cls", "p").alias("c"), F.first("label").alias("l")).collect()
        assert len(got) == 300 and all(r.s == pytest.approx(1) for r in got), name
        assert sum(r.c == "b" for r in got if r.l == "b") >= 12, name


def test_empty_tables(spark):
    none = spark.createDataFrame([], COLUMNS)
    f = kinematics.features(none, 5, 12.0, 3)
    assert f.count() == 0 and features.kinematic_features(f).count() == 0 and flags.undetected_gaps(none).count() == 0
    s = labeling.classify(kinematics.smoothed_speed(none, 1.0), 3.0, 2.0, 6.0, 2.0, 1.0).withColumn("source", F.lit("auto"))
    assert features.segment_features(labeling.segments(s)).count() == 0


def test_dates_of_numbers_take_six_digits(spark):
    cells = [(240229,), (230229,), (70809,), (0,), (-1,), (None,), (991231,), (991301,), (1111231,), (1140101,), (24010299999,)]
    got = spark.createDataFrame(cells, "n long").select(fn.parse_yymmdd(F.col("n")).cast("string")).collect()
    assert [r[0] for r in got] == ["2024-02-29", None, "2007-08-09", None, None, None, "2099-12-31", None, "2011-11-23", None, "2024-01-02"]


def test_labelling_tasks_grow_with_rows_and_sets():
    assert [calibrate.dealt(n, 4, 8) for n in (0, 800_000, 6_000_000, 36_000_000)] == [8, 8, 60, 360]
    assert calibrate.dealt(6_000_000, 9, 8) == 135 and calibrate.dealt(0, 1) == 1


def test_labelling_is_dealt_by_its_number_of_rows(spark, monkeypatch):
    rows = [(f"v{v}", i, i * 1.0, True, 10.0, None, float(v + i % 3), True, "g") for v in range(12) for i in range(20)]
    t = spark.createDataFrame(rows, "video_id string, frame_idx int, t_sec double, detected boolean, y_from_frame_top double, orientation_deg double, speed double, speed_valid boolean, grp string")
    targets = spark.createDataFrame([("g", "Controlled Swim", 1.0)], "grp string, state string, proportion double")
    sets = [{"freeze": 1.0, "erratic": 9.0}, {"freeze": 3.0, "erratic": 6.0}]
    want = sorted(map(tuple, calibrate.score_sets(t, targets, sets, ["Controlled Swim"]).collect()))
    monkeypatch.setattr(calibrate, "COPIES", 40)
    got = calibrate.score_sets(t, targets, sets, ["Controlled Swim"])
    assert "hashpartitioning(video_id" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", 12), REPARTITION_BY_NUM" in plan
    assert sorted(map(tuple, got.collect())) == want and len(want) == 2
