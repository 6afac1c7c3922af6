"""SQL of the time-series queries, written independently of their operators."""

from __future__ import annotations

TRACKS = """
WITH b AS (
  SELECT user_id, event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 11 // 10 AS INTEGER) AS frame_idx,
         CAST((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3600000000.0 AS DOUBLE) AS t_sec
  FROM events),
tracks AS (
  SELECT 'F_' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS video_id, frame_idx, t_sec,
         CASE WHEN event_type <> 'error' THEN value ELSE 0.0 END AS x, CASE WHEN event_type <> 'error' THEN k * 2.4 ELSE 0.0 END AS y,
         CASE WHEN event_type NOT IN ('error', 'signup') THEN ((event_id * 37) % 1800) / 10.0 END AS orientation_deg,
         CASE WHEN event_type <> 'error' THEN k * 2.4 END AS y_from_frame_top, event_type <> 'error' AS detected, event_type, event_id
  FROM b),
"""
RUNS = """
br AS (SELECT *, row_number() OVER w AS pos, lag(detected) OVER w AS d0, lag(t_sec) OVER w AS t0, lag(x) OVER w AS x0, lag(y) OVER w AS y0,
              lag(orientation_deg) OVER w AS o0, frame_idx - lag(frame_idx) OVER w AS df
       FROM tracks WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)),
isl AS (SELECT *, sum(CASE WHEN detected AND coalesce(d0, false) AND coalesce(df, 0) = 1 THEN 0 ELSE 1 END)
                  OVER (PARTITION BY video_id ORDER BY frame_idx) AS run FROM br),
rl AS (SELECT *, CASE WHEN detected THEN row_number() OVER (PARTITION BY video_id, run ORDER BY frame_idx) ELSE 0 END AS run_length FROM isl),
vel AS (SELECT *, t_sec - t0 AS dt, sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0)) AS step,
               coalesce(run_length >= 2 AND t_sec - t0 > 0, false) AS velocity_valid FROM rl),
vv AS (SELECT *, CASE WHEN velocity_valid THEN step / dt ELSE 0.0 END AS velocity FROM vel),
acc AS (SELECT *, velocity_valid AND coalesce(lag(velocity_valid) OVER w, false) AS acceleration_valid, lag(velocity) OVER w AS v0,
               coalesce(detected AND d0 AND df = 1 AND orientation_deg IS NOT NULL AND o0 IS NOT NULL AND dt > 0, false) AS angular_valid
        FROM vv WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)),
kin AS (SELECT *, CASE WHEN acceleration_valid THEN (velocity - v0) / dt ELSE 0.0 END AS acceleration,
               CASE WHEN angular_valid THEN ((((orientation_deg - o0 + 90.0) % 180.0) + 180.0) % 180.0 - 90.0) / dt ELSE 0.0 END AS angular_velocity,
               CASE WHEN run_length >= 2 THEN degrees(atan2(y - y0, x - x0)) END AS heading FROM acc),
tn AS (SELECT *, CASE WHEN run_length >= 3 THEN abs(((heading - lag(heading) OVER (PARTITION BY video_id, run ORDER BY frame_idx) + 180.0) % 360.0 + 360.0) % 360.0 - 180.0) END AS turn,
              CASE WHEN run_length >= 2 THEN step END AS dist FROM kin),
mea AS (SELECT *, coalesce(sum(turn) OVER m, 0) AS turns, coalesce(sum(dist) OVER m, 0) AS dists,
               sum(CASE WHEN velocity_valid AND velocity <= 12.0 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS is_immobile
        FROM tn WINDOW m AS (PARTITION BY video_id, run ORDER BY frame_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
"""
SPEED = """
ps AS (SELECT *, row_number() OVER w AS pos, t_sec - lag(t_sec) OVER w AS gap, frame_idx - lag(frame_idx) OVER w AS df
       FROM tracks WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)),
md AS (SELECT video_id, list_sort(list(gap)) AS gs FROM ps WHERE df = 1 AND gap > 0 GROUP BY video_id),
lg AS (SELECT video_id, greatest(1, CAST(round_even(24.0 / gs[len(gs) // 2 + 1], 0) AS INTEGER)) AS lag_rows FROM md),
sp AS (SELECT p.*, lg.lag_rows,
              CASE WHEN p.detected AND b.detected AND p.frame_idx - b.frame_idx = lg.lag_rows AND p.t_sec > b.t_sec
                   THEN sqrt((p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y)) / (p.t_sec - b.t_sec) END AS sb,
              CASE WHEN p.detected AND f.detected AND f.frame_idx - p.frame_idx = lg.lag_rows AND f.t_sec > p.t_sec
                   THEN sqrt((f.x - p.x) * (f.x - p.x) + (f.y - p.y) * (f.y - p.y)) / (f.t_sec - p.t_sec) END AS sf
       FROM ps p LEFT JOIN lg ON p.video_id = lg.video_id LEFT JOIN ps b ON b.video_id = p.video_id AND b.pos = p.pos - lg.lag_rows
       LEFT JOIN ps f ON f.video_id = p.video_id AND f.pos = p.pos + lg.lag_rows),
spd AS (SELECT *, coalesce(sb, sf, 0.0) AS speed, coalesce(sb, sf) IS NOT NULL AS speed_valid FROM sp),
"""


def _states(listing: bool) -> str:
    tilted = "detected AND coalesce(abs(orientation_deg - 90) >= 40.0, false)" if listing else "false"
    return SPEED + f"""
ho AS (SELECT *, speed_valid AND speed <= 3.0 AS still, {tilted} AS tilted FROM spd),
hb AS (SELECT *, lag(still) OVER w AS s0, lag(tilted) OVER w AS l0 FROM ho WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)),
hr AS (SELECT *, sum(CASE WHEN still AND coalesce(s0, false) AND coalesce(df, 0) = 1 THEN 0 ELSE 1 END) OVER w AS sr,
              sum(CASE WHEN tilted AND coalesce(l0, false) AND coalesce(df, 0) = 1 THEN 0 ELSE 1 END) OVER w AS lr
       FROM hb WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)),
hs AS (SELECT *, max(t_sec) OVER s - min(t_sec) OVER s AS span, max(t_sec) OVER l - min(t_sec) OVER l AS lspan, max(sr) OVER (PARTITION BY video_id) AS lastrun
       FROM hr WINDOW s AS (PARTITION BY video_id, sr), l AS (PARTITION BY video_id, lr)),
dead AS (SELECT *, still AND sr = lastrun AND span >= 8.0 AS is_dead FROM hs),
st AS (SELECT *, 'auto' AS source, CASE WHEN NOT detected THEN 'Undetermined' WHEN is_dead THEN 'Dead' WHEN y_from_frame_top <= 20.0 THEN 'Surface Breach'
       WHEN tilted AND lspan >= 5.0 THEN 'Listing/LORR' WHEN still AND span >= 8.0 THEN 'Freezing/Drift' WHEN NOT speed_valid THEN 'Undetermined'
       WHEN speed >= 6.0 THEN 'Erratic Movement' ELSE 'Controlled Swim' END AS state FROM dead),
"""


STATES = _states(False)
BINS = """
vt AS (SELECT video_id, CAST(floor(t_sec / 24.0 + 1e-9) AS INTEGER) AS bin, count(*) AS n, count(*) FILTER (state = 'Controlled Swim') AS n_0,
              count(*) FILTER (state = 'Erratic Movement') AS n_1, count(*) FILTER (state = 'Freezing/Drift') AS n_2, count(*) FILTER (state = 'Surface Breach') AS n_3,
              count(*) FILTER (state = 'Listing/LORR') AS n_4, count(*) FILTER (state = 'Dead') AS n_5, count(*) FILTER (state = 'Undetermined') AS n_6,
              count(*) FILTER (detected) AS n_detected, median(speed) FILTER (speed_valid AND detected) AS speed_median, min(y_from_frame_top) AS y_min
       FROM st GROUP BY ALL),
wn AS (SELECT *, CASE WHEN n = n_6 OR (n - n_6) / n < 0.5 THEN 'Undetermined' WHEN n_3 > 0 AND n_5 * 2 < n - n_6 THEN 'Surface Breach'
              WHEN n_0 + n_1 + n_2 + n_4 + n_5 = 0 THEN 'Undetermined'
              WHEN n_5 >= greatest(n_0, n_1, n_2, n_4) THEN 'Dead' WHEN n_4 >= greatest(n_0, n_1, n_2) THEN 'Listing/LORR'
              WHEN n_2 >= greatest(n_0, n_1) THEN 'Freezing/Drift' WHEN n_1 >= n_0 THEN 'Erratic Movement' ELSE 'Controlled Swim' END AS winner FROM vt),
"""
LABELLED = """
lab AS (SELECT *, CASE event_type WHEN 'click' THEN 'Controlled Swim' WHEN 'purchase' THEN 'Erratic Movement' WHEN 'view' THEN 'Freezing/Drift'
                  WHEN 'signup' THEN 'Surface Breach' ELSE 'Undetermined' END AS state,
               CASE WHEN event_id % 5 = 0 THEN 'manual' ELSE 'auto' END AS source FROM tracks),
"""


def _segments(of: str, gaps: bool = True) -> str:
    gap = "OR frame_idx - lag(frame_idx) OVER w <> 1" if gaps else ""
    return f"""
sg0 AS (SELECT video_id, frame_idx, state, source, CAST(CAST(t_sec AS FLOAT) AS DOUBLE) AS t FROM {of}),
sg1 AS (SELECT *, t - lag(t) OVER w AS gap, CASE WHEN lag(state) OVER w IS NULL OR state <> lag(state) OVER w OR source <> lag(source) OVER w {gap} THEN 1 ELSE 0 END AS brk
        FROM sg0 WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)),
sg2 AS (SELECT *, sum(brk) OVER (PARTITION BY video_id ORDER BY frame_idx) AS seg FROM sg1),
sg3 AS (SELECT video_id, seg, min(t) AS start_s, max(t) AS last_t, arg_min(state, frame_idx) AS state, arg_min(source, frame_idx) AS source FROM sg2 GROUP BY video_id, seg),
sgm AS (SELECT video_id, coalesce(median(gap), 0.0) AS spacing FROM sg1 GROUP BY video_id),
segs AS (SELECT video_id, seg, start_s, coalesce(lead(start_s) OVER (PARTITION BY video_id ORDER BY seg), last_t + spacing) AS end_s, state, source
         FROM sg3 JOIN sgm USING (video_id)),
"""


BOUTS = """
bo0 AS (SELECT *, end_s - start_s AS duration_s, CASE WHEN state = lag(state) OVER (PARTITION BY video_id ORDER BY start_s, seg) THEN 0 ELSE 1 END AS brk FROM segs),
bo1 AS (SELECT *, sum(brk) OVER (PARTITION BY video_id ORDER BY start_s, seg) AS bout FROM bo0),
bts AS (SELECT video_id, bout, any_value(state) AS state, min(start_s) AS start_s, sum(duration_s) AS duration_s FROM bo1 GROUP BY video_id, bout),
"""
EDITS = """
ed AS (SELECT video_id, edit_no, e0, e1, new_state FROM (SELECT DISTINCT video_id FROM tracks)
       CROSS JOIN (VALUES (1, 100.0, 200.0, 'Dead'), (2, 150.0, 260.0, 'Surface Breach'), (3, 120.0, 160.0, 'Freezing/Drift')) v(edit_no, e0, e1, new_state)),
"""
OVERLAY = EDITS + """
cu AS (SELECT DISTINCT video_id, t FROM (SELECT video_id, start_s AS t FROM segs UNION ALL SELECT video_id, end_s FROM segs
       UNION ALL SELECT video_id, CAST(e0 AS DOUBLE) FROM ed UNION ALL SELECT video_id, CAST(e1 AS DOUBLE) FROM ed)),
pc AS (SELECT video_id, t, lead(t) OVER (PARTITION BY video_id ORDER BY t) AS tend FROM cu),
pb AS (SELECT pc.video_id, pc.t, pc.tend, s.state AS s_state, s.source AS s_source, arg_max(ed.new_state, ed.edit_no) AS edit
       FROM pc JOIN segs s ON s.video_id = pc.video_id AND pc.t >= s.start_s AND pc.tend <= s.end_s
       LEFT JOIN ed ON ed.video_id = pc.video_id AND pc.t >= ed.e0 AND pc.tend <= ed.e1 WHERE pc.tend IS NOT NULL GROUP BY ALL),
pe AS (SELECT video_id, t, tend, coalesce(edit, s_state) AS state, CASE WHEN edit IS NULL THEN s_source ELSE 'manual' END AS source FROM pb),
pf AS (SELECT *, CASE WHEN state = lag(state) OVER w AND source = lag(source) OVER w AND t = lag(tend) OVER w THEN 0 ELSE 1 END AS brk
       FROM pe WINDOW w AS (PARTITION BY video_id ORDER BY t)),
pg AS (SELECT *, sum(brk) OVER (PARTITION BY video_id ORDER BY t) AS run FROM pf),
ov AS (SELECT video_id, min(t) AS start_s, max(tend) AS end_s, any_value(state) AS state, any_value(source) AS source FROM pg GROUP BY video_id, run),
"""


def _q(ctes: str, select: str) -> str:
    return TRACKS + ctes.rstrip().rstrip(",") + "\n" + select if ctes else TRACKS.rstrip().rstrip(",") + "\n" + select


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0 AS {n}" for n in names)


_SLUGS = {"Controlled Swim": "controlled_swim", "Erratic Movement": "erratic_movement", "Freezing/Drift": "freezing_drift",
          "Surface Breach": "surface_breach", "Listing/LORR": "listing_lorr", "Dead": "dead"}


def _segment_features(every: bool) -> str:
    cols = ["video_id"]
    for s, k in _SLUGS.items():
        cols.append(f"round(coalesce(sum(duration_s) FILTER (state = '{s}'), 0) / sum(duration_s) FILTER (state <> 'Undetermined'), 6) + 0 AS state_{k}_share")
        if every:
            cols.append(f"CAST(count(*) FILTER (state = '{s}') AS DOUBLE) AS state_{k}_bouts")
            cols.append(f"round(coalesce(avg(duration_s) FILTER (state = '{s}'), 0), 6) + 0 AS state_{k}_mean_bout_s")
            cols.append(f"round(coalesce(min(start_s) FILTER (state = '{s}') - min(first_s), min(recording_s)), 6) + 0 AS state_{k}_latency_s")
    if every:
        cols += [f"CAST(count(*) FILTER (state = '{a}' AND nxt = '{b}') AS DOUBLE) AS trans_{_SLUGS[a]}_to_{_SLUGS[b]}" for a in _SLUGS for b in _SLUGS if a != b]
    cols.append("round(min(recording_s), 6) + 0 AS recording_s")
    return f"""
SELECT {", ".join(cols)} FROM (SELECT *, lead(state) OVER (PARTITION BY video_id ORDER BY bout) AS nxt, min(start_s) OVER (PARTITION BY video_id) AS first_s,
       sum(duration_s) OVER (PARTITION BY video_id) AS recording_s FROM bts)
GROUP BY video_id HAVING sum(duration_s) FILTER (state <> 'Undetermined') > 0"""


_SEG = LABELLED + _segments("lab")
_SEGCOLS = "SELECT video_id, round(start_s, 6) + 0 AS start_s, round(end_s, 6) + 0 AS end_s, round(end_s - start_s, 6) + 0 AS duration_s, state, source FROM segs"

ORACLE = {
    "run_length": _q(RUNS, "SELECT video_id, frame_idx, CAST(run_length AS INTEGER) AS run_length FROM rl"),
    "velocity": _q(RUNS, f"SELECT video_id, frame_idx, {_r('velocity')}, velocity_valid FROM vv"),
    "acceleration": _q(RUNS, f"SELECT video_id, frame_idx, {_r('acceleration')}, acceleration_valid FROM kin"),
    "angular_velocity": _q(RUNS, f"SELECT video_id, frame_idx, {_r('angular_velocity')}, angular_valid FROM kin"),
    "meander": _q(RUNS, "SELECT video_id, frame_idx, round(CASE WHEN dists > 1e-9 THEN turns / dists ELSE 0 END, 6) + 0 AS meander FROM mea"),
    "immobility": _q(RUNS, "SELECT video_id, frame_idx, is_immobile FROM mea"),
    "smoothed_speed": _q(SPEED, f"SELECT video_id, frame_idx, lag_rows, {_r('speed')}, speed_valid FROM spd"),
    "classify_states": _q(STATES, "SELECT video_id, frame_idx, state FROM st"),
    "listing_states": _q(_states(True), "SELECT video_id, frame_idx, state FROM st"),
    "dead_suffix": _q(STATES, "SELECT video_id, frame_idx FROM dead WHERE is_dead"),
    "consolidate_bins": _q(STATES + BINS, "SELECT video_id, bin, n, winner AS state FROM wn"),
    "consolidated_states": _q(STATES + BINS, "SELECT st.video_id, st.frame_idx, wn.bin, wn.winner AS state FROM st JOIN wn ON st.video_id = wn.video_id AND CAST(floor(st.t_sec / 24.0 + 1e-9) AS INTEGER) = wn.bin"),
    "dead_violations": _q(STATES, "SELECT video_id, frame_idx, state FROM (SELECT *, max(CASE WHEN state = 'Dead' THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d FROM st) WHERE d = 1 AND state <> 'Dead'"),
    "segments": _q(_SEG, _SEGCOLS),
    "segments_ignoring_gaps": _q(LABELLED + _segments("lab", False), _SEGCOLS),
    "bouts": _q(_SEG + BOUTS, f"SELECT video_id, CAST(bout AS BIGINT) AS bout, state, {_r('start_s', 'duration_s')} FROM bts"),
    "transitions": _q(_SEG + BOUTS, "SELECT video_id, state, next_state, count(*) AS n FROM (SELECT *, lead(state) OVER (PARTITION BY video_id ORDER BY bout) AS next_state FROM bts) WHERE state <> 'Undetermined' AND next_state <> 'Undetermined' GROUP BY ALL"),
    "segments_to_frames": _q(_SEG, """SELECT l.video_id, l.frame_idx, s.state, s.source FROM lab l
       ASOF JOIN (SELECT *, coalesce(lag(end_s) OVER (PARTITION BY video_id ORDER BY seg), -1e300) AS from_s FROM segs) s ON l.video_id = s.video_id AND l.t_sec >= s.from_s"""),
    "apply_edits": _q(LABELLED + EDITS, """SELECT l.video_id, l.frame_idx, coalesce(x.new_state, l.state) AS state, CASE WHEN x.new_state IS NULL THEN l.source ELSE 'manual' END AS source
       FROM lab l LEFT JOIN (SELECT lab.video_id, lab.frame_idx, arg_max(new_state, edit_no) AS new_state FROM lab JOIN ed
         ON lab.video_id = ed.video_id AND t_sec >= e0 - 0.0005 AND t_sec < e1 - 0.0005 GROUP BY ALL) x ON l.video_id = x.video_id AND l.frame_idx = x.frame_idx"""),
    "merge_edit_intervals": _q(_SEG + OVERLAY, f"SELECT video_id, {_r('start_s', 'end_s')}, state, source FROM ov"),
    "edit_totals": _q(_SEG + OVERLAY, "SELECT video_id, state, round(sum(end_s - start_s), 6) + 0 AS seconds FROM ov GROUP BY ALL"),
    "session_flags": _q("", """SELECT video_id, round(greatest(min(t_sec) - 4.0, 0), 6) + 0 AS start_s, round(max(t_sec) + 4.0, 6) + 0 AS end_s, round(max(x), 6) + 0 AS max_score, count(*) AS n_samples
       FROM (SELECT *, sum(brk) OVER (PARTITION BY video_id ORDER BY t_sec, x) AS ses FROM
         (SELECT *, CASE WHEN t_sec - lag(t_sec) OVER (PARTITION BY video_id ORDER BY t_sec, x) <= 12.0 THEN 0 ELSE 1 END AS brk FROM tracks WHERE x >= 10.0))
       GROUP BY video_id, ses HAVING count(*) >= 2"""),
    "undetected_gaps": _q("", """SELECT video_id, start_pos, length, CAST(start_pos + length // 2 AS BIGINT) AS mid_pos FROM (
       SELECT video_id, CAST(min(pos) AS INTEGER) AS start_pos, count(*) AS length FROM (
         SELECT *, pos - row_number() OVER (PARTITION BY video_id ORDER BY pos) AS grp FROM
           (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) - 1 AS pos FROM tracks) WHERE NOT detected)
       GROUP BY video_id, grp)"""),
    "terminal_no_action": _q(SPEED, """SELECT video_id, round(start_s, 6) + 0 AS start_s, round(end_s, 6) + 0 AS end_s,
       lpad(CAST(CAST(floor(floor(start_s) / 60) AS BIGINT) AS VARCHAR), CAST(greatest(2, length(CAST(CAST(floor(floor(start_s) / 60) AS BIGINT) AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(CAST(floor(start_s) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS from_mmss
       FROM (SELECT video_id, coalesce(arg_max(t_sec, frame_idx) FILTER (speed_valid AND speed > 3.0), 0.0) AS start_s, arg_max(t_sec, frame_idx) AS end_s FROM spd GROUP BY video_id)
       WHERE end_s - start_s >= 12.0"""),
    "segment_features": _q(_SEG + BOUTS, _segment_features(True)),
    "kinematic_features": _q(RUNS, """SELECT video_id, round(vm, 6) + 0 AS velocity_mean, round(vmed, 6) + 0 AS velocity_median,
       round(CASE WHEN vm > 0 THEN vs / vm WHEN vn > 0 THEN 0 END, 6) + 0 AS velocity_cv, round(am, 6) + 0 AS abs_acceleration_mean, round(wm, 6) + 0 AS abs_angular_velocity_mean,
       round(mm, 6) + 0 AS meander_mean, round(im, 6) + 0 AS immobile_share, round(ds, 6) + 0 AS detected_share, round(dm, 6) + 0 AS depth_mean, round(dmin, 6) + 0 AS depth_min,
       round(p[1], 6) + 0 AS depth_p05, round(p[2], 6) + 0 AS depth_p25, round(p[3], 6) + 0 AS depth_p50, round(p[4], 6) + 0 AS depth_p75, round(p[5], 6) + 0 AS depth_p95
       FROM (SELECT video_id, avg(velocity) FILTER (one) AS vm, median(velocity) FILTER (one) AS vmed, stddev_pop(velocity) FILTER (one) AS vs, count(*) FILTER (one) AS vn,
         avg(abs(acceleration)) FILTER (two) AS am, avg(abs(angular_velocity)) FILTER (one) AS wm, avg(CASE WHEN dists > 1e-9 THEN turns / dists ELSE 0 END) FILTER (two) AS mm,
         avg(CASE WHEN is_immobile THEN 1.0 ELSE 0.0 END) FILTER (detected) AS im, avg(CASE WHEN detected THEN 1.0 ELSE 0.0 END) AS ds, avg(y_from_frame_top) FILTER (detected) AS dm,
         min(y_from_frame_top) FILTER (detected) AS dmin, quantile_cont(y_from_frame_top, [0.05, 0.25, 0.5, 0.75, 0.95]) FILTER (detected) AS p, count(*) FILTER (detected) AS seen
         FROM (SELECT *, one AND NOT coalesce(lag(first) OVER (PARTITION BY video_id ORDER BY frame_idx), false) AS two FROM
           (SELECT *, detected AND NOT coalesce(d0, false) AS first, detected AND coalesce(d0, false) AS one FROM mea))
         GROUP BY video_id) WHERE seen > 0"""),
    "undetermined_share": _q(_SEG, "SELECT video_id, round(CASE WHEN sum(end_s - start_s) > 0 THEN coalesce(sum(end_s - start_s) FILTER (state = 'Undetermined'), 0) / sum(end_s - start_s) ELSE 0 END, 6) + 0 AS undetermined_share FROM segs GROUP BY video_id"),
    "state_seconds": _q(_SEG, "SELECT video_id, state, round(sum(end_s - start_s), 6) + 0 AS seconds, count(*) AS segments FROM segs GROUP BY ALL"),
    "timeline": _q(LABELLED + RUNS.replace("FROM tracks WINDOW", "FROM lab WINDOW"), """, du AS (SELECT video_id, coalesce(median(t_sec - t0), 0) AS spacing, max(t_sec) AS last_t FROM vv GROUP BY video_id),
       bn AS (SELECT *, last_t + spacing AS duration_s, unnest(range(0, CAST(ceil((last_t + spacing) / 60.0) AS BIGINT))) AS bin FROM du),
       ag AS (SELECT video_id, CAST(floor(t_sec / 60.0) AS BIGINT) AS bin, count(*) FILTER (state <> 'Undetermined') AS known, avg(velocity) FILTER (detected AND d0) AS speed,
         count(*) FILTER (state = 'Controlled Swim') AS c0, count(*) FILTER (state = 'Erratic Movement') AS c1, count(*) FILTER (state = 'Freezing/Drift') AS c2,
         count(*) FILTER (state = 'Surface Breach') AS c3, count(*) FILTER (state = 'Listing/LORR') AS c4, count(*) FILTER (state = 'Dead') AS c5 FROM vv GROUP BY ALL)
       SELECT bn.video_id, CAST(bn.bin AS INTEGER) AS bin, bn.bin * 60.0::DOUBLE + 0 AS start_s, round(least((bn.bin + 1) * 60.0::DOUBLE, duration_s), 6) + 0 AS end_s,
         round(coalesce(known, 0) * spacing, 6) + 0 AS known_s, round(speed, 6) + 0 AS speed, round(c0 / nullif(known, 0), 6) + 0 AS share_controlled_swim,
         round(c1 / nullif(known, 0), 6) + 0 AS share_erratic_movement, round(c2 / nullif(known, 0), 6) + 0 AS share_freezing_drift, round(c3 / nullif(known, 0), 6) + 0 AS share_surface_breach,
         round(c4 / nullif(known, 0), 6) + 0 AS share_listing_lorr, round(c5 / nullif(known, 0), 6) + 0 AS share_dead
       FROM bn LEFT JOIN ag ON bn.video_id = ag.video_id AND bn.bin = ag.bin"""),
    "explain_bins": _q(STATES + BINS, "SELECT video_id, bin, n, n_detected, round(speed_median, 6) + 0 AS speed_median, round(y_min, 6) + 0 AS y_min, n_0, n_1, n_2, n_3, n_4, n_5, n_6, winner FROM wn"),
    "downsample_first": _q("", "SELECT video_id, frame_idx, round(t_sec, 6) + 0 AS t_sec FROM (SELECT *, floor(t_sec / 10.0) AS f, lag(floor(t_sec / 10.0)) OVER (PARTITION BY video_id ORDER BY frame_idx) AS f0 FROM tracks) WHERE f0 IS NULL OR f <> f0"),
    "strided_expand": _q("""sa AS (SELECT * FROM tracks WHERE frame_idx % 5 = 0),
       ev AS (SELECT video_id, CAST(unnest(range(0, max(frame_idx) + 1)) AS INTEGER) AS frame_idx FROM sa GROUP BY video_id),""", """
       SELECT e.video_id, e.frame_idx, round(CASE WHEN a.detected AND b.detected THEN a.x + (e.frame_idx % 5) / 5.0 * (b.x - a.x) WHEN a.detected THEN a.x ELSE 0 END, 6) + 0 AS x,
         round(CASE WHEN a.detected AND b.detected THEN a.y + (e.frame_idx % 5) / 5.0 * (b.y - a.y) WHEN a.detected THEN a.y ELSE 0 END, 6) + 0 AS y, coalesce(a.detected, false) AS detected
       FROM ev e LEFT JOIN sa a ON a.video_id = e.video_id AND a.frame_idx = e.frame_idx - e.frame_idx % 5
       LEFT JOIN sa b ON b.video_id = e.video_id AND b.frame_idx = e.frame_idx - e.frame_idx % 5 + 5"""),
    "flagship": _q(STATES + BINS + "cs AS (SELECT st.video_id, st.frame_idx, st.t_sec, wn.winner AS state, st.source FROM st JOIN wn ON st.video_id = wn.video_id AND CAST(floor(st.t_sec / 24.0 + 1e-9) AS INTEGER) = wn.bin),"
                   + _segments("cs") + BOUTS, _segment_features(False)),
}
