"""Networks, folds, training tasks, saved models and studies against plain loops."""

import datetime
import hashlib
import random
from collections import Counter, defaultdict
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethogrid.operators import artifact, evaluation, networks, passes, studies, training
from ethogrid.operators import folds as folding
from ethogrid.operators.networks import Settings

SMALL = Settings(hidden=(6, 4), dropout=0.2, rate=0.01, batch=8, epochs=30, patience=4, members=3)
SCHEMA = "video_id string, compound string, concentration_mM string, label string, date date, a double, b double, sex string, extra string, model string, fold int"


def subject_rows(n=150, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        comp = rng.choice(["CTRL", "CTRL", "X", "X", "Y", "Z"])
        dose = rng.choice(["1", "2", "3"]) if comp == "X" else rng.choice(["1", "2"]) if comp == "Y" else "0"
        day = datetime.date(2024, 1, 1 + rng.randint(0, 6)) if comp != "Z" else datetime.date(2024, 1, 3)
        a = None if rng.random() < 0.1 else rng.expovariate(1) * (3 if comp == "X" else 1)
        b = float("nan") if rng.random() < 0.1 else rng.gauss({"CTRL": 0, "X": 1, "Y": 2, "Z": 3}[comp], 1)
        rows.append((f"v{i:03d}", comp, dose, comp, day, a, b, rng.choice(["F", "M", None]), "e", "m", 7))
    rows.append(("v900", "X", "1", "X", None, 1.0, 2.0, "F", "e", "m", 7))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(subject_rows(), SCHEMA).repartition(3).cache()


# --- numpy -------------------------------------------------------------------------------------------


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(1)
    params = networks.layers(5, 3, (7, 4), rng)
    x, codes, weight = rng.normal(size=(11, 5)), rng.integers(0, 3, 11), np.array([0.5, 2.0, 1.0])
    for masks in (None, [rng.integers(0, 2, (11, h)) * 2.0 for h in (7, 4)]):
        _, grads = networks.loss_gradient(params, x, codes, weight, masks)
        for p, g in zip(params, grads, strict=True):
            for at in [np.unravel_index(i, p.shape) for i in rng.choice(p.size, min(p.size, 8), replace=False)]:
                old, values = p[at], []
                for step in (1e-6, -1e-6):
                    p[at] = old + step
                    values.append(networks.loss_gradient(params, x, codes, weight, masks)[0])
                p[at] = old
                assert (values[0] - values[1]) / 2e-6 == pytest.approx(g[at], abs=1e-6)


def test_decay_is_apart_from_the_gradient():
    p = [np.array([2.0, -4.0])]
    networks.AdamW(p, 0.1, 0.5).step(p, [np.zeros(2)])
    assert p[0].tolist() == [2.0 * 0.95, -4.0 * 0.95]
    p, q = [np.array([2.0])], [np.array([2.0])]
    networks.AdamW(p, 0.1, 0.0).step(p, [np.array([1e-3])])
    networks.AdamW(q, 0.1, 0.0).step(q, [np.array([1e3])])
    assert p[0] == pytest.approx(1.9, abs=1e-4) and q[0] == pytest.approx(1.9, abs=1e-4)  # the step does not depend on the slope's size


def test_training_stops_early_and_keeps_the_best_epoch():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4))
    codes = (x[:, 0] + rng.normal(0, 1.5, 120) > 0).astype(int)
    s = Settings(hidden=(16,), dropout=0.1, rate=0.03, epochs=200, patience=5, batch=16)
    got = networks.fit_network(x, codes, 2, s, 7)
    assert got["epochs"] == got["best"] + 5 < 200
    cut = networks.fit_network(x, codes, 2, Settings(**{**s.__dict__, "epochs": int(got["best"])}), 7)
    assert all((cut[k] == got[k]).all() for k in cut if k[0] == "p")
    other = networks.fit_network(x, codes, 2, s, 8)
    assert any((other[k] != got[k]).any() for k in other if k[0] == "p")


def test_network_learns_what_a_line_cannot():
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, (400, 2))
    codes = (x[:, 0] * x[:, 1] > 0).astype(int)
    s = Settings(hidden=(24,), dropout=0.0, rate=0.02, epochs=120, patience=30, batch=32)
    p = networks.predict("network", networks.fit_network(x, codes, 2, s, 1), x, np.zeros(400))
    assert (p.argmax(axis=1) == codes).mean() > 0.93
    line = networks.predict("logistic", networks.fit_logistic(x, codes, 2), x, np.zeros(400))
    assert (line.argmax(axis=1) == codes).mean() < 0.7


def test_weights_and_held_rows():
    codes = np.array([0] * 8 + [2] * 2)
    assert networks.balanced_weights(codes, 3).tolist() == [10 / 16, 0, 10 / 4]
    held = networks.held_rows(np.array([0] * 20 + [1] * 5 + [2] * 2), 0.2, np.random.default_rng(1))
    assert [held[:20].sum(), held[20:25].sum(), held[25:].sum()] == [4, 1, 1]
    one = networks.held_rows(np.array([0, 0, 0, 1]), 0.2, np.random.default_rng(1))
    assert one.sum() == 1
    assert networks.held_rows(np.array([0]), 0.5, np.random.default_rng(1)).sum() == 0


def test_logistic_is_at_its_optimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 3))
    codes = np.minimum(rng.integers(0, 4, 90), 2)
    w = networks.fit_logistic(x, codes, 3)["w"]
    z, weight, y = np.column_stack([x, np.ones(90)]), networks.balanced_weights(codes, 3)[codes], np.eye(3)[codes]
    g = z.T @ ((networks.softmax(z @ w) - y) * weight[:, None])
    g[:-1] += w[:-1]
    assert np.abs(g).max() < 1e-4


def test_scaler_fills_logs_and_flags():
    x = np.array([[0.0, 1.0], [np.nan, 2.0], [3.0, 2.0], [8.0, np.nan]])
    c = np.array([["F"], [""], ["M"], ["F"]])
    s = networks.fit_scaler(x, c, np.array([0]))
    assert s["level"].tolist() == ["F", "M"]
    assert s["fill"][0] == pytest.approx(np.log1p(3.0)) and s["fill"][1] == 2.0
    z = networks.scaled(s, x, c)
    assert z.mean(axis=0) == pytest.approx(np.zeros(4)) and z.std(axis=0) == pytest.approx(np.ones(4))
    new = networks.scaled(s, np.array([[np.nan, 5.0]]), np.array([["Q"]]))
    assert new[0, 0] == pytest.approx((s["fill"][0] - s["mean"][0]) / s["sd"][0])
    assert (new[0, 2:] == (0 - s["mean"][2:]) / s["sd"][2:]).all()  # an unseen level has all 0
    empty = networks.fit_scaler(np.full((2, 1), np.nan), np.zeros((2, 0), dtype=str), np.zeros(0, int))
    assert empty["fill"].tolist() == [0.0] and empty["sd"].tolist() == [1.0]


def test_dates_predict_the_nearest_days_mix():
    codes, days = np.array([0, 0, 1, 1, 1]), np.array([1.0, 1.0, 1.0, 5.0, np.nan])
    p = networks.predict("date_only", networks.fit_days(codes, days, 2), np.zeros((4, 1)), np.array([1.0, 3.0, 9.0, np.nan]))
    assert p == pytest.approx(np.array([[2 / 3, 1 / 3], [2 / 3, 1 / 3], [0, 1], [0.4, 0.6]]))  # 3 is as near to 1 as to 5: the earlier


def test_states_survive_packing():
    state = networks.fit_network(np.eye(6), np.array([0, 1, 0, 1, 0, 1]), 2, SMALL, 1)
    back = networks.unpacked(networks.packed(state))
    assert back.keys() == state.keys() and all((back[k] == state[k]).all() for k in state)


# --- folds -------------------------------------------------------------------------------------------


def slow_folds(rows, k, repeat, seed):
    """(A, B) as {id: fold} of (id, label, date text)."""
    sha = lambda *p: hashlib.sha256(":".join(map(str, (seed, repeat, *p))).encode()).hexdigest()
    rows = [r for r in rows if r[1] is not None]
    dates, by_label = defaultdict(set), defaultdict(list)
    for i, label, d in rows:
        dates[label].add(d)
        by_label[label].append(i)
    a = {i: -1 for i, label, _ in rows if len(dates[label]) == 1}
    free = [r for r in rows if len(dates[r[1]]) > 1]
    groups = defaultdict(list)
    for r in free:
        groups[r[2]].append(r)
    whole = Counter(r[1] for r in free)
    n = min(k, len(groups), max(whole.values(), default=0))
    have = [Counter() for _ in range(n)]
    for d in sorted(groups, key=lambda d: (-len(groups[d]), sha(d))):
        own = Counter(r[1] for r in groups[d])
        cost = lambda f: (sum((n * (have[f][c] + m) - whole[c]) ** 2 - (n * have[f][c] - whole[c]) ** 2 for c, m in own.items()), sum(have[f].values()), f)  # noqa: B023, E731
        best = min(range(n), key=cost)
        have[best] += own
        a |= {r[0]: best for r in groups[d]}
    if len(groups) < 2:
        a = {}
    k, start, b = min(k, max(map(len, by_label.values()), default=1)), 0, {}
    for label in sorted(by_label):
        for i, v in enumerate(sorted(by_label[label], key=lambda v: (sha(v), v))):
            b[v] = (start + i) % k
        start += len(by_label[label])
    return a, b


@pytest.mark.parametrize("k,repeats", [(5, 2), (2, 1), (40, 1)])
def test_folds_equal_a_loop(table, k, repeats):
    rows = [(r.video_id, r.label, str(r.date or "")) for r in table.collect()]
    got = {(r.scheme, r.repeat, r.video_id): r.fold for r in folding.folds(table, k, repeats, 3).collect()}
    want = {}
    for repeat in range(repeats):
        for scheme, found in zip("AB", slow_folds(rows, k, repeat, 3), strict=True):
            want |= {(scheme, repeat, i): f for i, f in found.items()}
    assert got == want
    assert {f for (s, _, i), f in got.items() if s == "A" and i in {r[0] for r in rows if r[1] == "Z"}} == {-1}


def test_folds_of_each_compound_equal_those_alone(table):
    rows = table.withColumn("label", F.col("concentration_mM"))
    got = Counter(map(tuple, folding.folds(rows, 3, 2, 1, ("compound",)).collect()))
    want = Counter()
    for c in ("CTRL", "X", "Y", "Z"):
        want += Counter((c, *r) for r in map(tuple, folding.folds(rows.where(F.col("compound") == c), 3, 2, 1).collect()))
    assert got == want
    assert not any(r[0] == "Z" and r[1] == "A" for r in got)  # all on one date: no scheme A


def test_folds_of_nothing(spark):
    assert folding.folds(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([("v", "X", "1", None, None, 1.0, 1.0, "F", "e", "m", 7)], SCHEMA)
    assert folding.folds(one).collect() == []


# --- training tasks ----------------------------------------------------------------------------------


def loop(rows, placed, keys, models, log, settings, seed):
    """Long probabilities by a plain loop over runs; rows: dicts with key, video_id, label, day, x, c."""
    out = {}
    fold_of = {(*f[:-1],): f[-1] for f in placed}  # (keys, scheme, repeat, video_id) -> fold
    runs = sorted({(*f[:-2], f[-1]) for f in placed if f[-1] >= 0})
    for run in runs:
        key, scheme, repeat, fold = run[: len(keys)], run[-3], run[-2], run[-1]
        own = [r for r in rows if tuple(r[k] for k in keys) == key and (*key, scheme, repeat, r["video_id"]) in fold_of]
        at = lambda r: fold_of[(*key, scheme, repeat, r["video_id"])]  # noqa: B023, E731
        train = sorted([r for r in own if at(r) != fold], key=lambda r: r["video_id"])
        test = [r for r in own if at(r) == fold]
        arrays = lambda rs: (np.array([[np.nan if v is None else v for v in r["x"]] for r in rs], float), np.array([r["c"] for r in rs], dtype=str).reshape(len(rs), -1), np.array([np.nan if r["day"] is None else r["day"] for r in rs]))
        (x, c, days), (tx, tc, tdays) = arrays(train), arrays(test)
        classes, codes = np.unique([r["label"] for r in train], return_inverse=True)
        scaler = networks.fit_scaler(x, c, np.array(log, int))
        for model in models:
            p = np.mean([networks.predict(model, networks.fit(model, networks.scaled(scaler, x, c), codes, days, len(classes), settings, training._seed(seed, *key, scheme, repeat, m)), networks.scaled(scaler, tx, tc), tdays)
                         for m in range(settings.members if model == "network" else 1)], axis=0)
            for r, row in zip(test, p, strict=True):
                for cls, v in zip(classes, row, strict=True):
                    out[(*run, model, r["video_id"], r["label"], str(cls))] = v
    return out


def same(got, want):
    assert got.keys() == want.keys() and len(got) > 50
    assert max(abs(got[k] - want[k]) for k in got) < 1e-9


def test_cross_fit_equals_a_loop(table):
    placed = folding.folds(table, 3, 1, 2)
    rows = training.as_rows(table, ["a", "b"], ["sex"])
    long = training.cross_fit(rows, placed, models=training.MODELS, log=[0], settings=SMALL, seed=5)
    got = {tuple(r[:-1]): r.p for r in long.collect()}
    same(got, loop([r.asDict() for r in rows.collect()], [tuple(r) for r in placed.collect()], [], training.MODELS, [0], SMALL, 5))
    sums = long.groupBy("scheme", "repeat", "model", "video_id").agg(F.sum("p").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in sums)


def test_scores_of_test_rows_do_not_reach_the_training(table, spark):
    """A test row with a wild value changes its own probabilities only."""
    placed = folding.folds(table, 3, 1, 2).where("scheme = 'B'")
    who = placed.where("fold = 1").orderBy("video_id").first().video_id
    wild = table.withColumn("b", F.when(F.col("video_id") == who, 1e6).otherwise(F.col("b")))
    one, two = ({(r.model, r.fold, r.video_id, r.cls): r.p for r in training.cross_fit(training.as_rows(t, ["a", "b"]), placed, models=("logistic",), seed=5).collect()} for t in (table, wild))
    moved = {k[2] for k in one if k[1] == 1 and abs(one[k] - two[k]) > 1e-9}
    assert moved == {who}


def test_training_rows_are_bounded(spark):
    rows = spark.range(3000).select(F.lit(0).alias("run"), F.col("id").cast("string").alias("video_id"), (F.col("id") % 2).cast("string").alias("label"), F.lit(1.0).alias("day"), F.array(F.col("id") * 1.0).alias("x"), F.array().cast("array<string>").alias("c"))
    tasks = training.tasks_of(spark.range(1).select(F.lit(0).alias("run")), ("majority", "logistic"), 1)
    got = training.fitted(rows, tasks, ["run"], most=200).collect()
    assert len(got) == 2 and all(140 < r.rows < 260 for r in got) and len({r.rows for r in got}) == 1
    again = training.fitted(rows.repartition(7), tasks, ["run"], most=200).collect()
    assert {(r.model, bytes(r.state)) for r in again} == {(r.model, bytes(r.state)) for r in got}


@pytest.fixture
def by_passes(monkeypatch):
    """Runs of a few rows are large ones."""
    monkeypatch.setattr(training, "ALONE", 20)
    monkeypatch.setattr(passes, "SLICE", 17)


def test_large_runs_are_fitted_on_all_rows(table, by_passes):
    """Baselines and logistic regression by passes over slices equal a loop over all training rows, for values that repeat, lie below 0, are missing or the same everywhere."""
    placed = folding.folds(table, 3, 2, 2)
    t = table.withColumns({"d": F.when(F.col("b") > 0, F.round("b")), "e": F.lit(None).cast("double"), "f": F.lit(-3.0)})
    rows = training.as_rows(t, ["a", "b", "d", "e", "f"], ["sex", "model"])
    models = ("majority", "date_only", "logistic")
    long = training.cross_fit(rows, placed, models=models, log=[0], settings=SMALL, seed=5)
    got = {tuple(r[:-1]): r.p for r in long.collect()}
    want = loop([r.asDict() for r in rows.collect()], [tuple(r) for r in placed.collect()], [], models, [0], SMALL, 5)
    assert got.keys() == want.keys() and len(got) > 50
    assert max(abs(got[k] - want[k]) for k in got if k[3] != "logistic") < 1e-12
    assert max(abs(got[k] - want[k]) for k in got) < 1e-4  # both stop at the same small slope
    one = training.fitted(rows.withColumn("run", F.lit(0)), training.tasks_of(table.sparkSession.range(1).select(F.lit(0).alias("run")), ("majority", "logistic"), 1), ["run"], [0]).collect()
    assert [r.rows for r in one] == [151, 151]
    x = np.array([[np.nan if v is None else v for v in r.x] for r in rows.collect()], float)
    scaler, want = {k[2:]: v for k, v in networks.unpacked(one[0].state).items() if k[0] == "s"}, networks.fit_scaler(x, np.array([r.c for r in rows.collect()]), np.array([0]))
    assert scaler.keys() == want.keys() and (scaler["fill"] == want["fill"]).all() and (scaler["level"] == want["level"]).all()
    assert scaler["mean"] == pytest.approx(want["mean"], abs=1e-12) and scaler["sd"] == pytest.approx(want["sd"], abs=1e-12)


def many_rows(spark, n):
    """More than a task's rows, of which about 1 in 9 belongs to label 1."""
    wave = F.sin(F.col("id") * 1.0)
    return spark.range(n).select(F.lit(0).alias("run"), F.col("id").cast("string").alias("video_id"), (F.col("id") % 9 == 0).cast("int").cast("string").alias("label"), (F.col("id") % 3).cast("double").alias("day"),
                                 F.array(wave, wave + (F.col("id") % 9 == 0).cast("int")).alias("x"), F.array().cast("array<string>").alias("c"))


def test_no_training_row_is_left_out(spark):
    rows = many_rows(spark, 120_000)
    tasks = training.tasks_of(spark.range(1).select(F.lit(0).alias("run")), ("majority", "date_only", "logistic"), 1)
    got = {r.model: r for r in training.fitted(rows, tasks, ["run"]).collect()}
    assert {r.rows for r in got.values()} == {120_000} and len(got) == 3
    assert (networks.unpacked(got["majority"].state)["m_prior"] * 120_000).round(6).tolist() == [106_666, 13_334]
    x = np.array([r.x for r in rows.select("x").collect()])
    assert networks.unpacked(got["logistic"].state)["s_fill"].tolist() == np.median(x, axis=0).tolist()


def test_networks_step_together_as_one_by_one():
    rng = np.random.default_rng(6)
    s = Settings(hidden=(7, 5), dropout=0.0, rate=0.01, batch=8)
    x, codes, weight = [rng.normal(size=(n, 4)) for n in (43, 40, 21)], [rng.integers(0, 3, n) for n in (43, 40, 21)], rng.uniform(0.5, 2, (3, 3))
    one = [networks.layers(4, 3, s.hidden, np.random.default_rng(k)) for k in range(3)]
    params = [np.stack(q) for q in zip(*one, strict=True)]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], np.zeros(3, np.int64)
    for _ in range(2):
        networks.epoch_together(params, m, v, t, x, codes, weight, s, rng)
    for k in range(3):
        opt = networks.AdamW(one[k], s.rate, s.decay)
        for at in 2 * list(range(0, len(codes[k]), s.batch)):
            rows = slice(at, at + s.batch)
            opt.step(one[k], networks.loss_gradient(one[k], x[k][rows], codes[k][rows], weight[k])[1])
        assert opt.t == t[k] and all(np.abs(p[k] - q).max() < 1e-12 for p, q in zip(params, one[k], strict=True))


def test_large_networks_train_on_all_rows(spark, by_passes):
    """A network dealt over slices learns what a line cannot, the same whenever it is fitted, and its rows are all seen."""
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, (400, 2))
    data = [(0, f"v{i}", str(int(a * b > 0)) if i else "once", 1.0, [float(a), float(b)], []) for i, (a, b) in enumerate(x)]
    rows = spark.createDataFrame(data, "run int, video_id string, label string, day double, x array<double>, c array<string>")
    tasks = training.tasks_of(spark.range(1).select(F.lit(0).alias("run")), ("network",), 2)
    s = Settings(hidden=(24,), dropout=0.0, rate=0.05, epochs=20, patience=20, batch=4)
    got = training.fitted(rows, tasks, ["run"], settings=s, seed=1).collect()
    assert [r.rows for r in got] == [400, 400] and {tuple(r.classes) for r in got} == {("0", "1", "once")}
    for r in got:
        state = networks.unpacked(r.state)
        p = training.probabilities(state, "network", x, np.zeros((400, 0), dtype=str), np.zeros(400))
        assert (p.argmax(axis=1)[1:] == (x[:, 0] * x[:, 1] > 0)[1:]).mean() > 0.9
        assert state["m_best"] <= state["m_epochs"] == 20
    assert any((networks.unpacked(got[0].state)[f"m_p{i}"] != networks.unpacked(got[1].state)[f"m_p{i}"]).any() for i in range(4))
    short = Settings(hidden=(24,), rate=0.05, epochs=2, patience=2, batch=4)
    one, two = ({(r.member, bytes(r.state)) for r in training.fitted(rows.repartition(n), tasks, ["run"], settings=short, seed=1).collect()} for n in (3, 5))
    assert one == two


def test_large_runs_hold_out_rows_of_each_class():
    settings, h = Settings(holdout=0.2), np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 1000)
    codes = np.array([0] * 900 + [1] * 96 + [2] * 2 + [3] + [4])
    h[997] = h[996]  # one id twice: neither copy is held out
    state = {"classes": np.array(list("abcde")), "seed": 9, "edges": None, "epoch": 0}

    class Half:
        def __init__(self, at):
            self.at, self.h, self.part = at, h, 1

        def rows_of(self, *_):
            return self.at

        def classes(self, _, at):
            return codes[at]

    parts = [next(passes._epoch(settings, Half(np.arange(i, 1000, 3)), [("A", 0, 0, "network", 0, state)]))[-1] for i in range(3)]
    t = passes._averaged(settings, [(0, False, state)], parts)[0][1]
    place, (lo, hi) = passes._place(h, 9), t["edges"]
    held = ((place < 0.2) & (place < hi[codes])) | (place <= lo[codes])
    n = np.bincount(codes[held], minlength=5)
    assert 130 < n[0] < 230 and 8 < n[1] < 32 and n[2:].tolist() == [0, 0, 0]
    own = np.bincount(codes[~held], minlength=5)
    assert t["weight"] == pytest.approx(own.sum() / (5 * own))
    two = passes._averaged(settings, [(0, False, {**state, "edges": None})], [[(2, 2, 0.01, 1, 0.1, 1)], [(3, 0, 0.6, 1, 0.9, 1)]])[0][1]
    assert two["edges"][0].tolist() == [0.01] and two["edges"][1].tolist() == [0.9]


def test_unknown_labels_rank_last(spark):
    long = spark.createDataFrame([(1, "v", "Q", "A", 0.7), (1, "v", "Q", "B", 0.3), (1, "w", "B", "A", 0.5), (1, "w", "B", "B", 0.5)], "r int, video_id string, label string, cls string, p double")
    got = {r.video_id: tuple(r)[2:] for r in training.chosen(long, ["r"]).collect()}
    assert got == {"v": ("Q", "A", 0.0, 3), "w": ("B", "A", 0.5, 2)}


@pytest.mark.parametrize("model", ["network", "logistic"])
def test_probabilities_do_not_depend_on_the_rows_beside(model):
    rng = np.random.default_rng(4)
    x, codes = rng.normal(size=(600, 9)), rng.integers(0, 4, 600)
    state = networks.fit(model, x, codes, np.zeros(600), 4, networks.Settings(hidden=(128, 64), epochs=1), 1)
    whole = networks.predict(model, state, x, np.zeros(600))
    for n in [*range(1, 70), 151, 599]:
        at = rng.permutation(600)[:n]
        assert (networks.predict(model, state, x[at], np.zeros(n)) == whole[at]).all(), n
    assert (networks.predict(model, state, np.asfortranarray(x), np.zeros(600)) == whole).all()


# --- saved models ------------------------------------------------------------------------------------


@pytest.mark.parametrize("model", ["network", "date_only"])
def test_a_saved_model_gives_the_same_again(spark, table, tmp_path, model):
    folder = f"file://{tmp_path}/m"
    info = artifact.save_model(table, folder, model, ["a", "b"], ["sex"], ["a"], SMALL, 3, {"verdict": "useful"})
    assert info["classes"] == ["CTRL", "X", "Y", "Z"] and info["rows"] == 151 and len(info["sha256"]) >= 2
    found = artifact.load_model(spark, folder)
    assert found.info == info and found.warnings == ()
    assert tuple(found.gap(table).first()) == (0.0, 151)
    assert tuple(found.gap(table.drop("label", "extra").where("video_id < 'v010'")).first()) == (0.0, 10)
    p = found.predict(table).groupBy("video_id").agg(F.sum("p").alias("s")).collect()
    assert len(p) == 151 and all(abs(r.s - 1) < 1e-9 for r in p)
    with pytest.raises(KeyError, match="lacks b, sex"):
        found.predict(table.drop("b", "sex"))
    with pytest.raises(FileExistsError):
        artifact.save_model(table, folder, model, ["a"])


def test_a_damaged_or_unfinished_model_is_refused(spark, table, tmp_path):
    folder = f"file://{tmp_path}/m"
    artifact.save_model(table, folder, "logistic", ["a", "b"], settings=SMALL)
    states = next((tmp_path / "m/states").glob("part-*.parquet"))
    for crc in (tmp_path / "m/states").glob(".*.crc"):  # else the local file system refuses first
        crc.unlink()
    data = states.read_bytes()
    states.write_bytes(data[:100] + bytes([data[100] ^ 1]) + data[101:])
    with pytest.raises(ValueError, match=states.name):
        artifact.load_model(spark, folder)
    states.write_bytes(data)
    artifact.load_model(spark, folder)
    extra = tmp_path / "m/states/part-more.parquet"
    extra.write_bytes(b"x")
    with pytest.raises(ValueError, match="part-more"):
        artifact.load_model(spark, folder)
    extra.unlink()
    (tmp_path / "m/info.json").rename(tmp_path / "m/other.json")
    with pytest.raises(FileNotFoundError):
        artifact.load_model(spark, folder)


def test_other_versions_warn(spark, table, tmp_path):
    import json

    folder = f"file://{tmp_path}/m"
    artifact.save_model(table, folder, "majority", ["a"])
    path = tmp_path / "m/info.json"
    info = json.loads(path.read_text())
    info["versions"]["numpy"] = "0.1"
    path.unlink()
    for crc in tmp_path.glob("m/.info.json.crc"):
        crc.unlink()
    path.write_text(json.dumps(info))
    assert len(artifact.load_model(spark, folder).warnings) == 1


# --- studies -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("by_date,least", [(True, 2), (True, 6), (False, 2)])
def test_minus_vehicle_equals_a_loop(table, by_date, least):
    setup = F.when(F.dayofmonth("date") <= 3, "s1").when(F.dayofmonth("date") <= 6, "s2")
    got = {r.video_id: r for r in studies.minus_vehicle(studies.logged(table, ["a", "b"], ["a"]), ["a", "b"], "CTRL", setup, by_date, least).collect()}
    rows = table.collect()
    value = lambda r, f: None if r[f] is None or r[f] != r[f] else float(np.log1p(r[f])) if f == "a" else r[f]
    place = lambda r: None if r.date is None else "s1" if r.date.day <= 3 else "s2" if r.date.day <= 6 else None
    veh = [r for r in rows if r.compound == "CTRL"]
    levels = Counter()
    for r in rows:
        on, within = [v for v in veh if v.date == r.date and r.date], [v for v in veh if place(v) == place(r) and place(r)]
        level, ref = ("date", on) if by_date and len(on) >= least else ("setup", within) if len(within) >= least else ("all", veh)
        levels[level] += 1
        assert got[r.video_id].reference == level
        for f in "ab":
            vs = [value(v, f) for v in ref if value(v, f) is not None]
            want = value(r, f) - median(vs) if value(r, f) is not None and vs else None
            assert got[r.video_id][f"n_{f}"] == (pytest.approx(want) if want is not None else None)
    assert len(levels) >= 2


def test_dose_models_equal_a_loop_over_compounds(spark, table):
    models = ("date_only", "logistic", "network")
    long = studies.dose_predictions(table, ["a", "b"], ["sex"], "CTRL", ["a"], models, 3, 1, SMALL, 6, least=4)
    got = {tuple(r[:-1]): r.p for r in long.collect()}
    rows = [r.asDict() for r in studies.dose_rows(table, ["a", "b"], ["sex"], "CTRL", ["a"], 4, 6).collect()]
    assert {r["compound"] for r in rows} == {"X", "Y"} and {r["variant"] for r in rows} == {"raw", "permuted", "normalised"}
    want = {}
    for compound in ("X", "Y"):
        own = [r for r in rows if r["compound"] == compound]
        base = [(r["video_id"], r["label"], str(r["date"] or "")) for r in own if r["variant"] == "raw"]
        placed = [(compound, v, s, 0, i, f) for v in ("raw", "permuted", "normalised") for s, found in zip("AB", slow_folds(base, 3, 0, 6), strict=True) for i, f in found.items()]
        want |= loop(own, placed, ["compound", "variant"], models, [], SMALL, 6)
    same(got, want)
    s = studies.dose_summary(spark.createDataFrame(long.collect(), long.schema)).collect()
    assert {(r.compound, r.doses) for r in s} == {("X", 3), ("Y", 2)} and all(0 <= r.b_normalised <= 1 for r in s)
    for r in rows:
        if r["variant"] == "permuted":
            break
    cells = lambda v: Counter((r["compound"], r["date"], r["label"]) for r in rows if r["variant"] == v)
    assert cells("raw") == cells("permuted")  # shuffled within a date only


def test_large_dose_models_equal_small_ones(table, monkeypatch):
    """Compounds above and below the size of a task beside each other: the same predictions whichever way a compound is fitted."""
    fit = lambda: {tuple(r[:-1]): r.p for r in studies.dose_predictions(table, ["a", "b"], ["sex"], "CTRL", ["a"], ("date_only", "logistic"), 3, 1, SMALL, 6, least=4).collect()}
    whole = fit()
    sizes = Counter(k[0] for k in whole if k[1:6] == ("raw", "B", 0, 0, "date_only"))
    monkeypatch.setattr(training, "ALONE", 20)  # X has more training rows, Y in some folds fewer
    monkeypatch.setattr(passes, "SLICE", 17)
    got = fit()
    assert set(sizes) == {"X", "Y"} and sizes["X"] > 20 and got.keys() == whole.keys()
    assert max(abs(got[k] - whole[k]) for k in got if k[5] == "date_only") < 1e-12
    assert max(abs(got[k] - whole[k]) for k in got) < 1e-4


def test_dose_models_without_vehicle_and_without_rows(spark, table):
    rows = studies.dose_rows(table.where("compound <> 'CTRL'"), ["a"], [], "CTRL", least=4)
    assert {r.variant for r in rows.select("variant").distinct().collect()} == {"raw", "permuted"}
    assert studies.dose_rows(table.where("false"), ["a"], [], "CTRL").collect() == []
    assert studies.dose_predictions(table.where("compound = 'Z'"), ["a"], [], "CTRL", models=("majority",)).collect() == []


def test_ablations_share_folds_and_leave_parts_out(spark, table):
    groups, used = {"size": ["b"], "sex": ["sex"]}, {"size": True, "sex": False}
    rows = studies.ablation_rows(table, ["a", "b"], ["sex"], groups, used, ["a"], "CTRL")
    by = defaultdict(list)
    for r in rows.collect():
        by[r.ablation].append(r)
    assert set(by) == {"main", "size=off", "sex=on", "no vehicle, raw", "no vehicle, normalised"}
    assert all(r.x[1] is None for r in by["size=off"]) and any(r.c[0] for r in by["sex=on"]) and not any(r.c[0] for r in by["main"])
    assert not any(r.label == "CTRL" for n in ("no vehicle, raw", "no vehicle, normalised") for r in by[n])
    models = ("majority", "logistic")
    got = studies.run_ablations(table, ["a", "b"], ["sex"], groups, used, "CTRL", ["a"], models, 3, 2, SMALL, 1).cache()
    placed = folding.folds(table, 3, 2, 1).withColumn("ablation", F.lit("size=off"))
    alone = training.scores(training.cross_fit(rows.where("ablation = 'size=off'"), placed, ["ablation"], models, (), SMALL, 1), ["ablation", "model", "scheme", "repeat"]).collect()
    assert Counter(map(tuple, alone)) == Counter(map(tuple, got.where("ablation = 'size=off'").collect()))
    report = {(r.ablation, r.model, r.scheme): r for r in studies.ablation_report(got).collect()}
    mean = lambda *k: np.mean([r.balanced_accuracy for r in got.collect() if (r.ablation, r.model, r.scheme) == k])
    assert report["main", "logistic", "A"].delta == 0
    assert report["size=off", "logistic", "B"].delta == pytest.approx(mean("size=off", "logistic", "B") - mean("main", "logistic", "B"))
    assert report["no vehicle, normalised", "logistic", "B"].delta == pytest.approx(mean("no vehicle, normalised", "logistic", "B") - mean("no vehicle, raw", "logistic", "B"))
    assert report["size=off", "logistic", "B"].delta < 0  # b tells the compounds apart


def test_tallies_give_the_scores_of_the_predictions(spark, table):
    placed = folding.folds(table, 3, 2, 5)
    sets = F.explode(F.array(F.lit("p"), F.lit("q"))).alias("part")
    rows = training.as_rows(table, ["a", "b"], ["sex"]).select("*", sets).withColumn("x", F.when(F.col("part") == "q", F.array(F.lit(None).cast("double"), F.col("x")[1])).otherwise(F.col("x")))
    by, models = ("part", "model", "scheme", "repeat"), ("majority", "date_only", "logistic")
    sums = training.cross_tally(rows, placed, ["part"], models, (), SMALL, 5, most=60)  # folds without the key are shared by its values
    got = {tuple(r[:4]): tuple(r)[4:] for r in evaluation.tally_metrics(sums, by).collect()}
    long = training.cross_fit(rows, placed.select("*", sets), ["part"], models, (), SMALL, 5, most=60)
    want = {tuple(r[:4]): tuple(r)[4:] for r in training.scores(long, list(by)).collect()}
    assert got.keys() == want.keys() and len(got) == 24
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert sums.count() <= 24 * 16  # pairs of classes, however many rows
