"""Models of runs with more rows than one task should hold: fitted by passes over slices of the rows, each row of a run read, none copied or thinned.

A pass is one job. Tasks read slices and the states so far (:func:`ethogrid.sources.tables.written`), give one small contribution a slice and model, and a task for each run (or each scheme and
repeat) adds these up to the next states. A subject's row lies in one slice with all its folds, and trains in every run that it was not kept from.
"""

from __future__ import annotations

import pickle
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethogrid.operators import networks
from ethogrid.operators.networks import Settings
from ethogrid.sources.tables import filesystem, written

SLICE = 25_000  # rows of a slice, about
BITS = 16  # of the 64 of a number, found by each pass towards a median
PAIRS = 10  # steps that the descent remembers
TOGETHER = 64 << 20  # bytes of the rows of networks that are trained side by side
STEPS = 1000  # passes of a descent at most; it ends at its tolerance long before


def fitted(placed: DataFrame, tasks: DataFrame, keys: list[str], log: list[int], settings: Settings, seed: int) -> DataFrame:
    """(keys, scheme, repeat, fold, model, member, classes, rows, state) of runs as tasks (keys, scheme, repeat, fold, __n, model, member).

    ``placed``: keys, video_id, label, day, x, c, __folds (an array of scheme, repeat, fold). A run trains on the labelled rows of its keys, scheme and repeat whose fold is another.
    """
    slot = [*keys, "scheme", "repeat"]
    tasks = written(tasks, "tasks")
    slices = _sliced(placed, tasks, keys, seed)
    p = _Passes(slices, keys, log)
    states = p.first(tasks.select(*slot, "fold").distinct())
    states = p.step(states, slot, _count, _counted)
    for _ in range(64 // BITS - 1):
        states = p.step(states, slot, _narrow, _narrowed)
    states = p.begin(states, tasks, settings, seed)
    for model, work, join in (("logistic", _slope, _descended), ("network", partial(_epoch, settings), partial(_averaged, settings))):
        own = states.where(F.col("model") == model)
        if own.isEmpty():
            continue
        states = states.where(F.col("model") != model)
        while not own.where("NOT done").isEmpty():
            own = p.step(own, [*slot, "fold", "model", "member"], work, join)
        states = states.unionByName(own)
    return p.end(states)


def _sliced(placed: DataFrame, tasks: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """(keys, __part, __h, label, day, x, c, __folds), written: rows of one slice lie together. The slice of a row goes by a hash of its id, so that the same rows give the same slices.

    Ranges, twice as many as slices: a file then holds one slice, where hashes would put several into one and tasks would be of unequal size.
    """
    parts = tasks.groupBy(*keys).agg(F.ceil(F.max("__n") / SLICE).alias("__slices"))
    total = parts.agg(F.sum("__slices")).first()[0]
    rows = placed.where("label IS NOT NULL")
    rows = rows.join(parts, keys) if keys else rows.crossJoin(parts)
    h = F.xxhash64(F.lit(seed), "video_id")
    rows = rows.select(*keys, F.xxhash64(*keys, F.pmod(h, "__slices")).alias("__part"), h.alias("__h"), "label", "day", "x", "c", "__folds")
    return written(rows.repartitionByRange(2 * int(total), "__part").sortWithinPartitions("__part", "__h", "label"), "slices")


class _Slice:
    """Arrays of a slice."""

    def __init__(self, rows: pa.Table, keys: list[str], log: np.ndarray):
        from ethogrid.operators.training import _numbers, _texts, _width

        self.key = tuple(rows.column(k)[0].as_py() for k in keys)
        self.part = rows.column("__part")[0].as_py()
        self.h = rows.column("__h").to_numpy().astype(np.int64)
        self.days = rows.column("day").to_numpy().astype(np.float64)
        self.names, self.codes = np.unique(np.array(rows.column("label").to_pylist(), dtype=str), return_inverse=True)
        self.x, self.c = networks.logged(_numbers(rows.column("x"), _width(rows.column("x"))), log[log < _width(rows.column("x"))]), _texts(rows.column("c"), _width(rows.column("c")))
        lists = rows.column("__folds").combine_chunks()
        flat, at = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        schemes, scheme = np.unique(np.array(flat.field("scheme").to_pylist(), dtype=str), return_inverse=True)
        repeat, fold = flat.field("repeat").to_numpy(), flat.field("fold").to_numpy()
        self.slots = {(str(s), int(r)): (at[own], fold[own]) for i, s in enumerate(schemes) for r in np.unique(repeat[scheme == i]) for own in [(scheme == i) & (repeat == r)]}
        self.flags: dict[tuple, np.ndarray] = {}

    def rows_of(self, scheme: str, repeat: int, fold: int) -> np.ndarray:
        """Places of the rows that the run trains on."""
        at, folds = self.slots.get((scheme, repeat), (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        return at[folds != fold]

    def scaled(self, scaler: dict, at: np.ndarray) -> np.ndarray:
        """:func:`networks.scaled` of the rows ``at``; the slice's numbers are logged already, its texts compared once for all runs."""
        for i, level in zip(scaler["of"].tolist(), scaler["level"].tolist(), strict=True):
            if (i, level) not in self.flags:
                self.flags[i, level] = (self.c[:, i] == level).astype(np.float64)
        flags = [self.flags[k][at] for k in zip(scaler["of"].tolist(), scaler["level"].tolist(), strict=True)]
        return networks.centred(scaler, np.column_stack([self.x[at], *flags]) if flags else self.x[at])

    def classes(self, classes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Codes of the labels of the rows ``at`` among sorted classes that hold them all."""
        return np.searchsorted(classes, self.names)[self.codes[at]]


def _slices(batches, keys: list[str], log: np.ndarray):
    """Slices of batches whose rows lie together."""
    have: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        part = b.column("__part").to_numpy()
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if have and have[-1].column("__part")[0].as_py() != part[lo]:
                yield _Slice(pa.Table.from_batches(have), keys, log)
                have = []
            have.append(b.slice(lo, hi - lo))
    if have:
        yield _Slice(pa.Table.from_batches(have), keys, log)


class _Passes:
    """The jobs over one table of slices. A state or contribution is a row (keys, scheme, repeat, fold, model, member, done, payload); done is null for contributions."""

    def __init__(self, slices: DataFrame, keys: list[str], log: list[int]):
        self.slices, self.keys, self.log = slices, keys, np.array(list(log), np.int64)
        kinds = {f.name: f.dataType.simpleString() for f in slices.schema.fields}
        kinds = {k: kinds[k] for k in keys} | {"scheme": "string", "repeat": "int", "fold": "int", "model": "string", "member": "int"}
        self.columns, self.run = list(kinds), ", ".join(f"{c} {k}" for c, k in kinds.items())
        self.kinds = kinds | {"done": "boolean", "payload": "binary"}
        self.schema = ", ".join(f"{c} {k}" for c, k in self.kinds.items())

    def first(self, runs: DataFrame) -> DataFrame:
        wide = runs.withColumns({"model": F.lit(""), "member": F.lit(0), "done": F.lit(False), "payload": F.lit(None)})
        return written(wide.select(*[F.col(c).cast(k).alias(c) for c, k in self.kinds.items()]), "states")

    def step(self, states: DataFrame, by: list[str], work, join) -> DataFrame:
        """Next states. ``work(slice, states of its key)`` gives (scheme, repeat, fold, model, member, contribution) of states that are not done; ``join(states, contributions)`` of one group of ``by``
        gives (done, state) for each state; states are [(fold, done, state)]."""
        keys, log, columns, n = self.keys, self.log, self.columns, len(self.keys)
        states = states if hasattr(states, "written_path") else written(states, "states")
        path = states.written_path

        def contribute(batches):
            import pyarrow.dataset as ds

            fs, folder = filesystem(path)
            kept = ds.dataset(folder, filesystem=fs, format="parquet")

            @lru_cache(4)
            def states_of(key: tuple):
                test = ~ds.field("done")
                for k, v in zip(keys, key, strict=True):
                    test = test & (ds.field(k) == v)
                got = kept.to_table(filter=test).sort_by([(c, "ascending") for c in columns[n:]]).to_pylist()
                return [(r["scheme"], r["repeat"], r["fold"], r["model"], r["member"], r["payload"] and pickle.loads(r["payload"])) for r in got]

            for s in _slices(batches, keys, log):
                for scheme, repeat, fold, model, member, found in work(s, states_of(s.key)):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*s.key, scheme, repeat, fold, model, member, None, pickle.dumps((s.part, found))), types, strict=True)], names=names)

        def add(group: pa.Table) -> pa.Table:
            given = group.column("done").is_valid()
            own = group.filter(given).sort_by([(c, "ascending") for c in columns[n:]])
            parts = sorted((pickle.loads(v) for v in group.filter(pc.invert(given)).column("payload").to_pylist()), key=lambda p: p[0])
            had = [(r["fold"], r["done"], r["payload"] and pickle.loads(r["payload"])) for r in own.select(["fold", "done", "payload"]).to_pylist()]
            if all(done for _, done, _ in had):
                return own
            new = join(had, [found for _, found in parts])
            own = own.drop(["done", "payload"])
            return own.append_column("done", pa.array([d for d, _ in new], pa.bool_())).append_column("payload", pa.array([pickle.dumps(s) for _, s in new], pa.binary()))

        from pyspark.sql.pandas.types import to_arrow_type
        from pyspark.sql.types import _parse_datatype_string

        fields = _parse_datatype_string(self.schema).fields
        names, types = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]
        found = self.slices.mapInArrow(contribute, self.schema).unionByName(states)
        return written(found.groupBy(*by).applyInArrow(add, self.schema), "states")

    def begin(self, states: DataFrame, tasks: DataFrame, settings: Settings, seed: int) -> DataFrame:
        """States of models before their first pass; baselines are done."""
        from ethogrid.operators.training import _seed

        keys, columns, log = [*self.keys, "scheme", "repeat", "fold"], self.columns, self.log

        def start(batches):
            for b in batches:
                found = []
                for r in b.to_pylist():
                    run = pickle.loads(r["payload"])
                    own = {"model": r["model"], "log": log[log < len(run["x"])], "seed": _seed(seed, *(r[k] for k in keys if k != "fold"), r["member"])}
                    found.append(_begun(run | own, settings))
                more = [pa.array([d for d, _ in found], pa.bool_()), pa.array([pickle.dumps(s) for _, s in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *more], names=[*columns, "done", "payload"])

        both = tasks.select(*keys, "model", "member").join(states.select(*keys, "payload"), keys)
        both = both.select(*[F.col(c).cast(k).alias(c) for c, k in self.kinds.items() if c != "done"])
        return written(both.mapInArrow(start, self.schema), "states")

    def end(self, states: DataFrame) -> DataFrame:
        columns = self.columns

        def pack(batches):
            for b in batches:
                found = [pickle.loads(v) for v in b.column("payload").to_pylist()]
                data = [networks.packed({f"m_{k}": v for k, v in s["fit"].items()} | {f"s_{k}": v for k, v in s["scaler"].items()}) for s in found]
                more = [pa.array([s["classes"].tolist() for s in found], pa.list_(pa.string())), pa.array([s["n"] for s in found], pa.int64()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *more], names=[*columns, "classes", "rows", "state"])

        return states.mapInArrow(pack, f"{self.run}, classes array<string>, rows long, state binary")


# --- counts, medians and deviations ------------------------------------------------------------------


def _ordered(x: np.ndarray) -> np.ndarray:
    """Numbers as unsigned integers in the same order (-0 is 0)."""
    b = (x + 0.0).view(np.uint64)
    return np.where(b >> np.uint64(63), ~b, b | np.uint64(1 << 63))


def _number(b: int) -> float:
    b = b & ~(1 << 63) if b >> 63 else ~b & (1 << 64) - 1
    return float(np.array([b], np.uint64).view(np.float64)[0])


def _count(s: _Slice, states: list):
    """Of each fold of each scheme and repeat: labels, days, levels; number, mean and squared deviations of each column; how often the first bits of its numbers occur."""
    bits, known = _ordered(s.x), ~np.isnan(s.x)
    for scheme, repeat in sorted({t[:2] for t in states}):
        at, folds = s.slots.get((scheme, repeat), (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        for fold in np.unique(folds):
            own = at[folds == fold]
            x, codes, days = s.x[own], s.codes[own], s.days[own]
            dated = ~np.isnan(days)
            pairs, times = np.unique(np.column_stack([days[dated], codes[dated]]), axis=0, return_counts=True)
            got = {"labels": dict(zip(s.names.tolist(), np.bincount(codes, minlength=len(s.names)).tolist(), strict=True)), "x": [], "levels": []}
            got["days"] = {(d, str(s.names[int(c)])): int(m) for (d, c), m in zip(pairs.tolist(), times, strict=True)}
            for i in range(s.c.shape[1]):
                got["levels"].append({str(v): int(m) for v, m in zip(*np.unique(s.c[own, i], return_counts=True), strict=True) if v})
            for j in range(x.shape[1]):
                v = x[known[own, j], j]
                first, times = np.unique(bits[own, j][known[own, j]] >> np.uint64(64 - BITS), return_counts=True)
                with np.errstate(invalid="ignore"):
                    got["x"].append((len(v), v.mean() if len(v) else 0.0, ((v - v.mean()) ** 2).sum() if len(v) else 0.0, dict(zip(first.tolist(), times.tolist(), strict=True))))
            yield scheme, repeat, int(fold), "", 0, (int(fold), got)


def _moments(parts: list[tuple[int, float, float]]) -> tuple[int, float, float]:
    """(number, mean, squared deviations) of rows from those of their parts."""
    n = sum(p[0] for p in parts)
    with np.errstate(invalid="ignore"):
        mean = sum(p[0] * p[1] for p in parts if p[0]) / n if n else 0.0
        return n, mean, sum(p[2] + p[0] * (p[1] - mean) ** 2 for p in parts if p[0])


def _sums(dicts: list[dict]) -> dict:
    out: dict = {}
    for d in dicts:
        for k, v in d.items():
            out[k] = out.get(k, 0) + v
    return out


def _chosen(counts: dict, rank: int) -> tuple[int, int]:
    """(value, rank inside it) of the rank-th (from 0) of counted values."""
    for v in sorted(counts):
        if rank < counts[v]:
            return v, rank
        rank -= counts[v]
    raise ValueError("fewer values than the rank")


def _counted(had: list, parts: list):
    folds = {}
    for fold, got in parts:
        folds.setdefault(fold, []).append(got)
    whole = {f: {"labels": _sums([g["labels"] for g in gs]), "days": _sums([g["days"] for g in gs]), "levels": [_sums(list(d)) for d in zip(*(g["levels"] for g in gs), strict=True)],
                 "x": [(*_moments([p[:3] for p in col]), _sums([p[3] for p in col])) for col in zip(*(g["x"] for g in gs), strict=True)]} for f, gs in folds.items()}
    out = []
    for fold, _, _ in had:
        own = [whole[f] for f in sorted(whole) if f != fold]
        labels = _sums([g["labels"] for g in own])
        s = {"labels": {k: labels[k] for k in sorted(labels) if labels[k]}, "days": _sums([g["days"] for g in own]), "x": [], "want": []}
        s["n"] = sum(s["labels"].values())
        s["levels"] = [_sums(list(d)) for d in zip(*(g["levels"] for g in own), strict=True)]
        for col in zip(*(g["x"] for g in own), strict=True):
            n, mean, dev = _moments([p[:3] for p in col])
            first = _sums([p[3] for p in col])
            s["x"].append((n, mean, dev))
            s["want"].append([_chosen(first, r) for r in ((n - 1) // 2, n // 2)] if n else None)
        out.append((False, s))
    return out


def _narrow(s: _Slice, states: list):
    """How often the next bits occur among the numbers that begin as a median does: {(column, beginning): {fold: counts}} of a scheme and repeat."""
    wanted: dict[tuple, set] = {}
    for scheme, repeat, _, _, _, state in states:
        wanted.setdefault((scheme, repeat), set()).update((j, w[0], state.get("level", 1)) for j, ws in enumerate(state["want"]) if ws for w in ws)
    bits, known = _ordered(s.x), ~np.isnan(s.x)
    near: dict[tuple, np.ndarray] = {}
    for (scheme, repeat), want in sorted(wanted.items()):
        at, folds = s.slots.get((scheme, repeat), (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        found = {}
        for j, begin, level in want:
            if (j, begin) not in near:
                near[j, begin] = known[:, j] & (bits[:, j] >> np.uint64(64 - BITS * level) == np.uint64(begin))
            own = near[j, begin][at]
            b, f = bits[at[own], j] >> np.uint64(64 - BITS * (level + 1)), folds[own]
            found[j, begin] = {int(k): dict(zip(*(a.tolist() for a in np.unique(b[f == k], return_counts=True)), strict=True)) for k in np.unique(f)}
        yield scheme, repeat, None, "", 0, found


def _narrowed(had: list, parts: list):
    found: dict[tuple, dict] = {}
    for p in parts:
        for k, by_fold in p.items():
            for fold, counts in by_fold.items():
                found.setdefault(k, {}).setdefault(fold, []).append(counts)
    found = {k: {f: _sums(c) for f, c in by_fold.items()} for k, by_fold in found.items()}
    out = []
    for fold, _, s in had:
        next_ = [ws and [_chosen(_sums([c for f, c in found[j, w[0]].items() if f != fold]), w[1]) for w in ws] for j, ws in enumerate(s["want"])]
        out.append((False, s | {"want": next_, "level": s.get("level", 1) + 1}))
    return out


# --- models ------------------------------------------------------------------------------------------


def _begun(run: dict, settings: Settings) -> tuple[bool, dict]:
    """(done, state) of a model before its first pass, from what was counted of its run."""
    classes, n = np.array(list(run["labels"]), dtype=str), run["n"]
    counts = np.array(list(run["labels"].values()), np.float64)
    values = [sorted(d) for d in run["levels"]]
    fill = [(_number(ws[0][0]) + _number(ws[1][0])) / 2 if ws else 0.0 for ws in run["want"]]
    moments = [_moments([m, (n - m[0], f, 0.0)]) for m, f in zip(run["x"], fill, strict=True)]
    for d, col in zip(run["levels"], values, strict=True):
        for v in col:
            m = d[v]
            fill.append(0.0 if 2 * m < n else 1.0 if 2 * m > n else 0.5)
            moments.append(_moments([(m, 1.0, 0.0), (n - m, 0.0, 0.0)]))
    sd = np.sqrt(np.array([m[2] / n for m in moments]))
    scaler = {"log": run["log"], "level": np.array([v for col in values for v in col], dtype=str), "of": np.array([i for i, col in enumerate(values) for _ in col], np.int64)}
    scaler |= {"fill": np.array(fill), "mean": np.array([m[1] for m in moments]), "sd": np.where(sd > 0, sd, 1.0)}
    state = {"classes": classes, "n": n, "scaler": scaler, "seed": run["seed"], "counts": counts}
    model, width = run["model"], len(fill)
    if model == "majority":
        return True, state | {"fit": {"prior": counts / n}}
    if model == "date_only":
        days = sorted({d for d, _ in run["days"]})
        mix = np.array([[run["days"].get((d, c), 0) for c in classes.tolist()] for d in days], np.float64).reshape(len(days), len(classes))
        return True, state | {"fit": {"prior": counts / n, "days": np.array(days, np.float64), "mix": mix / np.maximum(mix.sum(axis=1, keepdims=True), 1)}}
    if model == "logistic":
        zero = np.zeros((width + 1, len(classes)))
        return False, state | {"try": zero, "at": None, "pairs": [], "step": 1.0, "passes": 0}
    if model == "network":
        params = networks.layers(width, len(classes), settings.hidden, np.random.default_rng(run["seed"]))
        zeros = [np.zeros_like(p) for p in params]
        return False, state | {"params": params, "m": zeros, "v": zeros, "t": 0, "epoch": 0, "least": np.inf, "best": 0, "kept": params, "edges": None}
    raise ValueError(f"no model {model!r}")


def _slope(s: _Slice, states: list):
    """Loss of the candidate weights over the slice's rows, its gradient, and once the rows' weighted products."""
    for scheme, repeat, fold, model, member, t in states:
        at = s.rows_of(scheme, repeat, fold)
        if not len(at):
            continue
        z = np.column_stack([s.scaled(t["scaler"], at), np.ones(len(at))])
        codes = s.classes(t["classes"], at)
        w = (t["n"] / (len(t["counts"]) * t["counts"]))[codes]
        p = networks.softmax(z @ t["try"])
        own = p[np.arange(len(at)), codes]
        loss = float(-(w * np.log(np.maximum(own, 1e-300))).sum())
        p[np.arange(len(at)), codes] -= 1
        yield scheme, repeat, fold, model, member, (loss, z.T @ (p * w[:, None]), z.T @ (z * w[:, None]) if t["at"] is None else None)


def _descended(had: list, parts: list, tol: float = 1e-7):
    """One step of a quasi-Newton descent to the optimum of :func:`networks.fit_logistic`, from a bound of the curvature (half the rows' weighted products, for all classes); halved as long as the loss grows."""
    (_, _, t), t["passes"] = had[0], had[0][2]["passes"] + 1
    free = np.ones((len(t["try"]), 1))
    free[-1] = 0
    loss = sum(p[0] for p in parts) + 0.5 * float((free * t["try"] ** 2).sum())
    slope = sum(p[1] for p in parts) + free * t["try"]
    if t["at"] is None:
        t["bound"] = 0.5 * sum(p[2] for p in parts) + np.diag(free[:, 0])
    elif not loss <= t["loss"] + 1e-4 * t["step"] * float((t["slope"] * t["way"]).sum()) + 1e-12 * abs(t["loss"]):
        t["step"] /= 2
        t["try"] = t["at"] + t["step"] * t["way"]
        stuck = t["step"] < 1e-12 or t["passes"] >= STEPS
        return [(stuck, t | {"fit": {"w": t["at"]}} if stuck else t)]
    else:
        moved, turned = t["try"] - t["at"], slope - t["slope"]
        if (moved * turned).sum() > 0:
            t["pairs"] = [*t["pairs"], (moved, turned)][-PAIRS:]
    t |= {"at": t["try"], "loss": loss, "slope": slope, "step": 1.0}
    if not np.abs(slope).max(initial=0) >= tol * t["n"] or t["passes"] >= STEPS:
        return [(True, t | {"fit": {"w": t["at"]}})]
    q, shares = slope.copy(), []
    for moved, turned in reversed(t["pairs"]):
        a = (moved * q).sum() / (moved * turned).sum()
        q -= a * turned
        shares.append(a)
    q = np.linalg.solve(t["bound"], q)
    if t["pairs"]:
        moved, turned = t["pairs"][-1]
        q *= (moved * turned).sum() / (turned * np.linalg.solve(t["bound"], turned)).sum()
    for (moved, turned), a in zip(t["pairs"], reversed(shares), strict=True):
        q += (a - (turned * q).sum() / (moved * turned).sum()) * moved
    t["way"] = -q
    t["try"] = t["at"] + t["way"]
    return [(False, t)]


def _place(h: np.ndarray, seed: int) -> np.ndarray:
    """Places of rows in [0, 1), by the hashes of their ids and a model's seed."""
    with np.errstate(over="ignore"):
        z = h.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _epoch(settings: Settings, s: _Slice, states: list):
    """First: of each class the rows, those placed below the share held out, and the lowest and highest place. Then: the loss of the parameters so far on the slice's held-out rows, and what one
    epoch over its other rows makes of the parameters."""
    ready: dict[tuple, list] = {}
    for scheme, repeat, fold, model, member, t in states:
        at = s.rows_of(scheme, repeat, fold)
        if not len(at):
            continue
        codes, place, run = s.classes(t["classes"], at), _place(s.h[at], t["seed"]), (scheme, repeat, fold, model, member)
        if t["edges"] is None:
            found = []
            for c in range(len(t["classes"])):
                own = place[codes == c]
                lo, hi = own.min(initial=2.0), own.max(initial=-1.0)
                found.append((len(own), int((own < settings.holdout).sum()), lo, int((own == lo).sum()), hi, int((own == hi).sum())))
            yield *run, found
            continue
        lo, hi = (e[codes] for e in t["edges"])
        held = ((place < settings.holdout) & (place < hi)) | (place <= lo)
        x, loss = s.scaled(t["scaler"], at), 0.0
        if held.any():
            p = networks.softmax(networks.forward(t["params"], x[held])[-1])[np.arange(int(held.sum())), codes[held]]
            loss = float(-np.log(np.maximum(p, 1e-300)).sum())
        own = np.random.default_rng([t["seed"], t["epoch"], s.part & (1 << 63) - 1]).permutation(np.flatnonzero(~held))
        if not len(own):
            yield *run, (loss, int(held.sum()), 0, None)
            continue
        alike = ready.setdefault(tuple(p.shape for p in t["params"]), [])
        alike.append((run, t, (loss, int(held.sum()), len(own)), x[own], codes[own]))
        if sum(a[3].nbytes for a in alike) > TOGETHER:
            yield from _trained(settings, s.part, alike)
            alike.clear()
    for alike in ready.values():
        if alike:
            yield from _trained(settings, s.part, alike)


def _trained(settings: Settings, part: int, alike: list):
    alike = sorted(alike, key=lambda a: -len(a[4]))
    params, m, v = ([np.stack(q) for q in zip(*(a[1][k] for a in alike), strict=True)] for k in ("params", "m", "v"))
    t = np.array([a[1]["t"] for a in alike])
    rng = np.random.default_rng([alike[0][1]["seed"], alike[0][1]["epoch"], part & (1 << 63) - 1, 1])
    networks.epoch_together(params, m, v, t, [a[3] for a in alike], [a[4] for a in alike], np.array([a[1]["weight"] for a in alike]), settings, rng)
    for k, (run, _, sums, _, _) in enumerate(alike):
        yield *run, (*sums, ([q[k] for q in params], [q[k] for q in m], [q[k] for q in v], int(t[k])))


def _averaged(settings: Settings, had: list, parts: list):
    """The next epoch of :func:`networks.fit_network` for a network dealt over slices: each went over its rows from the same parameters, and their mean, weighted by rows, goes on."""
    t = had[0][2]
    if t["edges"] is None:  # of each class one row at least is held out, and never all; none of a class with one row
        lo, hi, own = [], [], []
        for rows in zip(*parts, strict=True):
            n, below, low, high = sum(r[0] for r in rows), sum(r[1] for r in rows), min(r[2] for r in rows), max(r[4] for r in rows)
            some = low < high
            lo.append(low if some else -1.0)
            hi.append(high if some else -1.0)
            held = below + (low >= settings.holdout) * sum(r[3] for r in rows if r[2] == low) - (high < settings.holdout) * sum(r[5] for r in rows if r[4] == high)
            own.append(n - held * some)
        own = np.array(own, np.float64)
        return [(False, t | {"edges": (np.array(lo), np.array(hi)), "weight": np.divide(own.sum(), np.count_nonzero(own) * own, out=np.zeros(len(own)), where=own > 0)})]
    n = sum(p[1] for p in parts)
    now = sum(p[0] for p in parts) / n if n else np.inf
    stop = t["epoch"] >= settings.epochs
    if t["epoch"] and now < t["least"]:
        t |= {"least": now, "best": t["epoch"], "kept": t["params"]}
    elif t["epoch"] - t["best"] >= settings.patience:
        stop = True
    if stop:
        fit = {f"p{i}": q for i, q in enumerate(t["kept"])} | {"epochs": np.array(t["epoch"]), "best": np.array(t["best"])}
        return [(True, {k: t[k] for k in ("classes", "n", "scaler")} | {"fit": fit})]
    new = [(p[2], p[3]) for p in parts if p[2]]
    rows = sum(w for w, _ in new)
    for i, k in enumerate(("params", "m", "v")):
        t[k] = [sum(w * q[i][j] for w, q in new) / rows for j in range(len(t[k]))]
    return [(False, t | {"t": max(q[3] for _, q in new), "epoch": t["epoch"] + 1})]
