"""Small classifiers as arrays: what one training task fits and one scoring task applies. Spark deals the tasks (:mod:`ethogrid.operators.training`).

A fitted model is a dict of arrays (its state), so that it can lie in a binary column or a file and be read back without running code.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Settings:
    """Of a network: layer widths, dropout, AdamW's rate and decay, batch rows, epochs at most, epochs without gain before it stops, share held out to see that, members."""

    hidden: tuple[int, ...] = (128, 64)
    dropout: float = 0.3
    rate: float = 1e-3
    decay: float = 1e-2
    batch: int = 32
    epochs: int = 300
    patience: int = 20
    holdout: float = 0.2
    members: int = 5


def packed(state: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **state)
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


def balanced_weights(codes: np.ndarray, classes: int) -> np.ndarray:
    """Weight of each class, so that those seen count alike: rows / (classes seen x rows of the class), 0 for one without rows."""
    n = np.bincount(codes, minlength=classes)
    return np.divide(len(codes), np.count_nonzero(n) * n, out=np.zeros(classes), where=n > 0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


# --- preprocessing -----------------------------------------------------------------------------------


def fit_scaler(x: np.ndarray, c: np.ndarray, log: np.ndarray) -> dict[str, np.ndarray]:
    """Of training rows: numbers ``x`` (NaN: missing) of which ``log`` columns are log1p'd first, texts ``c`` ("": missing).

    Each text column becomes a 0/1 column for each value seen; gaps get the column's median (0 if it has none); columns are centred and divided by their deviation (1 if constant).
    """
    values = [np.unique(c[:, i][c[:, i] != ""]) for i in range(c.shape[1])]
    state = {"log": log, "level": np.array([v for col in values for v in col], dtype=str), "of": np.array([i for i, col in enumerate(values) for _ in col], np.int64)}
    wide = _widened(state, x, c)
    fill = np.zeros(wide.shape[1])
    for i in range(wide.shape[1]):
        known = wide[:, i][~np.isnan(wide[:, i])]
        fill[i] = np.median(known) if len(known) else 0.0
    wide = np.where(np.isnan(wide), fill, wide)
    sd = wide.std(axis=0)
    return state | {"fill": fill, "mean": wide.mean(axis=0), "sd": np.where(sd > 0, sd, 1.0)}


def logged(x: np.ndarray, log: np.ndarray) -> np.ndarray:
    x = np.array(x, np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        x[:, log] = np.log1p(x[:, log])
    return x


def _widened(state: dict, x: np.ndarray, c: np.ndarray) -> np.ndarray:
    x = logged(x, state["log"])
    flags = [(c[:, i] == level).astype(np.float64) for i, level in zip(state["of"].tolist(), state["level"].tolist(), strict=True)]
    return np.column_stack([x, *flags]) if flags else x


def scaled(state: dict, x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return centred(state, _widened(state, x, c))


def centred(state: dict, wide: np.ndarray) -> np.ndarray:
    return (np.where(np.isfinite(wide), wide, state["fill"]) - state["mean"]) / state["sd"]


# --- network -----------------------------------------------------------------------------------------


def layers(width: int, classes: int, hidden: tuple[int, ...], rng: np.random.Generator) -> list[np.ndarray]:
    """Weights and offsets in turn, uniform within one over the root of the layer's inputs."""
    out, sizes = [], [width, *hidden, classes]
    for a, b in zip(sizes, sizes[1:], strict=False):
        bound = 1 / np.sqrt(max(a, 1))
        out += [rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)]
    return out


def forward(params: list[np.ndarray], x: np.ndarray, masks: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Inputs of each layer, then the logits. ``masks`` multiply the hidden layers (dropout while training)."""
    seen = [x]
    for i in range(0, len(params), 2):
        z = seen[-1] @ params[i] + params[i + 1]
        if i + 2 < len(params):
            z = np.maximum(z, 0)
            z = z if masks is None else z * masks[i // 2]
        seen.append(z)
    return seen


def loss_gradient(params: list[np.ndarray], x: np.ndarray, codes: np.ndarray, weight: np.ndarray, masks: list[np.ndarray] | None = None) -> tuple[float, list[np.ndarray]]:
    """Weighted mean cross-entropy of the rows and its gradient."""
    seen = forward(params, x, masks)
    p = softmax(seen[-1])
    w = weight[codes]
    total = w.sum()
    rows = np.arange(len(x))
    loss = float(-(w * np.log(np.maximum(p[rows, codes], 1e-300))).sum() / total)
    p[rows, codes] -= 1
    back = p * (w / total)[:, None]
    out: list[np.ndarray] = []
    for i in range(len(params) - 2, -1, -2):
        a = seen[i // 2]
        out = [a.T @ back, back.sum(axis=0), *out]
        if i:
            back = (back @ params[i].T) * (a > 0)
            back = back if masks is None else back * masks[i // 2 - 1]
    return loss, out


class AdamW:
    """Adam whose decay shrinks the parameters themselves instead of entering the gradient."""

    def __init__(self, params: list[np.ndarray], rate: float, decay: float):
        self.rate, self.decay, self.t = rate, decay, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, params: list[np.ndarray], grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(params, grads, self.m, self.v, strict=True):
            p *= 1 - self.rate * self.decay
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def held_rows(codes: np.ndarray, share: float, rng: np.random.Generator) -> np.ndarray:
    """Mask of rows held out: of each class about ``share`` (one at least, never all); a share of all rows where a class has one row only."""
    held = np.zeros(len(codes), bool)
    classes, n = np.unique(codes, return_counts=True)
    if n.min(initial=2) < 2:
        held[rng.permutation(len(codes))[: int(np.ceil(share * len(codes)))]] = len(codes) > 1
        return held
    for c, m in zip(classes, n, strict=True):
        held[rng.permutation(np.flatnonzero(codes == c))[: min(max(1, round(share * m)), m - 1)]] = True
    return held


def fit_network(x: np.ndarray, codes: np.ndarray, classes: int, s: Settings, seed: int) -> dict[str, np.ndarray]:
    """One member: trained on the rows that are not held out, with the parameters of the epoch that was best on those held out.

    The loss on held-out rows is not weighted; training ends after ``patience`` epochs without a better one. State: p0, p1, ...; epochs; best.
    """
    rng = np.random.default_rng(seed)
    held = held_rows(codes, s.holdout, rng)
    own, weight = np.flatnonzero(~held), balanced_weights(codes[~held], classes)
    params = layers(x.shape[1], classes, s.hidden, rng)
    opt, least, best, kept, epoch = AdamW(params, s.rate, s.decay), np.inf, 0, [p.copy() for p in params], 0
    for epoch in range(1, s.epochs + 1):
        order = rng.permutation(own)
        for at in range(0, len(order), s.batch):
            rows = order[at : at + s.batch]
            masks = [(rng.random((len(rows), h)) >= s.dropout) / (1 - s.dropout) for h in s.hidden]
            opt.step(params, loss_gradient(params, x[rows], codes[rows], weight, masks)[1])
        p = softmax(forward(params, x[held])[-1])[np.arange(int(held.sum())), codes[held]]
        now = float(-np.log(np.maximum(p, 1e-300)).mean()) if len(p) else np.inf
        if now < least:
            least, best, kept = now, epoch, [q.copy() for q in params]
        elif epoch - best >= s.patience:
            break
    return {f"p{i}": q for i, q in enumerate(kept)} | {"epochs": np.array(epoch), "best": np.array(best)}


def epoch_together(params: list[np.ndarray], m: list[np.ndarray], v: list[np.ndarray], t: np.ndarray, x: list[np.ndarray], codes: list[np.ndarray], weight: np.ndarray, s: Settings, rng: np.random.Generator) -> None:
    """One epoch of several networks of one shape, each on its own rows in the order given, as :func:`fit_network` steps: arrays are stacked by network and changed in place.

    ``t``: steps made so far; ``x`` and ``codes`` come by network, those with more rows first. One call of numpy serves a step of all of them.
    """
    steps = [-(-len(c) // s.batch) for c in codes]
    wide, row = np.zeros((len(x), steps[0] * s.batch, x[0].shape[1])), np.zeros((len(x), steps[0] * s.batch), np.int64)
    w = np.zeros(row.shape)  # rows that fill up a last batch weigh nothing
    for k, (a, c) in enumerate(zip(x, codes, strict=True)):
        wide[k, : len(c)], row[k, : len(c)], w[k, : len(c)] = a, c, weight[k, c]
    for i in range(steps[0]):
        n = sum(q > i for q in steps) if steps[-1] <= i else len(steps)
        at = slice(i * s.batch, (i + 1) * s.batch)
        seen, masks = [wide[:n, at]], []
        for j in range(0, len(params), 2):
            z = seen[-1] @ params[j][:n] + params[j + 1][:n, None]
            if j + 2 < len(params):
                masks.append((rng.random(z.shape, np.float32) >= s.dropout) / (1 - s.dropout))
                z = np.maximum(z, 0) * masks[-1]
            seen.append(z)
        back = np.exp(seen[-1] - seen[-1].max(axis=2, keepdims=True))
        back /= back.sum(axis=2, keepdims=True)
        back -= row[:n, at, None] == np.arange(back.shape[2])
        back *= (w[:n, at] / w[:n, at].sum(axis=1, keepdims=True))[:, :, None]
        t[:n] += 1
        for j in range(len(params) - 2, -1, -2):
            a = seen[j // 2]
            grads = a.transpose(0, 2, 1) @ back, back.sum(axis=1)
            if j:
                back = (back @ params[j][:n].transpose(0, 2, 1)) * (a > 0) * masks[j // 2 - 1]
            for q, g in zip((j, j + 1), grads, strict=True):
                own, first, second = params[q][:n], m[q][:n], v[q][:n]
                past = t[:n].reshape(-1, *[1] * (g.ndim - 1))
                own *= 1 - s.rate * s.decay
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                own -= s.rate * (first / (1 - 0.9**past)) / (np.sqrt(second / (1 - 0.999**past)) + 1e-8)


# --- the models by name ------------------------------------------------------------------------------


def fit_logistic(x: np.ndarray, codes: np.ndarray, classes: int, tol: float = 1e-7, steps: int = 5000) -> dict[str, np.ndarray]:
    """Softmax regression with balanced classes: weighted cross-entropy summed over rows plus half the squared weights (offsets aside), by accelerated gradient steps."""
    w = balanced_weights(codes, classes)[codes]
    z = np.column_stack([x, np.ones(len(x))])
    free = np.ones((z.shape[1], 1))
    free[-1] = 0
    rate = 1 / (0.5 * np.linalg.norm(z * np.sqrt(w)[:, None], 2) ** 2 + 1)
    y = np.zeros((len(x), classes))
    y[np.arange(len(x)), codes] = 1
    a = b = np.zeros((z.shape[1], classes))
    t = 1.0
    for _ in range(steps):
        g = z.T @ ((softmax(z @ b) - y) * w[:, None]) + free * b
        new = b - rate * g
        if np.abs(g).max(initial=0) < tol * len(x):
            a = new
            break
        if ((b - new) * (new - a)).sum() > 0:  # the pace goes against the slope: start anew
            t = 1.0
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        b, a, t = new + (t - 1) / u * (new - a), new, u
    return {"w": a}


def fit_days(codes: np.ndarray, days: np.ndarray, classes: int) -> dict[str, np.ndarray]:
    """Class shares of all rows, and of each day (NaN: no date) of the training rows."""
    known = ~np.isnan(days)
    own, at = np.unique(days[known], return_inverse=True)
    n = np.zeros((len(own), classes))
    np.add.at(n, (at, codes[known]), 1)
    return {"prior": np.bincount(codes, minlength=classes) / len(codes), "days": own, "mix": n / np.maximum(n.sum(axis=1, keepdims=True), 1)}


def fit(name: str, x: np.ndarray, codes: np.ndarray, days: np.ndarray, classes: int, settings: Settings, seed: int) -> dict[str, np.ndarray]:
    """State of model ``name`` (majority, date_only, logistic, network) on scaled rows."""
    if name == "network":
        return fit_network(x, codes, classes, settings, seed)
    if name == "logistic":
        return fit_logistic(x, codes, classes)
    if name == "date_only":
        return fit_days(codes, days, classes)
    if name == "majority":
        return {"prior": np.bincount(codes, minlength=classes) / len(codes)}
    raise ValueError(f"no model {name!r}")


def predict(name: str, state: dict[str, np.ndarray], x: np.ndarray, days: np.ndarray) -> np.ndarray:
    """Class probabilities of scaled rows. ``date_only``: those of the row's day or the nearest one (the earlier of equals), without a date those of all rows.

    Rows are multiplied one by one: the last bits of a product of many rows depend on how many they are, and so on how Spark deals them.
    """
    if name == "network":
        return softmax(forward([state[f"p{i}"] for i in range(sum(k[0] == "p" for k in state))], np.ascontiguousarray(x)[:, None])[-1][:, 0])
    if name == "logistic":
        return softmax((np.ascontiguousarray(np.column_stack([x, np.ones(len(x))]))[:, None] @ state["w"])[:, 0])
    out = np.repeat(state["prior"][None, :], len(x), axis=0)
    if name == "date_only" and len(state["days"]):
        known = np.flatnonzero(~np.isnan(days))
        out[known] = state["mix"][np.abs(state["days"][None, :] - days[known, None]).argmin(axis=1)]
    return out
