"""Text classifiers on averaged subword vectors, trained by numpy stochastic gradient descent (operators 1 and 3)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethogrid.llm.common import sliced

_U = np.uint64
_BASE = 0xD1342543DE82EF95
_WORD = _U(0x9AE16A3B2F90404F)
_AGAIN = 0xC949D7C7509E6557
PIECE = 1 << 19  # code points of a text that are hashed at once
_pow: list[np.ndarray] = []

_SPACE = np.array([0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


def _powers(n: int):
    if not _pow or len(_pow[0]) < n:
        size = max(n, PIECE + 64)
        _pow[:] = [np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _U(b))])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _pow[0][:n], _pow[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    return (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)


@dataclass(frozen=True)
class Subwords:
    """How a text becomes hashed features: whole words, their character n-grams with word ends included, and one feature for
    every word bigram that says the same word twice.

    ``fold`` lower-cases first; ``letters`` splits words at all ASCII but letters and digits, else at white space.
    """

    bits: int = 20
    least: int = 3
    most: int = 5
    fold: bool = False
    letters: bool = False

    def buckets(self, text: str | None):
        """Arrays of feature buckets; together they are all features of the whole text, repeats included."""
        if not text:
            return
        for piece in _pieces(text):
            x = np.frombuffer((piece.lower() if self.fold else piece).encode("utf-32-le", "surrogatepass"), np.uint32)
            gap = x <= 32
            if self.letters:
                gap |= (x < 128) & ~(((x >= 48) & (x <= 57)) | ((x >= 97) & (x <= 122)) | ((x >= 65) & (x <= 90)))
            if x.max() >= 0x85:
                gap |= np.isin(x, _SPACE)
            y = np.concatenate([[0], np.where(gap, 0, x), [0]]).astype(_U)
            y = y[np.append(True, (y[1:] != 0) | (y[:-1] != 0))]
            if len(y) < 3:
                continue
            pw, inv = _powers(len(y) + 1)
            p = np.zeros(len(y) + 1, _U)
            np.cumsum((y + _U(1)) * _U(0x9E3779B97F4A7C15) * pw[:-1], out=p[1:])
            zero = y == 0
            ends = np.flatnonzero(zero)
            a, b = ends[:-1] + 1, ends[1:]
            shift = _U(64 - self.bits)
            word = _mix(((p[b] - p[a]) * inv[a]) ^ _WORD) >> shift
            yield word.astype(np.int64)
            again = np.count_nonzero(word[1:] == word[:-1])
            if again:
                yield np.full(again, _AGAIN >> (64 - self.bits), np.int64)
            z = np.zeros(len(y) + 1, np.int32)
            np.cumsum(zero, out=z[1:])
            for n in range(self.least, self.most + 1):
                if len(y) >= n:
                    inner = z[n - 1 : len(y)] == z[1 : len(y) - n + 2]
                    yield (_mix((p[n:] - p[:-n]) * inv[: len(y) - n + 1]) >> shift)[inner].astype(np.int64)


def _pieces(text: str):
    """The text cut at spaces into pieces of about PIECE code points (one word longer than that is cut)."""
    at = 0
    while len(text) - at > PIECE:
        cut = max(text.rfind(" ", at, at + PIECE), text.rfind("\n", at, at + PIECE))
        cut = cut if cut > at else at + PIECE
        yield text[at:cut]
        at = cut
    yield text[at:]


@dataclass
class Model:
    """``margin`` of a text: sum of its features' weights over their number plus ``prior``; score: logistic of that."""

    how: Subwords
    weight: np.ndarray  # of each bucket: its vector times the softmax layer's difference of class 1 and class 0
    prior: float
    scale: float
    offset: float

    def margin(self, text: str | None) -> float:
        total, n = 0.0, 0
        for b in self.how.buckets(text):
            total += float(self.weight[b].sum())
            n += len(b)
        return total / (n + self.prior)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * self.margin(text) + self.offset, -60, 60))))


def train(
    texts: list[str], labels: list[int], how: Subwords, dim: int = 8, epochs: int = 8, rate: float = 1.0, prior: float = 200.0,
    min_docs: int = 10, min_z: float = 5.0, seed: int = 7,
) -> Model:
    """Vectors of hashed features and the softmax layer, trained together by stochastic gradient descent.

    Each step takes one document: the average of its feature vectors (over its features and ``prior`` empty ones, so that a
    few words say little) goes through the softmax, and the gradient goes back into the layer and the vectors. Features
    are scaled by the inverse root of their deviation. Vectors are learned for features in ``min_docs`` documents or
    more whose presence or share differs between the classes by ``min_z`` standard errors; all others keep weight 0.
    A fifth of the documents is left out of this: the epoch that does best on it stays, and it fits scale and offset.
    Without documents, or with one class only, every score is that class's share (0.5 without documents).
    """
    size = 1 << how.bits
    y = np.array(labels, np.int64)
    share = float(y.mean()) if len(y) else 0.5
    if len(set(labels)) < 2:
        return Model(how, np.zeros(size, np.float32), prior, 1.0, float(np.clip(np.log((share + 1e-4) / (1 - share + 1e-4)), -8, 8)))
    rng = np.random.default_rng(seed)

    def features(t: str) -> tuple[np.ndarray, np.ndarray]:
        parts = list(how.buckets(t))
        u, c = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0))
        return u, (c / (c.sum() + prior)).astype(np.float32)

    seen, mean = np.zeros((2, size), np.float32), np.zeros((2, size), np.float32)
    square = np.zeros(size, np.float32)
    for t, k in zip(texts, labels, strict=True):
        u, x = features(t)
        seen[k][u] += 1
        mean[k][u] += x
        square[u] += x * x
    n = len(y)
    n1, n0 = y.sum(), n - y.sum()
    error = 1 / n1 + 1 / n0
    p = seen.sum(axis=0) / n
    deviation = np.sqrt(np.maximum(square / n - (mean.sum(axis=0) / n) ** 2, 1e-18))
    z = np.abs(seen[1] / n1 - seen[0] / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-6) * error)
    z = np.maximum(z, np.abs(mean[1] / n1 - mean[0] / n0) / (deviation * np.sqrt(error)))
    used = (seen.sum(axis=0) >= min(min_docs, max(2, n // 20))) & (z >= min_z)
    scale = np.where(used, deviation**-0.5, 0).astype(np.float32)
    docs = [(u[k], x[k] * scale[u[k]]) for u, x in map(features, texts) for k in [used[u]]]  # anew, to hold only those used
    order = rng.permutation(n)
    checked, fitted = order[: n // 5], order[n // 5 :]
    if len(set(y[checked].tolist())) < 2:
        checked = fitted = order
    E = ((rng.random((size, dim)) - 0.5) * 1e-4).astype(np.float32)
    W = (rng.random((2, dim)) - 0.5).astype(np.float32)
    bias = np.zeros(2, np.float32)
    step = rate / max(float(np.mean([x @ x for _, x in docs])), 1e-12)
    best = (np.inf, None)
    for epoch in range(epochs):
        now = step * (1 - epoch / epochs)
        for i in rng.permutation(fitted):
            u, x = docs[i]
            v = E[u]
            h = x @ v
            o = W @ h + bias
            e = np.exp(o - o.max())
            g = e / e.sum()
            g[y[i]] -= 1
            back = g @ W
            W -= 0.02 * np.outer(g, h) / max(1.0, float(np.abs(h).max()))
            bias -= 0.02 * g
            E[u] = v - (now * x)[:, None] * back
        w = E @ (W[1] - W[0])
        m = np.array([x @ w[u] for u, x in docs], np.float64)
        a, b = _logistic(m[checked], y[checked])
        q = 1 / (1 + np.exp(-np.clip(a * m[checked] + b, -30, 30)))
        loss = -np.log(np.where(y[checked] == 1, q, 1 - q) + 1e-12).mean()
        if loss < best[0]:
            best = (loss, Model(how, (w * scale).astype(np.float32), prior, a, b))
    return best[1]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """scale >= 0 and offset of a logistic curve through (x, y), by Newton steps with a little ridge."""
    s = float(x.std()) or 1.0
    X = np.stack([x / s, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        h = (X * (p * (1 - p))[:, None]).T @ X + np.diag([0.05, 0.001])
        d = np.linalg.solve(h, X.T @ (p - y) + np.array([0.05, 0.001]) * w)
        w -= np.clip(d, -2, 2)
        if np.abs(d).max() < 1e-9:
            break
    return max(float(w[0]), 0.0) / s, float(w[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable, rows: int) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``rows`` labelled documents, chosen by a hash of doc_id; ``usable`` is a condition on doc_id.

    Of repeated rows of a document the least label and text count. Null labels and null ids are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable)
    known = known.groupBy(F.col("doc_id").alias("l_id")).agg(F.min(label).cast("int").alias("y"))
    some = known.orderBy(F.xxhash64("l_id"), "l_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("l_id"))
    got = found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    got.sort(key=lambda r: r["doc_id"])
    return [r["text"] or "" for r in got], [int(r["y"] > 0) for r in got]


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with the model's score of the whole ``text`` as a last column."""
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in sliced(batches):
            scores = [shared.value.score(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
