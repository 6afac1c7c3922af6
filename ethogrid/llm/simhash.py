"""SimHash near-duplicate detection with a binary trie self-join (operator 7)."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ethogrid.llm.common import drop_written, keeping_names, table, written
from ethogrid.llm.components import connected_components

BITS = 64
LEAF_PAIRS = 64  # node pairs with at most so many leaf pairs are compared directly
MARK = "__near_dedup_mark"  # helper column: what tells rows of one doc_id apart
STEP = 4080  # shingles whose bits are counted at once
MERGE = 1 << 12  # few node pairs of one level go down together, more of them those that agree first
CHUNK = 1 << 13  # node pairs that are taken down one level at a time


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit fingerprint: a bit is 1 if it is set in over half of the XXH64 values of all word shingles.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Fewer words than a shingle: the whole sequence is
    one. No words (null or empty text): 0.
    """
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_digest(line, seed)]
    else:
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        starts = [0, *(gaps[: len(words) - shingle] + 1).tolist()]
        ends = [*gaps[shingle - 1 :].tolist(), len(line)]
        h = xxhash.xxh64_digest
        hashes = [h(line[a:b], seed) for a, b in zip(starts, ends, strict=True)]
    rows = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8)
    return int.from_bytes(majority((rows[i : i + STEP] for i in range(0, len(rows), STEP)), len(rows), BITS), "big")


def majority(pieces, n: int, bits: int) -> bytes:
    """The bits that are set in over half of ``n`` rows, which come in ``pieces`` of bytes (rows, bits / 8) so that long texts need little memory."""
    total = np.zeros(bits, np.int64)
    for rows in pieces:
        flat = np.unpackbits(rows, axis=1)
        for k in range(0, len(flat), 255):
            total += np.add.reduce(flat[k : k + 255], axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > n).tobytes()


def with_fingerprint(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row; ``fp`` is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, shingle, seed) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int, budget: int, bits: int = BITS) -> list[tuple[int, list[int]]]:
    """(bits of the chosen blocks, bit order), one for each choice of ``blocks - budget`` blocks: the chosen blocks' bits come first.

    Two fingerprints that differ in at most ``budget`` bits agree on all bits of at least one choice.
    """
    cuts = [bits * i // blocks for i in range(blocks + 1)]
    parts = [list(range(cuts[i], cuts[i + 1])) for i in range(blocks)]
    out = []
    for chosen in combinations(range(blocks), blocks - budget):
        first = [b for i in chosen for b in parts[i]]
        out.append((len(first), first + [b for i in range(blocks) if i not in chosen for b in parts[i]]))
    return out


def permuted(values: np.ndarray, order: list[int]) -> np.ndarray:
    """Each uint64 with its bits in ``order`` (bit 0 is the highest)."""
    out = np.zeros_like(values)
    i = 0
    while i < BITS:  # move runs of adjacent bits together
        j = i
        while j + 1 < BITS and order[j + 1] == order[j] + 1:
            j += 1
        width = j - i + 1
        run = (values >> np.uint64(BITS - 1 - order[j])) & np.uint64((1 << width) - 1)
        out |= run << np.uint64(BITS - 1 - j)
        i = j + 1
    return out


class _Forest:
    """Labels of leaves 0..n-1 under unions; ``same_until[i]`` is the end of the run of equal labels at i."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.label = np.arange(n)
        self.stale = True

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def union(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Indexes of the pairs (a, b) that joined two sets."""
        self.refresh()
        n = len(self.label)
        _, at = np.unique(self.label[a] * n + self.label[b], return_index=True)
        joined = []
        for k, x, y in zip(at.tolist(), a[at].tolist(), b[at].tolist(), strict=True):
            rx, ry = self.find(x), self.find(y)
            if rx != ry:
                self.parent[max(rx, ry)] = min(rx, ry)
                joined.append(k)
        self.stale = self.stale or bool(joined)
        return joined

    def refresh(self) -> None:
        if not self.stale:
            return
        label = np.array(self.parent)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        self.label = label
        change = np.flatnonzero(label[1:] != label[:-1]) + 1
        ends = np.append(change, len(label))
        self.same_until = ends[np.searchsorted(ends, np.arange(len(label)), side="right")]
        self.stale = False

    def settled(self, p: np.ndarray) -> np.ndarray:
        """Node pairs all of whose leaves lie in one set."""
        self.refresh()
        return (self.same_until[p[0]] >= p[1]) & (self.same_until[p[2]] >= p[3]) & (self.label[p[0]] == self.label[p[2]])


def trie_join(values: np.ndarray, prefix: int, budget: int, forest: _Forest, meet, bits: int = BITS) -> None:
    """Self-join of a binary trie: ``meet(a, b)`` gets the index pairs a < b of values within ``budget`` differing bits.

    ``values`` (uint64, ascending; their first ``bits`` bits count) are the leaves; a node is a range of leaves that agree in their
    first bits. Starting at the nodes of depth ``prefix``, pairs of nodes go down together, adding a differing bit whenever one turns left
    and the other right, and a pair is dropped once that exceeds ``budget`` or once all its leaves lie in one set of ``forest``, which
    ``meet`` may join as it goes. Equal values beyond the last bit are halved by rank.
    """
    n = len(values)
    if n < 2:
        return
    top = values >> np.uint64(BITS - prefix) if prefix else np.zeros(n, np.uint64)
    cut = np.flatnonzero(top[1:] != top[:-1]) + 1
    lo, hi = np.append(0, cut), np.append(cut, n)
    keep = hi - lo > 1
    lo, hi = lo[keep], hi[keep]
    stack = [(prefix, np.stack([lo, hi, lo, hi, np.zeros_like(lo)]))]
    while stack:
        depth, p = stack.pop()
        while stack and stack[-1][0] == depth and p.shape[1] + stack[-1][1].shape[1] <= MERGE:
            p = np.concatenate([p, stack.pop()[1]], axis=1)
        if p.shape[1] > CHUNK:
            for i in range(0, p.shape[1], CHUNK):
                stack.append((depth, p[:, i : i + CHUNK]))
            continue
        p = p[:, ~forest.settled(p)]
        if not p.shape[1]:
            continue
        size = (p[1] - p[0]) * (p[3] - p[2])
        small = size <= LEAF_PAIRS
        if small.any():
            q, m = p[:, small], size[small]
            at = np.repeat(np.arange(len(m)), m)
            k = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            width = (q[3] - q[2])[at]
            a, b = q[0][at] + k // width, q[2][at] + k % width
            ok = (a < b) & (np.bitwise_count(values[a] ^ values[b]) <= budget)
            if ok.any():
                meet(a[ok], b[ok])
            p = p[:, ~small]
            if not p.shape[1]:
                continue
        own = p[0] == p[2]
        err = p[4]
        if depth < bits:
            bit = np.uint64(BITS - 1 - depth)
            above = ~((np.uint64(1) << (bit + np.uint64(1))) - np.uint64(1)) if depth else np.uint64(0)

            def split(first: np.ndarray, last: np.ndarray, above=above, bit=bit) -> np.ndarray:
                return np.minimum(np.searchsorted(values, (values[first] & above) | (np.uint64(1) << bit)), last)

            am, bm, more = split(p[0], p[1]), split(p[2], p[3]), 1
        else:
            am, bm, more = (p[0] + p[1] + 1) // 2, (p[2] + p[3] + 1) // 2, 0
        cross = np.concatenate(
            [
                np.stack([p[0], am, bm, p[3], err + more]),
                np.stack([am, p[1], p[2], bm, err + more])[:, ~own],
            ],
            axis=1,
        )
        along = np.concatenate([np.stack([p[0], am, p[2], bm, err]), np.stack([am, p[1], bm, p[3], err])], axis=1)
        for q in (cross, along):  # pairs that agree come off the stack first, so close leaves are joined first
            q = q[:, (q[0] < q[1]) & (q[2] < q[3]) & (q[4] <= budget)]
            q = q[:, ~((q[0] == q[2]) & (q[1] - q[0] < 2))]
            if q.shape[1]:
                stack.append((min(depth + 1, bits), q))


def trie_links(values: np.ndarray, prefix: int, budget: int) -> np.ndarray:
    """Index pairs (k, 2) that connect distinct ``values`` exactly as all links between values equal in ``prefix`` bits would.

    A pair of nodes is also dropped once both already lie in one component, so a dense ball of values gives a spanning tree.
    """
    forest, links = _Forest(len(values)), []

    def meet(a: np.ndarray, b: np.ndarray) -> None:
        k = forest.union(a, b)
        links.append(np.stack([a[k], b[k]], axis=1))

    trie_join(values, prefix, budget, forest, meet)
    return np.concatenate(links) if links else np.zeros((0, 2), np.int64)


def fingerprint_links(nodes: DataFrame, budget: int = 4, blocks: int | None = None, bucket: int = 512) -> DataFrame:
    """(u, v) links that connect all distinct fingerprints ``fp`` within ``budget`` differing bits.

    Fingerprints are dealt out once for each choice of ``blocks - budget`` of their blocks, keyed by those blocks'
    bits, and each partition self-joins the tries of its keys. ``blocks`` follows from the number of distinct
    fingerprints so that a key holds about ``bucket`` of unrelated ones; any value gives the same links' closure.
    As only distinct fingerprints take part, even one huge family of copies adds few: at most the number of
    values within some bits of each other, however many documents there are.
    """
    if blocks is None:
        n = nodes.count()
        blocks = budget + 1
        while n / 2 ** (BITS * (blocks - budget) // blocks) > bucket and blocks < budget + 4:
            blocks += 1
    orders = block_masks(blocks, budget)

    def deal(batches):
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for c, (first, order) in enumerate(orders):
                w = permuted(v, order)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(v), c, np.int32)), pa.array((w >> np.uint64(BITS - first)).view(np.int64)), pa.array(w.view(np.int64))],
                    ["choice", "key", "w"],
                )

    def join(batches):
        got = [(b.column(0).to_numpy(), b.column(2).to_numpy().view(np.uint64)) for b in batches if b.num_rows]
        if not got:
            return
        choice, w = (np.concatenate(x) for x in zip(*got, strict=True))
        for c, (first, order) in enumerate(orders):
            v = np.unique(w[choice == c])
            at = trie_links(v, first, budget)
            back = np.argsort(order).tolist()
            for i in range(0, len(at), 1 << 20):
                u = permuted(v[at[i : i + (1 << 20)].ravel()], back).view(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1])], ["u", "v"])

    dealt = nodes.select("fp").mapInArrow(deal, "choice int, key long, w long")
    return dealt.repartition("choice", "key").mapInArrow(join, "u long, v long")


def rooted_fingerprints(docs: DataFrame, budget: int = 4, shingle: int = 4, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) for every row of ``docs``, and (fp, least_id, root) for every distinct fingerprint: root is the least it reaches."""
    fps = written(with_fingerprint(docs, shingle, seed), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    comps = connected_components(fingerprint_links(fps.select("fp").distinct(), budget))
    rooted = nodes.join(comps, nodes.fp == comps.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "roots")
    drop_written(comps)
    return fps, rooted


def simhash_components(docs: DataFrame, budget: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id among all rows whose fingerprints link, directly or over others, at
    ``budget`` or fewer differing bits. Rows without words have fingerprint 0 and link like any other. Repeated rows each
    appear. A null doc_id is never a component_id unless all rows of the component have none. Empty table: no rows.
    """
    fps, rooted = rooted_fingerprints(docs, budget, shingle, seed)
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select(F.col("fp").alias("node_fp"), "component_id")
    return fps.join(named, fps.fp == named.node_fp, "left").select("doc_id", "fp", "component_id")


@keeping_names
def simhash_keep_one(docs: DataFrame, budget: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` with one document of each component: that with the smallest doc_id.

    Where rows of several components share that doc_id, each component keeps one of its own rows; of those with that doc_id and one
    fingerprint the row with the least text stays. Rows without a doc_id can't be named as a copy and stay.
    """
    _, rooted = rooted_fingerprints(docs, budget, shingle, seed)
    kept = rooted.where("least_id is not null").groupBy("root").agg(F.min(F.struct("least_id", "fp")).alias("x"))
    kept = kept.select(F.col("x.least_id").alias("doc_id"), F.col("x.fp").alias("mark"))

    def mark(batches):
        for b in batches:
            fps = [fingerprint(t, shingle, seed) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.array(fps, np.uint64).view(np.int64))], [*b.schema.names, MARK])

    marked = docs.where("doc_id is not null").mapInArrow(mark, T.StructType([*docs.schema.fields, T.StructField(MARK, T.LongType())]))
    return kept_rows(marked, kept).unionByName(docs.where("doc_id is null"))


def kept_rows(marked: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``marked`` whose doc_id and ``MARK`` are in ``kept`` (doc_id, mark), one for each: that with the least text, null first."""
    right = kept.select(F.col("doc_id").alias("__kept_id"), F.col("mark").alias("__kept_mark"))
    joined = marked.join(right, (F.col("doc_id") == F.col("__kept_id")) & (F.col(MARK) == F.col("__kept_mark"))).drop("__kept_id", "__kept_mark")
    place = F.row_number().over(Window.partitionBy("doc_id", MARK).orderBy("text"))
    return joined.withColumn("__kept_place", place).where("__kept_place = 1").drop("__kept_place", MARK)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` at 4 or fewer of 64 differing bits over 4-word shingles."""
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
