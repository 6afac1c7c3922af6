"""SimHash near-duplicates confirmed by the Jaccard similarity of five-word shingles (operator 7, as the pipeline uses it).

Fingerprints of 512 bits are cut into pieces of 32; the binary trie self-join of :mod:`simhash` finds documents that agree in a piece but
for ``BUDGET`` bits, all 512 bits say how close the pair is, and exact shingle sets decide.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ethogrid.llm.common import drop_written, keeping_names, sliced, written
from ethogrid.llm.components import connected_components
from ethogrid.llm.simhash import BITS, MARK, STEP, _Forest, block_masks, kept_rows, majority, permuted, trie_join

SHINGLE = 5
SIMILAR = 0.8
WORDS = 8  # 64-bit words of a fingerprint
PIECE = 32  # bits of a piece
PIECES = 8  # pieces that are joined, one trie each
BUDGET = 3  # bits in which two pieces may differ
#: Bits of 512 that differ: at a similarity of 0.8 some 78 with a deviation of 8, at 0.9 some 53 with 7.
FAR, SURE = 102, 53
BUCKET = 4096  # fingerprints that share a key, about
EDGES = 1 << 20  # candidate pairs held before they are thinned to a forest
_ODD = np.random.default_rng(42).integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def line_of(text: str | None) -> bytes:
    """Words as :func:`simhash.fingerprint` has them, one space between; null is empty."""
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split()) if text else b""


def node_of(line: bytes) -> bytes:
    return hashlib.md5(line, usedforsecurity=False).digest()


def shingles(line: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of all word shingles; fewer words than a shingle are one, no words none."""
    import xxhash

    if not line:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    n = len(gaps) + 2 - shingle
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(line)], np.uint64)
    starts = [0, *(gaps[: n - 1] + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(line)]
    h = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([h(line[a:b]) for a, b in zip(starts, ends, strict=True)]), np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """SimHash of 512 bits over distinct shingles; each shingle's hash is mixed to ``WORDS`` words."""

    def mixed():
        for i in range(0, len(hashes), STEP):
            x = hashes[i : i + STEP, None] * _ODD
            for _ in range(2):
                x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            yield (x ^ (x >> np.uint64(32))).view(np.uint8)

    return majority(mixed(), len(hashes), WORDS * 64)


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Indexes of the edges of a minimum spanning forest (Boruvka's rounds; ties go to the earlier edge)."""
    rank = np.empty(len(cost), np.int64)
    rank[np.argsort(cost, kind="stable")] = np.arange(len(cost))
    label, chosen, alive = np.arange(n), [], np.arange(len(cost))
    while len(alive):
        la, lb = label[a[alive]], label[b[alive]]
        alive, la, lb = (x[la != lb] for x in (alive, la, lb))
        if not len(alive):
            break
        best = np.full(n, len(cost))
        np.minimum.at(best, la, rank[alive])
        np.minimum.at(best, lb, rank[alive])
        pick = alive[(best[la] == rank[alive]) | (best[lb] == rank[alive])]
        chosen.append(pick)
        forest = np.arange(n)  # hook each component along its best edge; ranks differ, so only mutual pairs form loops
        la, lb = label[a[pick]], label[b[pick]]
        mine, other = best[la] == rank[pick], best[lb] == rank[pick]
        forest[la[mine]] = lb[mine]
        forest[lb[other & ~mine]] = la[other & ~mine]
        both = mine & other
        forest[np.maximum(la, lb)[both]] = np.minimum(la, lb)[both]
        forest[np.minimum(la, lb)[both]] = np.minimum(la, lb)[both]
        while not np.array_equal(up := forest[forest], forest):
            forest = up
        label = forest[label]
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def fixed(column, width: int) -> np.ndarray:
    """Rows of a binary column of one length as bytes (n, width)."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def close_pairs(wide: np.ndarray, values: np.ndarray, prefix: int, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, differing bits of 512): a minimum spanning forest of the pairs that the trie join of ``values`` proposes within ``FAR`` bits.

    Single links at every similarity are links of such a forest, so it stands for all pairs and has fewer edges than documents. Pairs within
    ``SURE`` bits join at once, which lets the trie drop what lies in one set already.
    """
    forest, held, size = _Forest(len(values)), [np.zeros((3, 0), np.int64)], 0

    def thin() -> None:
        e = np.concatenate(held, axis=1)
        held[:] = [e[:, spanning_forest(len(values), *e)]]

    def meet(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal size
        forest.refresh()
        new = forest.label[a] != forest.label[b]
        a, b = a[new], b[new]
        bits = np.bitwise_count(wide[a] ^ wide[b]).sum(axis=1, dtype=np.int64)
        sure = np.flatnonzero(bits <= SURE)
        sure = sure[np.argsort(bits[sure], kind="stable")]
        joined = sure[forest.union(a[sure], b[sure])] if len(sure) else sure
        take = np.append(joined, np.flatnonzero((bits > SURE) & (bits <= FAR)))
        held.append(np.stack([a[take], b[take], bits[take]]))
        size += len(take)
        if size > EDGES:
            thin()
            size = 0

    trie_join(values, prefix, budget, forest, meet, PIECE)
    thin()
    return tuple(held[0])


def near_pairs(nodes: DataFrame, budget: int = BUDGET, pieces: int = PIECES, bucket: int = BUCKET) -> DataFrame:
    """(u, v) pairs of nodes to confirm, from ``nodes`` (row: 16 bytes of node and 64 of fingerprint, distinct).

    Each piece is dealt out once for each choice of its blocks that two pieces within ``budget`` must share, as ``simhash.fingerprint_links``
    does; the number of blocks follows from the number of nodes, so a key holds about ``bucket`` unrelated ones and any choice proposes the same pairs.
    """
    n = nodes.count()
    blocks = budget + 1
    while n / 2 ** (PIECE * (blocks - budget) // blocks) > bucket and blocks < budget + 4:
        blocks += 1
    orders = [(f, [*o, *range(PIECE, BITS)]) for f, o in block_masks(blocks, budget, PIECE)]
    masks = [(k, first, order) for k in range(pieces) for first, order in orders]

    def piece(rows: np.ndarray, k: int, order: list[int]) -> np.ndarray:
        cut = np.ascontiguousarray(rows[:, 16 + 4 * k : 20 + 4 * k]).view(">u4").ravel().astype(np.uint64) << np.uint64(BITS - PIECE)
        return permuted(cut, order)

    def deal(batches):
        for b in batches:
            rows = fixed(b.column(0), 16 + WORDS * 8)
            for c, (k, first, order) in enumerate(masks):
                key = (piece(rows, k, order) >> np.uint64(BITS - first)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), c, np.int32)), pa.array(key), b.column(0)], ["choice", "key", "row"])

    def join(batches):
        got = [(b.column(0).to_numpy(), fixed(b.column(1), 16 + WORDS * 8)) for b in batches if b.num_rows]
        if not got:
            return
        choice, rows = (np.concatenate(x) for x in zip(*got, strict=True))
        for c in np.unique(choice).tolist():
            k, first, order = masks[c]
            mine = rows[choice == c]
            values = piece(mine, k, order)
            at = np.argsort(values, kind="stable")
            mine = mine[at]
            a, b, _ = close_pairs(np.ascontiguousarray(mine[:, 16:]).view(np.uint64), values[at], first, budget)
            ids = [x.tobytes() for x in mine[:, :16]] if len(a) else []
            for i in range(0, len(a), 1 << 16):
                u, v = ([ids[x] for x in s[i : i + (1 << 16)].tolist()] for s in (a, b))
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

    dealt = nodes.mapInArrow(deal, "choice int, key long, row binary").repartition("choice", "key").select("choice", "row")
    found = dealt.mapInArrow(join, "u binary, v binary")
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def similar_links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v) for the pairs of :func:`near_pairs` whose shingles have a Jaccard similarity of ``SIMILAR`` or more."""
    pairs = written(near_pairs(nodes), "pairs")

    def lines(batches):
        for b in sliced(batches):
            got = [line_of(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f(x) for x in got], pa.binary()) for f in (node_of, lambda x: zlib.compress(x, 1))], ["node", "line"])

    def confirm(batches):
        held = lru_cache(64)(lambda line: shingles(zlib.decompress(line)))
        for b in sliced(batches, 64):
            u, v, a, c = (x.to_pylist() for x in b.columns)
            ok = [k for k, (x, y) in enumerate(zip(a, c, strict=True)) if jaccard(held(x), held(y)) >= SIMILAR]
            yield pa.RecordBatch.from_arrays([pa.array([s[k] for k in ok], pa.binary()) for s in (u, v)], ["u", "v"])

    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    texts = docs.select("text").mapInArrow(lines, "node binary, line binary").join(wanted, "node", "left_semi")
    texts = written(texts.groupBy("node").agg(F.first("line").alias("line")), "lines")
    left = texts.select(F.col("node").alias("u"), F.col("line").alias("a"))
    right = texts.select(F.col("node").alias("v"), F.col("line").alias("b"))
    links = written(pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(confirm, "u binary, v binary"), "links")
    drop_written(pairs)
    drop_written(texts)
    return links


def similar_components(docs: DataFrame) -> DataFrame:
    """(node, least_id, root) for every distinct sequence of words in ``docs``: its least doc_id, and the least node its links reach.

    ``node`` is the MD5 of the lower-cased words. Texts without words (null, empty, white space) are one node. Empty table: no rows.
    """

    def sketch(batches):
        for b in sliced(batches):
            lines = [line_of(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([node_of(x) + wide_fingerprint(shingles(x)) for x in lines], pa.binary())], ["doc_id", "row"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = named.mapInArrow(sketch, "doc_id long, row binary").groupBy("row").agg(F.min("doc_id").alias("least_id"))
    fps = written(sketches, "sketches")
    links = similar_links(docs, fps.select("row"))
    comps = connected_components(links).withColumnsRenamed({"node": "__node", "root": "__root"})
    nodes = fps.select(F.substring("row", 1, 16).alias("node"), "least_id")
    rooted = written(nodes.join(comps, F.col("node") == F.col("__node"), "left").select("node", "least_id", F.coalesce("__root", "node").alias("root")), "roots")
    drop_written(links)
    drop_written(fps)
    return rooted


@keeping_names
def similar_keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document of each component of equal or linked texts: that with the smallest doc_id.

    Each component keeps a row of its own, also where others share its doc_id; of rows with that doc_id and the same words the one with the
    least text stays. Rows without a doc_id can't be named as a copy and stay. Texts without words are copies of each other.
    """
    found = similar_components(docs).where("least_id is not null").groupBy("root").agg(F.min(F.struct("least_id", "node")).alias("x"))
    kept = found.select(F.col("x.least_id").alias("doc_id"), F.col("x.node").alias("mark"))
    at = docs.columns.index("text")

    def mark(batches):
        for b in sliced(batches):
            nodes = pa.array([node_of(line_of(t)) for t in b.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, nodes], [*b.schema.names, MARK])

    marked = docs.where("doc_id is not null").mapInArrow(mark, T.StructType([*docs.schema.fields, T.StructField(MARK, T.BinaryType())]))
    return kept_rows(marked, kept).unionByName(docs.where("doc_id is null"))
