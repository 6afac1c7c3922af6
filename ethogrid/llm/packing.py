"""Best-fit packing of token sequences into several permitted lengths, chosen jointly (operator 6)."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ethogrid.llm.common import sliced, table, written
from ethogrid.llm.sstable import END_ID, _encoder, default_tokenizer

CAPACITIES = (2048, 4096, 8192, 16384)  # permitted sequence lengths, in tokens
OVERHEAD = 64  # what a sequence costs besides its tokens
ATTENTION = 12288  # length at which attention costs as much as all else (6 x a model width of 2048)
REMEMBERED = 250_000  # chunks whose ids a worker of the pipeline remembers at most, and for one partition
SHARD_ROWS = 20_000  # pieces that are packed together, about


class Rooms:
    """Numbers kept as counts, with the largest up to a limit or the smallest from one on found by a bit set."""

    def __init__(self):
        self.bits = 0
        self.count: dict[int, int] = {}

    def add(self, n: int, k: int = 1) -> None:
        left = self.count.get(n, 0) + k
        self.count[n] = left
        self.bits = self.bits | 1 << n if left else self.bits & ~(1 << n)

    def at_most(self, n: int) -> int:
        return (self.bits & ((1 << n + 1) - 1)).bit_length() - 1

    def at_least(self, n: int) -> int:
        rest = self.bits >> n
        return n + (rest & -rest).bit_length() - 1 if rest else -1


def cost_of(capacity: int, overhead: int = OVERHEAD, attention: float = ATTENTION) -> float:
    """Cost of a sequence: its tokens, attention over all pairs of them, and an overhead."""
    return capacity + capacity * capacity / attention + overhead


def fill(room: int, coming: Rooms) -> int:
    """What the pieces still to come would put into ``room``: the largest that fits, again and again."""
    free, n = room, coming.at_most(room)
    while n > 0:
        free -= n * min(coming.count[n], free // n)
        n = coming.at_most(min(free, n - 1))
    return room - free


def _pack(lengths: list[int], open_size) -> tuple[list[int], list[int], list[int]]:
    """Best fit: (bin of each piece, its offset in the bin, tokens of each bin); ``open_size(size, coming)`` opens bins."""
    coming, rooms = Rooms(), Rooms()
    for n in lengths:
        coming.add(n)
    free: dict[int, deque[int]] = {}  # room -> open bins, oldest first
    bin_of, offset, used = [], [], []
    for size in lengths:
        coming.add(size, -1)
        room = rooms.at_least(size)
        if room >= 0:
            k = free[room].popleft()
            rooms.add(room, -1)
        else:
            k, room = len(used), open_size(size, coming)
            used.append(0)
        bin_of.append(k)
        offset.append(used[k])
        used[k] += size
        room -= size
        if room:
            free.setdefault(room, deque()).append(k)
            rooms.add(room)
    return bin_of, offset, used


def pack(
    lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: float = ATTENTION
) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, its offset in the bin, capacity of each bin). Each length is 1 to the largest capacity, in descending order.

    A piece goes into the open bin with the least room that still holds it, the oldest of equals. If none does, a bin of the size is opened whose
    cost for each token that it would hold is least, the smaller of equals: what it would hold follows from the lengths of all pieces
    still to come (:func:`fill`), and its cost is that of the size it would end with. At the end each bin takes the smallest permitted
    size that holds its contents. So is packed once more with each single size for opening (the least that holds a larger piece), and
    the packing that costs least in all is taken.
    """
    order = sorted(capacities)

    def down(n: int) -> int:
        return next(c for c in order if c >= n)

    def least_cost(size: int, coming: Rooms) -> int:
        held = {c: size + fill(c - size, coming) for c in order if c >= size}
        return min(held, key=lambda c: (cost_of(down(held[c]), overhead, attention) / held[c], c))

    rules = [least_cost, *(lambda size, _, c=c: max(c, down(size)) for c in reversed(order))]
    plans = [_pack(lengths, rule) for rule in rules]
    totals = [sum(cost_of(down(u), overhead, attention) for u in used) for *_, used in plans]
    bin_of, offset, used = plans[totals.index(min(totals))]
    return bin_of, offset, [down(u) for u in used]


def pack_documents(
    lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: float = ATTENTION, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """(doc_id, length, copy, piece, piece_start, piece_len, bin_id, bin_offset, bin_capacity) for ``lengths`` (doc_id, length).

    A document longer than the largest capacity is cut into pieces of that capacity and a last one; together they are the whole
    document. Documents of no tokens (length 0 or null) have one piece of length 0 in no bin (bin_id null, capacity 0). Rows with one doc_id and
    length are counted by ``copy`` from 0. Pieces are dealt by a hash of doc_id, length, copy and piece into shards of about ``shard_rows``, so
    a task packs a bounded number whatever ids repeat or are null, and each shard is packed by :func:`pack` with pieces in descending length,
    then by doc_id, length, copy and piece. bin_id is shard * 2**32 + bin. Repeated rows are packed each; a null doc_id is packed like any other.
    """
    most = max(capacities)
    size = F.coalesce(F.col("length").cast("long"), F.lit(0))
    alike = lengths.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("length")).groupBy("doc_id", "length").agg(F.count("*").alias("rows"))
    alike = written(alike, "lengths")  # texts are encoded once: the rows are counted before they are dealt
    n = alike.agg(F.sum(F.col("rows") * F.greatest(F.ceil(F.col("length") / most), F.lit(1)))).first()[0] or 0
    shards = max(1, -(-int(n) // shard_rows))
    each = alike.select("doc_id", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("copy"))
    each = each.select("*", F.explode(F.sequence(F.lit(0), F.greatest((F.ceil(F.col("length") / most) - 1).cast("int"), F.lit(0)))).alias("piece"))
    start = F.col("piece").cast("long") * most
    pieces = each.select("*", start.alias("piece_start"), F.least(F.col("length") - start, F.lit(most)).alias("piece_len"))
    empty = pieces.where("piece_len = 0").select("*", F.lit(None).cast("long").alias("bin_id"), F.lit(0).cast("long").alias("bin_offset"), F.lit(0).alias("bin_capacity"))
    dealt = pieces.where("piece_len > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "length", "copy", "piece"), F.lit(shards)).cast("long"))
    names = ["doc_id", "length", "copy", "piece", "piece_start", "piece_len"]

    def solve(pdf):
        pdf = pdf.sort_values(["piece_len", "doc_id", "length", "copy", "piece"], ascending=[False, True, True, True, True], kind="stable", na_position="first")
        bins, offsets, sizes = pack(pdf["piece_len"].tolist(), capacities, overhead, attention)
        out = pdf[names].copy()
        out["bin_id"] = [int(s) << 32 | b for s, b in zip(pdf["shard"], bins, strict=True)]
        out["bin_offset"] = offsets
        out["bin_capacity"] = [sizes[b] for b in bins]
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    schema = "doc_id long, length long, copy long, piece int, piece_start long, piece_len long, bin_id long, bin_offset long, bin_capacity int"
    return dealt.groupBy("shard").applyInPandas(solve, schema).unionByName(empty)


def token_ids(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text, ids) of every row: the ids of the whole text and ``end_id``, little-endian 32-bit integers. Null text is empty."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = _encoder(path)
        for b in sliced(batches):
            ids = [np.append(x, x.dtype.type(end_id)).astype("<u4").tobytes() for x in enc.ids(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.binary())], ["doc_id", "text", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string, ids binary")


def text_lengths(docs: DataFrame, tokenizer: str | None = None, remembered: int | None = REMEMBERED) -> DataFrame:
    """(doc_id, length) of every row: tokens of the whole text, with the end id.

    ``remembered``: chunks of text whose ids a worker keeps at most, and for one partition; None for as many as ``sstable.CACHE``, from one partition to the
    next, which takes more memory and less time.
    """
    path = tokenizer or default_tokenizer()

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = _encoder(path)
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n + 1 for n in enc.counts(b.column(1).to_pylist())], pa.int64())], ["doc_id", "length"])
            if remembered is not None:
                enc.forget(remembered)
        if remembered is not None:
            enc.forget(0)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, length long")


def packed_sequences(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, shard_rows: int = SHARD_ROWS, tokenizer: str | None = None) -> DataFrame:
    """(bin_id, capacity, n_tokens, doc_ids, ends, ids): the sequences that ``docs`` (doc_id, text) fill.

    ``ids`` are the pieces' ids one after another, ``ends`` the offset after each piece and ``doc_ids`` whose it is (null for no id); what is
    left up to ``capacity`` is for padding. Each document's ids are in the result once. Rows of one id and length are told apart by the order of their
    texts. A sequence is gathered from at most ``capacity`` ids.
    """
    coded = token_ids(docs, tokenizer).withColumn("length", (F.octet_length("ids") / 4).cast("long"))
    packing = pack_documents(coded.select("doc_id", "length"), capacities, shard_rows=shard_rows)
    coded = coded.withColumn("copy", (F.row_number().over(Window.partitionBy("doc_id", "length").orderBy("text")) - 1).cast("long"))
    right = coded.select(F.col("doc_id").alias("id"), F.col("length").alias("n"), F.col("copy").alias("c"), "ids")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("length") == F.col("n")) & (F.col("copy") == F.col("c"))
    piece = F.expr("substring(ids, cast(piece_start * 4 + 1 as int), cast(piece_len * 4 as int))").alias("piece_ids")
    pieces = packing.join(right, same).select("bin_id", "bin_capacity", F.struct("bin_offset", "piece_len", "doc_id", piece).alias("x"))
    rows = pieces.groupBy("bin_id").agg(F.first("bin_capacity").alias("capacity"), F.array_sort(F.collect_list("x")).alias("xs"))

    def join(batches):
        for b in batches:
            for bin_id, capacity, xs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.frombuffer(b"".join(x["piece_ids"] for x in xs), "<u4").astype(np.int32)
                ends = [x["bin_offset"] + x["piece_len"] for x in xs]
                values = [bin_id], [capacity], [len(ids)], [[x["doc_id"] for x in xs]], [ends], [ids]
                kinds = pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())
                names = ["bin_id", "capacity", "n_tokens", "doc_ids", "ends", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

    return rows.mapInArrow(join, "bin_id long, capacity int, n_tokens int, doc_ids array<long>, ends array<int>, ids array<int>")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as tokens, packed into sequences of 2,048, 4,096, 8,192 or 16,384."""
    return pack_documents(text_lengths(table(spark, sf_dir, "documents"), remembered=None))
