"""Benchmark decontamination by Wu-Manber multi-pattern search over words (operator 5)."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ethogrid.llm.common import drop_written, keeping_names, sliced, table, written

WINDOW = 10
PART_BYTES = 16 << 20  # benchmark text whose search tables (some 10 x its size) are in memory at once

#: A-Z to a-z; ASCII other than letters and digits to a space; all other bytes stay.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class WuManber:
    """Search for windows of ``size`` words in flat arrays. Blocks are two adjacent words (one where windows have one word), by hash.

    ``shift``: for each block hash, how far the search may move on; one byte. ``begins``: where the bucket of windows that end in a
    block hash begins in the arrays ``first`` (hash of a window's first word), ``at`` and ``to`` (its bytes in ``lines``) and ``owned``
    (where its owners begin in ``owners``, numbers of items). Windows of equal bytes are one.
    """

    def __init__(self, size: int, lines: bytes, rows: np.ndarray, shifts: np.ndarray):
        """``rows``: (last block, first word, begin, end, item, hash of the window) of every window; ``shifts``: (block, words after it)."""
        self.size, self.lines = size, lines
        self.block = min(2, size)
        self.most = size - self.block + 1
        bits = max(10, int(2 * len(rows) + 1).bit_length())
        self.mask = (1 << bits) - 1
        shift = np.full(self.mask + 1, self.most, np.uint8)
        np.minimum.at(shift, shifts[:, 0] & self.mask, shifts[:, 1].astype(np.uint8))
        self.shift = shift.tobytes()
        last, first, at, to, item, whole = rows.T
        order = np.lexsort((item, whole, last & self.mask))
        last, first, at, to, item, whole = (x[order] for x in (last & self.mask, first, at, to, item, whole))
        like = np.flatnonzero((last[1:] == last[:-1]) & (whole[1:] == whole[:-1])) if len(last) else np.zeros(0, np.int64)
        same = np.zeros(len(last), bool)
        same[[k + 1 for k in like.tolist() if lines[at[k] : to[k]] == lines[at[k + 1] : to[k + 1]]]] = True
        heads = np.flatnonzero(~same)
        self.begins = np.searchsorted(last[heads], np.arange(self.mask + 2)).astype(np.uint32)
        self.first, self.at, self.to = first[heads].astype(np.uint32), at[heads].astype(np.uint32), to[heads].astype(np.uint32)
        self.owned, self.owners = np.append(heads, len(item)).astype(np.uint32), item.astype(np.int32)

    def search(self, text: list[bytes]):
        """(index of the first word, number of the window) of every occurrence."""
        size, shift, mask, begins, pair, crc = self.size, self.shift, self.mask, self.begins, self.block == 2, zlib.crc32
        i, n = size - 1, len(text)
        while i < n:
            h = crc(text[i - 1] + b" " + text[i] if pair else text[i]) & mask
            step = shift[h]
            if step:
                i += step
                continue
            start = i - size + 1
            a, b = int(begins[h]), int(begins[h + 1])
            if a < b:
                first = crc(text[start])
                line = None
                for k in range(a, b):
                    if self.first[k] == first:
                        line = b" ".join(text[start : i + 1]) if line is None else line
                        if self.lines[self.at[k] : self.to[k]] == line:
                            yield start, k
            i += 1

    def items_of(self, window: int) -> list[int]:
        return self.owners[self.owned[window] : self.owned[window + 1]].tolist()


class Search:
    """A :class:`WuManber` for each window length in ``items`` (item_id, text), and the item ids as text."""

    def __init__(self, items):
        import xxhash

        number, rows, shifts, lines, length = {}, {}, {}, bytearray(), 0
        for item, text in items:
            w = words(text)
            size = min(WINDOW, len(w))
            if not size:
                continue
            mine = number.setdefault(item, len(number))
            line = b" ".join(w)
            starts = np.cumsum([0, *(len(x) + 1 for x in w)])
            block = min(2, size)
            keys = np.array([zlib.crc32(line[a : b - 1]) for a, b in zip(starts.tolist(), starts[block:].tolist(), strict=False)], np.int64)
            n = len(w) - size + 1
            first = np.array([zlib.crc32(x) for x in w[:n]], np.int64)
            begin, end = starts[:n], starts[size:] - 1
            whole = np.array([xxhash.xxh64_intdigest(line[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)], np.uint64).view(np.int64)
            rows.setdefault(size, []).append(np.stack([keys[size - block :], first, begin + length, end + length, np.full(n, mine), whole], axis=1))
            # the least number of words after a block in any window that holds it: 0 from the first window's end on
            after = np.maximum(size - block - np.arange(len(keys)), 0)
            shifts.setdefault(size, []).append(np.stack([keys, after], axis=1))
            lines += line + b" "
            length = len(lines)
        self.items = [None if x is None else str(x) for x in number]
        lines = bytes(lines)
        self.by_size = [WuManber(k, lines, np.concatenate(rows[k]), np.concatenate(shifts[k])) for k in sorted(rows)]

    def find(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(word spans that all occurrences cover, in order and apart, ids of their items)."""
        spans, items = [], set()
        for m in self.by_size:
            for start, window in m.search(text):
                spans.append((start, start + m.size))
                items.update(m.items_of(window))
        return united(spans), {self.items[k] for k in items} - {None}


def united(spans) -> list[tuple[int, int]]:
    """Spans (a, b) in order, those that overlap or touch as one."""
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def benchmark_parts(benchmark: DataFrame, part_bytes: int = PART_BYTES) -> int:
    size = benchmark.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    return max(1, -(-size // part_bytes))


MARKS = "__op5_n_words long, __op5_spans array<struct<a:int,b:int>>, __op5_items array<string>"


def _searched(docs: DataFrame, search: Search, hits_only: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with the columns ``MARKS``; with ``hits_only`` only rows in which a window occurs."""
    tables = docs.sparkSession.sparkContext.broadcast(search)
    at, names = docs.columns.index("text"), [*docs.columns, "__op5_n_words", "__op5_spans", "__op5_items"]
    kinds = [pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.list_(pa.string())]

    def run(batches):
        for b in sliced(batches):
            got = []
            for t in b.column(at).to_pylist():
                w = words(t)
                spans, items = tables.value.find(w)
                got.append((len(w), [{"a": p, "b": q} for p, q in spans], sorted(items)))
            out = pa.RecordBatch.from_arrays([*b.columns, *(pa.array([x[k] for x in got], kind) for k, kind in enumerate(kinds))], names)
            yield out.filter(pa.array([bool(x[1]) for x in got], pa.bool_())) if hits_only else out

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *T._parse_datatype_string(MARKS).fields]))


def mark_contamination(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` with ``__op5_n_words``, ``__op5_spans`` (word spans a, b, apart) and ``__op5_items`` (item ids as text).

    The benchmark is dealt by a hash into parts of about ``part_bytes`` of text (one item is never cut), and the search tables of one part are
    built and broadcast at a time, so memory is bounded whatever the benchmark's size. A benchmark of one part is searched for in one
    pass without a shuffle. Of more, each part is a pass of its own over the texts that writes the hits of the documents it finds, by doc_id and a hash
    of the text, and these are joined to the documents at the end.
    """
    parts = benchmark_parts(benchmark, part_bytes)
    if parts == 1:
        return _searched(docs, Search(tuple(r) for r in benchmark.select("item_id", "text").toLocalIterator()))
    key = [F.col("doc_id").alias("__op5_id"), F.xxhash64("text").alias("__op5_hash")]
    hits = []
    for k in range(parts):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        search = Search(tuple(r) for r in part.select("item_id", "text").toLocalIterator())
        found = _searched(docs.select(*key, "text"), search, hits_only=True).dropDuplicates(["__op5_id", "__op5_hash"])
        hits.append(written(found.select("__op5_id", "__op5_hash", "__op5_spans", "__op5_items"), "hits"))
    every = hits[0]
    for more in hits[1:]:
        every = every.unionByName(more)
    merge = F.flatten(F.collect_list("__op5_spans")).alias("__op5_spans"), F.array_distinct(F.flatten(F.collect_list("__op5_items"))).alias("__op5_items")
    every = written(every.groupBy("__op5_id", "__op5_hash").agg(*merge), "hits")
    for x in hits:
        drop_written(x)
    same = docs.doc_id.eqNullSafe(F.col("__op5_id")) & (F.xxhash64(docs.text) == F.col("__op5_hash"))
    joined = docs.join(every, same, "left").drop("__op5_id", "__op5_hash")
    names = [*docs.columns, "__op5_n_words", "__op5_spans", "__op5_items"]
    at = docs.columns.index("text")

    def close(batches):
        for b in batches:
            spans = [[{"a": p, "b": q} for p, q in united((x["a"], x["b"]) for x in s or ())] for s in b.column(b.num_columns - 2).to_pylist()]
            items = [sorted(x or ()) for x in b.column(b.num_columns - 1).to_pylist()]
            counts = [len(words(t)) for t in b.column(at).to_pylist()]
            kinds = pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *(pa.array(v, kind) for v, kind in zip((counts, spans, items), kinds, strict=True))], names)

    return joined.mapInArrow(close, T.StructType([*docs.schema.fields, *T._parse_datatype_string(MARKS).fields]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs`` (doc_id, text).

    A benchmark window is 10 consecutive words of an item, or all its words if fewer; an item without words (or with
    null text) has none. n_hit counts the document's words inside any occurrence of a window, n_items the items with occurring
    windows. Repeated benchmark rows count once, since an item is its id; windows of an item without id mark words but
    name no item. Null or empty document text: no words. Empty benchmark: nothing is hit. Other columns are ignored.
    """
    marked = mark_contamination(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, part_bytes)

    def close(batches):
        for b in batches:
            hit = [sum(s["b"] - s["a"] for s in x) for x in b.column(2).to_pylist()]
            items = b.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array(hit, pa.int64()),
                    pa.array([len(x) for x in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items], pa.string()),
                    pa.array([h > 0 for h in hit], pa.bool_()),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return marked.select("doc_id", "__op5_n_words", "__op5_spans", "__op5_items").mapInArrow(close, schema)


@keeping_names
def drop_contaminated(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window, with their columns.

    Null and empty texts hold none and stay; rows that repeat stay or go together. An empty benchmark drops nothing.
    """
    return mark_contamination(docs, benchmark, part_bytes).where(F.size("__op5_spans") == 0).select(docs.columns)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` inside windows of ``benchmark``."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS s FROM bi),
di AS (SELECT d.doc_id, d.w, x.m, unnest(range(1, len(d.w) - x.m + 2)) AS i
       FROM d CROSS JOIN (SELECT DISTINCT m FROM bw) x WHERE len(d.w) >= x.m),
dw AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS s FROM di),
occ AS (SELECT dw.doc_id, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.m = bw.m),
pos AS (SELECT doc_id, i + unnest(range(0, m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM occ)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM pos GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
