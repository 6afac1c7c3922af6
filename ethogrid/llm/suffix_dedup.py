"""Removal of repeated long byte strings by bucket-pointer refinement of suffixes (operator 10)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethogrid.llm.common import drop_written, keeping_names, release, sliced, table, written

LENGTH = 200  # bytes of a repeated string
GRAM = 32  # bytes of an anchor
Q = 8  # bytes of the first suffix buckets; doubled until LENGTH
SEGMENT = 1 << 19  # bytes hashed at once
CHUNK = 1 << 18  # bytes of suffixes refined at once
BLOCK = 1 << 17  # suffixes of a pass that are sorted before their pointers are set
HOT = 4096  # distinct regions of an anchor (1.2 MB) beyond which its windows are dealt out one by one

_U = np.uint64
_BYTE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_pow: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _pow or len(_pow[0]) < n:
        size = max(n, SEGMENT + 2 * LENGTH)
        with np.errstate(over="ignore"):
            _pow[:] = [np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _U(b))])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _pow[0][:n], _pow[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _prefix(b: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] == hash of b[i:j] * base**i."""
    p = np.zeros(len(b) + 1, _U)
    np.cumsum(_BYTE[b] * _powers(len(b))[0], out=p[1:])
    return p


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Anchors of the strings that ``data`` holds one after another; ``ends`` are their ends.

    Every ``length``-byte window inside one string has one anchor: its first ``gram``-byte string of least hash, which
    follows from the window's bytes alone. Returns arrays (pos, lo, hi, gram hash, region hash): the windows that start at
    lo..hi have their anchor at pos, and the region hash covers bytes lo..hi+length and where pos lies in them.
    """
    n, w = len(data), length - gram + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, _U),) * 2
    p, inv = _prefix(data), _powers(n + 1)[1]
    g = _mix((p[gram:] - p[:-gram]) * inv[: n - gram + 1])
    key = np.full(-(-len(g) // w) * w, np.iinfo(_U).max, _U)
    key[: len(g)] = (g & _U(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=_U)
    rows = key.reshape(-1, w)
    left = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(rows, axis=1).ravel()
    starts = np.arange(n - length + 1)
    at = (np.minimum(left[: len(starts)], right[w - 1 : w - 1 + len(starts)]) & _U(0xFFFFFFFF)).astype(np.int64)
    inside = ends[np.searchsorted(ends, starts, side="right")] >= starts + length
    starts, at = starts[inside], at[inside]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, _U),) * 2
    new = np.append(True, at[1:] != at[:-1])
    lo, pos = starts[new], at[new]
    hi = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]
    region = (p[hi + length] - p[lo]) * inv[lo]
    region = _mix(region ^ _mix(((pos - lo) << 32 | (hi - lo)).astype(_U) + _U(1)))
    return pos, lo, hi, g[pos], region


def _segments(texts: list[bytes]):
    """(index of each string, offset of its first byte in that text, arrays) of bounded size; windows split over two of them."""
    ids, offs, parts, size = [], [], [], 0
    for i, t in enumerate(texts):
        for s in range(0, max(len(t) - LENGTH + 1, 0), SEGMENT):
            ids.append(i)
            offs.append(s)
            parts.append(t[s : s + SEGMENT + LENGTH - 1])
            size += len(parts[-1])
            if size >= SEGMENT:
                yield ids, offs, parts
                ids, offs, parts, size = [], [], [], 0
    if parts:
        yield ids, offs, parts


def _utf8(t: str | None) -> bytes:
    return t.encode("utf-8", "surrogatepass") if t else b""


def with_hash(docs: DataFrame) -> DataFrame:
    """(doc_id, text, crc): ``crc``, a 64-bit checksum of the text, tells rows of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("crc"))


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, crc, gram, region, loc) of every anchor; loc packs the first window (40 bits), pos - lo and hi - lo."""

    def run(batches):
        for b in sliced(batches):
            texts = [_utf8(t) for t in b.column(1).to_pylist()]
            doc = b.column(0).fill_null(0).to_numpy()
            missing = b.column(0).is_null().to_numpy(zero_copy_only=False)
            crc = b.column(2).to_numpy()
            for ids, offs, parts in _segments(texts):
                ends = np.cumsum([len(x) for x in parts])
                pos, lo, hi, g, r = anchors(np.frombuffer(b"".join(parts), np.uint8), ends)
                if not len(pos):
                    continue
                k = np.searchsorted(ends, lo, side="right")
                first = lo - np.append(0, ends)[k] + np.array(offs)[k]
                of = np.array(ids)[k]
                loc = first << 16 | (pos - lo) << 8 | (hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[of], mask=missing[of]), pa.array(crc[of]), pa.array(g.view(np.int64)), pa.array(r.view(np.int64)), pa.array(loc)],
                    ["doc_id", "crc", "gram", "region", "loc"],
                )

    return with_hash(docs).mapInArrow(run, "doc_id long, crc long, gram long, region long, loc long")


def _ranges(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... (counts[0] of them), begins[1], ..."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - begins, counts)


def refine(data: np.ndarray, begins: np.ndarray, widths: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) repeated window of each region (1 << 40 and -1 if none): bucket-pointer refinement of the regions' suffixes.

    Region i has the windows that start at begins[i] .. begins[i] + widths[i]. Suffixes are bucketed
    by their first ``Q`` bytes, in the order of the bytes; a suffix's bucket pointer is the rank at which its bucket begins. Each pass
    sorts the suffixes of buckets that still hold several on the pointers of the suffixes as many bytes later as the depth reached, block after
    block of buckets; pointers are set anew at once, so blocks that follow, and the next pass at twice the depth, sort on refined ones. Once
    the depth is ``length``, equal windows are neighbours in suffix order; their bytes are compared before they count as equal.
    """
    ends = begins + widths + length
    grams = np.zeros(max(len(data) - Q + 1, 0), _U)
    for k in range(Q):
        grams |= data[k : len(data) - Q + 1 + k].astype(_U) << _U(8 * (Q - 1 - k))
    counts = widths + length - Q + 1
    kind = np.int32 if len(data) < 1 << 31 else np.int64
    at = _ranges(begins, counts).astype(kind)
    last = np.repeat(ends - Q, counts).astype(kind)  # where a suffix's region has its last q-gram
    order = np.argsort(grams[at])
    at, last = at[order], last[order]
    heads = np.flatnonzero(np.append(True, grams[at[1:]] != grams[at[:-1]]))
    sizes = np.diff(np.append(heads, len(at)))
    first = np.repeat(heads + 1, sizes).astype(kind)
    pointer = np.zeros(len(data) + 1, kind)  # of the suffix at each byte, from 1; 0 where a region has no more q-grams
    pointer[at] = first
    open_ = np.flatnonzero(np.repeat(sizes, sizes) > 1)  # ranks in buckets of several
    own = first[open_]  # and their pointers
    depth = Q
    while depth < length and len(open_):
        rest, lo, after = [], 0, 2 * depth
        while 2 * after < length:  # later passes look on from a window by their depths at most
            after *= 2
        slack = 2 * after - 2 * depth if 2 * depth < length else 0
        needed = at[open_] <= last[open_] - (length - Q) + slack
        open_, own = open_[needed], own[needed]
        while lo < len(open_):
            hi = np.searchsorted(own, own[min(lo + BLOCK, len(open_)) - 1], side="right")
            rank, mine = open_[lo:hi], own[lo:hi]
            here, end = at[rank], last[rank]
            later = np.where(here + depth <= end, pointer[np.minimum(here + depth, len(data))], 0)
            by = np.argsort(mine.astype(np.int64) * (len(at) + 1) + later, kind="stable")  # mine is in order already; buckets that stay whole keep their places
            moved = np.flatnonzero(by != np.arange(len(by)))
            at[rank[moved]], last[rank[moved]] = here[by[moved]], end[by[moved]]
            later = later[by]
            cut = np.flatnonzero(np.append(True, (mine[1:] != mine[:-1]) | (later[1:] != later[:-1])))
            size = np.diff(np.append(cut, len(rank)))
            now = np.repeat(rank[cut] + 1, size).astype(kind)
            new = np.flatnonzero(now != mine)
            pointer[at[rank[new]]] = now[new]
            several = np.repeat(size, size) > 1
            rest.append((rank[several], now[several]))
            lo = hi
        if rest:
            open_, own = (np.concatenate(x) for x in zip(*rest, strict=True))
        depth *= 2
    n = len(data)
    owner = np.full(n, -1)
    starts = _ranges(begins, widths + 1)
    owner[starts] = np.repeat(np.arange(len(begins)), widths + 1)
    rows = at[owner[at] >= 0]  # windows in suffix order
    same = np.arange(len(rows) - 1)
    for k in [*range(0, length - Q, Q), length - Q]:
        same = same[grams[rows[same] + k] == grams[rows[same + 1] + k]]
    new = np.ones(len(rows), bool)
    new[same + 1] = False
    bucket = np.cumsum(new) - 1
    own = owner[rows]
    hit = np.bincount(bucket)[bucket] >= 2 if len(rows) else np.zeros(0, bool)
    own, window = own[hit], (rows - begins[own])[hit]
    first, final = np.full(len(begins), 1 << 40), np.full(len(begins), -1)
    np.minimum.at(first, own, window)
    np.maximum.at(final, own, window)
    return first, final


def _repeated(batches):
    """Rows (gram, region, nth, width, bytes) of one gram come together; gives each region's first and last repeated window, counted from the region's first.

    A region that occurs more than once has two rows, cut from two places: its windows are repeated if both are found side by side in suffix order and their bytes agree.
    """
    rows, size, at = [], 0, None

    def solve():
        widths = np.array([r[3] for r in rows])
        begins = np.cumsum(widths + LENGTH) - widths - LENGTH
        first, last = refine(np.frombuffer(b"".join([r[4] for r in rows]), np.uint8), begins, widths)
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for k in np.flatnonzero(last >= 0).tolist():
            a, z = found.get(rows[k][:2], (1 << 40, -1))
            found[rows[k][:2]] = min(a, int(first[k])), max(z, int(last[k]))
        columns = zip(*((*key, *ends) for key, ends in found.items()), strict=True) if found else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["gram", "region", "first", "last"])

    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if r[0] != at and size >= CHUNK:
                yield solve()
                rows, size = [], 0
            rows.append(r)
            size += len(r[4])
            at = r[0]
    if rows:
        yield solve()


def region_pieces(docs: DataFrame, regions: DataFrame) -> DataFrame:
    """(gram, region, nth, width, bytes) of ``regions`` (gram, region, nth, doc_id, crc, loc), cut from the texts of ``docs``."""
    named = F.struct("gram", "region", "nth", "loc")
    wanted = regions.groupBy(F.col("doc_id").alias("w_id"), F.col("crc").alias("w_crc")).agg(F.collect_list(named).alias("wanted"))

    def squeeze(batches):  # texts are shuffled compressed
        for b in sliced(batches):
            texts = [_utf8(t) for t in b.column(1).to_pylist()]
            z = [len(t).to_bytes(8, "little") + (pa.compress(t, codec="zstd", asbytes=True) if t else b"") for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z, pa.binary()), b.column(2)], ["doc_id", "z", "crc"])

    text = with_hash(docs).mapInArrow(squeeze, "doc_id long, z binary, crc long")

    def whole(z: bytes) -> bytes:
        n = int.from_bytes(z[:8], "little")
        return pa.decompress(z[8:], decompressed_size=n, codec="zstd", asbytes=True) if n else b""

    def cut(batches):
        types = [pa.int64()] * 4 + [pa.binary()]
        for b in batches:
            out, seen = [], set()
            for z, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
                t = whole(z)
                for x in wanted:
                    if (key := (x["gram"], x["region"], x["nth"])) in seen:  # rows repeated with one doc_id and text
                        continue
                    seen.add(key)
                    s, width = x["loc"] >> 16, x["loc"] & 255
                    out.append((*key, width, t[s : s + width + LENGTH]))
            for i in range(0, len(out), 20_000):
                part = out[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in part], types[k]) for k in range(5)], ["gram", "region", "nth", "width", "bytes"])

    found = text.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("crc") == F.col("w_crc")))
    return found.select("z", "wanted").mapInArrow(cut, "gram long, region long, nth long, width long, bytes binary")


def repeated_windows_of_hot(pieces: DataFrame) -> DataFrame:
    """What :func:`_repeated` gives, for anchors with very many regions: the last refinement, of buckets of half a window, is Spark's shuffle.

    Every window is a row (gram, bucket of its first half, bucket of its second half), buckets by 64-bit hash; equal rows are counted, combined
    before they are shuffled. So no task holds the regions of one anchor.
    """
    half = LENGTH // 2

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                widths = part.column(3).to_numpy()
                data = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint8)
                p, inv = _prefix(data), _powers(len(data) + 1)[1]
                at = _ranges(np.cumsum(widths + LENGTH) - widths - LENGTH, widths + 1)
                of = np.repeat(np.arange(len(widths)), widths + 1)
                window = _ranges(np.zeros(len(widths), np.int64), widths + 1)
                b0, b1 = (_mix((p[x + half] - p[x]) * inv[x]).view(np.int64) for x in (at, at + half))
                cols = [part.column(k).to_numpy()[of] for k in range(2)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*cols, window, b0, b1)], ["gram", "region", "window", "b0", "b1"])

    windows = written(pieces.mapInArrow(run, "gram long, region long, window long, b0 long, b1 long"), "windows")
    key = ["gram", "b0", "b1"]
    repeated = windows.groupBy(*key).agg(F.count("*").alias("total")).where("total > 1").select(*key)
    return windows.join(repeated, key).groupBy("gram", "region").agg(F.min("window").alias("first"), F.max("window").alias("last"))


def repeated_intervals(docs: DataFrame) -> DataFrame:
    """(doc_id, crc, s, e): byte intervals of each text that repeated LENGTH-byte strings cover; they may overlap.

    Anchors chosen by content stand for the 170 or so windows around them, so equal windows meet at equal anchors and only
    anchors, one for every 85 bytes or so, are dealt out. An anchor that occurs once drops out. Of every other the distinct regions are fetched, from two places
    where a region has more than one, and refined as suffixes: a window counts as repeated only where two places' bytes were sorted side by side and compared. What is found is looked up for every
    place that has the region. Regions are told apart by two 64-bit hashes (of anchor and region).
    """
    spark = docs.sparkSession
    placed = written(anchor_rows(docs), "anchors")
    spot = F.struct("doc_id", "crc", "loc")
    classes = placed.groupBy("gram", "region").agg(F.least(F.count("*"), F.lit(2)).alias("copies"), F.min(spot).alias("x"), F.max(spot).alias("y"))
    classes = written(classes.select("gram", "region", "copies", "x", F.when(F.col("copies") > 1, F.col("y")).alias("y")), "classes")
    grams = classes.groupBy("gram").agg(F.sum("copies").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    grams = grams.select(F.col("gram").alias("g"), (F.col("kinds") > HOT).alias("hot"))
    spots = F.array(F.struct(F.lit(0).cast("long").alias("nth"), "x.*"), F.struct(F.lit(1).cast("long").alias("nth"), "y.*"))
    spots = F.slice(spots, 1, F.col("copies").cast("int"))
    recurring = written(classes.join(grams, F.col("gram") == F.col("g")).select("gram", "region", "hot", F.inline(spots)), "recurring")
    drop_written(classes)
    release(spark)
    found = region_pieces(docs, recurring.where("not hot")).repartition("gram").sortWithinPartitions("gram")
    found = written(found.mapInArrow(_repeated, "gram long, region long, first long, last long"), "repeated")
    release(spark)
    if not recurring.where("hot").isEmpty():
        hot = written(repeated_windows_of_hot(region_pieces(docs, recurring.where("hot"))), "repeated")
        found = found.unionByName(hot)
    found = found.select(F.col("gram").alias("g"), F.col("region").alias("r"), "first", "last")
    begin = F.shiftright("loc", 16)
    out = placed.join(found, (F.col("gram") == F.col("g")) & (F.col("region") == F.col("r")))
    out = written(out.select("doc_id", "crc", (begin + F.col("first")).alias("s"), (begin + F.col("last") + LENGTH).alias("e")), "intervals")
    drop_written(placed)
    drop_written(recurring)
    release(spark)
    return out


def with_spans(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with ``__suffix_spans``: intervals (s, e) to remove, null if there are none."""
    spans = (
        repeated_intervals(docs)
        .groupBy(F.col("doc_id").alias("__suffix_id"), F.col("crc").alias("__suffix_crc"))
        .agg(F.collect_set(F.struct("s", "e")).alias("__suffix_spans"))
    )
    same = docs.doc_id.eqNullSafe(F.col("__suffix_id")) & (F.xxhash64(docs.text) == F.col("__suffix_crc"))
    return docs.join(spans, same, "left").drop("__suffix_id", "__suffix_crc")


def cut_out(text: str | None, spans) -> tuple[bytes, int, int]:
    """(remaining bytes, bytes removed, maximal removed runs)."""
    data = _utf8(text)
    kept, at, runs = [], 0, 0
    end = -1
    for s, e in sorted((x["s"], x["e"]) for x in (() if spans is None else spans)):
        if s > end:
            runs += 1
            kept.append(data[at:s])
        end = at = max(end, e)
    kept.append(data[at:])
    left = b"".join(kept)
    return left, len(data) - len(left), runs


@keeping_names
def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated strings removed from ``text`` and ``n_chars`` set anew where present.

    A cut inside a character drops that character's remaining bytes. Null text stays null. No row is dropped.
    """
    marked = with_spans(docs)
    names = docs.columns

    @F.pandas_udf("string")
    def rest(text, spans):
        import pandas as pd

        return pd.Series([None if t is None else t if s is None else cut_out(t, s)[0].decode("utf-8", "ignore") for t, s in zip(text, spans, strict=True)], dtype=object)

    out = marked.withColumn("text", F.when(F.col("__suffix_spans").isNull(), F.col("text")).otherwise(rest("text", "__suffix_spans")))
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__suffix_spans").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(kind))
    return out.select(names)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs`` (doc_id, text).

    Each byte of the UTF-8 text covered by a 200-byte string that also starts anywhere else, in the same text or
    another, counts as removed. Null text is empty. Texts under 200 bytes keep everything. Rows repeated with one doc_id are texts
    of their own, so they repeat each other. Empty table: no rows. Other columns are ignored.
    """

    def run(batches):
        for b in sliced(batches):
            got = [(cut_out(t, s)) for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(k) + r for k, r, _ in got], pa.int64()),
                    pa.array([r for _, r, _ in got], pa.int64()),
                    pa.array([x for _, _, x in got], pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() for k, _, _ in got], pa.string()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    marked = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return marked.select("doc_id", "text", "__suffix_spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 200-byte strings of ``documents``."""
    return suffix_dedup(table(spark, sf_dir, "documents"))
