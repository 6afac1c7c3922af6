"""Token ids in sorted-string-table shards (operator 2).

Shard file, all integers little-endian:

    data blocks     entries in ascending key order; every RESTART-th entry of a block stores its whole key
                    entry: varint shared key bytes, varint further key bytes, varint value bytes, key bytes, value
                    after the entries: uint32 restart offsets, uint32 their number, uint32 crc32 of all before
    index block     for each data block: varint key length, last key, uint64 offset, uint32 length
    Bloom filter    uint32 number of bits, uint32 number of hashes, bits
    footer          uint64 index offset, uint32 index length, uint64 Bloom offset, uint32 Bloom length,
                    uint64 entries, uint64 token ids, 8 bytes MAGIC

Keys are the document id as 9 bytes (a flag byte, 0 for a null id, and the id big-endian with its sign bit turned), so
that byte order is id order. A value is the ids, each as a little-endian unsigned 16-bit integer if flag byte 2 says so, else 32-bit.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethogrid.llm.common import filesystem, new_path, table, written

MAGIC = b"SSTIDS01"
BLOCK = 1 << 16
SHARD_BYTES, SHARDS = 16 << 20, 50_000
RESTART = 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
_FOOTER = struct.Struct("<QIQIQQ8s")
CACHE = 1_000_000  # white-space separated chunks whose ids a worker remembers at most
TOKENIZER = "word_bpe_49k.json"
END_ID = 1


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (1 << 64) - 1)


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(b, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return [(a + i * b) % bits for i in range(hashes)]


class Writer:
    """Writes entries, whose keys must not descend, to a binary stream. Memory: one block, the index and the keys' hashes."""

    def __init__(self, stream):
        self.stream, self.offset = stream, 0
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes = array("I")  # two a key
        self.entries = self.ids = 0
        self._open()

    def _open(self) -> None:
        self.block, self.restarts, self.count, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, value: bytes, ids: int) -> None:
        shared = 0
        if self.count % RESTART:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.count += 1
        self.last = key
        self.entries += 1
        self.ids += ids
        self.hashes.extend((zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1))
        if len(self.block) >= BLOCK:
            self._close()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.stream.write(data)
        self.offset += len(data)
        return self.offset - len(data), len(data)

    def _close(self) -> None:
        if not self.count:
            return
        body = bytes(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
        last = self.last
        self.index.append((last, *self._put(body + struct.pack("<I", zlib.crc32(body)))))
        self._open()

    def finish(self) -> None:
        self._close()
        index = self._put(b"".join(varint(len(k)) + k + struct.pack("<QI", o, n) for k, o, n in self.index))
        bits = max(64, BLOOM_BITS * self.entries)
        field = np.zeros(-(-bits // 8) * 8, np.uint8)
        if self.hashes:
            h = np.frombuffer(self.hashes, np.uint32).astype(np.uint64).reshape(-1, 2)
            for i in range(BLOOM_HASHES):
                field[((h[:, 0] + np.uint64(i) * h[:, 1]) % np.uint64(bits)).astype(np.int64)] = 1
        bloom = self._put(struct.pack("<II", bits, BLOOM_HASHES) + np.packbits(field, bitorder="little").tobytes())
        self._put(_FOOTER.pack(*index, *bloom, self.entries, self.ids, MAGIC))


class Reader:
    """Reads a shard from a seekable binary stream: scan in key order, or lookup by binary search."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.seek(0, 2)
        if size < _FOOTER.size:
            raise ValueError("not a shard: too short")
        self.index_at, self.index_len, self.bloom_at, self.bloom_len, self.entries, self.ids, magic = _FOOTER.unpack(
            self._get(size - _FOOTER.size, _FOOTER.size)
        )
        if magic != MAGIC:
            raise ValueError("not a shard: wrong magic")
        b, at = self._get(self.index_at, self.index_len), 0
        self.index = []
        while at < len(b):
            n, at = read_varint(b, at)
            self.index.append((b[at : at + n], *struct.unpack_from("<QI", b, at + n)))
            at += n + 12
        self.bloom = None

    def _get(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        data = self.stream.read(n)
        if len(data) != n:
            raise ValueError("shard is cut short")
        return data

    def _block(self, k: int) -> tuple[bytes, int]:
        _, at, n = self.index[k]
        b = self._get(at, n)
        if zlib.crc32(b[:-4]) != struct.unpack("<I", b[-4:])[0]:
            raise ValueError("block checksum does not match")
        count = struct.unpack_from("<I", b, n - 8)[0]
        return b, n - 8 - 4 * count

    @staticmethod
    def _entries(b: bytes, at: int, end: int):
        key = b""
        while at < end:
            shared, at = read_varint(b, at)
            more, at = read_varint(b, at)
            size, at = read_varint(b, at)
            key = key[:shared] + b[at : at + more]
            yield key, b[at + more : at + more + size]
            at += more + size

    def scan(self):
        """(key, value) of all entries in order."""
        for k in range(len(self.index)):
            b, end = self._block(k)
            yield from self._entries(b, 0, end)

    def may_hold(self, key: bytes) -> bool:
        if self.bloom is None:
            self.bloom = self._get(self.bloom_at, self.bloom_len)
        bits, hashes = struct.unpack_from("<II", self.bloom)
        return all(self.bloom[8 + p // 8] >> p % 8 & 1 for p in _bloom_places(key, bits, hashes))

    def get(self, key: bytes) -> list[bytes]:
        """Values of all entries with this key."""
        found: list[bytes] = []
        if not self.index or not self.may_hold(key):
            return found
        k = bisect.bisect_left([x[0] for x in self.index], key)
        while k < len(self.index):
            b, end = self._block(k)
            count = struct.unpack_from("<I", b, len(b) - 8)[0]
            restarts = struct.unpack_from(f"<{count}I", b, end)
            lo, hi = 0, count - 1
            while lo < hi:  # the last restart whose key is below the key
                mid = (lo + hi + 1) // 2
                if next(self._entries(b, restarts[mid], end))[0] < key:
                    lo = mid
                else:
                    hi = mid - 1
            for x, v in self._entries(b, restarts[lo], end):
                if x == key:
                    found.append(v)
                elif x > key:
                    return found
            k += 1
        return found


def pack_ids(ids: np.ndarray) -> bytes:
    small = not len(ids) or ids.max() < 1 << 16
    return b"\2" + ids.astype("<u2").tobytes() if small else b"\4" + ids.astype("<u4").tobytes()


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u2" if value[0] == 2 else "<u4", offset=1).astype("<u4")


class Encoder:
    """Ids of whole texts. The tokenizer never joins text over white space, so chunks between white space are encoded once
    and remembered. A chunk of ASCII letters with ASCII punctuation after them is made of the ids of both, as the tokenizer
    parts them and lower-cases. At most CACHE chunks and as many parts are remembered. A text with control characters 28 to
    31, which Python and the tokenizer split differently, goes through the tokenizer whole."""

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4"
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.odd = re.compile("[\x1c-\x1f]")
        self.plain = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!#$%&()*+,./:;=?@^`{}~-]*)").fullmatch

    def _encode(self, chunks: list[str], into: dict[str, bytes]) -> None:
        for i in range(0, len(chunks), 2000):
            part = chunks[i : i + 2000]
            e = self.tok.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids, owner = np.array(e.ids, self.kind), np.array(e.word_ids, np.int64)
            cuts = np.searchsorted(owner, np.arange(len(part) + 1))
            data, cuts = ids.tobytes(), (cuts * ids.itemsize).tolist()
            for c, a, b in zip(part, cuts, cuts[1:], strict=False):
                into[c] = data[a:b]

    def _learn(self, chunks: list[str]) -> None:
        split, rest, new = [], [], set()
        if len(self.parts) > CACHE:
            self.parts.clear()
        for c in chunks:
            m = self.plain(c)
            if m:
                word, tail = m[1].lower(), m[2]
                split.append((c, word, tail))
                new.add(word)
                new.add(tail)
            else:
                rest.append(c)
        new.discard("")
        self._encode(list(new.difference(self.parts)), self.parts)
        self.parts[""] = b""
        for c, word, tail in split:
            self.known[c] = self.parts[word] + self.parts[tail]
        self._encode(rest, self.known)

    def _split(self, texts: list[str | None]) -> list[list[str]]:
        """Chunks of each text, all known afterwards; none for a text that goes through the tokenizer whole."""
        split = [[] if not t or self.odd.search(t) else t.split() for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = set().union(*split)
        self._learn(list(new))
        return split

    def forget(self, most: int) -> None:
        """Remembers nothing, if it is more than ``most`` chunks."""
        if len(self.known) > most:
            self.known.clear()
        if len(self.parts) > most:
            self.parts.clear()

    def counts(self, texts: list[str | None]) -> list[int]:
        """Numbers of ids of whole texts."""
        get, size, out = self.known.__getitem__, int(self.kind[2]), []
        for t, chunks in zip(texts, self._split(texts), strict=True):
            whole = t and not chunks and self.odd.search(t)
            out.append(len(self.tok.encode(t, add_special_tokens=False).ids) if whole else sum(map(len, map(get, chunks))) // size)
        return out

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts."""
        split = self._split(texts)
        get = self.known.__getitem__
        out = []
        for t, chunks in zip(texts, split, strict=True):
            if t and not chunks and self.odd.search(t):
                out.append(np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32))
            else:
                out.append(np.frombuffer(b"".join(map(get, chunks)), self.kind))
        return out


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes shards in ascending doc_id order into ``folder``; returns their manifest.

    Texts are dealt out by range of doc_id, so shard after shard is in order, and encoded after that: what finds the ranges looks
    at ids alone, and each text is encoded once. A shard is written under an attempt's own
    name and then renamed, so a task that is run again leaves one whole file. The manifest (shard, path, entries, ids), a row a shard,
    is a written table. A shard is of about ``SHARD_BYTES`` of text, but there are as many as the session has cores at least and ``SHARDS`` at most. Rows that repeat an id stay, ordered by text; rows with a null id come first.
    """
    spark = docs.sparkSession

    def write(batches):
        import os
        import uuid

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = _encoder(tokenizer)
        fs, root = filesystem(folder)
        part = TaskContext.get().partitionId()
        name, temporary = f"{root}/shard-{part:06d}.sst", f"{root}/.attempt-{uuid.uuid4().hex}"
        entries = None
        for b in batches:
            docs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            if docs and entries is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(temporary)
                entries = Writer(out)
            for i in range(0, len(docs), 256):
                for doc, ids in zip(docs[i : i + 256], enc.ids(texts[i : i + 256]), strict=True):
                    ids = np.append(ids, ids.dtype.type(end_id))
                    entries.add(key_of(doc), pack_ids(ids), len(ids))
        if entries is None:
            return
        entries.finish()
        out.close()
        if fs.get_file_info(name).type.name != "NotFound":  # an earlier attempt's, of the same content
            fs.delete_file(name)
        fs.move(temporary, name)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, f"shard-{part:06d}.sst", entries.entries, entries.ids)], ["shard", "path", "entries", "ids"])

    n = shards
    if not n:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = min(max(-(-size // SHARD_BYTES), spark.sparkContext.defaultParallelism), SHARDS)
    order = F.col("doc_id").asc_nulls_first()
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, order).sortWithinPartitions(order, "text")
    return written(ordered.mapInArrow(write, "shard long, path string, entries long, ids long"), "manifest")


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every entry of the shards, each read back whole, in shard order.

    ``start`` counts the ids of all documents before: those of earlier shards come from the shards' footers, one row a shard.
    """
    spark = manifest.sparkSession

    def footers(batches):
        fs, root = filesystem(folder)
        for b in batches:
            ids = []
            for path in b.column(1).to_pylist():
                with fs.open_input_file(f"{root}/{path}") as stream:
                    ids.append(Reader(stream).ids)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.int64())], ["shard", "path", "ids"])

    listed = manifest.select("shard", "path").repartition(spark.sparkContext.defaultParallelism)
    before, starts = 0, []
    for _, path, ids in sorted(map(tuple, listed.mapInArrow(footers, "shard long, path string, ids long").collect())):
        starts.append((path, before))
        before += ids

    def read(batches):
        fs, root = filesystem(folder)
        for b in batches:
            for path, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{path}") as stream:
                    out = []
                    for key, value in Reader(stream).scan():
                        ids = unpack_ids(value)
                        out.append((id_of(key), at, len(ids), zlib.crc32(ids.tobytes())))
                        at += len(ids)
                        if len(out) == 10_000:
                            yield _rows(out)
                            out = []
                    yield _rows(out)

    paths = spark.createDataFrame(starts, "path string, before long").repartition(max(1, len(starts)))
    return paths.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op2_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of ``documents``, written to shards and read back."""
    folder = new_path(spark, "tokens")
    manifest = write_shards(table(spark, sf_dir, "documents"), folder, default_tokenizer())
    return read_shards(manifest, folder)
