"""WARC archives: writer with revisit records, and a reader that salvages damaged files (operator 9)."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethogrid.llm.common import filesystem, new_path, table, written

LEVEL = 6
_GZIP = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/\d\.\d\r?\n")
_NAMES = uuid.UUID("7a1c5a54-8c3d-5a0e-9c4d-52f6b9f0a1d3")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id, url, payload: bytes, payload_digest: str, refers_to=None) -> bytes:
    """One record. A revisit carries the HTTP header, whose Content-Length is that of the full payload, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    name = uuid.uuid5(_NAMES, f"{page_id}|{kind}|{payload_digest}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {re.sub(r'\s', '%20', url or 'urn:none')}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head.append(f"WARC-Profile: {PROFILE}")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class NeedMore(ValueError):
    """The bytes at hand end before the record does."""


def parse(data, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(header fields, block, end of the record) of the record at ``at`` of ``data``; ValueError if it fails a check."""
    m = _VERSION.match(data, at)
    if not m:
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", m.end() - 2)
    if end < 0:
        raise NeedMore("header does not end")
    if _VERSION.search(data, m.end(), end):
        raise ValueError("another record begins inside the header")
    fields = {}
    for line in bytes(data[m.end() : end]).split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    try:
        size = int(fields["content-length"])
    except (KeyError, ValueError):
        raise ValueError("no content length") from None
    if size < 0:
        raise ValueError("negative content length")
    stop = end + 4 + size
    if len(data) < stop + 4:
        raise NeedMore("block is cut short")
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("record does not end where its length says")
    block = bytes(data[end + 4 : stop])
    want = fields.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != digest(block):
        raise ValueError("block digest does not match")
    return fields, block, stop + 4


class Salvage:
    """Records of an archive, gzip members or plain, from a binary stream read ``step`` bytes at a time.

    When a record fails a check (gzip stream or its checksum, header, length, block digest), the reader looks for the next
    place after its start where a gzip member or version line begins a record that passes, goes on there, and appends the
    bytes skipped to ``gaps``: (first byte, end, reason). Inside a member of several records it does the same on the decompressed content,
    also that of a member that breaks off, so its good records but the last before the break are kept; such a gap has the member's place in the file and says where in the content it lies.
    Memory: the largest record or member, ``most`` bytes at most, or the gap being searched.
    """

    def __init__(self, stream, step: int = 1 << 20, most: int = 1 << 30):
        self.stream, self.step, self.most = stream, step, most
        self.buffer, self.base = bytearray(), 0
        self.gaps: list[tuple[int, int, str]] = []

    def _more(self) -> bool:
        data = self.stream.read(self.step)
        self.buffer += data
        return bool(data)

    def _member(self, at: int) -> tuple[bytes, int, str]:
        """(content, end, fault) of the gzip member at ``at`` of the buffer; with a fault the content is what came before it."""
        z, out, pos, size = zlib.decompressobj(31), [], at, 0
        while True:
            if pos >= len(self.buffer) and not self._more():
                return b"".join(out), pos, "gzip member is cut short"
            part = bytes(self.buffer[pos : pos + (1 << 14)])
            try:
                out.append(z.decompress(part))
            except zlib.error as e:
                return b"".join(out), pos, f"gzip: {e}"
            pos += len(part)
            size += len(out[-1])
            if z.eof:
                return b"".join(out), pos - len(z.unused_data), ""
            if size > self.most:
                return b"".join(out), pos, "member is too large"

    def _record(self, at: int):
        """(list of records, end, fault, gaps) at ``at`` of the buffer, each record a (fields, block), each gap (reason,)."""
        while len(self.buffer) - at < 16 and self._more():
            pass
        if self.buffer.startswith(_GZIP, at):
            data, end, fault = self._member(at)
            got, gaps, k = [], [], 0
            while k < len(data):
                try:
                    fields, block, k = parse(data, k)
                    got.append((fields, block))
                except ValueError as e:
                    m = _VERSION.search(data, k + 1)
                    nxt = m.start() if m else len(data)
                    if not (fault and not m):  # the end of what a broken member gave is part of its own gap
                        gaps.append(f"bytes {k} to {nxt} of the member: {e}")
                    k = nxt
                    if not got and not m and not fault:
                        raise
            if fault:
                got = got[:-1]  # no checksum covers what comes right before the break
            if not got:
                raise ValueError(fault or "no good record in the gzip member")
            return got, end, fault, gaps
        while True:
            try:
                fields, block, end = parse(self.buffer, at)
                return [(fields, block)], end, "", []
            except NeedMore:
                if len(self.buffer) - at > self.most:
                    raise ValueError("record is too large") from None
                if not self._more():
                    raise

    def __iter__(self):
        """(offset of the member or record, fields, block)."""
        bad, reason, at = None, "", 0
        while True:
            if at > 8 * self.step:
                del self.buffer[:at]
                self.base += at
                at = 0
            if at >= len(self.buffer) and not self._more():
                break
            try:
                got, end, fault, inner = self._record(at)
            except ValueError as e:
                if bad is None:
                    bad, reason = self.base + at, str(e)
                at = self._candidate(at + 1)
                if at is None:
                    break
                continue
            start = self.base + at
            if bad is not None:
                self.gaps.append((bad, start, reason))
                bad = None
            for fields, block in got:
                yield start, fields, block
            self.gaps += [(start, self.base + end, why) for why in inner]
            if fault:  # what follows the good records of a broken member is looked through like any gap
                bad, reason = start, f"{fault}, {len(got)} records read before"
                at = self._candidate(at + 1)
                if at is None:
                    break
                continue
            at = end
        if bad is not None:
            self.gaps.append((bad, self.base + len(self.buffer), reason))

    def _candidate(self, at: int) -> int | None:
        """Next place in the buffer, at or after ``at``, where a member or version line begins; None at the end."""
        while True:
            m = _VERSION.search(self.buffer, at)
            found = [k for k in (self.buffer.find(_GZIP, at), m.start() if m else -1) if k >= 0]
            if found:
                return min(found)
            at = max(at, len(self.buffer) - 16)
            if not self._more():
                return None


def page_of(fields: dict[str, str], block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record, checked against the payload it holds."""
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)[1])
    named = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or digest(payload) != named):
        raise ValueError("payload does not match its digest")
    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
    return (None if page is None else int(page), size, named, kind, None if refers is None else int(refers))


def with_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, n_bytes, digest, kind, refers): which rows become revisits of which.

    Only ids, sizes and digests are shuffled to find the smallest page_id of each payload; a payload that very many pages share is combined
    before the shuffle, and the join that hands the id back can be split.
    """

    @F.pandas_udf("struct<n_bytes:long,digest:string>")
    def measure(html):
        import pandas as pd

        data = [(h or "").encode("utf-8", "surrogatepass") for h in html]
        return pd.DataFrame({"n_bytes": [len(d) for d in data], "digest": [digest(d) for d in data]})

    rows = pages.select("page_id", "url", "html", measure("html").alias("m")).select("page_id", "url", "html", "m.n_bytes", "m.digest")
    keys = written(rows.select("page_id", "n_bytes", "digest"), "digests")
    first = (
        keys.where(F.col("n_bytes") >= least_bytes).groupBy(F.col("digest").alias("d"), F.col("n_bytes").alias("n"))
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    )
    first = written(first, "firsts")
    return rows.join(first, (rows.digest == first.d) & (rows.n_bytes == first.n), "left").drop("d", "n")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes a record for each row of ``pages`` into gzip archives in ``folder``, one a partition; returns their manifest.

    Among rows of equal payloads of ``least_bytes`` or more the one with the smallest page_id is the response and the others are
    revisits of it; smaller payloads are all responses. Rows that repeat the smallest page_id are responses too. Rows without
    a page_id are revisits, unless all rows of the payload have none; then they are responses. Null html is an empty payload.
    """
    rows = with_records(pages, least_bytes)
    leads = F.col("copies").isNull() | F.col("page_id").eqNullSafe(F.col("first_id"))
    return _write(rows.withColumn("leads", leads), folder)


def _write(every: DataFrame, folder: str) -> DataFrame:
    def write(batches):
        from pyspark import TaskContext

        fs, root = filesystem(folder)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        temporary, out, n = f"{root}/.attempt-{uuid.uuid4().hex}", None, 0
        for b in batches:
            for page, url, html, dig, first, leads in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(temporary)
                payload = (html or "").encode("utf-8", "surrogatepass")
                out.write(member(record("response" if leads else "revisit", page, url, payload, dig, None if leads else first)))
                n += 1
        if out is None:
            return
        out.close()
        if fs.get_file_info(f"{root}/{name}").type.name != "NotFound":  # an earlier attempt's, of the same rows
            fs.delete_file(f"{root}/{name}")
        fs.move(temporary, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["path", "records"])

    chosen = every.select("page_id", "url", "html", "digest", "first_id", "leads")
    return written(chosen.mapInArrow(write, "path string, records long"), "archives")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """(path, page_id, payload_bytes, payload_digest, record_type, refers_to, gap_from, gap_to, reason).

    One row for each record read, and one for each gap that the salvage reader skipped (page_id and the other record columns null there).
    """
    spark = manifest.sparkSession
    paths = [r[0] for r in manifest.select("path").collect()]
    schema = "path string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, gap_from long, gap_to long, reason string"
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in schema.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def read(batches):
        fs, root = filesystem(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{path}", compression=None) as stream:
                    reader = Salvage(stream)
                    for at, fields, block in reader:
                        try:
                            rows.append((path, *page_of(fields, block), None, None, None))
                        except (ValueError, KeyError, TypeError) as e:
                            reader.gaps.append((at, at, f"record: {e}"))
                        if len(rows) == 5000:
                            yield batch(rows)
                            rows = []
                    rows += [(path, None, None, None, None, None, a, z, why) for a, z, why in reader.gaps]
                yield batch(rows)

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return listed.mapInArrow(read, schema)


def read_whole(manifest: DataFrame, folder: str) -> DataFrame:
    """The records that :func:`read_archives` gives; RuntimeError if they are fewer or more than were written, or there is a gap."""
    found = written(read_archives(manifest, folder), "records")
    records, gaps = found.agg(F.count_if(F.col("reason").isNull()), F.count_if(F.col("reason").isNotNull())).first()
    if gaps or records != (manifest.agg(F.sum("records")).first()[0] or 0):
        raise RuntimeError(f"archives are damaged: {records} records read, {gaps} gaps")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` written to archives and read back whole."""
    folder = new_path(spark, "warc")
    return read_whole(write_archives(table(spark, sf_dir, "pages"), folder), folder)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT page_id, strlen(h) AS n, x, min(page_id) OVER (PARTITION BY x, strlen(h)) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda k:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST((CAST('0x' || substr(x, CAST(5 * i + 1 AS BIGINT), 5) AS INTEGER) >> k) & 31 AS BIGINT) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""
