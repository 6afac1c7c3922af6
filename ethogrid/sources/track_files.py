"""Track files: one compressed array file a subject, as trackers write them, read as a Spark data source with pruning by subject, time and stride."""

from __future__ import annotations

import io
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ethogrid.sources.tables import filesystem

SCHEMA = "video_id string, frame_idx int, t_sec double, x double, y double, orientation_deg double, y_from_frame_top double, detected boolean"
_NUMBERS = ("t_sec", "x", "y", "orientation_deg", "y_from_frame_top")
_TYPES = pa.schema([("video_id", pa.string()), ("frame_idx", pa.int32()), *[(c, pa.float64()) for c in _NUMBERS], ("detected", pa.bool_())])
_BATCH = 65_536  # rows that a reader hands over at once
_PART, _OPEN = 8 << 20, 16 << 10  # bytes of files that a partition takes at most, one file at least; what a file counts besides its bytes


def write(tracks: DataFrame, folder: str) -> DataFrame:
    """Writes one file a subject below ``folder`` in executors, over older ones; returns (video_id, rows). Null measurements are stored as NaN; rows lie in the order of their index.

    Rows without an id are not written. A subject's rows meet in one task, as its file has to hold them all.
    """

    def put(key, table):
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        table = table.sort_by("frame_idx")
        out = io.BytesIO()
        arrays = {c: table.column(c).cast(pa.float64()).to_numpy() for c in _NUMBERS}
        np.savez_compressed(out, frame_idx=table.column("frame_idx").to_numpy(), detected=np.array(table.column("detected").to_pylist(), bool), **arrays)
        name = f"{path}/{quote(key[0].as_py(), safe='')}.npz"
        with fs.open_output_stream(name + ".new") as f:
            f.write(out.getvalue())
        fs.move(name + ".new", name)  # a reader sees the old file or the new one
        return pa.table({"video_id": [key[0].as_py()], "rows": pa.array([len(table)], pa.int64())})

    columns = [F.col(c).cast("double").alias(c) for c in _NUMBERS]
    rows = tracks.where("video_id IS NOT NULL").select("video_id", F.col("frame_idx").cast("int").alias("frame_idx"), *columns, F.coalesce("detected", F.lit(False)).alias("detected"))
    return rows.groupBy("video_id").applyInArrow(put, "video_id string, rows long")


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        super().__init__(files)
        self.files = files  # (path, video_id)


class TrackFiles(DataSource):
    """Options: ``path``, the folder; ``stride``, read only rows whose index is a multiple of it; ``parts``, how many partitions to aim at where files are few."""

    @classmethod
    def name(cls) -> str:
        return "track_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("stride", "1")), int(self.options.get("parts", "1")))


class _Reader(DataSourceReader):
    """A partition takes several files, as a task costs more than a small file. Conditions on the subject choose files; those on time and index cut rows before they leave the worker."""

    def __init__(self, path: str, stride: int, parts: int = 1):
        if stride < 1:
            raise ValueError(f"stride {stride} is not positive")
        self.path, self.stride, self.parts = path, stride, parts
        self.ids: set[str] | None = None
        self.bounds: list[tuple[str, str, float]] = []

    def pushFilters(self, filters) -> Iterator:
        tests = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", EqualTo: "="}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == "video_id" and isinstance(f, EqualTo | In):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.ids = own if self.ids is None else self.ids & own
            elif column in ("t_sec", "frame_idx") and type(f) in tests:
                self.bounds.append((column, tests[type(f)], f.value))
            else:
                yield f  # Spark's to do

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs as pafs

        fs, path = filesystem(self.path)
        found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        files = sorted((f.path, unquote(f.base_name[:-4]), f.size + _OPEN) for f in found if f.is_file and f.base_name.endswith(".npz"))
        files = [f for f in files if self.ids is None or f[1] in self.ids]
        most = min(_PART, sum(size for _, _, size in files) / max(self.parts, 1))
        out: list[list[tuple[str, str]]] = []
        held = 0
        for p, v, size in files:
            if not out or held + size > most:
                out.append([])
                held = 0
            out[-1].append((p, v))
            held += size
        return [_Files(part) for part in out] or [_Files([])]  # Spark wants one partition at least

    def read(self, part: _Files) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        kept, rows = [], 0
        for path, video_id in part.files:
            for batch in self._cut(fs, path, video_id):
                if rows + len(batch) > _BATCH:
                    yield pa.concat_batches(kept)
                    kept, rows = [], 0
                kept.append(batch)
                rows += len(batch)
        if rows:
            yield pa.concat_batches(kept)

    def _cut(self, fs, path: str, video_id: str) -> Iterator[pa.RecordBatch]:
        """The rows of a file that are asked for."""
        with fs.open_input_stream(path) as f, np.load(io.BytesIO(f.read()), allow_pickle=False) as z:
            data = {c: z[c] for c in z.files}
        keep = data["frame_idx"] % self.stride == 0
        compare = {">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal, "=": np.equal}
        for column, test, value in self.bounds:
            keep &= compare[test](data[column], value)
        at = np.flatnonzero(keep)
        for a in range(0, len(at), _BATCH):
            some = at[a : a + _BATCH]
            columns = [pa.array([video_id] * len(some), pa.string()), pa.array(data["frame_idx"][some], pa.int32())]
            columns += [pa.array(data[c][some], pa.float64(), from_pandas=True) for c in _NUMBERS]  # NaN is null again
            yield pa.RecordBatch.from_arrays([*columns, pa.array(data["detected"][some], pa.bool_())], schema=_TYPES)


def read(spark: SparkSession, folder: str, stride: int = 1) -> DataFrame:
    """Tracks of all files below ``folder``; conditions on video_id, t_sec and frame_idx that follow are pushed to the readers."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TrackFiles)
    return spark.read.format("track_files").option("stride", stride).option("parts", 4 * spark.sparkContext.defaultParallelism).load(folder)
