"""Helpers shared by the training-data operators: shared folder, written tables, filesystem access."""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Where none is named, a local session (tests) gets a temporary folder as its checkpoint folder; on a cluster RuntimeError is raised, since
    executors could not read a folder of the driver's.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that nothing reads any more."""
    path = getattr(df, "written_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sliced(batches, rows: int = 256):
    """The Arrow batches in slices of some rows, so that a worker holds few of the Python objects that it makes of them at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a folder URI: file, hdfs, s3, gs. A bare path is local."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def keeping_names(f):
    """``f(docs, ...)`` that returns columns of ``docs``: those whose names begin like the operators' helper columns (two underscores) are called something else meanwhile."""

    @functools.wraps(f)
    def run(docs: DataFrame, *rest, **named) -> DataFrame:
        taken, away = set(docs.columns), {}
        for c in docs.columns:
            if c.startswith("__"):
                new = "held" + c
                while new in taken:
                    new = "held" + new
                taken.add(new)
                away[c] = new
        if not away:
            return f(docs, *rest, **named)
        return f(docs.withColumnsRenamed(away), *rest, **named).withColumnsRenamed({new: c for c, new in away.items()})

    return run


def held_out(doc_id, modulus: int, remainder: int):
    """crc32 of the id's decimal text, modulo ``modulus``, equals ``remainder`` (false for a null id)."""
    return F.coalesce((F.crc32(doc_id.cast("string").cast("binary")) % modulus) == remainder, F.lit(False))
