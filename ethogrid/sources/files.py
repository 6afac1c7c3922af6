"""Small text files in whatever store a path names (local, hdfs, s3, ...), through Spark's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _store(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _put(store, path, text: str, replace: bool) -> None:
    out = store.create(path, replace)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file that must not exist yet: FileExistsError if it does, whose content stays."""
    store, p = _store(spark, path)
    if store.exists(p):
        raise FileExistsError(path)
    _put(store, p, text, False)


def replace(spark: SparkSession, path: str, text: str) -> None:
    """Writes or replaces a file; the new text is complete under another name before the old file goes."""
    store, p = _store(spark, path)
    _, fresh = _store(spark, f"{path}.new")
    _put(store, fresh, text, True)
    store.delete(p, False)
    if not store.rename(fresh, p):
        raise OSError(f"{path}: can't be replaced; the new text is in {path}.new")


def read(spark: SparkSession, path: str) -> str:
    """The text of one small file: FileNotFoundError if there is none."""
    store, p = _store(spark, path)
    if not store.exists(p):
        raise FileNotFoundError(path)
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0].value if rows else ""
