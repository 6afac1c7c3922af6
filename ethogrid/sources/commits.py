"""A log of numbered commits beside data folders: what is written becomes visible by one small file that is made last."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ethogrid.sources import files


class Conflict(RuntimeError):
    """Another writer took the number."""


def entries(spark: SparkSession, folder: str) -> list[tuple[int, dict]]:
    """(number, content) of the commits below ``folder`` in order; one whose writer died before its content was whole is passed over."""
    store, path = files._store(spark, f"{folder}/commits")
    if not store.exists(path):
        return []
    out = []
    for s in store.listStatus(path):
        name = s.getPath().getName()
        if name.endswith(".json") and name[:-5].isdigit():
            try:
                out.append((int(name[:-5]), json.loads(files.read(spark, s.getPath().toString()))))
            except ValueError:
                continue
    return sorted(out, key=lambda e: e[0])


def append(spark: SparkSession, folder: str, after: int, content: dict) -> int:
    """Commits ``content`` as the next number after ``after``; Conflict if another writer has gone on since that number was read.

    The store must make a file that doesn't exist yet for one caller only (local, HDFS and stores with conditional writes do).
    """
    number = after + 1
    try:
        files.write_new(spark, f"{folder}/commits/{number:08d}.json", json.dumps(content, sort_keys=True))
    except FileExistsError as e:
        raise Conflict(f"commit {number} of {folder} was made by another writer") from e
    except Exception as e:  # the store's own refusal of a file that came in between
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"commit {number} of {folder} was made by another writer") from e
        raise
    return number


def last_number(spark: SparkSession, folder: str) -> int:
    """Highest number that is taken, readable or not; 0 without any."""
    store, path = files._store(spark, f"{folder}/commits")
    if not store.exists(path):
        return 0
    names = [s.getPath().getName() for s in store.listStatus(path)]
    return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)
