"""Derived tables that are written once per state of their input and then read by every query."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from docloom.session import shared_dir

#: Input bytes that one file of a derived table stands for.
FILE_BYTES = 32 << 20


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def state_of(spark: SparkSession, path: str) -> tuple[str, int]:
    """A digest of the names, lengths and times of a table's files, and their bytes."""
    fs, target = _path(spark, path)
    files, it = [], fs.listFiles(target, True)
    while it.hasNext():
        status = it.next()
        files.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return hashlib.sha256(repr(sorted(files)).encode()).hexdigest()[:24], sum(size for _, size, _ in files)


def file_count(spark: SparkSession, input_bytes: int) -> int:
    """Files for a table made from so many bytes: one per core at least, so that one large input file is no single task."""
    return max(spark.sparkContext.defaultParallelism, input_bytes // FILE_BYTES)


def once(spark: SparkSession, label: str, state: str, build: Callable[[str], None]) -> str:
    """The folder that ``build`` fills, built only where no earlier call with this label and state has.

    A folder is built under a name of its own and takes its final name when it is whole, so nobody
    reads half a table, and of two builders at once one wins.
    """
    parent = os.path.join(shared_dir(spark), "docloom", "store")
    final = os.path.join(parent, f"{label}-{state}")
    fs, target = _path(spark, final)
    if fs.exists(target):
        return final
    building = os.path.join(parent, f"building-{label}-{uuid.uuid4().hex}")
    build(building)
    source = _path(spark, building)[1]
    # A rename onto a folder that another builder has finished meanwhile would nest inside it.
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)
    return final
