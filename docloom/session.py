"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The temporary folder of each local session that names none; the session's own settings stay as they are.
_FALLBACK: dict[str, str] = {}

#: Removes the shuffle files of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "docloom", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the library defaults; settings passed by the cluster win over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder; a cluster without the
    setting is an error, because a machine-local folder dies with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="docloom-")
    return _FALLBACK[app]


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The result has no lineage, survives executor loss, and carries real file statistics, so
    later joins choose their strategy on measured size.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_work(df, label))


def write_work(df: DataFrame, label: str = "step") -> str:
    """``df`` as a table in the shared folder; returns its path, so that it can be removed.

    What was shuffled to make it goes with the end of the write, and not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "docloom", f"{label}-{uuid.uuid4().hex}")
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)  # a plan of its own, made under the setting
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return path


def remove_work(spark: SparkSession, *paths: str) -> None:
    """Remove work tables that nothing reads any more."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Rounds:
    """The state of an iteration, one work table per round; a round's table goes once its successor is written."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.path = spark, label, None

    def store(self, df: DataFrame) -> DataFrame:
        path = write_work(df, self.label)
        if self.path:
            remove_work(self.spark, self.path)
        self.path = path
        return self.spark.read.schema(df.schema).parquet(path)
