"""What the operators of this subpackage share: input, work tables, tokenizer pieces."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import shared_dir

#: Entries that one worker remembers before it starts its memory of pieces anew.
CACHE_ENTRIES = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Work folders named since :func:`noted` began; None outside it.
_NOTED: list[str] | None = None


def work_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the one that all executors share."""
    path = os.path.join(shared_dir(spark), "docloom", f"{label}-{uuid.uuid4().hex}")
    if _NOTED is not None:
        _NOTED.append(path)
    return path


@contextmanager
def noted() -> Iterator[list[str]]:
    """The work folders named inside, so that whoever writes the result can delete them afterwards."""
    global _NOTED
    before, _NOTED = _NOTED, []
    try:
        yield _NOTED
    finally:
        _NOTED = before


def slices(batch: pa.RecordBatch, columns: list[str], rows: int, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``rows`` rows, and of about ``most_bytes`` in the strings and binaries among ``columns``.

    What a slice holds becomes Python objects at once, so long texts must not meet in one.
    """
    size = np.zeros(batch.num_rows, np.int64)
    for name in columns:
        values = batch.column(name)
        if pa.types.is_string(values.type) or pa.types.is_binary(values.type) or pa.types.is_large_string(values.type):
            size += pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False)
    upto, lo = np.cumsum(size), 0
    while lo < batch.num_rows:
        before = upto[lo - 1] if lo else 0
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(upto, before + most_bytes, side="right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def stored(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: no lineage, safe from lost executors."""
    path = work_path(df.sparkSession, label)
    (df if files is None else df.coalesce(files)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a work folder that no later step reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def whole(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text, F.lit(""))


class Remembered(dict):
    """What ``work`` gives for a piece, computed once per worker.

    Bounded: a full memory becomes the old generation, from which what is still in use moves back.
    """

    def __init__(self, work: Callable, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.work, self.entries, self.old = work, entries, {}

    def __missing__(self, piece):
        value = self.old[piece] if piece in self.old else self.work(piece)
        self.bound()
        self[piece] = value
        return value

    def bound(self) -> None:
        """A full memory becomes the old generation. To be called after entries were put in directly."""
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()


#: What operators remember in this worker from task to task: the module that does, and how to forget it.
_FORGET: dict[str, Callable[[], None]] = {}


def remembers(module: str, forget: Callable[[], None]) -> None:
    _FORGET[module] = forget


def begin(module: str) -> None:
    """A task of ``module`` begins in this worker: what others remember is dropped, so that memories do not add up."""
    others = [m for m in _FORGET if m != module]
    for m in others:
        _FORGET.pop(m)()
    if others:
        pa.default_memory_pool().release_unused()


def per_batch(df: DataFrame, fn: Callable[[dict[str, list]], Iterable[dict]], schema) -> DataFrame:
    """``fn`` gets the columns of an Arrow batch as lists and yields columns of output rows."""
    from pyspark.sql.types import StructType

    if isinstance(schema, str):
        schema = df.sparkSession.createDataFrame([], schema).schema
    assert isinstance(schema, StructType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        begin(fn.__module__)
        for batch in batches:
            for part in slices(batch, batch.schema.names, 2000):
                for out in fn(part.to_pydict()):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def with_columns(df: DataFrame, inputs: list[str], fn: Callable[..., dict[str, list]], columns, keep: list[str]) -> DataFrame:
    """``keep`` as it is and the ``columns`` that ``fn`` makes from lists of the ``inputs``.

    Kept columns stay in Arrow; only the inputs of a few rows at a time become Python objects.
    """
    from pyspark.sql.types import StructType

    made = df.sparkSession.createDataFrame([], columns).schema if isinstance(columns, str) else columns
    schema = StructType([*df.select(*keep).schema, *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fresh = to_arrow_schema(made)
        begin(fn.__module__)
        for batch in batches:
            for part in slices(batch, inputs, 500):
                out = fn(*[part.column(c).to_pylist() for c in inputs])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *[pa.array(out[f.name], f.type) for f in fresh]], names=[*keep, *fresh.names])

    return df.select(*dict.fromkeys([*keep, *inputs])).mapInArrow(run, schema)
