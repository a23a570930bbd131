"""Small helpers that several operators of this package share."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where none is set and all is one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "quarrymap-checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, tag: str, options: dict[str, Any] | None = None) -> DataFrame:
    """Cut lineage: write `df` to a fresh Parquet folder under the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for added columns, with as many underscores before them as set them apart from the columns of `df`."""
    mark = "__"
    while any(c.startswith(mark) for c in df.columns):
        mark += "_"
    return [mark + n for n in names]


def crc_fold(id_col: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo `folds`; null ids fall in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0))


_held: list = []


def trim() -> None:
    """Give freed Arrow and C memory of this process back to the machine."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """make(), kept in this Python worker until another key is asked for.

    Workers outlive operators; with one slot the caches of a pipeline's operators don't pile up.
    """
    if not _held or _held[0] != key:
        _held.clear()
        trim()
        _held[:] = [key, make()]
    return _held[1]


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches], key: Hashable = None) -> Callable[[Batches], Batches]:
    """`run` for mapInArrow: begins with nothing kept that isn't `key`'s, and gives freed memory back at its end."""

    @functools.wraps(run)
    def tidied(it: Batches) -> Batches:
        if _held and _held[0] != key:
            _held.clear()
            trim()
        try:
            yield from run(it)
        finally:
            trim()

    return tidied


def slices(sizes: list[int], limit: int) -> Iterator[slice]:
    """Consecutive rows of about `limit` bytes (or words) in all, whatever the sizes."""
    start = total = 0
    for k, n in enumerate(sizes):
        total += n
        if total >= limit:
            yield slice(start, k + 1)
            start, total = k + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Column as Python strings; nulls become empty."""
    return [x or "" for x in column.to_pylist()]


def int_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of rows of 64-bit integers, exact; sums beyond 64 bits are cut to their range."""
    top = lambda x: int(max(abs(int(x.min())), abs(int(x.max())))) if x.size else 0
    bound = top(a) * top(b) * a.shape[1]
    if bound < 1 << 53:  # doubles hold every partial sum
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if bound < 1 << 63:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)
