"""Shared helpers: the documents table, stored intermediate tables, batches of a bounded size."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docweave.session import shared_folder

#: Bytes of text that a task's Python code works on at once; a single longer text is a batch of its own.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths of the tables stored so far and not deleted, oldest first; whoever ends a piece of work deletes its own.
STORED: list[str] = []


def store(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: later stages survive a lost executor."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    STORED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that no later plan reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        place = hadoop.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        if path in STORED:
            STORED.remove(path)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more, before they pile up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``most`` bytes of ``column`` (string or binary)."""
    if batch.num_rows == 0:
        return
    sizes = np.diff(offsets(batch.column(column)))
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array's values in its buffer; a null has no bytes."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    raw = column.buffers()[1]
    if raw is None or len(column) == 0:
        return np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(raw, dtype=kind)[column.offset: column.offset + len(column) + 1].astype(np.int64)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values' bytes, one after another, and the offsets of the values in them (no copy)."""
    at = offsets(column)
    raw = column.buffers()[2] if len(column.buffers()) > 2 else None
    if raw is None or at[-1] == at[0]:
        return np.zeros(0, dtype=np.uint8), at - at[0]
    return np.frombuffer(raw, dtype=np.uint8)[at[0]: at[-1]], at - at[0]


#: How to drop what a module's tasks keep in this worker for the tasks after them.
_KEPT: dict[str, Callable[[], None]] = {}


def keeping(module: str, drop: Callable[[], None]) -> None:
    """Called where a task of ``module`` begins: drops what other modules' tasks left in the worker, which outlives them."""
    others = [m for m in _KEPT if m != module]
    for other in others:
        _KEPT.pop(other)()
    if others:
        _return_memory()
    _KEPT[module] = drop


def _return_memory() -> None:
    """Gives what was dropped back to the system, where it would count as this worker's for good."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not use."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_chunks(data: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """``data`` in pieces of about ``most`` bytes, cut at ASCII white space; a longer word stays whole."""
    low = 0
    while low < len(data):
        found = _SPACE.search(data, low + most) if low + most < len(data) else None
        stop = found.start() if found else len(data)
        yield data[low:stop]
        low = stop
