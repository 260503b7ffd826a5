"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words of every operator here: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of an Arrow batch on its way to Python, so that long rows make short batches.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_scratch = threading.local()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are bounded in bytes, not in rows alone."""
    df.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the session's spark.checkpoint.dir. Where that is unset, a
    local session gets a temporary folder, and a cluster an error, as its machines share no folder that is known."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def persisted(df: DataFrame, lasting: bool = False) -> DataFrame:
    """df, computed once and written as a Parquet table to the shared folder, so that a lost executor costs a read and no
    recomputation, and later readers only read the columns they use. Within scratch() the table goes at its end;
    lasting: at the end of the scratch() around that, or never."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    levels = getattr(_scratch, "levels", [])
    if len(levels) > lasting:
        levels[-1 - lasting].append((spark, folder))
    return spark.read.schema(df.schema).parquet(folder)


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes the tables that persisted() writes within, but for lasting ones."""
    if not hasattr(_scratch, "levels"):
        _scratch.levels = []
    _scratch.levels.append([])
    try:
        yield
    finally:
        for spark, folder in _scratch.levels.pop():
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, most: int = 100_000, lasting: bool = True) -> DataFrame:
    """df, written out, with a broadcast hint if it has at most so many (short) rows; else joins shuffle it, and as a
    written table can be read again by each part of a skewed partition."""
    df = persisted(df, lasting)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def numbered(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """df with the places of its rows in the order of some columns, from 0. Range partitions are sorted and written;
    their counts, one row a partition, are added up and broadcast."""
    kept = persisted(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()), lasting=True)
    part = F.shiftright("_row", 33)
    counts = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(F.broadcast(before), part == F.col("_part")).select(*df.columns, place.alias(name))


def mark_of(text: Column) -> Column:
    """What tells apart the texts of rows with one id: the text's MD5, null counting as empty."""
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


_held: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks: one thing, so that the caches of one operator go when another starts, and
    their memory goes back to the system."""
    if key not in _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
        _held[key] = make()
    return _held[key]


def texts_of(column: pa.Array) -> list[str]:
    """The texts of an Arrow column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def runs_of(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) for runs of rows of about `most` bytes, so that what a task holds beside its Arrow
    batch is bounded by that and the longest single text."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64)
    end = np.cumsum(lengths)
    first, n = 0, len(column)
    while first < n:
        base = end[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(end, base + most, side="right")))
        yield first, last - first
        first = last


def blocks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) for runs of rows of about `most` bytes."""
    for first, n in runs_of(column, most):
        yield first, texts_of(column.slice(first, n))


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each item (the finaliser of the public splitmix64 generator)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
