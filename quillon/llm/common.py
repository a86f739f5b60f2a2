"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where that is unset on one machine (tests), one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="quillon-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df below the shared scratch folder and return a scan of it: lineage ends there."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_sizes(col: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.binary_length(col), 0), np.int64)


def by_bytes(batches: Iterable[pa.RecordBatch], text: int, size: int = 1 << 20, length: Callable[[pa.Array], np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, of about ``size`` bytes in column ``text`` (a longer text stands alone): work on them takes
    memory in proportion, whatever the rows' lengths. length: bytes of each value, where it isn't a text."""
    for b in batches:
        ends, i = np.cumsum((length or text_sizes)(b.column(text)) + 16), 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, size + (ends[i - 1] if i else 0), "right")))
            yield b.slice(i, j - i)
            i = j


def give_back() -> None:
    """Return a worker's freed memory to the machine: workers live on and share the executor with later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only in GNU's C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Bytes of a batch that goes to a worker at once, unless the session asks for less: it stands in the JVM and in Python at the same time.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_BYTES."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def map_arrow(df: DataFrame, work: Callable, schema, forget: Callable[[], None] | None = None) -> DataFrame:
    """``df.mapInArrow`` in small batches, after which a task gives its worker's freed memory back."""
    small_batches(df.sparkSession)

    def run(batches):
        try:
            yield from work(batches)
        finally:
            if forget:
                forget()
            give_back()

    return df.mapInArrow(run, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has at most so many rows (checked by a count that stops there); else as it is."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
