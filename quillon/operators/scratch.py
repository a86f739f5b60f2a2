"""Intermediate tables and streams' files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset on one machine (tests), below one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


#: Folders that this process has made.
_MADE: list[str] = []


def clear(spark: SparkSession) -> int:
    """Delete the folders made so far, for a user who needs no more of the results that read them; gives their number."""
    n = len(_MADE)
    while _MADE:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return n


def kept(rows: DataFrame, name: str = "kept") -> DataFrame:
    """rows, written once and read back: lineage ends there."""
    path = folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
