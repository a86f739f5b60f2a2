"""Streaming forms of the scheduled jobs: each reads what is new, then stops (available-now).

A job that is given its folder goes on there the next time; without one it starts anew below ``spark.checkpoint.dir``. Windows
with watermarks are extensions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators.buckets import BucketTable
from quillon.operators.scratch import folder


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """New files of a table, a folder of part files or a single one, as a stream with the schema that the table has now;
    times get the session's zone, as watermarks need."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    source = spark.readStream.schema(schema)
    rows = source.parquet(path) if whole else source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def run(stream: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Append the stream's rows to Parquet and return all there are."""
    path = path or folder(stream.sparkSession, name)
    stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def upsert_stream(stream: DataFrame, keys: list[str], order: list, name: str, path: str | None = None, buckets: int = 64) -> DataFrame:
    """The newest row of each key after every batch. A batch reads and writes the buckets of its keys alone, and one that is run again gives the same table."""
    spark, path = stream.sparkSession, path or folder(stream.sparkSession, name)
    table = BucketTable(spark, f"{path}/table", stream.schema, keys, buckets)

    def merge(batch: DataFrame, i: int) -> None:
        BucketTable(batch.sparkSession, table.path, stream.schema, keys, buckets).merge(batch, i, order)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return table.rows()


def window_counts(stream: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """(window_start, key, n) of the tumbling windows that the watermark has closed."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("window_start"), key, "n")


def first_within(stream: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """Rows whose keys weren't seen within the watermark: state ends with it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def count_and_last(stream: DataFrame, key: str, time: str, value: Column) -> DataFrame:
    """(key, n, last): after each batch, how many rows a key has had and its newest value, kept as state of two fields and a time."""

    def step(k: tuple, frames, state: GroupState):
        n, at, last = state.get if state.exists else (0, 0, None)
        for f in frames:
            n += len(f)
            top = f.loc[f["at"].idxmax()]
            if int(top["at"]) >= at:
                at, last = int(top["at"]), float(top["value"])
        state.update((n, at, last))
        yield pd.DataFrame({key: [k[0]], "n": [n], "last": [last]})

    rows = stream.select(key, F.unix_micros(time).alias("at"), value.cast("double").alias("value"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} long, n long, last double", "n long, at long, last double", "append", GroupStateTimeout.NoTimeout)
