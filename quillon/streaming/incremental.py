"""A search index kept as a stream: new versions of sources come in, and only the chunks whose text changed go on.

The state of a source is its last version and the hashes of its chunks. A changed source sends its new and changed chunks, and
deletions of the chunks that it no longer has; an unchanged one, or one older than what was seen, sends nothing. What goes on is merged into a
table of buckets, of which a batch rewrites those that it touches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillon.operators.buckets import BucketTable
from quillon.operators.scratch import folder
from quillon.sources.readers import markdown_chunks

CHUNK = "version long, chunk_index int, title string, chunk string, hash string"


class Changes(StatefulProcessor):
    """Chunks of one source (rows of ``CHUNK``; a source without chunks is one row without index) against the hashes in its state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.version = handle.getValueState("version", "version long")
        self.hashes = handle.getMapState("hashes", "chunk_index int", "hash string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest: list[Row] = []
        for r in rows:
            if not newest or r.version > newest[0].version:
                newest = [r]
            elif r.version == newest[0].version:
                newest.append(r)
        if self.version.exists() and newest[0].version <= self.version.get()[0]:
            return
        self.version.update((newest[0].version,))
        was = {k[0]: v[0] for k, v in self.hashes.iterator()} if self.hashes.exists() else {}
        now = {r.chunk_index: r for r in newest if r.chunk_index is not None}
        for i, r in sorted(now.items()):
            if was.get(i) != r.hash:
                self.hashes.updateValue((i,), (r.hash,))
                yield Row(source_id=key[0], version=r.version, chunk_index=i, title=r.title, chunk=r.chunk, hash=r.hash, state="changed" if i in was else "new")
        for i in sorted(set(was) - set(now)):
            self.hashes.removeKey((i,))
            yield Row(source_id=key[0], version=newest[0].version, chunk_index=i, title=None, chunk=None, hash=None, state="deleted")

    def close(self) -> None:
        pass


def changed_chunks(sources: DataFrame, id_col: str, version_col: str, text_col: str) -> DataFrame:
    """(source_id, version, chunk_index, title, chunk, hash, state) of a stream of sources' versions; a null text is a source that is gone.

    Keyed state needs the session's RocksDB store, which is set here for the session.
    """
    spark = sources.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    cut = sources.select(F.col(id_col).alias("source_id"), F.col(version_col).cast("long").alias("version"), F.posexplode_outer(markdown_chunks(F.col(text_col))).alias("chunk_index", "_c"))
    chunks = cut.select("source_id", "version", "chunk_index", "_c.title", "_c.chunk", F.sha2(F.col("_c.chunk").cast("binary"), 256).alias("hash"))
    out = T.StructType([T.StructField("source_id", chunks.schema["source_id"].dataType), *T.StructType.fromDDL(f"{CHUNK}, state string").fields])
    return chunks.groupBy("source_id").transformWithState(Changes(), out, "Update", "None")


def index_stream(sources: DataFrame, id_col: str, version_col: str, text_col: str, path: str | None = None, buckets: int = 64) -> BucketTable:
    """Take in what is new of the sources, then stop; gives the table of chunks (source_id, version, chunk_index, title, chunk, hash). With a
    folder of its own it goes on there the next time."""
    spark, path = sources.sparkSession, path or folder(sources.sparkSession, "chunks")
    changes = changed_chunks(sources, id_col, version_col, text_col)
    table = BucketTable(spark, f"{path}/table", T.StructType([f for f in changes.schema if f.name != "state"]), ["source_id", "chunk_index"], buckets)

    def merge(batch: DataFrame, i: int) -> None:
        # the changes are written first: state must not be stepped twice in a batch
        batch.write.mode("overwrite").parquet(f"{path}/changes/v{i}")
        changed = batch.sparkSession.read.schema(changes.schema).parquet(f"{path}/changes/v{i}")
        BucketTable(batch.sparkSession, table.path, table.schema, table.keys, buckets).merge(changed, i, [F.desc("version")], F.col("state") == "deleted")

    changes.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return table
