"""A table of keyed rows in buckets, each write of which makes new files for the buckets that it touches and leaves the others' alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.index import upsert


class BucketTable:
    """Rows of a schema by ``keys`` below ``path``: ``data/v<n>/bucket=<b>`` holds the files that write n made of bucket b, and
    ``versions/v<n>`` names the write that each bucket's rows come from. A version counts once it is written whole, so a write that fails or runs
    again leaves or gives the same table."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, keys, buckets

    def _at(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> list[str]:
        files, at = self._at(path)
        return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []

    def versions(self) -> list[int]:
        """Numbers of the finished versions, ascending."""
        return sorted(int(n[1:]) for n in self._names(f"{self.path}/versions") if n[:1] == "v" and "_SUCCESS" in self._names(f"{self.path}/versions/{n}"))

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """Which write each filled bucket's rows come from, in a version or the newest one; a row a bucket."""
        have = [v for v in self.versions() if version is None or v <= version]
        return {r.bucket: r.version for r in self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/versions/v{have[-1]}").collect()} if have else {}

    def rows(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows of a version (default the newest), of some buckets or all."""
        paths = [f"{self.path}/data/v{v}/bucket={b}" for b, v in sorted(self.manifest(version).items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, changes: DataFrame, version: int, order: list, deleted: Column | None = None) -> set[int]:
        """Make the next version: of the rows of one key, old or changed, the first in ``order`` stays, unless it is a deletion. Gives
        the touched buckets; theirs alone are read and written."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        given = changes.withColumn("_deleted", F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)).select(*self.schema.names, "_deleted")
        touched = {r[0] for r in given.select(bucket).distinct().collect()}  # as many as buckets at most
        base = {b: v for b, v in self.manifest(version - 1).items()}
        if touched:
            before = self.rows(version - 1, touched).withColumn("_deleted", F.lit(False))
            after = upsert(before, given, self.keys, order).where("NOT _deleted").drop("_deleted").withColumn("bucket", bucket)
            after.repartition(min(len(touched), self.buckets), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v{version}")
            filled = {int(n.split("=")[1]) for n in self._names(f"{self.path}/data/v{version}") if n.startswith("bucket=")}
            base = {b: v for b, v in base.items() if b not in touched} | dict.fromkeys(filled, version)
        self.spark.createDataFrame(sorted(base.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/v{version}")
        return touched

    def vacuum(self, keep: int = 2) -> None:
        """Remove versions but the newest ``keep``, and files that none of those has."""
        have = self.versions()
        files, _ = self._at(self.path)
        used = {(b, v) for n in have[-keep:] for b, v in self.manifest(n).items()}
        for n in have[:-keep]:
            files.delete(self._at(f"{self.path}/versions/v{n}")[1], True)
        for v in (int(n[1:]) for n in self._names(f"{self.path}/data") if n[1:].isdigit() and have and int(n[1:]) <= have[-1]):
            for name in self._names(f"{self.path}/data/v{v}"):
                if name.startswith("bucket=") and (int(name.split("=")[1]), v) not in used:
                    files.delete(self._at(f"{self.path}/data/v{v}/{name}")[1], True)
