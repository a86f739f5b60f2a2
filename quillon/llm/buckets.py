"""Tables bucketed by a key in the shared scratch folder: two of them meet by that key without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import scratch_dir


class Bucketed:
    """A written table of ``n`` buckets of column ``key``; ``rows`` reads it, ``remove`` deletes it."""

    def __init__(self, df: DataFrame, key: str, n: int, name: str, dealt: bool = False):
        """dealt: df's tasks hold a bucket's rows each already, as those of a join of such tables do."""
        self.spark: SparkSession = df.sparkSession
        self.name = f"quillon_{name}_{uuid.uuid4().hex}"
        self.path = f"{scratch_dir(self.spark)}/{self.name}"
        rows = df if dealt else df.repartition(n, key)
        rows.write.format("parquet").bucketBy(n, key).sortBy(key).option("path", self.path).option("compression", "zstd").saveAsTable(self.name)

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def remove(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
