"""Approximate vector search by an inverted file: rows lie in lists around centroids, a query probes the lists whose centroids are nearest.

Centroids are fitted on a bounded sample, but every row is in a list. Lists are partitions of the written index, so a search reads the
probed ones alone; long lists are cut into parts, so a hot one is several tasks' work, and short ones are put together into units. All queries of a
search share one pass over the lists: a query goes once to each unit with a list that it probes, where rows of a list meet all queries that probe it,
and each one's best are kept. Rows go to blocks of queries, so a task holds PART_ROWS rows and QUERY_BLOCK queries, whatever the size
of the index. Similarities are exact, so a search that probes all lists is an exact one.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.scratch import folder, kept
from quillon.operators.vector import ROWS, Best, as_matrix, unit_rows

#: Rows for each centroid that the fit sees, rows of a part of a list or of a unit of lists; queries that meet them in a task.
SAMPLE_PER_LIST, PART_ROWS, QUERY_BLOCK = 64, 16_384, 16_384


def sliced(batches):
    """Arrow batches of at most ROWS rows, so that a task's matrices are bounded whatever the session's batches are."""
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            yield b.slice(lo, ROWS)


class VectorIndex:
    """An index below ``path``: ``lists`` (rows by list), ``sizes`` (list, n, parts) and ``centroids`` (list, center)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        found = sorted(spark.read.parquet(f"{path}/centroids").collect(), key=lambda r: r["list"])  # a bounded number, see build
        self.centers = np.array([r.center for r in found], float).reshape(len(found), -1)
        schema = T.StructType.fromJson(json.loads(spark.read.text(f"{path}/schema", wholetext=True).first()[0]))  # an index of nothing has no files
        self.rows = spark.read.schema(schema).parquet(f"{path}/lists")
        self.id_col, self.vector_col = self.rows.columns[:2]

    @property
    def lists(self) -> int:
        return len(self.centers)

    @classmethod
    def build(cls, rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = (), path: str | None = None, lists: int | None = None, most_lists: int = 4096, seed: int = 7) -> VectorIndex:
        """Index rows with their ``keep`` columns for filters. lists: the root of the number of rows unless given, most_lists at most; the centroids
        are fitted on SAMPLE_PER_LIST rows a list, chosen by a hash of the row. A null or zero vector is kept but similar to nothing."""
        spark, path = rows.sparkSession, path or folder(rows.sparkSession, "index")
        v = F.col(vector_col).cast("array<double>")
        named = rows.select(id_col, v.alias(vector_col), *keep)
        size = named.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector_col)).alias("width")).first()
        n, width = size["n"], max(size["width"] or 0, 0)
        k = max(1, min(lists or round(n**0.5), most_lists, n or 1))
        length = F.sqrt(F.aggregate(vector_col, F.lit(0.0), lambda s, x: s + x * x))
        fit = named.where(F.col(vector_col).isNotNull()).where(length > 0).where(F.pmod(F.xxhash64(id_col, vector_col, F.lit(seed)), F.lit(1 << 20)) < (k * SAMPLE_PER_LIST << 20) / max(n, 1))
        sample = kept(fit.select(array_to_vector(F.transform(vector_col, lambda x: x / length)).alias("features")), "sample")
        centers = KMeans(k=k, seed=seed, maxIter=12, distanceMeasure="cosine").fit(sample).clusterCenters() if k > 1 and sample.limit(2).count() > 1 else [np.zeros(width)]
        centers = unit_rows(np.array(centers, float).reshape(len(centers), width))
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "list int, center array<double>").write.parquet(f"{path}/centroids")

        schema = T.StructType([*named.schema.fields, T.StructField("list", T.IntegerType())])

        def place(batches):
            for b in sliced(batches):
                near = (as_matrix(b.column(1), width) @ centers.T).argmax(1) if width else np.zeros(b.num_rows)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], [*b.schema.names, "list"])

        placed = kept(named.mapInArrow(place, schema), "placed")
        sizes = kept(placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts")), "sizes")  # a row a list
        part = F.pmod(F.xxhash64(id_col, vector_col), F.col("parts")).cast("int")
        cut = placed.join(F.broadcast(sizes), "list").select(id_col, vector_col, *keep, part.alias("part"), "list")
        cut.repartition("list", "part").sortWithinPartitions("list", "part").write.partitionBy("list").parquet(f"{path}/lists")
        sizes.write.parquet(f"{path}/sizes")
        spark.createDataFrame([(cut.schema.json(),)], "schema string").coalesce(1).write.text(f"{path}/schema")
        return cls(spark, path)

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, threshold: float | None = None, where: Column | None = None, query_id: str = "query_id", query_vector: str = "q", others: bool = False) -> DataFrame:
        """(query_id, id, similarity, rank): the k most similar rows of the ``probes`` nearest lists for each query, similarities rounded
        to six places and above the threshold before that; equal ones by id. where: a filter on the index's columns. others: a row isn't its own result."""
        id_col, width, centers = self.id_col, self.centers.shape[1], self.centers
        probes = min(probes, self.lists)
        whole = probes == self.lists
        id_type, query_type = self.rows.schema[id_col].dataType, queries.schema[query_id].dataType
        unit_of, parts_of = self._units()
        asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("q")).where("q IS NOT NULL")
        pairs = T.ArrayType(T.StructType([T.StructField("unit", T.IntegerType()), T.StructField("lists", T.ArrayType(T.IntegerType()))]))
        choice = T.StructType([T.StructField("query_id", query_type), T.StructField("q", T.ArrayType(T.DoubleType())), T.StructField("met", pairs)])

        def choose(batches):
            """Each query with the lists that it probes, by unit."""
            for b in sliced(batches):
                q = as_matrix(b.column(1), width)
                near = np.argsort(-(unit_rows(q) @ centers.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
                units = unit_of[near]
                order = np.argsort(units, axis=1, kind="stable")
                near, units = np.take_along_axis(near, order, 1), np.take_along_axis(units, order, 1)
                begins = np.ones(units.shape, bool)
                begins[:, 1:] = units[:, 1:] != units[:, :-1]
                lists = pa.ListArray.from_arrays(pa.array(np.append(np.flatnonzero(begins), near.size).astype(np.int32)), pa.array(near.ravel()))
                met = pa.StructArray.from_arrays([pa.array(units[begins]), lists], ["unit", "lists"])
                met = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(begins.sum(1))).astype(np.int32)), met)
                yield pa.RecordBatch.from_arrays([*b.columns, met], ["query_id", "q", "met"])

        if whole:  # every list of every unit
            asked = kept(asked, "asked")
            n = asked.count()
            counts = {u: n for u in range(len(parts_of))} if n else {}
            probed = asked.select("query_id", "q", F.explode(F.sequence(F.lit(0), F.lit(len(parts_of) - 1))).alias("unit"), F.lit(None).cast("array<int>").alias("lists"))
            rows = self.rows
        else:
            asked = kept(asked.mapInArrow(choose, choice), "asked")
            probed = asked.select("query_id", "q", F.explode("met").alias("m")).select("query_id", "q", "m.unit", "m.lists")
            met = asked.select(F.explode("met").alias("m"))
            counts = {r["unit"]: r["count"] for r in met.groupBy("m.unit").count().collect()}  # a row a unit
            rows = self.rows.where(F.col("list").isin([r["list"] for r in met.select(F.explode("m.lists").alias("list")).distinct().collect()]))
        # of each unit: how many parts, and how many blocks of queries
        blocks_of = {u: -(-n // QUERY_BLOCK) for u, n in counts.items()}
        plan = self.spark.createDataFrame([(u, parts_of[u], blocks_of[u]) for u in blocks_of], "unit int, parts int, blocks int")
        listed = self.spark.createDataFrame([(i, int(u), blocks_of[u]) for i, u in enumerate(unit_of.tolist()) if u in blocks_of], "list int, unit int, blocks int")
        rows = rows if where is None else rows.where(where)
        left = rows.select(F.col(id_col).alias("id"), F.col(self.vector_col).alias("v"), "list", "part").join(F.broadcast(listed), "list")
        left = left.select("id", "v", "list", "unit", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        right = probed.join(F.broadcast(plan), "unit").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
        right = right.select("query_id", "q", "lists", "unit", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block")
        found = T.StructType([T.StructField("query_id", query_type), T.StructField("id", id_type), T.StructField("similarity", T.DoubleType())])

        def best(a, b):
            """Each query's k best rows of one part of a unit."""
            names, asks = a["id"].combine_chunks(), b["query_id"].combine_chunks()
            kept_ = Best(unit_rows(as_matrix(b["q"], width)), k)
            own = pc.fill_null(pc.index_in(names.cast(asks.type), value_set=asks), -1).to_numpy(zero_copy_only=False) if others else None
            of_list = {None: None}
            if not whole:
                at = np.repeat(np.arange(b.num_rows), pc.list_value_length(b["lists"]).to_numpy())
                probed_list = b["lists"].combine_chunks().flatten().to_numpy()
                of_list = {i: at[probed_list == i] for i in np.unique(probed_list).tolist()}
            in_list = a["list"].to_numpy()
            for i, only in of_list.items():
                chosen = a["v"].combine_chunks() if i is None else a["v"].combine_chunks().filter(pa.array(in_list == i))
                ids, mine = (names, own) if i is None else (names.filter(pa.array(in_list == i)), None if own is None else own[in_list == i])
                for lo in range(0, len(chosen), ROWS):  # similarities of ROWS rows at once, however large the part
                    kept_.offer(unit_rows(as_matrix(chosen.slice(lo, ROWS), width)), ids.slice(lo, ROWS), None if mine is None else mine[lo : lo + ROWS], threshold, only)
            at, ids, sims = kept_.found()
            return pa.table([asks.take(pa.array(at)), ids if ids is not None else names.slice(0, 0), pa.array(sims)], names=["query_id", "id", "similarity"])

        keys = ["unit", "part", "block"]
        some = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, found)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
        return some.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("id", id_col)

    def _units(self) -> tuple[np.ndarray, list[int]]:
        """(unit of each list, parts of each unit): short lists are put together up to PART_ROWS rows, a list of several parts is a unit of its own."""
        sizes = {r["list"]: (r["n"], r["parts"]) for r in self.spark.read.parquet(f"{self.path}/sizes").collect()}  # a bounded number, see build
        unit_of, parts_of, filled = np.zeros(self.lists, np.int32), [], PART_ROWS + 1
        for i in range(self.lists):
            n, parts = sizes.get(i, (0, 1))
            if filled + n > PART_ROWS or parts > 1:
                parts_of.append(parts)
                filled = 0
            unit_of[i] = len(parts_of) - 1
            filled += n
        return unit_of, parts_of

    def probes_for(self, queries: DataFrame, goal: float = 0.9, k: int = 10, **how) -> int:
        """The least power of two of probes (or all lists) that finds ``goal`` of the exact k best of these queries, on the average."""
        exact = kept(self.search(queries, k, self.lists, **how), "exact")
        probes = 1
        while probes < self.lists and recall(self.search(queries, k, probes, **how), exact, self.id_col) < goal:
            probes *= 2
        return min(probes, self.lists)


def recall(found: DataFrame, exact: DataFrame, id_col: str) -> float:
    """Share of the exact results that were found; 1 where there are none."""
    r = exact.select("query_id", id_col).join(found.select("query_id", id_col, F.lit(1).alias("hit")), ["query_id", id_col], "left").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits")).first()
    return r.hits / r.n if r.n else 1.0
