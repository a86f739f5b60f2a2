"""Evaluation in stages that cost more and more: each sees only the rows that the one before let through, and none twice.

A stage's results are kept by a hash of what it read, in a table of buckets, so that a rerun, or another row of the same content, takes them
from there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.buckets import BucketTable
from quillon.operators.scratch import kept


@dataclass(frozen=True)
class Stage:
    """work: rows (_hash, inputs) to rows (_hash, result), the result of a type given as DDL; a null result counts as a failure, kept as such.
    keep: whether a row goes on, of its column named like the stage."""

    name: str
    inputs: tuple[str, ...]
    result: str
    work: Callable[[DataFrame], DataFrame]
    keep: Callable[[Column], Column]


def run(rows: DataFrame, stages: list[Stage], path: str, buckets: int = 16) -> tuple[DataFrame, DataFrame]:
    """(rows with a column for each stage and ``stage``, the last that they reached; counts (place, stage, seen, computed, passed)).

    A row that a stage rejects has null for the later ones. Results live below ``path``. Rows of null inputs are evaluated like others.
    """
    spark, counts = rows.sparkSession, []
    alive, done = rows, None
    for place, s in enumerate(stages):
        schema = T.StructType.fromDDL(f"_hash string, _at long, result {s.result}")
        store = BucketTable(spark, f"{path}/{s.name}", schema, ["_hash"], buckets)
        hashed = F.sha2(F.to_json(F.struct(*[F.col(c) for c in s.inputs]), {"ignoreNullFields": "false"}).cast("binary"), 256)
        alive = kept(alive.withColumn("_hash", hashed), f"before-{s.name}")
        version = max(store.versions(), default=-1) + 1
        known = store.rows()
        new = alive.select("_hash", *s.inputs).dropDuplicates(["_hash"]).join(known.select("_hash"), "_hash", "left_anti")
        fresh = kept(s.work(new).select("_hash", F.lit(version).cast("long").alias("_at"), F.col("result").cast(schema["result"].dataType).alias("result")), f"after-{s.name}")
        computed = fresh.count()
        if computed:
            store.merge(fresh, version, [F.desc("_at")])
        judged = kept(alive.join(store.rows().select("_hash", F.col("result").alias(s.name)), "_hash", "left").drop("_hash").withColumn("_keep", F.coalesce(s.keep(F.col(s.name)), F.lit(False))), f"judged-{s.name}")
        seen, passed = judged.agg(F.count(F.lit(1)).alias("n"), F.count_if("_keep").alias("k")).first()
        counts.append((place, s.name, seen, computed, passed))
        last = place == len(stages) - 1
        out = judged.where("NOT _keep OR " + str(last).lower()).drop("_keep").withColumn("stage", F.lit(s.name))
        done = out if done is None else done.unionByName(out, allowMissingColumns=True)
        alive = judged.where("_keep").drop("_keep")
    order = [c for c in done.columns if c != "stage"]
    return done.select(*order, "stage"), spark.createDataFrame(counts, "place int, stage string, seen long, computed long, passed long")
