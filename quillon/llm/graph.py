"""Connected components: links are contracted to the least neighbour, then minimum labels and pointer jumping, each round cut off from the last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize


def contract(edges: DataFrame) -> DataFrame:
    """(u, v), u > v, with the components of edges (a, b): every node is linked to its least neighbour, and so are its other
    lesser neighbours. Many centres of one group become few, so about a link a node is left."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.collect_set("v").alias("vs"))  # as many as centres that met u
    return least.select(F.explode(F.array_append(F.array_remove("vs", F.col("m")), F.col("u"))).alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(k, root) for every end of an edge (a, b); root is the least k of its component."""
    short = materialize(contract(edges), "contracted")
    short = contract(short.withColumnsRenamed({"u": "a", "v": "b"}))
    both = materialize(short.select(F.col("u").alias("a"), F.col("v").alias("b")).union(short.select(F.col("v").alias("a"), F.col("u").alias("b"))), "edges")
    label = materialize(both.groupBy(F.col("a").alias("k")).agg(F.min(F.least("a", "b")).alias("root")), "labels")
    while True:
        least = both.join(label.withColumnRenamed("k", "b"), "b").groupBy("a").agg(F.min("root").alias("m"))
        lower = label.join(least.withColumnRenamed("a", "k"), "k").select("k", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        lower = materialize(lower, "lowered")
        jump = label.select(F.col("k").alias("root"), F.col("root").alias("far"))
        jumped = lower.join(jump, "root", "left").select("k", "was", F.least("root", F.coalesce("far", "root")).alias("root"))
        label = materialize(jumped, "labels")
        if not label.where("root <> was").limit(1).count():
            return label.select("k", "root")
