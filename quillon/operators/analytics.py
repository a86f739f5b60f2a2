"""Metrics: totals, best variant, conditional counts, normalisation, cumulative shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.scratch import kept


def totals(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Sums with null as 0, and the number of rows."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(v, F.lit(0))).alias(f"total_{v}") for v in values])


def best_variant(rows: DataFrame, group: str, variant: str, score: Column, least: int = 2, order: str | None = None) -> DataFrame:
    """Of each group with at least ``least`` scored variants, the best; ties keep the first in an order, by name if none is given."""
    w = Window.partitionBy(group)
    out = rows.withColumn("score", score).where("score IS NOT NULL").withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_rn", F.row_number().over(w.orderBy(F.desc("score"), order or variant)))
    return out.where((F.col("_rn") == 1) & (F.col("_n") >= least)).select(group, variant, "score")


def band_counts(rows: DataFrame, keys: list[str], bands: dict[str, Column]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in bands.items()])


def ordered_averages(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, average) of each group's values, added up as doubles in the order given, so that neither partitions nor tasks change the last digit. A
    window reads a group row by row, whatever its size; null values count for nothing."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.select(*keys, order, value, F.sum(F.col(value).cast("double")).over(w).alias("_sum"))
    return run.groupBy(*keys).agg((F.max_by(F.struct("_sum"), F.struct(order))["_sum"] / F.nullif(F.count(value), F.lit(0))).alias("average"))


def min_max(rows: DataFrame, key: str, value: str) -> DataFrame:
    """value scaled to 0..1 over all rows; one value: 0. The range is one row, sent to every task."""
    span = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return rows.join(F.broadcast(span)).select(key, F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)).alias("scaled"))


def coalesced_lookup(left: DataFrame, sides: list[tuple[DataFrame, str]], key: str, out: str) -> DataFrame:
    """Left joins on one key; the first side that has a value gives it."""
    for i, (df, col) in enumerate(sides):
        left = left.join(df.select(key, F.col(col).alias(f"_v{i}")), key, "left")
    return left.withColumn(out, F.coalesce(*[f"_v{i}" for i in range(len(sides))])).drop(*[f"_v{i}" for i in range(len(sides))])


def latest_state(events: DataFrame, key: str, order: Column, state: Column) -> DataFrame:
    """The state that each key's last event leaves."""
    return events.groupBy(key).agg(F.max_by(state, order).alias("state"))


def descend(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, path) of each node under the roots; edges(parent, child). A level is a join; ends with the last level, and a path never
    comes back to a node of its own."""
    out = level = roots.select("id", F.array("id").alias("path"))
    while True:
        level = level.join(edges, level.id == edges.parent).where(~F.array_contains("path", F.col("child"))).select(F.col("child").alias("id"), F.array_append("path", F.col("child")).alias("path"))
        level = kept(level)
        if level.isEmpty():
            return out
        out = out.union(level)


def exploded_counts(rows: DataFrame, values: str, name: str) -> DataFrame:
    """(name, n): how often each value stands in the rows' arrays."""
    return rows.select(F.explode(values).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def category_arrays(rows: DataFrame, category: str, known: list[str], value: str) -> DataFrame:
    """(category, items) of the known categories that have rows, items in order; other categories go."""
    return rows.where(F.col(category).isin(*known)).groupBy(category).agg(F.array_sort(F.collect_list(value)).alias("items"))


def best_of(columns: list[str], higher: Column) -> Column:
    """The greatest of the columns where higher is better, else the least."""
    return F.when(higher, F.greatest(*columns)).otherwise(F.least(*columns))


def deviations(rows: DataFrame, keys: list[str], deviation: Column, error: float, warning: float) -> DataFrame:
    """(keys, worst, errors, warnings): the greatest absolute deviation, and how many exceed either limit."""
    off = F.abs(deviation)
    return rows.groupBy(*keys).agg(F.max(off).alias("worst"), F.count_if(off > error).alias("errors"), F.count_if((off > warning) & (off <= error)).alias("warnings"))
