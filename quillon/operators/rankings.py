"""Rank tracking: latest and previous snapshots, deltas, alerts, history, as-of lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_and_previous(snapshots: DataFrame, key: str, day: str, position: str) -> DataFrame:
    """(key, day, position, previous_position, delta) of each key's latest snapshot; a positive delta is an improvement."""
    w = Window.partitionBy(key).orderBy(F.desc(day))
    out = snapshots.select(key, day, position, F.lead(position).over(w).alias("previous_position"), F.row_number().over(w).alias("_rn"))
    return out.where("_rn = 1").drop("_rn").withColumn("delta", F.col("previous_position") - F.col(position))


def is_drop(current: Column, previous: Column, threshold: int, alert_on_lost: bool) -> Column:
    return F.when(previous.isNull(), False).when(current.isNull(), F.lit(alert_on_lost)).otherwise(current - previous >= threshold)


def history(snapshots: DataFrame, key: str, day: str, position: str, n: int = 30) -> DataFrame:
    """(key, history): the last n snapshots in ascending order of day, one without a day at the end."""
    w = Window.partitionBy(key).orderBy(F.desc(day))
    last = snapshots.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    dated = F.struct(F.col(day).isNull().alias("undated"), F.col(day).alias("day"), F.col(position).alias("position"))
    in_order = F.transform(F.array_sort(F.collect_list(dated)), lambda x: F.struct(x.day.alias("day"), x.position.alias("position")))
    return last.groupBy(key).agg(in_order.alias("history"))


def prior(snapshots: DataFrame, key: str, day: str, position: str, today) -> DataFrame:
    """As-of lookup: each key's last known position strictly before ``today``, and the day of its last snapshot; one aggregate, no sort."""
    before = snapshots.where(F.col(day) < today)
    known = F.when(F.col(position).isNotNull(), F.col(day))
    return before.groupBy(key).agg(F.max_by(position, known).alias("prior_position"), F.max(day).alias("prior_day"))


#: Microseconds from 1601, from which a browser's history counts, to 1970.
SINCE_1601 = 11_644_473_600_000_000


def search_history(visits: DataFrame, keywords: list[str], since: Column | None = None, limit: int = 0, by_visits: bool = False) -> DataFrame:
    """(title, url, visited, visits) of addresses (title, url, last_visit: microseconds since 1601, visits) whose title and address together hold every
    keyword, whatever its case, visited since a time; the latest first, or the most visited. limit 0: all."""
    hay = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("url", F.lit(""))))
    rows = visits.where("last_visit > 0")
    for k in keywords:
        rows = rows.where(hay.contains(k.lower()))
    rows = rows.withColumn("visited", F.timestamp_micros(F.col("last_visit") - SINCE_1601))
    rows = rows if since is None else rows.where(F.col("visited") >= since)
    order = [F.desc("visits"), F.desc("last_visit")] if by_visits else [F.desc("last_visit")]
    out = rows.orderBy(*order, "url")
    return (out.limit(limit) if limit else out).select("title", "url", "visited", "visits")


def quota_top(rows: DataFrame, group: str, order: list, quota: Column) -> DataFrame:
    """The first rows of each group with their place ``rn``, as many as its quota."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rn") <= quota)


def commonest(rows: DataFrame, group: str, kind: str, priority: list[str]) -> DataFrame:
    """(group, category): the kind with the most rows; of several the one that stands first in the priority, others last."""
    n = rows.groupBy(group, kind).agg(F.count(F.lit(1)).alias("n"))
    place = F.coalesce(*[F.when(F.col(kind) == k, i) for i, k in enumerate(priority)], F.lit(len(priority)))
    return n.groupBy(group).agg(F.max_by(kind, F.struct("n", -place)).alias("category"))


def last_of(rows: DataFrame, group: str, value: str, order: list[str]) -> DataFrame:
    """(group, value of the last row, n)."""
    return rows.groupBy(group).agg(F.max_by(value, F.struct(*order)).alias("last"), F.count(F.lit(1)).alias("n"))


def renumbered(rows: DataFrame, group: str, order: list[str], name: str = "id") -> DataFrame:
    """rows with their places in each group, from 1."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))
