"""Interval algebra of timelines: offsets, gaps, coverage, grouping of word timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frames(seconds: Column, fps: int = 30) -> Column:
    """Whole frames that hold the seconds, one at least."""
    return F.greatest(F.ceil(seconds * fps - 1e-6), F.lit(1)).cast("long")


def offsets(rows: DataFrame, group: str, order: str, length: str) -> DataFrame:
    """``start``: the sum of the lengths before a row."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(length).over(w), F.lit(0)))


def gaps(rows: DataFrame, group: str, order: str, value: Column, least: float) -> DataFrame:
    """Rows whose distance from the one before exceeds ``least``."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("gap", value - F.lag(value).over(w)).where(F.col("gap") > least)


def coverage(rows: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """(group, covered, total, pct): union of intervals against the span from 0 to the last end, one decimal."""
    w = Window.partitionBy(group).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    hole = F.greatest(F.lit(0), F.col(start) - F.coalesce(F.max(end).over(w), F.lit(0)))
    out = rows.withColumn("_h", hole).groupBy(group).agg(F.max(end).alias("total"), F.sum("_h").alias("holes"))
    return out.select(group, (F.col("total") - F.col("holes")).alias("covered"), "total", F.round(100 * (F.col("total") - F.col("holes")) / F.col("total"), 1).alias("pct"))


def layout(rows: DataFrame, group: str, start: str, end: str, fill: float = 0.6, lead_frames: int = 2, fps: int = 30) -> DataFrame:
    """``shown_end``: an end beyond the next start is cut to it; one shortly before it is drawn out to some frames before it."""
    nxt = F.lead(start).over(Window.partitionBy(group).orderBy(start, end))
    gap = nxt - F.col(end)
    return rows.withColumn("shown_end", F.when(gap < 0, nxt).when((gap > 0) & (gap < fill), F.greatest(F.col(end), nxt - lead_frames / fps)).otherwise(F.col(end)))


def gaps_at(gap_rows: DataFrame, boundaries: DataFrame, group: str, start: str, end: str, at: str, slack: float) -> DataFrame:
    """The gaps (group, start, end) that hold a boundary (group, at) within the slack; groups meet by key before the interval is tested."""
    g, b = gap_rows.alias("g"), boundaries.alias("b")
    near = (F.col(f"g.{group}") == F.col(f"b.{group}")) & F.col(f"b.{at}").between(F.col(f"g.{start}") - slack, F.col(f"g.{end}") + slack)
    return g.join(b, near, "left_semi")


def contiguous(rows: DataFrame, group: str, position: str, first: int = 0) -> DataFrame:
    """(group, contiguous): whether the positions are first, first + 1 and so on, each once."""
    n = F.count(F.lit(1))
    return rows.groupBy(group).agg(((F.min(position) == first) & (F.max(position) == first + n - 1) & (F.countDistinct(position) == n)).alias("contiguous"))


def clip_frames(seconds: Column, fps: int = 30, buffer: float = 0.5) -> Column:
    """Frames of a scene's clip: its speech and a buffer, one at least."""
    return frames(seconds + buffer, fps)


def word_sync(pairs: DataFrame, group: str, tolerance: float) -> DataFrame:
    """(group, matches, first_mismatch, max_deviation, offenders): rendered against expected words (group, i, rendered, expected, onset, start).
    Times count up to the first place where the texts differ."""
    differs = ~F.col("rendered").eqNullSafe(F.col("expected"))
    first = F.min(F.when(differs, F.col("i"))).over(Window.partitionBy(group))
    off = F.when((F.col("i") < F.coalesce("_first", F.lit(1 << 30))) & F.col("rendered").isNotNull(), F.abs(F.col("onset") - F.col("start")))
    out = pairs.withColumn("_first", first).withColumn("_off", off).groupBy(group).agg(F.min("_first").alias("first_mismatch"), F.coalesce(F.max("_off"), F.lit(0.0)).alias("max_deviation"), F.count_if(F.col("_off") > tolerance).alias("offenders"))
    return out.withColumn("matches", F.col("first_mismatch").isNull())


def gap_violations(cues: DataFrame, boundaries: DataFrame, group: str, chain: float = 2 / 30, least: float = 0.5, slack: float = 0.011) -> DataFrame:
    """(group, gap, start) of gaps between cues (group, start, end) that are neither the chain's two frames, nor a real pause, nor at a
    boundary (group, at)."""
    w = Window.partitionBy(group).orderBy("start", "end")
    g = cues.select(group, F.lag("end").over(w).alias("before"), "start").where("before IS NOT NULL").withColumn("gap", F.col("start") - F.col("before"))
    odd = g.where((F.abs(F.col("gap") - chain) > slack) & (F.col("gap") < least - slack)).alias("g")
    b = boundaries.alias("b")
    near = (F.col(f"g.{group}") == F.col(f"b.{group}")) & F.col("b.at").between(F.col("g.before") - slack, F.col("g.start") + slack)
    return odd.join(b, near, "left_anti").select(group, "gap", "start")


def shift_cues(cues: DataFrame, drift: DataFrame, keys: list[str]) -> DataFrame:
    """Cues (keys, start, end, words: array of struct text, onset) moved by their scene's drift, if it has one."""
    d = F.coalesce("drift", F.lit(0.0))
    moved = F.transform("words", lambda w: F.struct(w["text"].alias("text"), (w["onset"] + d).alias("onset")))
    return cues.join(drift.select(*keys, "drift"), keys, "left").withColumns({"start": F.col("start") + d, "end": F.col("end") + d, "words": moved}).drop("drift")


def audio_sync(measured: DataFrame, keys: list[str], tolerance: float = 0.08) -> DataFrame:
    """(keys, checked, errors, passed) of measured against expected onsets."""
    late = F.abs(F.col("measured") - F.col("expected")) > tolerance + 1e-9
    return measured.groupBy(*keys).agg(F.count(F.lit(1)).alias("checked"), F.count_if(late).alias("errors")).withColumn("passed", F.col("errors") == 0)


def week_plan(topics: DataFrame, ratio: dict[str, float], days: int = 7) -> DataFrame:
    """(plan, day, pillar, topic) of seven days: each pillar's first topics by its share, in the ratio's order; then what is left over, pillar by
    pillar; days without a topic stay empty. topics: plan, pillar, ordinal, topic."""
    place = {p: i for i, p in enumerate(ratio)}
    at = F.coalesce(*[F.when(F.col("pillar") == p, i) for p, i in place.items()])
    share = F.coalesce(*[F.when(F.col("pillar") == p, int(days * r + 0.5)) for p, r in ratio.items()])
    n = F.row_number().over(Window.partitionBy("plan", "pillar").orderBy("ordinal"))
    ranked = topics.where(F.col("pillar").isin(*ratio)).withColumns({"_at": at, "_n": n}).withColumn("_late", (F.col("_n") > share).cast("int")).where(F.col("_n") <= days)
    day = ranked.withColumn("day", F.row_number().over(Window.partitionBy("plan").orderBy("_late", "_at", "_n"))).where(F.col("day") <= days)
    grid = topics.select("plan").distinct().select("plan", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("day"))
    return grid.join(day.select("plan", "day", "pillar", "topic"), ["plan", "day"], "left")
