"""Rules over rows: each broken rule gives a row, and rows roll up to a verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    level: str  # error or warning
    category: str
    check: str
    broken: Column
    detail: Column


def findings(rows: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """(keys, level, category, check, detail) of each broken rule of each row; one pass, whatever the number of rules."""
    made = [F.when(r.broken, F.struct(F.lit(r.level).alias("level"), F.lit(r.category).alias("category"), F.lit(r.check).alias("check"), r.detail.cast("string").alias("detail"))) for r in rules]
    return rows.select(*keys, F.explode(F.array_compact(F.array(*made))).alias("f")).select(*keys, "f.*")


def verdicts(rows: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """(keys, errors, warnings, verdict) of every row: fail, warn or pass."""
    count = lambda level: sum((F.coalesce(r.broken, F.lit(False)).cast("long") for r in rules if r.level == level), F.lit(0).cast("long"))
    out = rows.select(*keys, count("error").alias("errors"), count("warning").alias("warnings"))
    return out.withColumn("verdict", F.when(F.col("errors") > 0, "fail").when(F.col("warnings") > 0, "warn").otherwise("pass"))


def scenes(turns: DataFrame, video: str, order: str, text: str) -> DataFrame:
    """One row for each video: figures of its scenes that the rules ask for."""
    words = F.filter(F.split(F.col(text), r"[ \t\n\r]+"), lambda w: w != "")
    breath = F.array_max(F.transform(F.split(F.col(text), "[.!?]+"), lambda s: F.size(F.filter(F.split(s, r"[ \t\n\r]+"), lambda w: w != ""))))
    per = turns.select(video, F.col(order).alias("_o"), F.col(text).alias("_t"), F.size(words).cast("long").alias("_n"), breath.cast("long").alias("_b"))
    return per.groupBy(video).agg(
        F.count(F.lit(1)).alias("scenes"), F.sum("_n").alias("words"), F.max("_b").alias("breath"), F.sum(F.col("_t").contains("—").cast("long")).alias("dashes"),
        F.min_by("_n", "_o").alias("hook_words"), F.min_by("_t", "_o").alias("hook"), F.max_by("_t", "_o").alias("closer"),
    )


def scene_rules() -> list[Rule]:
    """Limits of a short video's script, over the figures of scenes()."""
    return [
        Rule("error", "structure", "scene_count", ~F.col("scenes").between(6, 10), F.col("scenes")),
        Rule("error", "voice", "word_count", F.col("words") > 180, F.col("words")),
        Rule("warning", "voice", "one_breath", F.col("breath") > 25, F.col("breath")),
        Rule("error", "style", "no_em_dashes", F.col("dashes") > 0, F.col("dashes")),
        Rule("warning", "hook", "hook_length", F.col("hook_words") > 15, F.col("hook_words")),
        Rule("warning", "hook", "no_greeting", F.lower("hook").rlike("^(hi|hello|hey|welcome)\\b"), F.left("hook", F.lit(20))),
        Rule("warning", "closer", "closer_asks", ~F.col("closer").rlike("[?!]$"), F.right("closer", F.lit(20))),
    ]


#: Fields of a post's record, the size of its video, its frame rates and lengths in seconds, what is left to a person.
META, META_MORE, META_SERIES, META_LISTS = ("subject", "pipelineId", "title", "article"), ("createdAt", "topics", "keyEntities", "dataPoints"), ("seriesId", "partNumber", "totalParts"), ("companies", "people", "models")
FRAME, RATES, SHORT, BEST, LONGEST = (1080, 1920), (23, 60), 180, 70, 600
BY_HAND = ("Title (< 60 chars)", "Description (with SEO keywords)", "3-5 hashtags (broad + niche)", "Geographic tag", "In-app editing (algorithm bonus)")


def final_gate(videos: DataFrame, keys: list[str], meta: Column, probe: Column, subtitled: Column, hook_subtitled: Column, tiktok: bool = True) -> DataFrame:
    """(keys, level, category, check): each check of a finished video with its level, pass, warning, error or manual.

    meta: its record as a variant; probe: a struct (width, height, fps, duration_ms), null for an unreadable file; subtitled: whether all scenes but the
    last have subtitles, hook_subtitled whether the first has. One pass over the videos, whatever the number of checks.
    """
    # read once a video, not once a check
    videos = videos.select(*keys, meta.alias("_meta"), probe.alias("_probe"), subtitled.alias("_subtitled"), hook_subtitled.alias("_hook"))
    meta, probe, subtitled, hook_subtitled = (F.col(c) for c in ("_meta", "_probe", "_subtitled", "_hook"))
    field = lambda f: F.try_variant_get(meta, f"$.{f}", "variant")
    raw = lambda f: F.coalesce(F.try_variant_get(meta, f"$.{f}", "string"), F.lit("")) != ""
    there = lambda f: field(f).isNotNull() & F.coalesce(~F.is_variant_null(field(f)), F.lit(False)) & ~F.coalesce(F.try_variant_get(meta, f"$.{f}", "string").isin("", "0", "false"), F.lit(False))
    is_list = lambda f: F.try_variant_get(meta, f"$.keyEntities.{f}", "array<variant>").isNotNull()
    seconds = probe["duration_ms"] / 1000
    row = lambda when, level, category, check: F.when(F.coalesce(when, F.lit(False)), F.struct(F.when(level, "pass").otherwise(F.lit(category[1])).alias("level"), F.lit(category[0]).alias("category"), F.lit(check).alias("check")))
    always, known = F.lit(True), meta.isNotNull()
    made = [row(~known, F.lit(False), ("Meta", "error"), "meta loads")]
    made += [row(known, there(f), ("Meta", "error"), f"meta.{f} exists") for f in META] + [row(known, there(f), ("Meta", "warning"), f"meta.{f} exists (extended)") for f in META_MORE]
    made += [row(known & raw("seriesId"), field(f).isNotNull(), ("Meta", "warning"), f"meta.{f} exists (series)") for f in META_SERIES]
    made += [row(known & there("keyEntities"), is_list(f), ("Meta", "error"), f"meta.keyEntities.{f} is array") for f in META_LISTS]
    read = probe.isNotNull()
    made += [row(always, read, ("Specs", "error"), "video can be read"), row(read, (probe["width"] == FRAME[0]) & (probe["height"] == FRAME[1]), ("Specs", "error"), "Resolution 1080×1920 (9:16)"), row(read, probe["fps"].between(*RATES), ("Specs", "error"), "Frame rate (23-60fps)")]
    if tiktok:
        made += [row(read & (seconds <= LONGEST), seconds <= BEST, ("Duration", "warning"), "TikTok optimal (60-70s)"), row(read & (seconds > LONGEST), F.lit(False), ("Duration", "error"), "TikTok max (600s/10min)")]
    else:
        made += [row(read, seconds <= SHORT, ("Duration", "error"), "YouTube Shorts duration (≤180s)")]
    made += [row(read, subtitled, ("Subtitles", "error"), "All scenes have subtitle timing"), row(read, hook_subtitled, ("Subtitles", "error"), "Scene 1 (hook) has subtitles")]
    made += [row(read, F.lit(False), ("Publish", "manual"), c) for c in BY_HAND]
    return videos.select(*keys, F.explode(F.array(*made)).alias("f")).where("f IS NOT NULL").select(*keys, "f.*")


def term_pairs(rows: DataFrame, keys: list[str], text: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """(keys, first, second) of each pair of contrary terms that one text holds both of; 'versus' between texts excuses them."""
    low = F.lower(text)
    both = [F.when(low.contains(a) & low.contains(b), F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"))) for a, b in pairs]
    return rows.where(~low.rlike(r"\b(vs|versus)\b")).select(*keys, F.explode(F.array_compact(F.array(*both))).alias("p")).select(*keys, "p.*")


def patch_states(rows: DataFrame, patches: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state) of each patch (key, before, after): missing, already-applied, conflict or none."""
    now = F.col(value)
    state = F.when(F.col("_has").isNull(), "missing").when(now.eqNullSafe(F.col("after")), "already-applied").when(~now.eqNullSafe(F.col("before")), "conflict").otherwise("none")
    return patches.join(rows.select(key, value, F.lit(1).alias("_has")), key, "left").select(key, state.alias("state"))


def drift(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, left_value, right_value) where two sources differ, rows of one side alone included."""
    out = left.select(key, F.col(value).alias("left_value")).join(right.select(key, F.col(value).alias("right_value")), key, "full")
    return out.where(~F.col("left_value").eqNullSafe(F.col("right_value")))
