"""Asset scoring, top-n, and greedy assignment of assets to scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.media import fnv1a


def _plain(text: Column) -> Column:
    """Without possessive apostrophes, hyphens as blanks."""
    return F.replace(F.regexp_replace(text, "['’]", ""), F.lit("-"), F.lit(" "))


def boundary_match(text: Column, keyword: Column) -> Column:
    """The keyword between blanks, punctuation or the text's ends; an East Asian one anywhere."""
    edge = r"[\s,.!?;:()'\"/]"
    t, k = _plain(text), _plain(keyword)
    whole = F.regexp_like(t, F.concat(F.lit(rf"(?:^|{edge})\Q"), k, F.lit(rf"\E(?:$|{edge})")))
    return F.coalesce((t != "") & (k != "") & F.when(keyword.rlike(r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}]"), F.contains(t, k)).otherwise(whole), F.lit(False))


def duration_score(kind: Column, seconds: Column) -> Column:
    return F.when(kind == "image", 14).when(seconds.between(3, 8), 18).when((seconds > 8) & (seconds <= 15), 10).otherwise(3)


def size_score(kind: Column, size: Column) -> Column:
    small, large = F.when(kind == "image", 5_000_000).otherwise(20_000_000), F.when(kind == "image", 10_000_000).otherwise(50_000_000)
    return F.when(size < small, 14).when(size < large, 7).otherwise(0)


def resolution_score(res: Column) -> Column:
    r = F.lower(res)
    return F.when(r.isNull() | (r == ""), 0).when(r.contains("1080") | r.contains("4k") | r.contains("2160"), 10).when(r.contains("720"), 7).otherwise(3)


def technical_score(title: Column, keyword: Column, kind: Column, seconds: Column, size: Column, res: Column) -> Column:
    """0 to 70: title, duration, size and resolution."""
    k = F.lower(keyword)
    t = F.lower(F.coalesce(title, F.lit("")))
    name = F.when(boundary_match(t, k), 28).when((F.length(k) > 3) & boundary_match(t, F.left(k, F.lit(5))), 14).otherwise(0)
    return name + duration_score(kind, seconds) + size_score(kind, size) + resolution_score(res)


def relevance(keyword: Column, subjects: Column, description: Column) -> Column:
    """0 to 30: the keyword among the subjects (20; several words by their share), and in the description (10)."""
    k, own = F.lower(keyword), F.transform(subjects, F.lower)
    words = F.filter(F.split(_plain(k), r"[\s,.!?;:()'\"/]+"), lambda w: w != "")
    some = F.size(F.filter(words, lambda w: F.array_contains(own, w)))
    part = F.when(F.size(words) > 1, F.floor(some / F.size(words) * 20 + 0.5)).otherwise(0)
    named = F.when(F.coalesce(F.size(own), F.lit(0)) <= 0, 0).when(F.array_contains(own, k), 20).otherwise(part)
    told = F.when(boundary_match(F.lower(F.coalesce(description, F.lit(""))), k), 10).otherwise(0)
    return F.least(named + told, F.lit(30))


#: Least technical score of an asset that is downloaded, and of one that is looked at closely.
BEFORE_DOWNLOAD, BEFORE_ANALYSIS = 20, 30


def low_confidence(title: Column, keyword: Column, technical: Column, least: int = BEFORE_ANALYSIS) -> Column:
    """Whether a technical score rules an asset out; without a title or a keyword it can't."""
    return (F.coalesce(title, F.lit("")) != "") & (F.coalesce(keyword, F.lit("")) != "") & (technical < least)


#: Scenes that show no media; the kind of scene that a content kind prefers; least score and fit of a hook's asset.
NO_MEDIA = ("cta", "data", "stat-reveal")
PREFERRED = {"product_demo": "narrative", "talking_head": "quote"}
HOOK_SCORE, HOOK_FIT = 60, "cover"


def recommend(assets: DataFrame, scenes: DataFrame) -> DataFrame:
    """(content_id, asset, scene, animation, overlay) of the scene that suits each asset (content_id, asset, kind, type): the first open
    one of the kind its content prefers, else the first open one. Scenes: content_id, scene, visual_type, media."""
    fits = F.col("visual_type").isin("hook", "narrative", "info-card", "quote") & F.col("media").isNull()
    wish = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in PREFERRED.items()])
    met = assets.withColumn("_wish", wish).join(scenes.where(fits), "content_id")
    rank = F.struct(F.when(F.col("visual_type").eqNullSafe(F.col("_wish")), 0).otherwise(1).alias("pass"), F.col("scene").alias("scene"))
    best = met.groupBy("content_id", "asset", "type").agg(F.min_by(F.struct("scene", "visual_type"), rank).alias("b"))
    vt, kind = F.col("b.visual_type"), F.col("type")
    moves = F.when(vt == "hook", "ken-burns").when(vt == "narrative", F.when(kind == "video", "zoom").otherwise("ken-burns")).when(vt == "info-card", F.when(kind == "image", "ken-burns").otherwise("fade")).otherwise("fade")
    veil = F.when(vt == "hook", 0.5).when(vt == "narrative", 0.7).when(vt == "info-card", 0.75).otherwise(0.8)
    return best.select("content_id", "asset", F.col("b.scene").alias("scene"), moves.alias("animation"), veil.alias("overlay"))


def assign(assets: DataFrame, scenes: DataFrame) -> DataFrame:
    """(content_id, scene, asset, score): assets (content_id, asset, score, fit, path) by falling score, each to the first open scene
    (content_id, scene, visual_type, media) that takes it.

    Hooks take assets of HOOK_SCORE that cover, other scenes but those without media take any, and a path is used once (assets
    of one path have one fit; those without a path take none). An asset that a hook takes is not for others, so the n-th that
    suits a hook gets the n-th hook, and of those left the n-th gets the n-th other scene: windows, no loop.
    """
    order = [F.desc(F.coalesce("score", F.lit(0.0))), F.col("asset")]
    once = assets.where("path IS NOT NULL AND path <> ''").withColumn("_rn", F.row_number().over(Window.partitionBy("content_id", "path").orderBy(*order))).where("_rn = 1")
    scene = scenes.where(F.col("media").isNull() & ~F.col("visual_type").isin(*NO_MEDIA)).withColumn("hook", F.col("visual_type") == "hook")
    scene = scene.withColumn("place", F.row_number().over(Window.partitionBy("content_id", "hook").orderBy("scene")))
    hooks = scene.where("hook").groupBy("content_id").agg(F.count(F.lit(1)).alias("_hooks"))
    suits = (F.coalesce("score", F.lit(0.0)) >= HOOK_SCORE) & F.col("fit").eqNullSafe(HOOK_FIT)
    ranked = once.join(hooks, "content_id", "left").withColumn("_suits", suits).withColumn("_n", F.row_number().over(Window.partitionBy("content_id", "_suits").orderBy(*order)))
    ranked = ranked.withColumn("hook", F.col("_suits") & (F.col("_n") <= F.coalesce("_hooks", F.lit(0))))
    placed = ranked.withColumn("place", F.row_number().over(Window.partitionBy("content_id", "hook").orderBy(*order)))
    return placed.join(scene.select("content_id", "hook", "place", "scene"), ["content_id", "hook", "place"]).select("content_id", "scene", "asset", "score")


def pick_music(posts: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """posts with ``pick``: the file (name, instant, news) that each key's FNV-1a hash chooses among those that begin at once and sound like news;
    if there are none, among those that begin at once, else among all, in the order of their names; null of an empty pool. The pool is a folder's files."""
    order = lambda kept: F.array_sort(F.collect_list(F.when(kept, F.col("name"))))
    pools = pool.agg(order(F.col("instant") & F.col("news")).alias("_a"), order(F.col("instant")).alias("_b"), order(F.lit(True)).alias("_c"))
    use = pools.select(F.when(F.size("_a") > 0, F.col("_a")).when(F.size("_b") > 0, F.col("_b")).otherwise(F.col("_c")).alias("_pool"))
    n = F.size("_pool")
    return posts.join(F.broadcast(use)).withColumn("pick", F.when(n > 0, F.get("_pool", (fnv1a(F.col(key).cast("string")) % n).cast("int")))).drop("_pool")
