"""Rules of short videos' scripts: every check of a video gives a row (check, level, detail), all in one pass over its scenes.

Scenes: content, id, visual_type, voiceover, texts (map of on-screen texts), media; a video's own figures (companies, core
numbers, series) come by content and may be missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words and phrases that spoken text does without.
BLACKLIST = (
    "leverage", "utilize", "facilitate", "streamline", "robust", "seamless", "delve", "navigate", "unlock", "harness", "foster", "cultivate", "fundamentally", "essentially", "ultimately", "crucially", "notably", "moreover", "furthermore",
    "myriad", "paradigm", "ecosystem", "landscape", "realm", "tapestry", "journey", "game-changer", "deep dive", "at the end of the day", "dive in", "it's not just", "in today's fast-paced world", "hey guys", "what's up everyone",
    "without further ado", "oaicite", "contentreference", "turn0search0", "as of my last update", "i cannot browse", "[your name]", "[insert hook]", "[brand]", "certainly!", "sure, here is", "i hope this helps",
)
#: Patterns of texts.
DASHES = "—|–|--"
DEAD_CLOSER = "thanks for watching|don't forget to (like|subscribe)|subscribe for more|what do you think|drop your thoughts|let me know in the comments|hit subscribe"
STRONG_WORD = r"\b(leaked|paused|crash|surge|breakthrough|exclusive|secret|revealed|banned|crisis|first|never|only)\b"
WRITTEN_OPENER = "in this video,? i will|today i want to talk about|in this video,? we will|today we're going to"
SOURCE = r"\b(reported|said|told|according to|revealed|stated|announced|confirmed|bloomberg|reuters|ft|wall street journal|sources?)\b"
CALLS = "follow|subscribe|like|comment|share|save|download|click|sign up|check out|visit"
CLICKBAIT = r"\byou won't believe\b|\bshocking truth\b|\bthis will blow your mind\b|\bclick here\b"
WATERMARK = "@instagram|@youtube|@facebook|tiktok watermark|repost from"
GREETING = r"\b(hey|hi|hello|what's up|welcome back|good morning|good evening|yo|sup)\b"
NAMED_SOURCE = r"\b(according to|reported by|bloomberg|reuters|FT|wall street journal)\b"
GOALS = (r"\bfollow|subscribe\b", r"\bcomment|tell|ask|question\b", r"\bshare|save\b")
KEYWORDS = ("china", "ai")
COMPANIES = ("deepseek", "huawei", "zhipu", "moonshot", "kimi", "minimax", "baidu", "alibaba", "tencent", "bytedance")
#: A term of the voice-over and the on-screen term that contradicts it.
CONTRADICTIONS = (
    ("restricted", "can buy"), ("restricted", "available"), ("restricted", "legal"), ("export-restricted", "can buy"), ("export-restricted", "available"), ("export-restricted", "legal"), ("illegal", "can buy"), ("illegal", "legal"),
    ("not allowed", "can buy"), ("not allowed", "available"), ("banned", "can buy"), ("banned", "available"), ("banned", "legal"), ("legal", "banned"), ("legal", "illegal"), ("clean", "accused"), ("clean", "guilty"),
    ("not on that list", "accused"), ("rejected", "accepted"), ("rejected", "approved"), ("raises", "lowers"), ("raises", "cuts"), ("increases", "decreases"), ("up", "down"), ("open source", "closed source"), ("closed source", "open source"),
)
WORDS, BREATH, SCENES, FAIL_OVERLAP, WARN_OVERLAP, GRAM, RHYTHM, STACK, MOST_GOALS = 180, 25, (6, 10), 0.8, 0.5, 4, 0.15, 3, 2


def found(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?i){pattern}")


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def comparable(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^A-Za-z0-9_\s]", " "), r"\s+", " "))


def shown(texts: Column) -> Column:
    """On-screen texts as one lower-cased JSON text."""
    return F.lower(F.coalesce(F.to_json(texts), F.lit('""')))


def contradictions(scenes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, voice_term, shown_term, level) of each contradicting pair within a scene; a comparison only warns."""
    vo, seen = F.lower("voiceover"), shown(F.col("texts"))
    hits = [F.when(vo.contains(a) & seen.contains(b), F.struct(F.lit(a).alias("voice_term"), F.lit(b).alias("shown_term"))) for a, b in CONTRADICTIONS]
    out = scenes.select(*keys, F.explode(F.array_compact(F.array(*hits))).alias("c"), F.when(seen.rlike(r"\bvs\b"), "warn").otherwise("fail").alias("level"))
    return out.select(*keys, "c.voice_term", "c.shown_term", "level")


def let(value: Column, body) -> Column:
    """body(value), value being computed once, however often body's own functions ask for it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def facts(scenes: DataFrame) -> DataFrame:
    """One row for each video: what the checks ask of its scenes."""
    vo, own, t = F.coalesce("voiceover", F.lit("")), F.coalesce(F.to_json("texts"), F.lit('""')), F.col("texts")
    low, seen = F.lower(vo), F.lower(own)
    long_words = F.filter(F.split(low, r"\s+"), lambda w: F.length(w) > 3)
    grams = F.split(comparable(vo), " ")
    around = F.concat(F.lit(" "), comparable(own), F.lit(" "))
    windows = lambda g: F.when(F.size(g) >= GRAM, F.transform(F.sequence(F.lit(1), F.size(g) - GRAM + 1), lambda i: F.array_join(F.slice(g, i, GRAM), " "))).otherwise(F.array().cast("array<string>"))
    repeated = let(F.struct(grams.alias("g"), around.alias("a")), lambda x: F.exists(windows(x["g"]), lambda w: F.contains(x["a"], F.concat(F.lit(" "), w, F.lit(" ")))))
    shown_words = let(F.struct(long_words.alias("w"), seen.alias("s")), lambda x: F.size(F.filter(x["w"], lambda w: F.contains(x["s"], w))))
    no_dollars = r"(?<!\$\d[\s\S]{0,28})"
    capital = lambda a, b: F.coalesce(t[a].rlike("^[A-Z]") & t[b].rlike("^[A-Z]") & ~t[a].rlike(r"\s$"), F.lit(False))
    pair = [low.contains(a) & seen.contains(b) for a, b in CONTRADICTIONS]
    sentences = F.filter(F.split(vo, r"[.!?\n]+"), lambda x: F.btrim(x, F.lit(" \t\n\r")) != "")
    one = scenes.select(
        "content", "id", "visual_type", "media", "texts", vo.alias("vo"), low.alias("low"), seen.alias("seen"),
        F.size(split_words(vo)).alias("n_words"), F.size(F.filter(sentences, lambda x: F.size(split_words(x)) > BREATH)).alias("long_breaths"), (vo.rlike(DASHES) | own.rlike(DASHES)).alias("dashes"),
        sum((low.contains(w).cast("int") for w in BLACKLIST), F.lit(0)).alias("blacklisted"), F.size(long_words).alias("hook_words"), shown_words.alias("hook_shown"),
        F.array_join(F.slice(F.split(low, r"\s+"), 1, 3), " ").alias("opening"), *[(low.contains(k) | seen.contains(k)).alias(f"has_{k}") for k in KEYWORDS], found(vo, SOURCE).alias("sourced"), F.concat(vo, own).rlike(r"\d").alias("data"),
        found(vo, CLICKBAIT).alias("clickbait"), (found(vo, r"\bsources say\b") & ~found(vo, NAMED_SOURCE)).alias("unverified"), found(F.concat_ws(" ", vo, own, "visual_type", "media"), WATERMARK).alias("watermark"),
        F.when(vo != "", F.size(F.split(vo, r"\s+"))).alias("length"), (F.regexp_count(vo, F.lit(f"(?i){CALLS}")) >= STACK).alias("stacked"), *[found(vo, g).alias(f"goal_{i}") for i, g in enumerate(GOALS)],
        sum((p.cast("int") for p in pair), F.lit(0)).alias("contradicted"), seen.rlike(r"\bvs\b").alias("compares"), repeated.alias("repeats"),
        F.concat(vo, F.lit(" "), own).rlike(rf"(?i){no_dollars}¥[\d,.]+|{no_dollars}\d[\d,.]*\s*(?:billion|million|thousand)\s*yuan").alias("yuan"), (capital("title", "titleHighlight") | capital("line1", "line2")).alias("run_on"),
    )
    any_of, count_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False)), lambda c: F.count_if(F.col(c))
    head = F.struct("id", "visual_type", "media", "texts", "vo", "low", "seen", "hook_words", "hook_shown", "opening")
    lengths = F.collect_list("length")  # as many as scenes
    return one.groupBy("content").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(head, "id").alias("hook"), F.max_by(head, "id").alias("last"), F.sum("n_words").alias("words"), F.sum("long_breaths").alias("long_breaths"), any_of("dashes").alias("dashes"), F.sum("blacklisted").alias("blacklisted"),
        *[count_of(f"has_{k}").alias(f"n_{k}") for k in KEYWORDS], count_of("sourced").alias("sourced"), count_of("data").alias("data"), count_of("clickbait").alias("clickbait"), count_of("unverified").alias("unverified"), any_of("watermark").alias("watermark"),
        lengths.alias("lengths"), count_of("stacked").alias("stacked"), sum((any_of(f"goal_{i}").cast("int") for i in range(len(GOALS))), F.lit(0)).alias("goals"), F.sum(F.when(F.col("compares"), F.col("contradicted")).otherwise(0)).alias("compared"),
        F.sum(F.when(~F.col("compares"), F.col("contradicted")).otherwise(0)).alias("contradicted"), F.array_compact(F.collect_list(F.when(F.col("repeats"), F.col("id")))).alias("repeats"), any_of("yuan").alias("yuan"), any_of("run_on").alias("run_on"),
    )


def checks(videos: DataFrame, long_form: bool = False) -> DataFrame:
    """(content, check, level, detail) of every check of each video, from facts joined with the videos' own companies, core_numbers and
    series (struct of part, parts, id). Long form lets the limits on scenes and words warn."""
    v, hook, last = F.col, lambda f: F.col("hook")[f], lambda f: F.col("last")[f]
    over = F.lit("warn" if long_form else "fail")
    has = lambda x: F.coalesce(F.btrim(x) != "", F.lit(False))
    level = lambda ok, bad="fail": F.when(ok, "pass").otherwise(bad)
    number, claim = has(hook("texts")["bigNumber"]), has(hook("texts")["hookText"])
    ratio = hook("hook_shown") / hook("hook_words")
    mean = F.aggregate("lengths", F.lit(0.0), lambda a, x: a + x) / F.size("lengths")
    even = F.forall("lengths", lambda x: F.abs(x - mean) / mean < RHYTHM)
    own_company = F.exists(F.coalesce(v("companies"), F.array().cast("array<string>")), lambda c: F.contains(hook("seen"), F.lower(c)))
    known = sum((hook("seen").contains(c).cast("int") for c in COMPANIES), F.lit(0)) > 0
    echo = F.exists(F.slice(F.filter(F.split(hook("low"), r"\s+"), lambda w: F.length(w) > 4), 1, 5), lambda w: F.contains(last("low"), w))
    core = F.exists(F.filter(F.coalesce(v("core_numbers"), F.array().cast("array<string>")), lambda x: x != ""), lambda x: F.contains(last("low"), F.lower(x)))
    body = F.size(F.filter("repeats", lambda i: (i != hook("id")) & (i != last("id"))))
    s = v("series")
    rows = [
        ("scene_count", F.when(v("n").between(*SCENES), "pass").otherwise(over), v("n")), ("hook_visual_type", level(hook("visual_type").eqNullSafe("hook")), hook("visual_type")),
        ("hook_contract", level(~hook("visual_type").eqNullSafe("hook") | (number != claim)), F.when(number & claim, "both").when(~number & ~claim, "none").otherwise("one")),
        ("cta_visual_type", level(last("visual_type").eqNullSafe("cta")), last("visual_type")), ("cta_action", level(~last("visual_type").eqNullSafe("cta") | has(last("texts")["action"])), F.lit("")),
        ("hook_compelling", level(hook("vo").rlike(r"\d") | found(hook("vo"), STRONG_WORD)), F.lit("")), ("no_dashes", level(~v("dashes")), F.lit("")), ("no_blacklisted_words", level(v("blacklisted") == 0), v("blacklisted")),
        ("no_written_opener", level(~found(hook("vo"), WRITTEN_OPENER)), F.lit("")), ("hook_differs_from_text", F.when(hook("hook_words") == 0, "pass").when(ratio >= FAIL_OVERLAP, "fail").when(ratio >= WARN_OVERLAP, "warn").otherwise("pass"), F.concat_ws("/", hook("hook_shown"), hook("hook_words"))),
        ("no_dead_closer", level(~last("low").rlike(DEAD_CLOSER)), F.lit("")), ("no_greeting", level(~hook("opening").rlike(GREETING)), F.lit("")), *[(f"keyword_{k}", level(v(f"n_{k}") >= 2), v(f"n_{k}")) for k in KEYWORDS],
        ("source_attribution", level(v("sourced") >= 2), v("sourced")), ("data_points", level(v("data") >= 0.5 * v("n")), v("data")), ("word_count", F.when(v("words") <= WORDS, "pass").otherwise(over), v("words")),
        ("one_breath", level(v("long_breaths") == 0, "warn"), v("long_breaths")), ("subject_visibility", level(own_company | has(hook("texts")["subject"]) | known, "warn"), F.lit("")),
        ("series_meta", F.when(s.isNotNull(), level((F.coalesce(s["part"], F.lit(0)) > 0) & (F.coalesce(s["parts"], F.lit(0)) > 0) & has(s["id"]))), F.lit("")), ("no_clickbait", level(v("clickbait") == 0), v("clickbait")),
        ("no_unverified_claims", level(v("unverified") == 0), v("unverified")), ("no_watermarks", level(~v("watermark")), F.lit("")), ("rhythm", level((F.size("lengths") <= 2) | ~even, "warn"), F.size("lengths")),
        ("cta_stacking", level(v("stacked") == 0, "warn"), v("stacked")), ("primary_goal", level(v("goals") <= MOST_GOALS, "warn"), v("goals")),
        ("semantic_consistency", F.when(v("contradicted") > 0, "fail").when(v("compared") > 0, "warn").otherwise("pass"), v("contradicted") + v("compared")), ("loop_close", level(core, "warn"), F.when(core, "core").when(echo, "echo").otherwise("none")),
        ("text_repeats_voice", level(body == 0, "warn"), body), ("hook_media", level(~hook("visual_type").eqNullSafe("hook") | has(hook("media")), "warn"), F.lit("")), ("currency_notes", level(~v("yuan"), "warn"), F.lit("")), ("text_spacing", level(~v("run_on"), "warn"), F.lit("")),
    ]
    made = [F.struct(F.lit(name).alias("check"), how.alias("level"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail")) for name, how, detail in rows]
    return videos.select("content", F.explode(F.array(*made)).alias("r")).select("content", "r.*").where("level IS NOT NULL")


def with_own(per: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """facts with the videos' own figures (content, companies, core_numbers, series); none are missing ones."""
    if own is None:
        return per.withColumns({"companies": F.lit(None).cast("array<string>"), "core_numbers": F.lit(None).cast("array<string>"), "series": F.lit(None).cast("struct<part:int,parts:int,id:string>")})
    return per.join(own, "content", "left")
