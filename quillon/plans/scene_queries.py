"""The rules of scripts over conversations read as scenes, with SQL that states each rule by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import scene_rules as R
from quillon.plans.twins import registry
from quillon.sources.readers import table

Q, S, query = registry()

#: What is said besides, by (conv_id + turn) modulo 12.
SAID = [
    "We leverage -- China ai.", "Bloomberg reported $3 billion.", "Follow, like and share, or comment.", "Sources say it is banned and up.", "You won't believe ¥500 now.", "", "Thanks for watching, click here", "China ai said it first.",
    "hey, an open source model", "one two three four five six", "a repost from @youtube", "never mind, tell us and save",
]
#: What is shown in the body, by turn modulo 6.
SHOWN = ["legal vs available", "one two three four five", "China down", "closed source", "it is legal", "plain"]


def _scenes(s, d) -> DataFrame:
    c = table(s, d, "conversations").withColumn("last", F.max("turn").over(Window.partitionBy("conv_id")))
    k, t = F.col("conv_id"), F.col("turn")
    pick = lambda xs, i: F.get(F.array(*map(F.lit, xs)), i.cast("int"))
    said = F.concat_ws(" ", F.when((k + t) % 12 == 8, "hey there"), F.col("text"), F.nullif(pick(SAID, (k + t) % 12), F.lit("")))
    kind = F.when((t == 0) & (k % 3 != 0), "hook").when((t == F.col("last")) & (k % 2 == 0), "cta").otherwise("narrative")
    entry = lambda name, value, where: F.when(where, F.struct(F.lit(name).alias("k"), F.lit(value).alias("v")))
    first, last = t == 0, t == F.col("last")
    texts = F.array_compact(F.array(
        entry("hookText", "a claim first", first & (k % 4 != 1)), entry("bigNumber", "42", first & (k % 4 == 2)), entry("subject", "Kimi", first & (k % 5 == 0)), entry("action", "FOLLOW", last & (k % 4 == 0)),
        entry("title", "STRATEGIC", t % 5 == 3), entry("titleHighlight", "BACKERS", (t % 5 == 3) & (k % 2 == 1)), F.when(~first & ~last, F.struct(F.lit("body").alias("k"), pick(SHOWN, t % 6).alias("v"))),
    ))
    return c.select(k.alias("content"), (t + 1).alias("id"), kind.alias("visual_type"), said.alias("voiceover"), F.map_from_entries(texts).alias("texts"), F.when(k % 7 == 0, "image: a.png").alias("media"))


def _own(s, d) -> DataFrame:
    k = F.col("conv_id")
    series = F.when(k % 6 == 0, F.struct(F.lit(1).alias("part"), F.lit(3).alias("parts"), F.lit("a-b").alias("id"))).when(k % 6 == 1, F.struct(F.lit(1).alias("part"), F.lit(None).cast("int").alias("parts"), F.lit("a-b").alias("id")))
    return table(s, d, "conversations").select(k.alias("content"), F.when(k % 8 == 0, F.array(F.lit("Claim"))).alias("companies"), F.when(k % 9 == 0, F.array(F.lit("500"), F.lit(""))).alias("core_numbers"), series.alias("series")).distinct()


def _list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _re(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


FIXTURE = rf"""c AS (SELECT conv_id AS k, turn AS t, text AS x, max(turn) OVER (PARTITION BY conv_id) AS l FROM conversations),
s AS (SELECT k, t, l, t = 0 AS f, t = l AS e, CASE WHEN t = 0 AND k % 3 <> 0 THEN 'hook' WHEN t = l AND k % 2 = 0 THEN 'cta' ELSE 'narrative' END AS vt,
 CASE WHEN (k + t) % 12 = 8 THEN 'hey there ' ELSE '' END || x || CASE WHEN {_list(SAID)}[CAST((k + t) % 12 + 1 AS INT)] <> '' THEN ' ' || {_list(SAID)}[CAST((k + t) % 12 + 1 AS INT)] ELSE '' END AS vo,
 concat_ws(',', CASE WHEN t = 0 AND k % 4 <> 1 THEN '"hookText":"a claim first"' END, CASE WHEN t = 0 AND k % 4 = 2 THEN '"bigNumber":"42"' END, CASE WHEN t = 0 AND k % 5 = 0 THEN '"subject":"Kimi"' END, CASE WHEN t = l AND k % 4 = 0 THEN '"action":"FOLLOW"' END,
 CASE WHEN t % 5 = 3 THEN '"title":"STRATEGIC"' END, CASE WHEN t % 5 = 3 AND k % 2 = 1 THEN '"titleHighlight":"BACKERS"' END, CASE WHEN t <> 0 AND t <> l THEN '"body":"' || {_list(SHOWN)}[CAST(t % 6 + 1 AS INT)] || '"' END) AS tj FROM c),
w AS (SELECT *, lower(vo) AS low, lower('{{' || tj || '}}') AS seen, regexp_split_to_array(vo, '[ \t\n\x0B\f\r]+') AS ws, list_filter(regexp_split_to_array(lower(vo), '[ \t\n\x0B\f\r]+'), lambda z: length(z) > 3) AS lw FROM s),
p AS (SELECT *, len(list_filter(ws, lambda z: z <> '')) AS nw, len(list_filter({_list(R.BLACKLIST)}, lambda z: contains(low, z))) AS bl, len(list_filter(lw, lambda z: contains(seen, z))) AS hs,
 len(list_filter(regexp_split_to_array(vo, '[.!?\n]+'), lambda q: len(list_filter(regexp_split_to_array(q, '[ \t\n\x0B\f\r]+'), lambda z: z <> '')) > 25)) AS lb,
 len(list_filter({"[" + ", ".join(f"struct_pack(a := '{a}', b := '{b}')" for a, b in R.CONTRADICTIONS) + "]"}, lambda z: contains(low, z.a) AND contains(seen, z.b))) AS cx, regexp_matches(seen, '\bvs\b') AS vs,
 string_split(trim(regexp_replace(regexp_replace(low, '[^a-z0-9_ \t\n\x0B\f\r]', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')), ' ') AS g, ' ' || trim(regexp_replace(regexp_replace(seen, '[^a-z0-9_ ]', ' ', 'g'), ' +', ' ', 'g')) || ' ' AS ar FROM w),
r AS (SELECT *, len(list_filter(range(1, greatest(len(g) - 2, 1)), lambda i: contains(ar, ' ' || array_to_string(g[i:i + 3], ' ') || ' '))) > 0 AS rp FROM p),
v AS (SELECT k, count(*) AS n, max(CASE WHEN f THEN vt END) AS hvt, max(CASE WHEN e THEN vt END) AS lvt, max(CASE WHEN f THEN vo END) AS hvo, max(CASE WHEN f THEN low END) AS hlow, max(CASE WHEN e THEN low END) AS llow, max(CASE WHEN f THEN len(lw) END) AS hw, max(CASE WHEN f THEN hs END) AS hs,
 CAST(sum(nw) AS BIGINT) AS words, CAST(sum(lb) AS BIGINT) AS lb, bool_or(regexp_matches(vo || tj, '—|–|--')) AS da, CAST(sum(bl) AS BIGINT) AS bl, count(*) FILTER (contains(low, 'china') OR contains(seen, 'china')) AS nc, count(*) FILTER (contains(low, 'ai') OR contains(seen, 'ai')) AS na,
 count(*) FILTER (regexp_matches(vo, {_re(R.SOURCE)}, 'i')) AS so, count(*) FILTER (regexp_matches(vo || tj, '[0-9]')) AS dt, count(*) FILTER (regexp_matches(vo, {_re(R.CLICKBAIT)}, 'i')) AS cb, count(*) FILTER (contains(low, 'sources say')) AS uv, bool_or(contains(low, '@youtube')) AS wm,
 list(len(ws)) AS ls, avg(len(ws)) AS lm, count(*) FILTER (len(regexp_extract_all(low, '{R.CALLS}')) >= 3) AS st, bool_or(regexp_matches(low, '\bfollow|subscribe\b'))::INT + bool_or(regexp_matches(low, '\bcomment|tell|ask|question\b'))::INT + bool_or(regexp_matches(low, '\bshare|save\b'))::INT AS go,
 CAST(sum(CASE WHEN vs THEN cx ELSE 0 END) AS BIGINT) AS cw, CAST(sum(CASE WHEN vs THEN 0 ELSE cx END) AS BIGINT) AS cf, count(*) FILTER (rp AND NOT f AND NOT e) AS rp, bool_or(contains(vo, '¥')) AS yu, bool_or(contains(tj, 'BACKERS')) AS ro, bool_or(f AND e) AS alone FROM r GROUP BY k)"""
OK = "CASE WHEN {} THEN 'pass' ELSE '{}' END"


def _rule(name: str, ok: str, detail: str = "''", bad: str = "fail", where: str = "") -> str:
    return f"SELECT k AS content, '{name}' AS \"check\", {OK.format(ok, bad)} AS level, CAST({detail} AS VARCHAR) AS detail FROM v{where}"


RULES = [
    _rule("scene_count", "n BETWEEN 6 AND 10", "n"), _rule("hook_visual_type", "hvt = 'hook'", "hvt"), _rule("hook_contract", "hvt <> 'hook' OR k % 4 IN (0, 3)", "CASE k % 4 WHEN 1 THEN 'none' WHEN 2 THEN 'both' ELSE 'one' END"),
    _rule("cta_visual_type", "lvt = 'cta'", "lvt"), _rule("cta_action", "lvt <> 'cta' OR k % 4 = 0"), _rule("hook_compelling", f"regexp_matches(hvo, '[0-9]') OR regexp_matches(hvo, {_re(R.STRONG_WORD)}, 'i')"), _rule("no_dashes", "NOT da"),
    _rule("no_blacklisted_words", "bl = 0", "bl"), _rule("no_written_opener", "true"),
    "SELECT k, 'hook_differs_from_text', CASE WHEN hw = 0 THEN 'pass' WHEN hs / hw >= 0.8 THEN 'fail' WHEN hs / hw >= 0.5 THEN 'warn' ELSE 'pass' END, hs || '/' || hw FROM v",
    _rule("no_dead_closer", "NOT contains(llow, 'thanks for watching')"), _rule("no_greeting", rf"NOT regexp_matches(array_to_string(regexp_split_to_array(hlow, '[ \t\n\x0B\f\r]+')[1:3], ' '), {_re(R.GREETING)})"), _rule("keyword_china", "nc >= 2", "nc"), _rule("keyword_ai", "na >= 2", "na"),
    _rule("source_attribution", "so >= 2", "so"), _rule("data_points", "dt >= 0.5 * n", "dt"), _rule("word_count", "words <= 180", "words"), _rule("one_breath", "lb = 0", "lb", "warn"),
    _rule("subject_visibility", "k % 5 = 0 OR (k % 8 = 0 AND k % 4 <> 1)", bad="warn"), _rule("series_meta", "k % 6 = 0", where=" WHERE k % 6 < 2"), _rule("no_clickbait", "cb = 0", "cb"), _rule("no_unverified_claims", "uv = 0", "uv"), _rule("no_watermarks", "NOT wm"),
    _rule("rhythm", "len(ls) <= 2 OR len(list_filter(ls, lambda z: abs(z - lm) / lm >= 0.15)) > 0", "len(ls)", "warn"), _rule("cta_stacking", "st = 0", "st", "warn"), _rule("primary_goal", "go <= 2", "go", "warn"),
    "SELECT k, 'semantic_consistency', CASE WHEN cf > 0 THEN 'fail' WHEN cw > 0 THEN 'warn' ELSE 'pass' END, CAST(cf + cw AS VARCHAR) FROM v",
    "SELECT k, 'loop_close', CASE WHEN k % 9 = 0 AND contains(llow, '500') THEN 'pass' ELSE 'warn' END, CASE WHEN k % 9 = 0 AND contains(llow, '500') THEN 'core' WHEN len(list_filter(list_filter(regexp_split_to_array(hlow, '[ \\t\\n\\x0B\\f\\r]+'), lambda z: length(z) > 4)[1:5], lambda z: contains(llow, z))) > 0 THEN 'echo' ELSE 'none' END FROM v",
    _rule("text_repeats_voice", "rp = 0", "rp", "warn"), _rule("hook_media", "hvt <> 'hook' OR k % 7 = 0", bad="warn"), _rule("currency_notes", "NOT yu", bad="warn"), _rule("text_spacing", "NOT ro", bad="warn"),
]


@query("script_checks", f"WITH {FIXTURE} " + " UNION ALL ".join(RULES))
def _(s, d):
    return R.checks(R.with_own(R.facts(_scenes(s, d)), _own(s, d)))


@query("script_verdicts", f"WITH {FIXTURE}, f AS (" + " UNION ALL ".join(RULES) + ") SELECT content, count(*) FILTER (level = 'pass') AS passed, count(*) FILTER (level = 'warn') AS warned, count(*) FILTER (level = 'fail') AS failed FROM f GROUP BY content")
def _(s, d):
    found = R.checks(R.with_own(R.facts(_scenes(s, d)), _own(s, d)))
    return found.groupBy("content").agg(*[F.count_if(F.col("level") == x).alias(n) for x, n in (("pass", "passed"), ("warn", "warned"), ("fail", "failed"))])


@query("script_contradictions", f"WITH {FIXTURE} SELECT k AS content, t + 1 AS id, z.a AS voice_term, z.b AS shown_term, CASE WHEN vs THEN 'warn' ELSE 'fail' END AS level FROM p, (SELECT unnest({'[' + ', '.join(f'struct_pack(a := {a!r}, b := {b!r})' for a, b in R.CONTRADICTIONS) + ']'}) AS z) WHERE contains(low, z.a) AND contains(seen, z.b)")
def _(s, d):
    return R.contradictions(_scenes(s, d), ["content", "id"])
