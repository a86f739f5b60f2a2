"""Queries of scripts, subtitles, patches and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import media as M
from quillon.operators import rules, timeline
from quillon.sources.readers import table
from quillon.sources.subtitles import karaoke_text, karaoke_words, parse_subtitles, subtitle_line
from quillon.streaming import jobs

Q: dict = {}
S: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


@query("url_slugs", r"""WITH a AS (SELECT page_id, trim(lower(regexp_replace(regexp_replace(regexp_replace(repeat(url || '/', page_id % 6 + 1), '^[a-zA-Z]+://', ''), '[?#].*$', ''), '[^A-Za-z0-9]+', '-', 'g')), '-') AS s FROM pages),
b AS (SELECT *, left(s, 100) AS cut FROM a)
SELECT page_id, CASE WHEN length(s) <= 100 THEN s WHEN length(cut) - instr(reverse(cut), '-') > 50 THEN left(cut, length(cut) - instr(reverse(cut), '-')) ELSE cut END AS slug FROM b""")
def _(s, d):
    return table(s, d, "pages").select("page_id", M.url_slug(F.repeat(F.concat("url", F.lit("/")), (F.col("page_id") % 6 + 1).cast("int"))).alias("slug"))


@query("speech_seconds", r"""SELECT doc_id, round(greatest(len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) / 4.5 + len(regexp_extract_all(text, '[A-Za-z0-9]+')) / 2.8
 + len(regexp_extract_all(text, '[,.;:!?，。；：！？、]')) * 0.15, 0.5), 4) AS seconds FROM documents""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.round(M.speech_seconds(F.col("text")), 4).alias("seconds"))


@query("truncate_captions", r"""SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE CASE WHEN h = '' THEN left(text, 200) ELSE h END || '…' END AS caption
FROM (SELECT doc_id, text, regexp_extract(text, '(?s)^(.{1,200})[ \t\n\r]', 1) AS h FROM documents)""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", M.truncate_at_word(F.col("text"), 200).alias("caption"))


NAMES = "replace(p_name, ' ', '_') || ['.png', '.JPG', '.mp4', '.xyz', ''][p_partkey % 5 + 1]"


@query("media_types", f"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'video/mp4' ELSE 'application/octet-stream' END AS media_type, {NAMES} AS name FROM part""")
def _(s, d):
    ends = F.array(*map(F.lit, [".png", ".JPG", ".mp4", ".xyz", ""]))
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.get(ends, (F.col("p_partkey") % 5).cast("int")))
    return table(s, d, "part").select("p_partkey", M.media_type(name).alias("media_type"), name.alias("name"))


@query("since_parser", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 86400 WHEN 1 THEN p_size * 3600 WHEN 2 THEN p_size * 60 END::BIGINT AS seconds FROM part""")
def _(s, d):
    unit = F.get(F.array(*map(F.lit, "dhmx")), (F.col("p_partkey") % 4).cast("int"))
    return table(s, d, "part").select("p_partkey", M.since_seconds(F.concat(F.col("p_size").cast("string"), unit)).alias("seconds"))


@query("hash_pick", """SELECT c_custkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) % 5 AS pick FROM customer""")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", (M.fnv1a(F.col("c_name")) % 5).alias("pick"))


WIDTHS = "MAP {" + ", ".join("'" + c.replace("'", "''") + f"': {n}" for c, n in M.ADVANCES.items()) + "}"


@query("text_widths", f"SELECT conv_id, turn, list_sum(list_transform(string_split(text, ''), lambda c: coalesce({WIDTHS}[c], 556))) * 60.0 / 1000 AS width FROM conversations")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", M.text_width(F.col("text"), M.ADVANCES, M.ADVANCE, 60.0).alias("width"))


TIMES = "SELECT conv_id, turn, text, turn * 61.337 AS a, turn * 61.337 + 2.5 AS b FROM conversations"


def _times(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", "text", (F.col("turn") * 61.337).alias("a"), (F.col("turn") * 61.337 + 2.5).alias("b"))


def _clock(x: str) -> str:
    c = f"floor({x} * 100 + 0.5)::BIGINT"
    return f"printf('%d:%02d:%02d.%02d', {c} // 360000, {c} // 6000 % 60, {c} // 100 % 60, {c} % 100)"


@query("subtitle_render", f"SELECT conv_id, turn, 'Dialogue: 0,' || {_clock('a')} || ',' || {_clock('b')} || ',Default,,0,0,0,,' || regexp_replace(text, '\\r?\\n', '\\\\N', 'g') AS line FROM ({TIMES})")
def _(s, d):
    return _times(s, d).select("conv_id", "turn", subtitle_line(F.col("a"), F.col("b"), F.col("text")).alias("line"))


@query("subtitle_parse", f"SELECT conv_id, turn, floor(a * 100 + 0.5) / 100 AS start, floor(b * 100 + 0.5) / 100 AS \"end\", replace(text, chr(10), '\\N') AS text, 55::BIGINT AS karaoke_cs FROM ({TIMES})")
def _(s, d):
    text = F.concat(F.lit("{\\k20}"), "text", F.lit("{\\kf35}"))
    return parse_subtitles(_times(s, d).select("conv_id", "turn", subtitle_line(F.col("a"), F.col("b"), text).alias("line")), ["conv_id", "turn"], "line")


KARAOKE = r"""'{\kt0\kf' || (20 + turn) || '}' || role || ' {\kt' || (30 + turn) || '\kf12.5}\{x\} {\kf10}end'"""


@query("karaoke_render", f"SELECT conv_id, turn, {KARAOKE} AS text FROM conversations")
def _(s, d):
    t = F.col("turn")
    word = lambda text, at, end: F.struct(text.alias("text"), at.alias("start"), end.alias("end"))
    words = F.array(word(F.col("role"), F.lit(0.0), 0.2 + t / 100), word(F.lit("{x}"), 0.3 + t / 100, 0.425 + t / 100))
    return table(s, d, "conversations").select("conv_id", "turn", F.concat(karaoke_text(words, F.lit(0.0)), F.lit(" {\\kf10}end")).alias("text"))


@query("karaoke_words", """SELECT conv_id, turn, 0 AS i, role AS text, turn * 61.0 AS onset, (20 + turn) / 100.0 AS fill FROM conversations UNION ALL SELECT conv_id, turn, 1, '{x}', turn * 61.0 + (30 + turn) / 100.0, 0.125 FROM conversations
UNION ALL SELECT conv_id, turn, 2, 'end', turn * 61.0 + (42.5 + turn) / 100.0, 0.1 FROM conversations""")
def _(s, d):
    t = F.col("turn")
    text = F.concat(F.lit("{\\kt0\\kf"), 20 + t, F.lit("}"), F.col("role"), F.lit(" {\\kt"), 30 + t, F.lit("\\kf12.5}\\{x\\} {\\kf10}end"))
    w = table(s, d, "conversations").select("conv_id", "turn", F.posexplode(karaoke_words(text, t * 61.0)).alias("i", "w"))
    return w.select("conv_id", "turn", "i", "w.text", F.round("w.onset", 6).alias("onset"), "w.fill")


SCENES = r"""WITH t AS (SELECT conv_id, turn, text, len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> '')) AS n,
 list_max(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: len(list_filter(regexp_split_to_array(x, '[ \t\n\r]+'), lambda w: w <> '')))) AS b FROM conversations),
v AS (SELECT conv_id, count(*) AS scenes, sum(n)::BIGINT AS words, max(b) AS breath, sum((contains(text, '—'))::INT)::BIGINT AS dashes, arg_min(n, turn) AS hook_words, arg_min(text, turn) AS hook, arg_max(text, turn) AS closer FROM t GROUP BY conv_id),
f AS (SELECT conv_id, 'error' AS level, 'structure' AS category, 'scene_count' AS "check", scenes::VARCHAR AS detail FROM v WHERE scenes NOT BETWEEN 6 AND 10
UNION ALL SELECT conv_id, 'error', 'voice', 'word_count', words::VARCHAR FROM v WHERE words > 180
UNION ALL SELECT conv_id, 'warning', 'voice', 'one_breath', breath::VARCHAR FROM v WHERE breath > 25
UNION ALL SELECT conv_id, 'error', 'style', 'no_em_dashes', dashes::VARCHAR FROM v WHERE dashes > 0
UNION ALL SELECT conv_id, 'warning', 'hook', 'hook_length', hook_words::VARCHAR FROM v WHERE hook_words > 15
UNION ALL SELECT conv_id, 'warning', 'hook', 'no_greeting', left(hook, 20) FROM v WHERE regexp_matches(lower(hook), '^(hi|hello|hey|welcome)\b')
UNION ALL SELECT conv_id, 'warning', 'closer', 'closer_asks', right(closer, 20) FROM v WHERE NOT regexp_matches(closer, '[?!]$')) """


@query("scene_rules", SCENES + 'SELECT conv_id, level, category, "check", detail FROM f')
def _(s, d):
    return rules.findings(rules.scenes(table(s, d, "conversations"), "conv_id", "turn", "text"), ["conv_id"], rules.scene_rules())


@query("scene_verdicts", SCENES + """SELECT conv_id, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings,
 CASE WHEN count(*) FILTER (level = 'error') > 0 THEN 'fail' WHEN count(*) FILTER (level = 'warning') > 0 THEN 'warn' ELSE 'pass' END AS verdict FROM v LEFT JOIN f USING (conv_id) GROUP BY conv_id""")
def _(s, d):
    return rules.verdicts(rules.scenes(table(s, d, "conversations"), "conv_id", "turn", "text"), ["conv_id"], rules.scene_rules())


PAIRS = [("the", "that"), ("open", "closed"), ("an", "die"), ("and", "not")]


@query("contradiction_pairs", "SELECT doc_id, a AS first, b AS second FROM documents JOIN (VALUES " + ", ".join(map(str, PAIRS)) + r") p(a, b) ON contains(lower(text), a) AND contains(lower(text), b) WHERE NOT regexp_matches(lower(text), '\b(vs|versus)\b')")
def _(s, d):
    return rules.term_pairs(table(s, d, "documents"), ["doc_id"], "text", PAIRS)


PATCHES = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS before, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus ELSE 'Z' END AS after FROM orders WHERE o_orderkey % 2 = 0"


@query("patch_states", f"""SELECT k AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'missing' WHEN o_orderstatus IS NOT DISTINCT FROM after THEN 'already-applied' WHEN o_orderstatus IS DISTINCT FROM before THEN 'conflict' ELSE 'none' END AS state
FROM ({PATCHES}) p LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 7 <> 0) o ON o.o_orderkey = k""")
def _(s, d):
    o, k = table(s, d, "orders"), F.col("o_orderkey")
    patches = o.where(k % 2 == 0).select("o_orderkey", F.when(k % 3 == 0, "X").otherwise(F.col("o_orderstatus")).alias("before"), F.when(k % 5 == 0, F.col("o_orderstatus")).otherwise("Z").alias("after"))
    return rules.patch_states(o.where(k % 7 != 0), patches, "o_orderkey", "o_orderstatus")


@query("source_drift", "SELECT k AS p_partkey, a.v AS left_value, b.v AS right_value FROM (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 9 <> 0) a FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_partkey % 11 <> 0) b USING (k) WHERE a.v IS DISTINCT FROM b.v")
def _(s, d):
    p, k = table(s, d, "part"), F.col("p_partkey")
    other = p.where(k % 11 != 0).select("p_partkey", F.when(k % 4 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"))
    return rules.drift(p.where(k % 9 != 0), other, "p_partkey", "p_size")


CUES = "SELECT conv_id, turn, turn * 3.0 AS a, turn * 3.0 + (length(text) % 40) / 10.0 AS b FROM conversations"


def _cues(s, d):
    t = F.col("turn").cast("double") * 3.0
    return table(s, d, "conversations").select("conv_id", "turn", t.alias("a"), (t + F.length("text") % 40 / 10.0).alias("b"))


@query("cue_layout", f"""SELECT conv_id, turn, round(CASE WHEN n - b < 0 THEN n WHEN n - b > 0 AND n - b < 0.6 THEN greatest(b, n - 2 / 30.0) ELSE b END, 6) AS shown_end
FROM (SELECT conv_id, turn, a::DOUBLE AS a, b::DOUBLE AS b, lead(a) OVER (PARTITION BY conv_id ORDER BY a, b)::DOUBLE AS n FROM ({CUES}))""")
def _(s, d):
    return timeline.layout(_cues(s, d), "conv_id", "a", "b").select("conv_id", "turn", F.round("shown_end", 6).alias("shown_end"))


@query("gaps_at_boundaries", f"""WITH c AS ({CUES}), g AS (SELECT conv_id, turn, b AS a, lead(a) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM c)
SELECT conv_id, turn FROM g WHERE EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = g.conv_id AND x.turn * 4 BETWEEN g.a - 0.25 AND g.b + 0.25)""")
def _(s, d):
    from pyspark.sql import Window

    g = _cues(s, d).select("conv_id", "turn", F.col("b").alias("a"), F.lead("a").over(Window.partitionBy("conv_id").orderBy("turn")).alias("b"))
    marks = table(s, d, "conversations").select("conv_id", (F.col("turn") * 4).alias("at"))
    return timeline.gaps_at(g, marks, "conv_id", "a", "b", "at", 0.25).select("conv_id", "turn")


@query("position_contiguity", "SELECT conv_id, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS contiguous FROM conversations WHERE (conv_id + turn) % 17 <> 5 GROUP BY conv_id")
def _(s, d):
    return timeline.contiguous(table(s, d, "conversations").where("(conv_id + turn) % 17 <> 5"), "conv_id", "turn")


@query("page_url_scan", r"""SELECT page_id, count(*) AS links, count(DISTINCT u) AS urls FROM (SELECT page_id, unnest(regexp_extract_all(html, 'https?://[^ \t\n\r"<>]+')) AS u FROM pages) GROUP BY page_id""")
def _(s, d):
    u = table(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'https?://[^ \t\n\r"<>]+'), 0)).alias("u"))
    return u.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("u").alias("urls"))


@query("dispatch_status", """SELECT user_id, sent, failed, CASE WHEN sent = 0 THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'sent' END AS status
FROM (SELECT user_id, count(*) FILTER (event_type <> 'error') AS sent, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY user_id)""")
def _(s, d):
    bad = F.count_if(F.col("event_type") == "error")
    out = table(s, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("sent"), bad.alias("failed"))
    return out.withColumn("status", F.when(F.col("sent") == 0, "failed").when(F.col("failed") > 0, "partial").otherwise("sent"))


@query("reading_progress", "SELECT l_orderkey, l_linenumber, least(100.0, greatest(0.0, 100 * (l_quantity - 5) / 40.0)) AS pct FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", M.percentage(F.col("l_quantity") - 5, F.lit(40.0)).alias("pct"))


@query("stream_latest", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _(s, d):
    events = jobs.table_stream(s, d, "events").select("user_id", "event_id", "ts", "value")
    return jobs.upsert_stream(events, ["user_id"], [F.desc("ts"), F.desc("event_id")], "latest").drop("ts")


@query("stream_window_counts", """SELECT window_start, event_type, n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2)
WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def _(s, d):
    return jobs.run(jobs.window_counts(jobs.table_stream(s, d, "events"), "ts", "event_type", "1 hour", "10 minutes"), "windows").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_first_within", "SELECT DISTINCT user_id, event_type FROM events")
def _(s, d):
    return jobs.run(jobs.first_within(jobs.table_stream(s, d, "events").select("ts", "user_id", "event_type"), "ts", ["user_id", "event_type"], "10 minutes"), "first").select("user_id", "event_type")


@query("stream_count_and_last", "SELECT user_id, count(*) AS n, arg_max(value, ts) AS last FROM events GROUP BY user_id")
def _(s, d):
    return jobs.run(jobs.count_and_last(jobs.table_stream(s, d, "events"), "user_id", "ts", F.col("value")), "last")
