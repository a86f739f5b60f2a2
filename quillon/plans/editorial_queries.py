"""Queries of research, publishing and timing records, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions.content import feed_item, site_entry
from quillon.functions.text import html_title
from quillon.operators import index, research, timeline, trends
from quillon.plans.text_queries import NORM
from quillon.plans.twins import registry
from quillon.sources.apis import pointer_files
from quillon.sources.readers import table

Q, S, query = registry()

KINDS = ["primary", "authoritative-secondary", "independent-secondary", "community", ""]


@query("research_brief", f"""WITH n AS (SELECT page_id, norm_url FROM ({NORM.replace('FROM pages', "FROM (SELECT page_id, regexp_replace(url, '[0-9]+', '', 'g') AS url FROM pages)")})),
g AS (SELECT page_id % 4 AS c, page_id, norm_url, {KINDS}[CAST(page_id % 5 + 1 AS INT)] AS kind, CASE WHEN page_id % 3 > 0 THEN DATE '2024-06-01' - CAST(page_id % 40 AS INT) END AS dated FROM n),
o AS (SELECT *, min(page_id) OVER (PARTITION BY c, norm_url) AS f FROM g QUALIFY row_number() OVER (PARTITION BY c, norm_url ORDER BY CASE kind WHEN 'primary' THEN 4 WHEN 'authoritative-secondary' THEN 3 WHEN 'independent-secondary' THEN 2 WHEN 'community' THEN 1 ELSE 0 END DESC, page_id) = 1)
SELECT c AS content_id, CAST(row_number() OVER (PARTITION BY c ORDER BY CASE kind WHEN 'primary' THEN 0 WHEN 'authoritative-secondary' THEN 1 WHEN 'independent-secondary' THEN 2 WHEN 'community' THEN 3 ELSE 99 END, f) AS INT) AS place, norm_url AS url, 't' || page_id AS title, CASE WHEN kind = '' THEN 'cat' ELSE kind END AS source_type, CAST(dated AS VARCHAR) AS published FROM o WHERE dated IS NULL OR dated >= DATE '2024-05-02'""")
def _(s, d):
    k = F.col("page_id")
    src = table(s, d, "pages").select((k % 4).alias("content_id"), k.alias("ordinal"), F.regexp_replace("url", "[0-9]+", "").alias("url"), F.concat(F.lit("t"), k).alias("title"), F.get(F.array(*map(F.lit, KINDS)), (k % 5).cast("int")).alias("source_type"), F.lit("cat").alias("category"), F.when(k % 3 > 0, F.date_sub(F.lit("2024-06-01").cast("date"), (k % 40).cast("int"))).alias("published_at"))
    return research.brief(src, F.lit("2024-06-01").cast("date"), 30).withColumn("published", F.col("published_at").cast("string")).drop("published_at")


@query("document_errors", """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'schemaVersion "9" does not match expected "1.0.0"' WHEN 1 THEN 'Missing required field: contentId' WHEN 2 THEN 'Field "sources" must be of type array, got string' WHEN 3 THEN 'Field "tier" must be one of [standard, deep], got "wild"' WHEN 4 THEN 'sources[1] missing required field: url' ELSE '' END AS errors FROM pages""")
def _(s, d):
    k = F.col("page_id") % 6
    item = '{"url": "u", "title": "t"}'
    doc = F.concat(
        F.lit('{"schemaVersion": "'), F.when(k == 0, "9").otherwise("1.0.0"), F.when(k == 1, '"').otherwise('", "contentId": "c"'), F.lit(', "tier": "'), F.when(k == 3, "wild").otherwise("deep"),
        F.lit('", "sources": '), F.when(k == 2, '"none"').when(k == 4, f'[{item}, {{"title": "t", "url": null}}]').otherwise(f"[{item}]"), F.lit("}"),
    )
    found = research.document_errors(F.try_parse_json(doc), "1.0.0", ["contentId", "sources"], {"sources": "array", "contentId": "string"}, {"tier": ["standard", "deep"]}, ("sources", ["url", "title"]))
    return table(s, d, "pages").select("page_id", F.array_join(found, ";").alias("errors"))


@query("jsonld_errors", """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'Article.headline;Article.image' WHEN 1 THEN 'BreadcrumbList position 3 should be 2' WHEN 2 THEN 'FAQPage.mainEntity' WHEN 3 THEN 'missing @context' WHEN 4 THEN 'document is not an object' ELSE '' END AS errors FROM pages""")
def _(s, d):
    k = F.col("page_id") % 6
    body = F.when(k == 0, '"@type": "Article", "headline": "", "description": "d", "url": "https://x.org", "inLanguage": "en"').when(k == 1, '"@type": "BreadcrumbList", "itemListElement": [{"position": 1}, {"position": 3}]').when(k == 2, '"@type": "FAQPage", "mainEntity": [{}]').otherwise('"@type": "Odd"')
    doc = F.when(k == 4, "[not").otherwise(F.concat(F.lit("{"), F.when(k == 3, "").otherwise('"@context": "https://schema.org", '), body, F.lit("}")))
    return table(s, d, "pages").select("page_id", F.array_join(research.json_ld_errors(F.try_parse_json(doc)), ";").alias("errors"))


SERIES = "CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN p_name WHEN 2 THEN lower(replace(p_name, ' ', '-')) ELSE lower(p_brand) END"


@query("series_errors", f"SELECT p_partkey, concat_ws(';', CASE WHEN {SERIES} = '' THEN 'seriesId is required' WHEN NOT regexp_full_match({SERIES}, '[a-z0-9]+(-[a-z0-9]+)*') THEN 'seriesId must be kebab-case' END, CASE WHEN p_partkey % 6 = 0 THEN 'partNumber is required' WHEN p_size % 9 NOT BETWEEN 1 AND 5 THEN 'partNumber must be an integer 1-5' END, CASE WHEN p_size % 7 NOT BETWEEN 1 AND 5 THEN 'totalParts must be an integer 1-5' END, CASE WHEN p_partkey % 6 > 0 AND p_size % 9 > p_size % 7 THEN 'partNumber must be <= totalParts' END) AS errors FROM part")
def _(s, d):
    k = F.col("p_partkey")
    name = F.when(k % 4 == 1, F.col("p_name")).when(k % 4 == 2, F.lower(F.replace("p_name", F.lit(" "), F.lit("-")))).when(k % 4 == 3, F.lower("p_brand"))
    return table(s, d, "part").select("p_partkey", F.array_join(research.series_errors(name, F.when(k % 6 > 0, F.col("p_size") % 9), F.col("p_size") % 7), ";").alias("errors"))


@query("alert_preview", "SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber % 4 <> 3 AS valid, CASE l_linenumber % 4 WHEN 0 THEN l_partkey % 30 >= 10 WHEN 1 THEN true ELSE false END AS alert, CASE l_linenumber % 4 WHEN 0 THEN CASE WHEN l_partkey % 30 >= 10 THEN 'drop' END WHEN 1 THEN 'lost' END AS kind FROM lineitem")
def _(s, d):
    n, p = F.col("l_linenumber") % 4, F.col("l_partkey")
    before = F.when(n == 3, "x").otherwise("5")
    after = F.when(n == 0, (p % 30 + 5).cast("string")).when(n == 1, " ").otherwise("5")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", research.alert_preview(before, after, 10, True).alias("a")).select("l_orderkey", "l_linenumber", "l_partkey", "a.*")


@query("manifest_update", "SELECT c_nationkey AS run, c_mktsegment AS filename, max(c_custkey) AS size FROM customer WHERE c_custkey % 2 = 1 GROUP BY 1, 2 UNION ALL SELECT c_nationkey, c_mktsegment, min(c_custkey) FROM customer WHERE c_custkey % 2 = 0 AND (c_nationkey, c_mktsegment) NOT IN (SELECT c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 1) GROUP BY 1, 2")
def _(s, d):
    c = table(s, d, "customer").select(F.col("c_nationkey").alias("run"), F.col("c_mktsegment").alias("filename"), "c_custkey")
    old = c.where("c_custkey % 2 = 0").groupBy("run", "filename").agg(F.min("c_custkey").alias("size"))
    return index.record_artifacts(old, c.where("c_custkey % 2 = 1").groupBy("run", "filename").agg(F.max("c_custkey").alias("size")))


@query("error_side_output", "SELECT 'good' AS side, count(*) AS n FROM events WHERE event_type <> 'error' UNION ALL SELECT 'bad', count(*) FROM events WHERE event_type = 'error'")
def _(s, d):
    good, bad = index.split_errors(table(s, d, "events").select("event_id", F.when(F.col("event_type") == "error", "failed").alias("error")), "error")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "n")
    return count(good, "good").union(count(bad, "bad"))


@query("published_export", "SELECT doc_id, left(text, 200) AS content, lang AS status FROM documents WHERE doc_id % 3 = 0")
def _(s, d):
    return table(s, d, "documents").where("doc_id % 3 = 0").select("doc_id", F.left("text", F.lit(200)).alias("content"), F.col("lang").alias("status"))


TYPES = "['unsubscribed', 'opened', 'resubscribed', 'bounced', 'complaint']"


@query("subscription_times", f"""WITH e AS (SELECT user_id AS email, {TYPES}[CAST(event_id % 5 + 1 AS INT)] AS kind, ts FROM events), l AS (SELECT email, arg_max(struct_pack(k := kind, t := ts), struct_pack(t := ts, k := kind)) AS e FROM e WHERE kind <> 'opened' AND email % 3 > 0 GROUP BY email)
SELECT u.email, CAST(CASE WHEN l.email IS NULL THEN TIMESTAMP '2020-01-01' WHEN l.e.k <> 'resubscribed' THEN l.e.t END AS VARCHAR) AS unsubscribed_at FROM (SELECT DISTINCT user_id AS email FROM events) u LEFT JOIN l USING (email)""")
def _(s, d):
    e = table(s, d, "events")
    kinds = F.array(*map(F.lit, ["unsubscribed", "opened", "resubscribed", "bounced", "complaint"]))
    ev = e.where("user_id % 3 > 0").select(F.col("user_id").alias("email"), F.get(kinds, (F.col("event_id") % 5).cast("int")).alias("type"), F.col("ts").alias("at"))
    subs = e.select(F.col("user_id").alias("email")).distinct().withColumn("unsubscribed_at", F.lit("2020-01-01").cast("timestamp_ntz"))
    return index.subscription_times(subs, ev).withColumn("unsubscribed_at", F.col("unsubscribed_at").cast("string"))


@query("field_patch", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Z' END ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    return index.patch_field(o, "o_orderkey", "o_orderstatus", o.where("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "Z").alias("value")))


@query("single_settings", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 5 = 0")
def _(s, d):
    return index.only_one(table(s, d, "customer").where("c_custkey % 5 = 0").select("c_custkey", "c_name"), ["c_custkey"])


@query("scene_timeline_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, o_orderdate AS offset_at FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def _(s, d):
    side = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("offset_at"))
    return index.lookup_or_fail(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), side, "l_orderkey", "offset_at")


MEDIA = "(SELECT l_orderkey AS content, l_linenumber AS scene, CASE WHEN any_value(l_linenumber) % 3 > 0 THEN 'image' END AS media_type, CASE WHEN any_value(l_linenumber) % 3 = 1 THEN 'a' WHEN any_value(l_linenumber) % 3 = 2 THEN 'b' END AS media_path FROM lineitem GROUP BY 1, 2)"
PATCH = "(SELECT l_orderkey AS content, l_linenumber + l_orderkey % 2 * 7 AS scene, CASE WHEN l_linenumber % 4 = 0 THEN 'unassigned' ELSE 'assigned' END AS status FROM lineitem GROUP BY l_orderkey, l_linenumber)"


@query("patch_receipts", f"""SELECT content, count(*) FILTER (f = 'added') AS added, 0::BIGINT AS replaced, count(*) FILTER (f = 'already') AS already, count(*) FILTER (f = 'conflict') AS conflicts, count(*) FILTER (f = 'missing') AS missing, count(*) FILTER (f = 'skipped') AS skipped FROM
(SELECT p.content, CASE WHEN status <> 'assigned' THEN 'skipped' WHEN m.content IS NULL THEN 'missing' WHEN media_path IS NULL THEN 'added' WHEN media_path = 'a' THEN 'already' ELSE 'conflict' END AS f FROM {PATCH} p LEFT JOIN {MEDIA} m USING (content, scene)) GROUP BY content""")
def _(s, d):
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("content"), F.col("l_linenumber").alias("scene")).distinct()
    n = F.col("scene")
    media = li.select("content", "scene", F.when(n % 3 > 0, "image").alias("media_type"), F.when(n % 3 == 1, "a").when(n % 3 == 2, "b").alias("media_path"))
    patches = li.select("content", (n + F.col("content") % 2 * 7).alias("scene"), n.alias("ordinal"), F.when(n % 4 == 0, "unassigned").otherwise("assigned").alias("status"), F.lit("image").alias("media_type"), F.lit("a").alias("media_path"))
    return index.apply_media(media, patches)[1]


@query("patched_scenes", f"SELECT m.content, m.scene, CASE WHEN p.content IS NOT NULL AND media_path IS DISTINCT FROM 'a' THEN 'image' ELSE media_type END AS media_type, CASE WHEN p.content IS NOT NULL THEN 'a' ELSE media_path END AS media_path FROM {MEDIA} m LEFT JOIN (SELECT * FROM {PATCH} WHERE status = 'assigned') p USING (content, scene)")
def _(s, d):
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("content"), F.col("l_linenumber").alias("scene")).distinct()
    n = F.col("scene")
    media = li.select("content", "scene", F.when(n % 3 > 0, "image").alias("media_type"), F.when(n % 3 == 1, "a").when(n % 3 == 2, "b").alias("media_path"))
    patches = li.select("content", (n + F.col("content") % 2 * 7).alias("scene"), n.alias("ordinal"), F.when(n % 4 == 0, "unassigned").otherwise("assigned").alias("status"), F.lit("image").alias("media_type"), F.lit("a").alias("media_path"))
    return index.apply_media(media, patches, force=True)[0]


@query("feed_items_full", "SELECT page_id, '<item><title>' || e || '</title><link>https://x.org/' || page_id || '</link><guid>https://x.org/' || page_id || '</guid><pubDate>' || strftime(DATE '2024-01-01' + CAST(page_id % 300 AS INT), '%a, %d %b %Y 00:00:00 GMT') || '</pubDate></item>' AS item FROM (SELECT page_id, replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&apos;') AS e FROM (SELECT page_id, regexp_extract(html, '<title[^>]*>([^<]+)</title>', 1, 'i') AS t FROM pages)) ORDER BY page_id DESC LIMIT 50")
def _(s, d):
    p = table(s, d, "pages").orderBy(F.desc("page_id")).limit(50)
    link = F.concat(F.lit("https://x.org/"), "page_id")
    return p.select("page_id", feed_item(html_title(F.col("html")), link, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 300).cast("int"))).alias("item"))


@query("sitemap", "SELECT page_id, '<url><loc>https://x.org/' || page_id || '</loc><lastmod>' || CAST(DATE '2024-01-01' + CAST(page_id % 300 AS INT) AS VARCHAR) || '</lastmod></url>' AS entry FROM pages ORDER BY page_id DESC LIMIT 500")
def _(s, d):
    p = table(s, d, "pages").orderBy(F.desc("page_id")).limit(500)
    return p.select("page_id", site_entry(F.concat(F.lit("https://x.org/"), "page_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 300).cast("int"))).alias("entry"))


@query("word_sync", """WITH w AS (SELECT conv_id * 100 + turn AS g, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM conversations)
SELECT g, m IS NULL AS matches, m AS first_mismatch, coalesce(round(max(CASE WHEN i < coalesce(m, 1 << 30) THEN (i % 4) * 0.05 END), 6), 0.0) AS max_deviation, count(*) FILTER (i < coalesce(m, 1 << 30) AND i % 4 = 3) AS offenders
FROM (SELECT *, min(CASE WHEN (g + i) % 37 = 5 THEN i END) OVER (PARTITION BY g) AS m FROM w) GROUP BY g, m""")
def _(s, d):
    w = table(s, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("g"), F.posexplode(F.split("text", " ")).alias("i", "expected"))
    t = F.col("i") * 0.4
    said = w.select("g", "i", F.when((F.col("g") + F.col("i")) % 37 == 5, "other").otherwise(F.col("expected")).alias("rendered"), (t + F.col("i") % 4 * 0.05).alias("onset"))
    pairs = w.withColumn("start", t).join(said, ["g", "i"], "full_outer")
    return timeline.word_sync(pairs, "g", 0.12).withColumn("max_deviation", F.round("max_deviation", 6))


@query("gap_violations", """WITH c AS (SELECT conv_id, turn, turn * 3.0 AS a, turn * 3.0 + 3.0 - CASE turn % 4 WHEN 0 THEN 2 / 30.0 WHEN 1 THEN 0.7 ELSE 0.2 END AS b FROM conversations), g AS (SELECT conv_id, turn, a, a - lag(b) OVER (PARTITION BY conv_id ORDER BY a) AS gap, lag(turn) OVER (PARTITION BY conv_id ORDER BY a) AS pt FROM c)
SELECT conv_id, round(gap, 6) AS gap, a AS start FROM g WHERE gap IS NOT NULL AND abs(gap - 2 / 30.0) > 0.011 AND gap < 0.489 AND NOT (turn % 6 = 3 AND EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = g.conv_id AND x.turn = g.turn))""")
def _(s, d):
    t = F.col("turn").cast("double") * 3.0
    hole = F.when(F.col("turn") % 4 == 0, 2 / 30).when(F.col("turn") % 4 == 1, 0.7).otherwise(0.2)
    c = table(s, d, "conversations")
    cues = c.select("conv_id", t.alias("start"), (t + 3.0 - hole).alias("end"))
    return timeline.gap_violations(cues, c.where("turn % 6 = 3").select("conv_id", (t - 0.1).alias("at")), "conv_id").select("conv_id", F.round("gap", 6).alias("gap"), "start")


@query("shifted_cues", "SELECT conv_id, turn, turn * 3.0 + CASE WHEN conv_id % 2 = 0 THEN 0.25 ELSE 0 END AS start, turn * 3.0 + 1 + CASE WHEN conv_id % 2 = 0 THEN 0.25 ELSE 0 END AS \"end\", turn * 3.0 + 0.5 + CASE WHEN conv_id % 2 = 0 THEN 0.25 ELSE 0 END AS onset FROM conversations")
def _(s, d):
    t = F.col("turn").cast("double") * 3.0
    cues = table(s, d, "conversations").select("conv_id", "turn", t.alias("start"), (t + 1).alias("end"), F.array(F.struct(F.lit("w").alias("text"), (t + 0.5).alias("onset"))).alias("words"))
    drift = table(s, d, "conversations").where("conv_id % 2 = 0").select("conv_id").distinct().withColumn("drift", F.lit(0.25))
    return timeline.shift_cues(cues, drift, ["conv_id"]).select("conv_id", "turn", "start", "end", F.get("words", F.lit(0))["onset"].alias("onset"))


@query("audio_sync", "SELECT conv_id, count(*) AS checked, count(*) FILTER (turn % 5 = 3) AS errors, count(*) FILTER (turn % 5 = 3) = 0 AS passed FROM conversations GROUP BY conv_id")
def _(s, d):
    m = table(s, d, "conversations").select("conv_id", F.col("turn").cast("double").alias("expected"), (F.col("turn") + F.when(F.col("turn") % 5 == 3, 0.09).otherwise(0.08)).alias("measured"))
    return timeline.audio_sync(m, ["conv_id"])


@query("clip_frames", "SELECT conv_id, turn, CAST(greatest(ceil((length(text) / 15.0 + 0.5) * 30 - 1e-6), 1) AS BIGINT) AS frames FROM conversations")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", timeline.clip_frames(F.length("text") / 15.0).alias("frames"))


@query("week_plans", """WITH t AS (SELECT c_nationkey AS plan, {0} AS p, c_custkey, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS n FROM customer WHERE c_mktsegment IN ('HOUSEHOLD', 'MACHINERY', 'BUILDING')),
r AS (SELECT plan, {1} AS pillar, c_custkey AS topic, row_number() OVER (PARTITION BY plan ORDER BY CASE WHEN n > CASE p WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END THEN 1 ELSE 0 END, p, n) AS day FROM t WHERE n <= 7)
SELECT g.plan, CAST(g.day AS INT) AS day, pillar, topic FROM (SELECT plan, unnest(range(1, 8)) AS day FROM (SELECT DISTINCT c_nationkey AS plan FROM customer)) g LEFT JOIN r ON r.plan = g.plan AND r.day = g.day""".format("CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END", "CASE p WHEN 0 THEN 'HOUSEHOLD' WHEN 1 THEN 'MACHINERY' ELSE 'BUILDING' END"))
def _(s, d):
    t = table(s, d, "customer").select(F.col("c_nationkey").alias("plan"), F.col("c_mktsegment").alias("pillar"), F.col("c_custkey").alias("ordinal"), F.col("c_custkey").alias("topic"))
    return timeline.week_plan(t, {"HOUSEHOLD": 0.4, "MACHINERY": 0.3, "BUILDING": 0.2})


@query("keyword_snapshots", "SELECT n_nationkey, c_mktsegment AS database, n_name, max(c_acctbal) AS volume FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2, 3")
def _(s, d):
    tracked = table(s, d, "nation").join(table(s, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("database")).distinct(), "n_nationkey").select("n_nationkey", "database", F.upper("n_name").alias("keyword"), "n_name")
    metric = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("c_mktsegment").alias("database"), F.lower("n_name").alias("keyword")).agg(F.max("c_acctbal").alias("volume"))
    return tracked.withColumn("keyword", F.lower("keyword")).join(metric, ["database", "keyword"]).select("n_nationkey", "database", "n_name", "volume")


@query("group_members", "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS members FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey % 3 > 0 AND r_regionkey <> 2 GROUP BY r_name")
def _(s, d):
    n = table(s, d, "nation").where("n_nationkey % 3 > 0 AND n_regionkey <> 2").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_name")).alias("m"))
    return table(s, d, "region").join(n, "r_regionkey").select("r_name", F.array_join("m", ",").alias("members"))


@query("hash_pick_fallback", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'calm' ELSE ['calm', 'fast', 'odd'][CAST(c_custkey % 3 + 1 AS INT)] END AS pick FROM customer WHERE c_custkey % 2 = 0")
def _(s, d):
    pool = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(m).alias("mood")) for n, m in (("calm", "BUILDING"), ("fast", "x"), ("odd", "y"))])
    mine = F.filter(pool, lambda p: p["mood"] == F.col("c_mktsegment"))
    use = F.when(F.size(mine) > 0, mine).otherwise(pool)
    return table(s, d, "customer").where("c_custkey % 2 = 0").select("c_custkey", F.get(use, (F.col("c_custkey") % F.size(use)).cast("int"))["name"].alias("pick"))


@query("vendor_prices", "SELECT p_partkey, v.n AS vendor, round(CASE WHEN v.n = 'us' THEN p_retailprice ELSE p_retailprice * 2 / 6.78 END, 4) AS usd FROM part, (VALUES ('us'), ('cn')) v(n) WHERE v.n = 'us' OR p_size > 10 ORDER BY usd DESC, p_partkey")
def _(s, d):
    price = lambda n, p, over: F.struct(F.lit(n).alias("vendor"), p.alias("price"), F.lit(over).alias("overseas"))
    vendors = F.array(price("us", F.col("p_retailprice"), True), price("cn", F.when(F.col("p_size") > 10, F.col("p_retailprice") * 2).otherwise(0.0), False))
    v = table(s, d, "part").select("p_partkey", F.explode(vendors).alias("v")).where("v.price > 0")
    usd = F.when(F.col("v.overseas"), F.col("v.price")).otherwise(F.col("v.price") / 6.78)
    return v.select("p_partkey", F.col("v.vendor").alias("vendor"), F.round(usd, 4).alias("usd")).orderBy(F.desc("usd"), "p_partkey")


@query("history_search", "SELECT event_id, user_id FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS visits, ts FROM events WHERE contains(event_type, 'c') AND contains(event_type, 'k') AND ts >= TIMESTAMP '2024-01-20') ORDER BY visits DESC, ts DESC, event_id LIMIT 20")
def _(s, d):
    # times as microseconds since 1601, as a browser's history keeps them
    e = table(s, d, "events").select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) + 11644473600000000).alias("at"))
    e = e.withColumn("ts", F.timestamp_micros(F.col("at") - 11644473600000000))
    hit = e.where(F.forall(F.array(F.lit("c"), F.lit("k")), lambda k: F.contains(F.col("event_type"), k)) & (F.col("ts") >= F.lit("2024-01-20").cast("timestamp")))
    return hit.withColumn("visits", F.count(F.lit(1)).over(Window.partitionBy("user_id"))).orderBy(F.desc("visits"), F.desc("ts"), "event_id").limit(20).select("event_id", "user_id")


@query("cached_images", "SELECT doc_id, 'https://i.org/' || doc_id AS image FROM documents WHERE contains(lower(text), 'the') AND doc_id % 4 > 0")
def _(s, d):
    from quillon.functions.content import any_substring, not_content_image

    k = F.col("doc_id")
    image = F.when(k % 4 == 0, F.concat(F.lit("https://i.org/logo"), k)).otherwise(F.concat(F.lit("https://i.org/"), k))
    topic = F.struct(F.col("text").alias("title"), F.array(image, F.lit("")).alias("images"))
    cache = table(s, d, "documents").select("doc_id", F.create_map("lang", F.array(topic)).alias("topics"))
    t = cache.select("doc_id", F.explode(F.flatten(F.map_values("topics"))).alias("t")).where(any_substring(F.col("t.title"), ["THE"]))
    return t.select("doc_id", F.explode("t.images").alias("image")).where(~not_content_image(F.col("image")))


@query("claim_ids", "SELECT p_partkey, unnest(list_filter(string_split(p_name, ' '), lambda w: w <> '')) AS claim FROM part WHERE p_partkey % 3 > 0")
def _(s, d):
    ids = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.array(F.lit(""), F.lit(None).cast("string")), F.split("p_name", " ")))
    return table(s, d, "part").select("p_partkey", F.explode(F.filter(ids, lambda x: F.length(x) > 0)).alias("claim"))


@query("pointer_files", "SELECT page_id FROM pages WHERE page_id % 3 = 0 AND NOT starts_with(html, 'version https://git-lfs') AND page_id % 5 <> 0")
def _(s, d):
    k = F.col("page_id")
    files = table(s, d, "pages").select("page_id", F.concat("url", F.when(k % 3 == 0, ".MP4").otherwise(".txt")).alias("name"), F.when(k % 5 != 0, F.col("html")).otherwise(F.concat(F.lit("version https://git-lfs.github.com/spec/v1\noid "), F.md5("html"))).alias("content"))
    return pointer_files(files, s.createDataFrame([("mp4",), ("png",)], "ext string")).select("page_id")


@query("paired_values", "SELECT p_partkey, p_size AS left_value, p_size + 1 AS right_value FROM part WHERE p_partkey % 4 = 0")
def _(s, d):
    n = F.col("p_size")
    one = F.concat(F.lit("const WIDTH = "), n, F.lit(";"))
    two = F.concat(F.lit("width: "), F.when(F.col("p_partkey") % 4 == 0, n + 1).otherwise(n), F.lit("px"))
    got = table(s, d, "part").select("p_partkey", F.regexp_extract(one, r"WIDTH = (\d+)", 1).cast("int").alias("left_value"), F.regexp_extract(two, r"width: (\d+)px", 1).cast("int").alias("right_value"))
    return got.where("left_value <> right_value")


@query("topic_windows", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 2 DAY")
def _(s, d):
    # dates as texts; those that can't be read count as undated and go
    e = table(s, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("published"))
    return trends.fresh(e, F.try_to_timestamp("published"), F.lit("2024-01-30").cast("timestamp"), 2).select("event_id")


@query("sql_match_content", """WITH m AS (SELECT 3 AS kind, a.vec_id, a.label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 7) b WHERE a.label = 3
UNION ALL SELECT NULL, a.vec_id, a.label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 7) b)
SELECT kind, vec_id, label, round(s, 6) AS similarity FROM m WHERE s > 0.01 QUALIFY row_number() OVER (PARTITION BY kind ORDER BY round(s, 6) DESC, vec_id) <= 8""")
def _(s, d):
    from quillon.operators import vector

    table(s, d, "embeddings").createOrReplaceTempView("embedding_index")
    vector.register(s, "embedding_index")
    # the one vector goes in as a parameter: laterally, the function would be held for every distinct vector of the index before the filter of the outer rows
    probe = [r.v for r in s.sql("SELECT CAST(embedding AS ARRAY<DOUBLE>) AS v FROM embedding_index WHERE vec_id = 7 LIMIT 1").collect()]
    vec = F.array(*map(F.lit, probe[0])) if probe and probe[0] else F.lit(None).cast("array<double>")
    one = lambda kind: f"SELECT CAST({kind} AS INT) AS kind, * FROM match_content(:vec, {kind}, 0.01D, 8)"
    return s.sql(f"{one(3)} UNION ALL {one('CAST(NULL AS INT)')}", args={"vec": vec})


@query("sql_has_role", "SELECT DISTINCT user_id, EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error' AND x.value > 95) AS admin FROM events e")
def _(s, d):
    from quillon.operators import vector

    e = table(s, d, "events")
    e.where("value > 95").selectExpr("user_id", "event_type AS role").createOrReplaceTempView("user_roles")
    table(s, d, "embeddings").createOrReplaceTempView("embedding_index")
    vector.register(s, "embedding_index", "user_roles")
    e.select("user_id").distinct().createOrReplaceTempView("some_users")
    return s.sql("SELECT user_id, has_role(user_id, 'error') AS admin FROM some_users")


@query("json_paths", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'array' WHEN 1 THEN 'object' ELSE 'string' END AS kind, CASE WHEN event_id % 3 = 0 THEN 2 END AS size, CASE WHEN event_id % 3 = 1 THEN event_type END AS inner_value FROM events")
def _(s, d):
    k = F.col("event_id") % 3
    raw = F.concat(F.lit('{"topics": '), F.when(k == 0, '["a", "b"]').when(k == 1, F.concat(F.lit('{"x": "'), "event_type", F.lit('"}'))).otherwise('"plain"'), F.lit("}"))
    doc = F.parse_json(raw)
    kind = F.lower(F.regexp_extract(F.schema_of_variant(F.try_variant_get(doc, "$.topics", "variant")), "^([A-Z]+)", 1))
    return table(s, d, "events").select("event_id", kind.alias("kind"), F.json_array_length(F.when(k == 0, F.get_json_object(raw, "$.topics"))).alias("size"), F.try_variant_get(doc, "$.topics.x", "string").alias("inner_value"))


@query("nulls_first", "SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN n_chars END AS n FROM documents ORDER BY n DESC NULLS FIRST, doc_id LIMIT 100")
def _(s, d):
    n = F.when(F.col("doc_id") % 4 > 0, F.col("n_chars"))
    return table(s, d, "documents").select("doc_id", n.alias("n")).orderBy(F.desc_nulls_first("n"), "doc_id").limit(100)


@query("bookmark_search", "SELECT n_nationkey AS id, 'bar/' || r_name || '/' || n_name AS path FROM nation JOIN region ON r_regionkey = n_regionkey WHERE contains(lower(r_name || n_name), 'a') AND contains(lower(n_name), '1')")
def _(s, d):
    from quillon.operators.analytics import descend

    n, r = table(s, d, "nation"), table(s, d, "region")
    edges = r.select(F.lit("bar").alias("parent"), F.col("r_name").alias("child")).union(n.join(r, F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "n_name"))
    tree = descend(edges, s.createDataFrame([("bar",)], "id string")).select("id", F.array_join("path", "/").alias("path"))
    marks = tree.join(n.select(F.col("n_name").alias("id"), "n_nationkey", "n_regionkey"), "id")
    hay = F.lower(F.col("path"))
    return marks.where(F.contains(F.substring_index(hay, "/", -2), F.lit("a")) & F.contains(F.lower("id"), F.lit("1"))).select(F.col("n_nationkey").alias("id"), "path")


@query("since_times", "SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN TIMESTAMP '2024-06-01' - INTERVAL 1 DAY * p_size WHEN 1 THEN TIMESTAMP '2024-06-01' - INTERVAL 1 HOUR * p_size WHEN 2 THEN TIMESTAMP '2024-05-03' END AS VARCHAR) AS since FROM part")
def _(s, d):
    from quillon.functions.media import since_time

    k, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(n, F.lit("d"))).when(k == 1, F.concat(n, F.lit("h"))).when(k == 2, "2024-05-03").otherwise("soon")
    return table(s, d, "part").select("p_partkey", since_time(text, F.lit("2024-06-01").cast("timestamp")).cast("string").alias("since"))
