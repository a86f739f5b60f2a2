"""Queries of landed payloads: made of the tables' columns as a service would answer, read back, and told by SQL from the columns alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.plans.twins import registry
from quillon.sources import apis
from quillon.sources.readers import table

Q, S, query = registry()


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def _obj(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _turns(s, d):
    return table(s, d, "conversations").withColumn("head", F.col("text"))


TURNS = "(SELECT *, text AS head FROM conversations)"
ISO_SQL = "strftime(make_timestamp({} * 1000000), '%Y-%m-%dT%H:%M:%S.%gZ')"


@query("source_reddit", f"""SELECT conv_id, turn, 0 AS i, head AS title, 'https://reddit.com/r/' || conv_id AS url, role AS author, {ISO_SQL.format('(1700000000 + conv_id * 1000 + turn)')} AS published FROM {TURNS}
UNION ALL SELECT conv_id, turn, 1, '', 'https://reddit.com', role, '' FROM {TURNS}""")
def _(s, d):
    full = _obj(data=_obj(title=F.col("head"), permalink=F.concat(F.lit("/r/"), "conv_id"), author=F.col("role"), created_utc=(F.lit(1700000000) + F.col("conv_id") * 1000 + F.col("turn")).cast("double")))
    bare = _obj(data=_obj(title=F.lit(None).cast("string"), permalink=F.lit(None).cast("string"), author=F.col("role"), created_utc=F.lit(None).cast("double")))
    return apis.reddit_posts(_turns(s, d).withColumn("p", _json(data=_obj(children=F.array(full, bare)))), ["conv_id", "turn"], "p")


@query("source_hn", f"SELECT conv_id, turn, 0 AS i, head AS title, CASE WHEN turn % 2 = 0 THEN 'https://x.org/' || conv_id ELSE 'https://news.ycombinator.com/item?id=' || (conv_id * 10 + turn) END AS url, role AS author, CASE WHEN conv_id % 3 = 0 THEN '' ELSE {ISO_SQL.format('(1600000000 + conv_id)')} END AS published FROM {TURNS}")
def _(s, d):
    hit = _obj(title=F.col("head"), url=F.when(F.col("turn") % 2 == 0, F.concat(F.lit("https://x.org/"), "conv_id")), objectID=(F.col("conv_id") * 10 + F.col("turn")).cast("string"), author=F.col("role"), created_at_i=F.when(F.col("conv_id") % 3 != 0, F.lit(1600000000) + F.col("conv_id")))
    return apis.hn_hits(_turns(s, d).withColumn("p", _json(hits=F.array(hit))), ["conv_id", "turn"], "p")


@query("source_repositories", "SELECT p_partkey, 0 AS i, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '/' || p_name ELSE p_name END AS title, 'https://g.org/' || p_partkey AS url, coalesce(CASE WHEN p_partkey % 5 <> 0 THEN left(repeat(p_name || ' ', 40), 200) END, '') AS snippet FROM part")
def _(s, d):
    item = _obj(full_name=F.when(F.col("p_partkey") % 2 == 0, F.concat("p_brand", F.lit("/"), "p_name")), name=F.col("p_name"), html_url=F.concat(F.lit("https://g.org/"), "p_partkey"), description=F.when(F.col("p_partkey") % 5 != 0, F.repeat(F.concat("p_name", F.lit(" ")), F.lit(40))))
    return apis.repositories(table(s, d, "part").withColumn("p", _json(items=F.array(item))), ["p_partkey"], "p")


@query("source_works", r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda x: x <> '') AS w FROM documents),
u AS (SELECT doc_id, x, min(i) AS i FROM (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM w) GROUP BY 1, 2)
SELECT d.doc_id, 0 AS i, d.lang AS title, CASE WHEN d.doc_id % 2 = 0 THEN 'https://doi.org/' || d.doc_id ELSE 'https://w.org/' || d.doc_id END AS url, left(coalesce(t, ''), 200) AS snippet, '2024-01-02' AS published
FROM documents d LEFT JOIN (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM u GROUP BY doc_id) USING (doc_id)""")
def _(s, d):
    docs = table(s, d, "documents")
    words = F.filter(F.split("text", "[^A-Za-z]+"), lambda x: x != "")
    rows, places = docs.withColumn("places", apis.inverted_index(words)), F.coalesce("places", F.create_map().cast("map<string, array<int>>"))
    work = _obj(title=F.lit(None).cast("string"), display_name=F.col("lang"), doi=F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://doi.org/"), "doc_id")), id=F.concat(F.lit("https://w.org/"), "doc_id"), publication_date=F.lit("2024-01-02"), abstract_inverted_index=places)
    return apis.works(rows.withColumn("p", _json(results=F.array(work))), ["doc_id"], "p")


@query("source_rss", r"""SELECT page_id, 0 AS i, 'Tom & "Jo" ' || page_id AS title, url, left(repeat('a b ', 60), 200) AS snippet, '2024-05-01' AS published FROM pages WHERE page_id % 3 <> 0""")
def _(s, d):
    x = F.concat(
        F.lit("<rss><item><title><![CDATA[Tom &amp; <b>&quot;Jo&quot;</b>  "), "page_id", F.lit("]]></title><link>"), F.when(F.col("page_id") % 3 != 0, F.replace("url", F.lit("&"), F.lit("&amp;"))).otherwise(""),
        F.lit("</link><description>"), F.repeat(F.lit("a <i>b</i>\n"), F.lit(60)), F.lit("</description><pubDate>2024-05-01</pubDate></item><item><title>no link</title></item></rss>"),
    )
    return apis.rss_items(table(s, d, "pages").withColumn("x", x), ["page_id"], "x")


@query("source_atom", "SELECT page_id, 0 AS i, 'A title ' || page_id AS title, CASE WHEN page_id % 2 = 0 THEN url ELSE 'urn:' || page_id END AS url, left(repeat('s ', 150), 200) AS snippet, '2024-02-03T00:00:00Z' AS published FROM pages")
def _(s, d):
    link = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<link rel="alternate" type="text/html" href="'), "url", F.lit('"/>'))).otherwise('<link rel="self" href="x"/>')
    x = F.concat(F.lit("<feed><entry><title>\n A title\n"), "page_id", F.lit(" </title><id> urn:"), "page_id", F.lit(" </id>"), link, F.lit("<summary>"), F.repeat(F.lit("s\n"), F.lit(150)), F.lit("</summary><published>2024-02-03T00:00:00Z</published></entry><entry><id>only</id></entry></feed>"))
    return apis.atom_entries(table(s, d, "pages").withColumn("x", x), ["page_id"], "x")


@query("source_numbered_list", r"""WITH t AS (SELECT conv_id, turn, regexp_replace(text, '[*"\n]', '', 'g') AS h FROM conversations)
SELECT conv_id, turn, 0 AS i, left(h, 200) AS title, 'https://a.org/' || conv_id AS url, '@u' || turn AS author FROM t WHERE h <> ''
UNION ALL SELECT conv_id, turn, 1, 'quoted ' || turn, 'https://b.org/x?y=' || turn, '' FROM t WHERE h <> ''""")
def _(s, d):
    t = _turns(s, d).withColumn("head", F.regexp_replace("head", '[*"\n]', "")).where("head <> ''")
    x = F.concat(
        F.lit("Found:\n1. **"), "head", F.lit("** and so on\n   - **URL**: https://a.org/"), "conv_id", F.lit("\n   - **Author**: Some One (@u"), "turn", F.lit(")\n2. \"quoted "), "turn",
        F.lit("\" more\nsee https://b.org/x?y="), "turn", F.lit(" or https://c.org\n3. plain goes with the last\n"),
    )
    return apis.numbered_list(t.withColumn("x", x), ["conv_id", "turn"], "x")


@query("source_photos", "SELECT p_partkey, 0 AS i, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END AS title, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'L' || p_partkey ELSE 'O' || p_partkey END AS url, 'image' AS type, p_size || 'x' || (p_size + 1) AS resolution FROM part")
def _(s, d):
    k = F.col("p_partkey")
    photo = _obj(alt=F.when(k % 3 != 0, F.col("p_name")).otherwise(""), src=_obj(original=F.when(k % 4 > 1, F.concat(F.lit("O"), k)), large=F.when(k % 4 == 1, F.concat(F.lit("L"), k))), width=F.col("p_size"), height=F.col("p_size") + 1)
    return apis.photos(table(s, d, "part").withColumn("p", _json(photos=F.array(photo))), ["p_partkey"], "p", F.col("p_type"))


@query("source_videos", """SELECT o_orderkey, 0 AS i, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority || ' video' ELSE 'kw' END AS title, 'f' || n AS url, 'video' AS type, w || 'x' || 10 AS resolution, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 5) || 's' END AS duration, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS author
FROM orders LEFT JOIN (SELECT l_orderkey, arg_min(l_linenumber, struct_pack(a := -l_partkey, b := l_linenumber)) AS n, max(l_partkey) AS w FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) GROUP BY 1) ON l_orderkey = o_orderkey""")
def _(s, d):
    one = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").agg(F.max("l_partkey").alias("w"))
    file = _obj(n=F.col("l_linenumber"), link=F.concat(F.lit("f"), "l_linenumber"), width=F.col("w"), height=F.lit(10))
    files = one.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(file)).alias("files"))
    k = F.col("o_orderkey")
    video = _obj(user=_obj(name=F.when(k % 2 == 0, F.col("o_orderpriority"))), duration=k % 5, video_files=F.col("files"))
    return apis.videos(table(s, d, "orders").join(files, "o_orderkey", "left").withColumn("p", _json(videos=F.array(video))), ["o_orderkey"], "p", F.lit("kw"))


@query("source_short_videos", f"""SELECT conv_id, turn, 0 AS i, CASE WHEN turn % 3 = 0 THEN '@' || role || ' video ' || (conv_id * 10 + turn) ELSE left(head, 200) END AS title, CASE WHEN turn % 2 = 0 THEN 'https://s.org/' || conv_id ELSE 'https://www.tiktok.com/@' || role || '/video/' || (conv_id * 10 + turn) END AS url, role AS author FROM {TURNS}""")
def _(s, d):
    info = _obj(aweme_id=(F.col("conv_id") * 10 + F.col("turn")).cast("string"), desc=F.when(F.col("turn") % 3 != 0, F.col("head")), share_url=F.when(F.col("turn") % 2 == 0, F.concat(F.lit("https://s.org/"), "conv_id", F.lit("?u=1"))), author=_obj(unique_id=F.col("role")))
    nested, flat = _json(search_item_list=F.array(_obj(aweme_info=info))), _json(data=F.array(info, _obj(aweme_id=F.lit(""), desc=F.lit(""), share_url=F.lit(""), author=_obj(unique_id=F.lit("")))))
    return apis.short_videos(_turns(s, d).withColumn("p", F.when(F.col("conv_id") % 2 == 0, nested).otherwise(flat)), ["conv_id", "turn"], "p")


@query("source_platform_videos", "SELECT event_id, 0 AS i, 'v' || event_id AS id, event_type AS text, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS views, user_id % 7 AS likes, 0 AS shares, 1 AS comments FROM events WHERE event_id % 5 <> 0")
def _(s, d):
    e, k = table(s, d, "events"), F.col("event_id")
    item = _obj(id=F.when(k % 5 != 0, F.concat(F.lit("v"), k)), text=F.col("event_type"), playCount=F.when(k % 3 != 0, F.col("user_id")), diggCount=F.col("user_id") % 7, commentCount=F.lit(1))
    return apis.platform_videos(e.withColumn("p", _json(items=F.array(item))), ["event_id"], "p")


@query("source_platform_comments", f"SELECT conv_id, turn, 0 AS i, head AS text, turn AS likes, role AS author FROM {TURNS} WHERE turn % 2 = 0 AND head <> ''")
def _(s, d):
    item = _obj(text=F.when(F.col("turn") % 2 == 0, F.col("head")), diggCount=F.nullif(F.col("turn"), F.lit(0)), uniqueId=F.col("role"))
    return apis.platform_comments(_turns(s, d).withColumn("p", _json(items=F.array(item))), ["conv_id", "turn"], "p")


@query("source_metric_rows", "SELECT p_partkey, 0 AS i, p_name AS \"name\", CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_size::VARCHAR END AS size FROM part")
def _(s, d):
    size = F.when(F.col("p_partkey") % 4 != 0, F.col("p_size").cast("string"))
    listed = _json(data=_obj(columnNames=F.array(F.lit("name"), F.lit("size")), rows=F.array(F.array("p_name", size))))
    objects = F.to_json(_obj(data=_obj(rows=F.array(_obj(name=F.col("p_name"), size=size)))), {"ignoreNullFields": "false"})
    rows = apis.metric_rows(table(s, d, "part").withColumn("p", F.when(F.col("p_partkey") % 2 == 0, listed).otherwise(objects)), ["p_partkey"], "p")
    return rows.select("p_partkey", "i", F.col("row")["name"].alias("name"), F.col("row")["size"].alias("size"))


@query("media_probe", "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 THEN CAST(floor(p_retailprice * 1000 + 0.5) AS BIGINT) END AS duration_ms, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 THEN floor(CASE WHEN p_partkey % 2 = 0 THEN 30000 / 1001.0 ELSE p_size END * 100 + 0.5) / 100 END AS fps, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 THEN p_partkey % 3 = 0 END AS has_audio, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 THEN CASE WHEN p_partkey % 4 = 0 THEN 90.0 ELSE -90.0 END END AS rotation FROM part")
def _(s, d):
    k = F.col("p_partkey")
    video = _obj(codec_type=F.when(k % 7 != 0, "video").otherwise("data"), r_frame_rate=F.when(k % 2 == 0, "30000/1001").otherwise(F.col("p_size").cast("string")), width=F.lit(1080), tags=_obj(rotate=F.when(k % 4 == 0, "90")), side_data_list=F.array(_obj(rotation=F.lit(-90.0))))
    sound = _obj(codec_type=F.when(k % 3 == 0, "audio").otherwise("subtitle"), r_frame_rate=F.lit("0/0"), width=F.lit(None).cast("int"), tags=_obj(rotate=F.lit(None).cast("string")), side_data_list=F.lit(None).cast("array<struct<rotation: double>>"))
    p = _json(streams=F.array(sound, video), format=_obj(duration=F.when(k % 5 != 0, F.col("p_retailprice").cast("string"))))
    found = table(s, d, "part").select("p_partkey", apis.probe(p).alias("m"))
    return found.select("p_partkey", "m.duration_ms", "m.fps", "m.has_audio", "m.rotation")


@query("packet_log", "SELECT user_id, count(*) AS n, round(sum(event_id / 10.0), 1) AS total FROM events WHERE event_id % 4 <> 0 GROUP BY user_id")
def _(s, d):
    k = F.col("event_id")
    line = F.when(k % 4 == 0, F.lit("N/A")).when(k % 3 == 0, F.concat((k / 10).cast("string"), F.lit(","))).otherwise(F.concat(F.lit("  "), (k / 10).cast("string")))
    log = table(s, d, "events").groupBy("user_id").agg(F.array_join(F.collect_list(line), "\r\n").alias("log"))
    t = log.select("user_id", apis.packet_times(F.col("log")).alias("t")).where(F.size("t") > 0)
    return t.select("user_id", F.size("t").cast("long").alias("n"), F.round(F.aggregate("t", F.lit(0.0), lambda a, x: a + x), 1).alias("total"))


@query("silence_log", "SELECT conv_id, turn, turn + 0.5 AS start, turn + 1.25 AS \"end\" FROM conversations WHERE (conv_id, turn) NOT IN (SELECT conv_id, max(turn) FROM conversations GROUP BY 1)")
def _(s, d):
    c = table(s, d, "conversations").withColumn("last", F.max("turn").over(apis.Window.partitionBy("conv_id")))
    line = F.concat(F.lit("[x] silence_start: "), F.col("turn") + 0.5, F.when(F.col("turn") < F.col("last"), F.concat(F.lit("\n[x] silence_end: "), F.col("turn") + 1.25, F.lit(" | silence_duration: 0.75"))).otherwise(""))
    log = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))), lambda r: r["x"]), "\n").alias("log"))
    return log.select("conv_id", F.posexplode(apis.silences(F.col("log"))).alias("turn", "s")).select("conv_id", F.col("turn").cast("long").alias("turn"), "s.start", "s.end")


@query("url_field_scan", "SELECT page_id, 0 AS i, url, 'w' || page_id % 3 AS widget, 'url' AS field FROM pages UNION ALL SELECT page_id, 1, 'https://s.org/' || page_id, 'w' || page_id % 3, 'sourceUrl' FROM pages")
def _(s, d):
    content = F.concat(F.lit("{ url: '"), "url", F.lit("', n: 1,\n sourceUrl : \"https://s.org/"), "page_id", F.lit('" }'))
    path = F.concat(F.lit("w"), F.col("page_id") % 3, F.lit("/data/a.ts"))
    return apis.url_fields(table(s, d, "pages").select("page_id", content.alias("c"), path.alias("f")), ["page_id"], "c", "f")


@query("jsonld_scan", "SELECT page_id, 0 AS i, CASE WHEN page_id % 4 <> 3 THEN CASE WHEN page_id % 2 = 0 THEN 'Article' ELSE 'BreadcrumbList' END END AS type, CASE WHEN page_id % 4 = 3 THEN '{not json ' || page_id END AS parse_error FROM pages")
def _(s, d):
    k = F.col("page_id")
    body = F.when(k % 4 == 3, F.concat(F.lit("{not json "), k)).otherwise(F.concat(F.lit('\n{"@type": "'), F.when(k % 2 == 0, "Article").otherwise("BreadcrumbList"), F.lit('"}\n')))
    html = F.concat(F.lit("<head><script data-x type='application/ld+json' id=1>"), body, F.lit("</script><script type='text/javascript'>{}</script>"), "html")
    found = apis.json_ld(table(s, d, "pages").select("page_id", html.alias("h")), ["page_id"], "h")
    return found.select("page_id", "i", F.try_variant_get("doc", '$["@type"]', "string").alias("type"), "parse_error")


@query("fallback_layers", "SELECT page_id, layer, n FROM (SELECT page_id % 50 AS page_id, 2 + page_id % 2 AS layer, page_id AS n FROM pages WHERE page_id % 50 % 3 = 0 UNION ALL SELECT page_id % 50, 1, page_id FROM pages WHERE page_id % 50 % 3 = 1 UNION ALL SELECT page_id % 50, 3, page_id FROM pages) QUALIFY layer = min(layer) OVER (PARTITION BY page_id)")
def _(s, d):
    p, key = table(s, d, "pages"), F.col("page_id") % 50
    layer = lambda where, n: p.where(where).select(key.alias("page_id"), n.alias("layer"), F.col("page_id").alias("n"))
    rows = layer(key % 3 == 0, 2 + F.col("page_id") % 2).union(layer(key % 3 == 1, F.lit(1).cast("long"))).union(layer(F.lit(True), F.lit(3).cast("long")))
    return apis.first_layer(rows, ["page_id"], "layer")


@query("source_registry", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 5 <> 0")
def _(s, d):
    k = F.col("s_suppkey")
    return apis.capable(table(s, d, "supplier").withColumns({"capabilities": F.when(k % 2 == 0, F.array(F.lit("api"), F.lit("images"))).otherwise(F.array(F.lit("cdp"))), "paid": F.when(k % 5 == 0, F.lit(True))}), "api").select("s_suppkey")


@query("image_enrichment", "SELECT a.page_id, a.url, CASE WHEN page_id % 3 = 0 THEN 'own' ELSE m END AS image_url FROM pages a LEFT JOIN (SELECT url, arg_min('img' || page_id, page_id) AS m FROM pages WHERE page_id % 2 = 0 GROUP BY url) USING (url)")
def _(s, d):
    p, k = table(s, d, "pages"), F.col("page_id")
    return apis.with_images(p.select("page_id", "url", F.when(k % 3 == 0, "own").otherwise("").alias("image_url")), p.where(k % 2 == 0).select(k.alias("ordinal"), "url", F.concat(F.lit("img"), k).alias("image_url"))).select("page_id", "url", "image_url")


@query("source_markdown", r"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '# Source: ' || t || ' (Stub)' || chr(10) || '> URL: ' || url || chr(10) || '> Extracted from widget: w' || chr(10) || chr(10) || '## Note' || chr(10) || 'Content could not be fetched (HTTP 403).' || CASE WHEN page_id % 2 = 0 THEN ' Widget data summary: first value; second value.' ELSE '' END || chr(10)
ELSE '# Source: ' || t || chr(10) || '> URL: ' || url || chr(10) || '> Extracted from widget: w' || chr(10) || chr(10) || 'body' || chr(10) END AS page
FROM (SELECT *, coalesce(nullif(regexp_extract(html, '<title[^>]*>([^<]+)</title>', 1, 'i'), ''), '(Untitled)') AS t FROM pages)""")
def _(s, d):
    from quillon.functions.text import html_title

    data = F.when(F.col("page_id") % 2 == 0, "{ a: 'first value', u: 'https://x.org', c: '#ffffff', b: \"second value\", s: 'abc' }").otherwise("{}")
    title = html_title(F.col("html"))
    page = F.when(F.col("page_id") % 3 == 0, apis.stub_page(F.col("url"), F.lit("w"), title, F.lit("HTTP 403"), apis.widget_summary(data))).otherwise(apis.source_page(F.col("url"), F.lit("w"), title, F.lit("body")))
    return table(s, d, "pages").select("page_id", page.alias("page"))
