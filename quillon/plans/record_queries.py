"""Queries of files, captions, credits, metadata, uploads, picks, keywords and searches made by rule, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import content as C
from quillon.functions.text import html_title
from quillon.functions.urls import normalize_url
from quillon.operators import assets, index, rankings, research, vector
from quillon.operators.vector import expected_hits
from quillon.plans.post_queries import WORD
from quillon.plans.table_queries import BATCH
from quillon.plans.twins import registry
from quillon.sources import subtitles
from quillon.sources.readers import table

Q, S, query = registry()


def _text(s: str) -> str:
    """A text as SQL has it."""
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in s.split("\n"))


CLOCK = "printf('%d:%02d:%02d.%02d', {c} // 360000, {c} // 6000 % 60, {c} // 100 % 60, {c} % 100)"
ESCAPED = "regexp_replace(replace(replace(replace(text, '\\', '\\\\'), '{', '\\{'), '}', '\\}'), '\\r?\\n', '\\\\N', 'g')"


@query("subtitle_files", f"""SELECT conv_id, {_text(subtitles.header(subtitles.Style()))} || string_agg('Dialogue: 0,' || {CLOCK.format(c="(turn * 200)")} || ',' || {CLOCK.format(c="(turn * 200 + 150)")} || ',Default,,0,0,0,,' ||
CASE WHEN turn % 2 = 0 THEN '{{\\kt0\\kf50}}' || role || ' {{\\kt60\\kf12.5}}end' ELSE {ESCAPED} END, chr(10) ORDER BY turn) || chr(10) AS content FROM conversations GROUP BY conv_id""")
def _(s, d):
    t = F.col("turn") * 2.0
    word = lambda text, a, b: F.struct(text.alias("text"), a.alias("start"), b.alias("end"))
    words = F.when(F.col("turn") % 2 == 0, F.array(word(F.col("role"), t, t + 0.5), word(F.lit("end"), t + 0.6, t + 0.725)))
    return subtitles.subtitle_files(table(s, d, "conversations").select("conv_id", t.alias("start"), (t + 1.5).alias("end"), "text", words.alias("words")), "conv_id")


@query("series_captions", "SELECT p_partkey, p_name || chr(10) || chr(10) || p_type || chr(10) || chr(10) || 'Part ' || p_size || '/50 #ab' AS caption FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", C.series_caption(F.col("p_name"), F.concat("p_type", F.lit(" ")), F.lit("a-b"), F.col("p_size"), F.lit(50)).alias("caption"))


@query("credits_sections", """WITH a AS (SELECT p_brand, p_partkey, split_part(p_type, ' ', 1) || CASE WHEN p_partkey % 5 > 0 THEN 'a' || p_partkey % 5 ELSE '' END AS who FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 4 = 1),
f AS (SELECT p_brand, who, min(p_partkey) AS p FROM a GROUP BY 1, 2)
SELECT b.p_brand, CASE WHEN t IS NULL THEN '' ELSE chr(10) || chr(10) || '--- Credits ---' || chr(10) || t || chr(10) || '--- /Credits ---' END AS credits FROM (SELECT DISTINCT p_brand FROM part) b LEFT JOIN (SELECT p_brand, string_agg('by ' || p, chr(10) ORDER BY p) AS t FROM f GROUP BY p_brand) USING (p_brand)""")
def _(s, d):
    k = F.col("p_partkey")
    author = F.when(k % 5 > 0, F.concat(F.lit("a"), k % 5))
    return C.credits(table(s, d, "part").select("p_brand", k, F.split_part("p_type", F.lit(" "), F.lit(1)).alias("source"), author.alias("author"), F.concat(F.lit("by "), k).alias("text"), F.when(k % 3 == 0, True).alias("logo"), (k % 4 == 1).alias("required")), ["p_brand"], "p_partkey")


@query("sound_terms", "SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS terms FROM (SELECT p_partkey, list_filter(string_split(lower(p_name), ' '), lambda w: length(w) > 2) || CASE WHEN p_partkey % 2 = 0 THEN [lower(p_brand)] ELSE [] END || CASE WHEN p_partkey % 3 = 0 THEN [lower(p_type)] ELSE [] END || ['news', 'breaking news', 'tech news', 'ai news'] AS l FROM part)")
def _(s, d):
    k = F.col("p_partkey")
    terms = C.sound_keywords(F.concat(F.lit("the "), "p_name"), F.when(k % 2 == 0, F.col("p_brand")).otherwise(""), F.when(k % 3 == 0, F.col("p_type")))
    return table(s, d, "part").select("p_partkey", F.array_join(terms, ",").alias("terms"))


@query("metadata_objects", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '{}' WHEN 1 THEN '{"topics":["a","' || lower(p_brand) || '"],"file":"' || p_type || '"}' WHEN 2 THEN '{"entities":{"companies":["' || lower(replace(p_name, ' ', '_')) || '"],"other":{"x":[1,"Y z"]}},"part":' || p_size || '}' ELSE '{"file":null,"topics":[]}' END AS metadata FROM part""")
def _(s, d):
    k = F.col("p_partkey") % 4
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    one = F.concat(F.lit('{"topics": [" A ", "  ", '), q(F.col("p_brand")), F.lit('], "file": '), q(F.col("p_type")), F.lit("}"))
    two = F.concat(F.lit('{"entities": {"companies": ['), q(F.col("p_name")), F.lit(', " "], "other": {"x": [1, "Y z"]}}, "part": '), "p_size", F.lit("}"))
    raw = F.when(k == 0, F.when(F.col("p_partkey") % 8 == 0, "null")).when(k == 1, one).when(k == 2, two).otherwise('{"file": null, "entities": null, "topics": []}')
    return table(s, d, "part").select("p_partkey", C.normalized_metadata(raw).alias("metadata"))


@query("article_files", """SELECT doc_id, CASE WHEN doc_id % 5 < 2 THEN 'A "b" ' || lang END AS title, CASE doc_id % 5 WHEN 0 THEN 'a-b-' || lang WHEN 1 THEN 'own-' || doc_id END AS slug, CASE WHEN doc_id % 5 = 1 THEN 'an excerpt' END AS excerpt, CASE WHEN doc_id % 5 < 2 THEN md5(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) END AS content_md5, CASE doc_id % 5 WHEN 0 THEN true WHEN 1 THEN false END AS published,
CASE doc_id % 5 WHEN 2 THEN 'Frontmatter is required' WHEN 3 THEN 'title is required in frontmatter' WHEN 4 THEN 'slug must match [a-z0-9-]+ pattern (got: "No Slug")' END AS error FROM documents WHERE text IS NOT NULL""")
def _(s, d):
    k = F.col("doc_id") % 5
    front = F.when(k == 0, F.concat(F.lit("---\ntitle: 'A \"b\" "), "lang", F.lit("'\npublished: true\n---\n"))).when(k == 1, F.concat(F.lit('\n---\ntitle:  "A "b" '), "lang", F.lit('"\nslug: own-'), "doc_id", F.lit("\nexcerpt:  an excerpt \npublished: yes\n---\n")))
    front = F.coalesce(front, F.when(k == 2, "no block ").when(k == 3, "---\ntitle: ''\n---\n").otherwise("---\ntitle: T\nslug: No Slug\n---\n"))
    a = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", C.parsed_article(F.concat(front, "text")).alias("a"))
    return a.select("doc_id", "a.title", "a.slug", "a.excerpt", F.md5("a.content").alias("content_md5"), "a.published", "a.error")


@query("checked_uploads", """WITH f AS (SELECT *, p_size || CASE WHEN p_partkey % 2 = 0 THEN '.PDF' ELSE '.png' END AS n FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'File not found: ' || p WHEN p_partkey % 13 = 0 THEN 'File is empty: ' || p WHEN p_partkey % 17 = 0 THEN 'File too large: ' || p || ' (57.2 MB). Max: 50 MB' WHEN p_partkey % 19 = 0 THEN 'Unsupported file type: ' || p WHEN c > 1 THEN 'Duplicate file names: ' || n END AS error,
CASE WHEN p_partkey % 19 = 0 THEN 'application/octet-stream' WHEN p_partkey % 2 = 0 THEN 'application/pdf' ELSE 'image/png' END AS media_type FROM (SELECT p_partkey, 'd/' || n AS p, n, count(*) OVER (PARTITION BY p_brand, n) AS c FROM (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 19 = 0 THEN n || '.exe' ELSE n END AS n FROM f))""")
def _(s, d):
    k = F.col("p_partkey")
    name = F.concat(F.lit("d/"), "p_size", F.when(k % 2 == 0, ".PDF").otherwise(".png"), F.when(k % 19 == 0, ".exe").otherwise(""))
    size = F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, 0).when(k % 17 == 0, 60_000_000).otherwise(1000).cast("long")
    return C.checked_uploads(table(s, d, "part").select(k, "p_brand", name.alias("path"), size.alias("size")), "p_brand").select(k, "error", "media_type")


FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({t}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"


@query("music_picks", f"""WITH p AS (SELECT list(n_name ORDER BY n_name) FILTER (n_nationkey % 6 = 0) AS a, list(n_name ORDER BY n_name) FILTER (n_nationkey % 2 = 0) AS b, list(n_name ORDER BY n_name) AS c FROM nation)
SELECT 'all kinds' AS pool, c_custkey, a[CAST({FNV.format(t="c_name")} % len(a) + 1 AS INT)] AS pick FROM customer, p UNION ALL SELECT 'no news', c_custkey, b[CAST({FNV.format(t="c_name")} % len(b) + 1 AS INT)] FROM customer, p UNION ALL SELECT 'slow', c_custkey, c[CAST({FNV.format(t="c_name")} % len(c) + 1 AS INT)] FROM customer, p UNION ALL SELECT 'none', c_custkey, NULL FROM customer""")
def _(s, d):
    n, c, k = table(s, d, "nation"), table(s, d, "customer").select("c_custkey", "c_name"), F.col("n_nationkey")
    pool = lambda instant, some: n.select(F.col("n_name").alias("name"), instant.alias("instant"), some.alias("news"))
    pools = {"all kinds": pool(k % 2 == 0, k % 3 == 0), "no news": pool(k % 2 == 0, k < 0), "slow": pool(k < 0, k % 3 == 0), "none": pool(k < 0, k < 0).limit(0)}
    out = None
    for name, p in pools.items():
        one = assets.pick_music(c, p, "c_name").select(F.lit(name).alias("pool"), "c_custkey", "pick")
        out = one if out is None else out.union(one)
    return out


@query("golden_hits", f"""WITH t AS {BATCH}, g AS (SELECT vec_id AS q, label FROM embeddings WHERE vec_id % 50 = 0), r AS (SELECT query_id AS q, t.vec_id, similarity, label FROM t JOIN embeddings e ON e.vec_id = t.vec_id WHERE rank <= 5)
SELECT g.q AS query, CASE WHEN q % 100 = 0 THEN coalesce((SELECT max(similarity) FROM r WHERE r.q = g.q), 0) < 0.5 ELSE EXISTS (SELECT 1 FROM r WHERE r.q = g.q AND r.label = g.label) END AS hit, CASE WHEN q % 100 = 0 THEN 0 ELSE (SELECT count(DISTINCT r.label) FROM r WHERE r.q = g.q AND r.label = g.label) END AS matched, CASE WHEN q % 100 = 0 THEN 0 ELSE 2 - (SELECT count(DISTINCT r.label) FROM r WHERE r.q = g.q AND r.label = g.label) END AS missed FROM g""")
def _(s, d):
    e = table(s, d, "embeddings")
    found = vector.batch_topk(e, e.where("vec_id % 50 = 0"), 5).join(e.select("vec_id", "label"), "vec_id")
    results = found.select(F.col("query_id").alias("query"), F.lit("kind").alias("content_type"), F.col("label").cast("string").alias("source_id"), "similarity", "rank")
    source = lambda i: F.struct(F.lit("kind").alias("content_type"), i.alias("source_id"))
    golden = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.when(F.col("vec_id") % 100 != 0, F.array(source(F.col("label").cast("string")), source(F.lit("nowhere")))).alias("expected"))
    return expected_hits(golden, results).select("query", "hit", "matched", "missed")


HISTORY = "(SELECT page_id, regexp_extract(html, '<title[^>]*>([^<]+)</title>', 1, 'i') AS title, url, page_id % 7 AS visits, CASE WHEN page_id % 11 > 0 THEN make_timestamp(1700000000000000 + page_id * 1000000) END AS visited FROM pages)"


@query("history_by_time", f"SELECT title, url, visited, visits FROM {HISTORY} WHERE visited >= make_timestamp(1700000000000000 + 20 * 1000000) AND contains(lower(title || ' ' || url), 'e') AND contains(lower(title || ' ' || url), '/')")
def _(s, d):
    return _history(s, d, ["E", "/"], F.timestamp_micros(F.lit(1700000000000000 + 20 * 1000000)))


@query("history_by_visits", f"SELECT title, url, visited, visits FROM {HISTORY} WHERE visited IS NOT NULL ORDER BY visits DESC, visited DESC LIMIT 30")
def _(s, d):
    return _history(s, d, [], None, 30, True)


def _history(s, d, keywords, since, limit=0, by_visits=False):
    k = F.col("page_id")
    at = F.when(k % 11 > 0, k * 1_000_000 + 1_700_000_000_000_000 + rankings.SINCE_1601).otherwise(0)
    visits = table(s, d, "pages").select(html_title(F.col("html")).alias("title"), "url", at.alias("last_visit"), (k % 7).alias("visits"))
    return rankings.search_history(visits, keywords, since, limit, by_visits).withColumn("visited", F.col("visited").cast("timestamp_ntz"))


@query("entity_keywords", f"""WITH k AS (SELECT upper(left(w, 1)) || substr(w, 2) AS name, w, row_number() OVER (ORDER BY w) - 1 AS place FROM ({WORD})), c AS (SELECT DISTINCT conv_id FROM conversations),
g AS (SELECT conv_id, 0 AS tier, 0 AS a, 0 AS b, 'Acme' AS kw FROM c WHERE conv_id % 3 = 0 UNION ALL SELECT conv_id, 0, 1, 0, 'Bolt' || conv_id % 2 FROM c WHERE conv_id % 3 = 0 UNION ALL SELECT conv_id, 1, 0, 0, 'ACME' FROM c WHERE conv_id % 2 = 0
UNION ALL SELECT s.conv_id, 2, turn, place, name FROM conversations s, k WHERE s.conv_id % 3 <> 0 AND s.conv_id % 2 <> 0 AND contains(lower(text), w)),
f AS (SELECT conv_id, lower(kw) AS low, min(struct_pack(tier := tier, a := a, b := b, kw := kw)) AS o FROM g GROUP BY 1, 2)
SELECT conv_id AS content, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY o) - 1 AS INT) AS ordinal, o.kw AS keyword FROM f""")
def _(s, d):
    c = table(s, d, "conversations")
    contents = c.select(F.col("conv_id").alias("content")).distinct()
    k = F.col("content")
    named = contents.where("content % 3 = 0").select("content", F.posexplode(F.array(F.lit("Acme"), F.concat(F.lit("Bolt"), k % 2))).alias("ordinal", "keyword"))
    wished = contents.where("content % 2 = 0").select("content", F.lit(0).alias("ordinal"), F.lit("ACME").alias("keyword"))
    words = table(s, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), 0)).alias("w")).distinct()
    from quillon.operators.captions import ranked

    known = ranked(words, ["w"], ["w"]).select("place", F.initcap("w").alias("name"))
    return index.keywords_of(contents, named, wished, c.select(F.col("conv_id").alias("content"), F.col("turn").alias("scene"), F.col("text").alias("voiceover")), known)


@query("url_params", "SELECT p_partkey, 'https://ex.org/p?a=%25zz&A=A+x&b=' || replace(p_name, ' ', '+') || '&b=%C3%BC%26&c=' AS url FROM part")
def _(s, d):
    url = F.concat(F.lit("HTTPS://Ex.org:443/p/?b="), F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("&A=%41+x&a=%zz&utm_source=q&c&b=ü%26&re%66=1#f"))
    return table(s, d, "part").select("p_partkey", normalize_url(url).alias("url"))


@query("jsonld_graphs", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'empty @graph' WHEN 1 THEN 'missing @context;node without @type;ItemList.itemListElement;ItemList.numberOfItems' WHEN 2 THEN 'BreadcrumbList position 2 should be 1;FAQPage.mainEntity' ELSE '' END AS errors FROM pages")
def _(s, d):
    k, u = F.col("page_id") % 4, F.to_json(F.struct("url"))
    nodes = F.when(k == 0, "").when(k == 1, F.concat(u, F.lit(', {"@type": "ItemList"}'))).when(k == 2, '{"@type": "BreadcrumbList", "itemListElement": [{"position": 2}, {"position": 2}]}, {"@type": "FAQPage"}').otherwise(F.concat(F.lit('{"@type": "Odd", "x": '), u, F.lit("}")))
    doc = F.concat(F.lit("{"), F.when(k != 1, '"@context": "https://schema.org", ').otherwise(""), F.lit('"@graph": ['), nodes, F.lit("]}"))
    return table(s, d, "pages").select("page_id", F.array_join(research.json_ld_errors(F.try_parse_json(doc)), ";").alias("errors"))


@query("asset_gates", "SELECT p_partkey, t, p_partkey % 7 > 0 AND t < 20 AS before_download, p_partkey % 7 > 0 AND t < 30 AS before_analysis FROM (SELECT p_partkey, 14 + CASE WHEN p_size < 25 THEN 14 ELSE 0 END + CASE WHEN p_partkey % 2 = 0 THEN 10 ELSE 0 END - 8 AS t FROM part)")
def _(s, d):
    k = F.col("p_partkey")
    score = assets.technical_score(F.col("p_name"), F.lit("zzzzzz"), F.lit("image"), F.lit(None).cast("int"), F.when(F.col("p_size") < 25, 1).otherwise(20_000_000), F.when(k % 2 == 0, "1080p").otherwise("")) - 8
    p = table(s, d, "part").select(k, score.cast("int").alias("t"), F.when(k % 7 > 0, F.col("p_name")).alias("title"))
    gate = lambda least: assets.low_confidence(F.col("title"), F.lit("zzzzzz"), F.col("t"), least)
    return p.select(k, "t", gate(assets.BEFORE_DOWNLOAD).alias("before_download"), gate(assets.BEFORE_ANALYSIS).alias("before_analysis"))
