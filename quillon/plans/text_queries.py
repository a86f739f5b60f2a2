"""Queries over documents, pages and conversations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.functions.urls import normalize_url, url_host
from quillon.operators import cues, evidence, index, timeline, trends
from quillon.sources.readers import chunk_markdown, table

Q: dict = {}
S: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


@query("token_estimate", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("chunk_markdown", "SELECT doc_id, 0 AS chunk_index, CAST(NULL AS VARCHAR) AS title, length(text) AS chars FROM documents WHERE trim(text) <> ''")
def _(s, d):
    return chunk_markdown(table(s, d, "documents"), "doc_id", "text").select("doc_id", "chunk_index", "title", F.length("chunk").alias("chars"))


HASHES = "SELECT doc_id, sha256(text) AS chunk_hash FROM documents"


@query("chunk_hash_diff", f"""WITH c AS ({HASHES}), o AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE chunk_hash END AS h FROM c WHERE doc_id % 10 <> 0)
SELECT doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN o.h = chunk_hash THEN 'unchanged' ELSE 'changed' END AS state FROM c LEFT JOIN o USING (doc_id)""")
def _(s, d):
    cur = table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("chunk_hash"))
    old = cur.where("doc_id % 10 <> 0").withColumn("chunk_hash", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("chunk_hash")))
    return index.hash_diff(cur, old, ["doc_id"]).select("doc_id", "state")


@query("orphan_antijoin", "SELECT vec_id, label FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = e.vec_id AND d.lang = 'en')")
def _(s, d):
    cur = table(s, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("vec_id"))
    return index.orphans(table(s, d, "embeddings").select("vec_id", "label"), cur, ["vec_id"])


@query("retained_semijoin", "SELECT vec_id, label FROM embeddings e WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = e.vec_id AND d.lang = 'en')")
def _(s, d):
    cur = table(s, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("vec_id"))
    return index.retained(table(s, d, "embeddings").select("vec_id", "label"), cur, ["vec_id"])


HTML = "html"
for tag in X.DROPPED:
    HTML = f"regexp_replace({HTML}, '<{tag}[^>]*>.*?</{tag}>', '', 'gis')"
HTML = f"regexp_replace({HTML}, '<(?:p|div|h[1-6]|br|li|tr)[^>]*>', chr(10), 'gi')"
HTML = f"regexp_replace({HTML}, '<[^>]+>', '', 'g')"
for a, b in X.ENTITIES:
    HTML = f"replace({HTML}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
HTML = f"trim(regexp_replace(regexp_replace({HTML}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13))"


@query("html_to_text", f"SELECT page_id, length(t) AS chars, md5(t) AS text_md5 FROM (SELECT page_id, {HTML} AS t FROM pages)")
def _(s, d):
    return table(s, d, "pages").select("page_id", X.html_text(F.col("html")).alias("t")).select("page_id", F.length("t").alias("chars"), F.md5("t").alias("text_md5"))


@query("page_titles", "SELECT page_id, regexp_extract(html, '<title[^>]*>([^<]+)</title>', 1, 'i') AS title FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", X.html_title(F.col("html")).alias("title"))


#: Titles with what is to go from them, pairs within pairs too.
TITLE = "regexp_extract(html, '<title[^>]*>([^<]+)</title>', 1, 'i')"
EMOJI = "[\\x{1F300}-\\x{1F64F}\\x{1F680}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{FE00}-\\x{FE0F}\\x{1F1E6}-\\x{1F1FF}\\x{1F200}-\\x{1F251}]"
BLANK = "\\s\\x{0B}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"


def _unpaired(t: str) -> str:
    return f"regexp_replace({t}, '#[^#{BLANK}]+#', '', 'g')"


@query("clean_titles", f"""SELECT page_id, left(regexp_replace(regexp_replace(regexp_replace(replace({_unpaired(_unpaired(_unpaired("regexp_replace(t, '" + EMOJI + "', '', 'g')")))}, '#', ''), '【[^】]*】', '', 'g'), '[{BLANK}]+', ' ', 'g'), '^ | $', '', 'g'), 200) AS title
FROM (SELECT page_id, '【' || page_id || '】 🇩🇪☂️ C# vs F# ##a#b#\u3000#x##y#z#' || {TITLE} || ' #no pair# end' AS t FROM pages)""")
def _(s, d):
    t = F.concat(F.lit("【"), F.col("page_id"), F.lit("】 🇩🇪☂️ C# vs F# ##a#b#\u3000#x##y#z#"), X.html_title(F.col("html")), F.lit(" #no pair# end"))
    return table(s, d, "pages").select("page_id", X.clean_title(t).alias("title"))


P = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$'"
NORM = f"""SELECT page_id, url, CASE WHEN NOT regexp_matches(url, {P}) THEN url ELSE
  lower(regexp_extract(url, {P}, 1)) || '://' || lower(regexp_extract(url, {P}, 2)) ||
  CASE WHEN length(regexp_extract(url, {P}, 3)) > 1 THEN regexp_replace(regexp_extract(url, {P}, 3), '/$', '') WHEN regexp_extract(url, {P}, 3) = '' THEN '/' ELSE regexp_extract(url, {P}, 3) END ||
  CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS norm_url
FROM (SELECT page_id, url, list_sort(list_filter(string_split(regexp_extract(url, {P}, 4), '&'), lambda p: p <> '' AND NOT list_contains(['utm_source','utm_medium','utm_campaign','utm_term','utm_content','fbclid','gclid','ref','source','from','share','spm'], split_part(p, '=', 1)))) AS q FROM pages)"""


@query("url_normalize", f"SELECT page_id, norm_url FROM ({NORM})")
def _(s, d):
    return table(s, d, "pages").select("page_id", normalize_url(F.col("url")).alias("norm_url"))


PRIORITY = "CASE page_id % 5 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END"


@query("url_dedup_priority", f"""WITH n AS (SELECT page_id, norm_url, {PRIORITY} AS p FROM ({NORM.replace('FROM pages', "FROM (SELECT page_id, regexp_replace(url, '[0-9]+', '', 'g') AS url FROM pages)")}))
SELECT page_id, norm_url FROM (SELECT *, row_number() OVER (PARTITION BY norm_url ORDER BY p DESC, page_id) AS rn FROM n) WHERE rn = 1""")
def _(s, d):
    kinds = F.get(F.array(*map(F.lit, [*evidence.SOURCE_PRIORITY, "unknown"])), (F.col("page_id") % 5).cast("int"))
    sites = table(s, d, "pages").select("page_id", F.regexp_replace("url", "[0-9]+", "").alias("url"), kinds.alias("kind"))
    return evidence.dedup_sources(sites, "url", evidence.priority(F.col("kind")), "page_id").select("page_id", "norm_url")


@query("source_dedup", f"SELECT norm_url, min(page_id) AS page_id FROM ({NORM}) GROUP BY norm_url")
def _(s, d):
    p = table(s, d, "pages")
    noise = F.concat("url", F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_source=x&gclid=1"), F.when(F.col("page_id") % 2 == 0, "#top").otherwise(""))
    twice = p.select("page_id", "url").union(p.select("page_id", F.when(F.col("url").contains("#"), F.col("url")).otherwise(noise)))
    return evidence.dedup_sources(twice, "url", F.lit(0), "page_id").select("norm_url", "page_id")


@query("url_keyword_search_topk", "SELECT page_id, url FROM pages WHERE contains(lower(html || ' ' || url), 'example') AND contains(lower(html || ' ' || url), '/en/') ORDER BY page_id DESC LIMIT 20")
def _(s, d):
    hay = F.lower(F.concat_ws(" ", "html", "url"))
    hit = table(s, d, "pages").where(F.forall(F.array(F.lit("example"), F.lit("/en/")), lambda k: F.contains(hay, k)))
    return hit.select("page_id", "url").orderBy(F.desc("page_id")).limit(20)


WORDS = r"regexp_split_to_array(lower(t), '[\s,.;:!?''\x22\-()\[\]{}]+')"


@query("keyword_filter", f"SELECT doc_id FROM (SELECT doc_id, text AS t FROM documents) WHERE list_contains({WORDS}, 'the') OR contains(lower(t), 'of the') OR contains(lower(t), 'ción')")
def _(s, d):
    return table(s, d, "documents").where(X.any_keyword(F.col("text"), ["the", "of the", "ción"])).select("doc_id")


CASES = " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w.lower()}')" for w in words) + f" THEN '{c}'" for c, words in trends.CLASSES)


@query("topic_classify", f"SELECT doc_id, CASE {CASES} ELSE 'fermenting' END AS topic FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", X.cascade(F.col("text"), trends.CLASSES, "fermenting").alias("topic"))


@query("topic_counts_rollup", f"SELECT coalesce(topic, 'all') AS topic, count(*) AS n FROM (SELECT CASE {CASES} ELSE 'fermenting' END AS topic FROM documents) GROUP BY ROLLUP (topic)")
def _(s, d):
    t = table(s, d, "documents").select(X.cascade(F.col("text"), trends.CLASSES, "fermenting").alias("topic"))
    return t.rollup("topic").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("topic", F.lit("all")).alias("topic"), "n")


@query("near_dup_pairs", r"""WITH t AS (SELECT conv_id * 100 + turn AS id, list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9_ \t\n\x0B\f\r一-鿿]', ' ', 'g'), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN 'NUM' ELSE x END))) AS w FROM conversations),
c AS (SELECT w, min(id) AS id FROM t WHERE len(w) > 0 GROUP BY w),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS x, len(b.w) AS y FROM c a JOIN c b ON a.id < b.id),
r AS (SELECT a, b, i / (x + y - i) AS jaccard, i / least(x, y) AS containment FROM p)
SELECT a, b, round(jaccard, 6) AS jaccard, round(containment, 6) AS containment FROM r WHERE jaccard >= 0.8 OR containment >= 0.9""")
def _(s, d):
    rows = table(s, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return trends.similar_titles(rows, "id", "text")


@query("near_dup_greedy")
def _(s, d):
    p = table(s, d, "pages").select(F.col("page_id").alias("ordinal"), X.html_title(F.col("html")).alias("title"), url_host(F.col("url")).alias("source"), "url", F.lit("fermenting").alias("category"))
    return trends.merge_all_topics(p)


@query("sentence_split", r"SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS BIGINT) AS sentences FROM documents")
def _(s, d):
    parts = F.filter(F.split("text", r"(?<=[.!?])[ \t\n\x0B\f\r]+"), lambda x: x != "")
    return table(s, d, "documents").select("doc_id", F.size(parts).cast("long").alias("sentences"))


@query("slugify", "SELECT p_partkey, regexp_replace(left(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80), '-+$', '') AS slug, lower(regexp_replace(trim(p_name), '(?:-|[ \\t\\n\\x0B\\f\\r])+', '_', 'g')) AS snake FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", X.slug(F.col("p_name")).alias("slug"), X.snake_case(F.col("p_name")).alias("snake"))


@query("feed_render", "SELECT page_id, '<item><title>' || replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&apos;') || '</title></item>' AS item FROM (SELECT page_id, regexp_extract(html, '<title[^>]*>([^<]+)</title>', 1, 'i') AS t FROM pages) ORDER BY page_id DESC LIMIT 50")
def _(s, d):
    p = table(s, d, "pages").orderBy(F.desc("page_id")).limit(50)
    return p.select("page_id", F.concat(F.lit("<item><title>"), X.xml_escape(X.html_title(F.col("html"))), F.lit("</title></item>")).alias("item"))


@query("file_sizes", "SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN (floor(n / 102.4 + 0.5) / 10)::DOUBLE || ' KB' ELSE (floor(n / 104857.6 + 0.5) / 10)::DOUBLE || ' MB' END AS size FROM (SELECT doc_id, n_chars * 7 AS n FROM documents)")
def _(s, d):
    return table(s, d, "documents").select("doc_id", X.file_size(F.col("n_chars") * 7).alias("size"))


@query("link_extraction", r"""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages""")
def _(s, d):
    return table(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("href"))


@query("claim_audit", """WITH c AS (SELECT doc_id AS claim_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id END AS evidence_id, CASE WHEN lang = 'fr' THEN 'analysis' ELSE 'fact' END AS type, CASE WHEN n_chars > 2000 THEN 'high' END AS risk FROM documents),
e AS (SELECT doc_id AS evidence_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 0 THEN 'context' ELSE 'verified' END AS status, CASE WHEN doc_id % 4 = 0 THEN 'primary' ELSE 'community' END AS st, doc_id % 13 = 0 AS old FROM labels)
SELECT claim_id, reason FROM (SELECT claim_id, CASE WHEN c.evidence_id IS NULL THEN 'no evidence mapping' WHEN e.evidence_id IS NULL THEN 'evidence not found' WHEN status = 'rejected' THEN 'rejected' WHEN old THEN 'stale' WHEN status = 'context' THEN 'context'
 WHEN risk = 'high' AND (SELECT count(*) FROM e x WHERE x.evidence_id = c.evidence_id + 1) + 1 < 2 THEN 'too few sources'
 WHEN risk = 'high' AND st <> 'primary' AND NOT EXISTS (SELECT 1 FROM e x WHERE x.evidence_id = c.evidence_id + 1 AND x.st = 'primary') THEN 'no primary source' END AS reason
 FROM c LEFT JOIN e ON e.evidence_id = c.evidence_id WHERE type <> 'analysis') WHERE reason IS NOT NULL""")
def _(s, d):
    doc = table(s, d, "documents")
    claims = doc.select(F.col("doc_id").alias("claim_id"), F.when(F.col("doc_id") % 11 != 0, F.col("doc_id")).alias("evidence_id"), F.when(F.col("lang") == "fr", "analysis").otherwise("fact").alias("type"), F.when(F.col("n_chars") > 2000, "high").alias("risk"))
    lab, now = table(s, d, "labels"), F.lit("2024-06-01").cast("timestamp")
    ev = lab.select(F.col("doc_id").alias("evidence_id"), F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 0, "context").otherwise("verified").alias("status"), F.when(F.col("doc_id") % 13 == 0, F.lit("2024-01-01").cast("timestamp")).alias("valid_until"), F.when(F.col("doc_id") % 4 == 0, "primary").otherwise("community").alias("source_type"), F.array(F.col("doc_id") + 1).alias("cross_ids"))
    return evidence.audit(claims, ev, now, "deep")


@query("rule_word_count", "SELECT conv_id, count(*) AS scenes, CAST(sum(n) AS BIGINT) AS words, sum(n) > 180 AS too_long, count(*) NOT BETWEEN 6 AND 10 AS odd_scenes FROM (SELECT conv_id, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS n FROM conversations) GROUP BY conv_id")
def _(s, d):
    n = table(s, d, "conversations").select("conv_id", F.regexp_count("text", F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long").alias("n"))
    return n.groupBy("conv_id").agg(F.count(F.lit(1)).alias("scenes"), F.sum("n").alias("words")).select("*", (F.col("words") > 180).alias("too_long"), (~F.col("scenes").between(6, 10)).alias("odd_scenes"))


@query("rule_rhythm", "SELECT conv_id, round(max(abs(n - m) / m), 6) AS deviation FROM (SELECT conv_id, length(text) AS n, avg(length(text)) OVER (PARTITION BY conv_id) AS m FROM conversations) GROUP BY conv_id")
def _(s, d):
    from pyspark.sql import Window

    m = table(s, d, "conversations").select("conv_id", F.length("text").alias("n"), F.avg(F.length("text")).over(Window.partitionBy("conv_id")).alias("m"))
    return m.groupBy("conv_id").agg(F.round(F.max(F.abs(F.col("n") - F.col("m")) / F.col("m")), 6).alias("deviation"))


@query("first_last_turn", "SELECT conv_id, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role, arg_min(length(text), turn) AS hook_chars, arg_max(length(text), turn) AS cta_chars FROM conversations GROUP BY conv_id")
def _(s, d):
    return table(s, d, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"), F.min_by(F.length("text"), "turn").alias("hook_chars"), F.max_by(F.length("text"), "turn").alias("cta_chars"))


@query("ngram_overlap", r"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM conversations),
g AS (SELECT conv_id, turn, list_distinct(list_transform(range(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM w)
SELECT a.conv_id, a.turn, CAST(len(list_intersect(a.g, b.g)) AS BIGINT) AS shared FROM g a JOIN g b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1""")
def _(s, d):
    from pyspark.sql import Window

    w = table(s, d, "conversations").select("conv_id", "turn", F.filter(F.split(F.lower("text"), r"[ \t\n\x0B\f\r]+"), lambda x: x != "").alias("w"))
    n = F.size("w")
    grams = F.when(n >= 4, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 3, F.lit(1))), lambda i: F.array_join(F.slice("w", i, 4), " ")))).otherwise(F.array().cast("array<string>"))
    g = w.select("conv_id", "turn", grams.alias("g")).withColumn("before", F.lag("g").over(Window.partitionBy("conv_id").orderBy("turn")))
    return g.where("before IS NOT NULL").select("conv_id", "turn", F.size(F.array_intersect("g", "before")).cast("long").alias("shared"))


@query("timeline_offsets", "SELECT conv_id, turn, f AS frames, CAST(coalesce(sum(f) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT conv_id, turn, CAST(greatest(ceil(length(text) / 15.0 * 30 - 1e-6), 1) AS BIGINT) AS f FROM conversations)")
def _(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", timeline.frames(F.length("text") / 15.0).alias("frames"))
    return timeline.offsets(c, "conv_id", "turn", "frames")


def _word_times(s, d):
    w = table(s, d, "conversations").select(F.col("conv_id").alias("content"), F.col("turn").cast("long").alias("scene"), F.posexplode(F.split("text", r"\s+")).alias("i", "text"))
    return w.select("content", "scene", F.lit(0).alias("segment"), "i", "text", (F.col("i") * 0.4).alias("start"), (F.col("i") * 0.4 + 0.35).alias("end"))


@query("cue_grouping")
def _(s, d):
    w = _word_times(s, d)
    return cues.build(w, w.groupBy("content", "scene").agg(F.max("end").alias("duration")))


@query("word_phrases")
def _(s, d):
    return cues.phrases(_word_times(s, d).select(F.concat_ws("-", "content", "scene").alias("scene"), "i", "text", "start", "end"))
