"""Queries of content records: chunks, metadata, captions, articles, names, addresses, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import content as C
from quillon.functions import text as X
from quillon.operators import analytics, trends, vector
from quillon.plans.twins import registry
from quillon.sources.readers import chunk_markdown, table

Q, S, query = registry()

BODY = "regexp_replace(text, '[\\n#]', ' ', 'g')"


@query("chunk_sections", rf"""WITH d AS (SELECT doc_id, rtrim({BODY}, ' ') AS b, repeat('p ', 7500) AS p FROM documents)
SELECT doc_id, 0 AS chunk_index, 'One' AS title, md5('## One' || chr(10) || b) AS chunk_md5, length(b) + 7 AS chars FROM d WHERE b <> ''
UNION ALL SELECT doc_id, 0, 'One', md5('## One'), 6 FROM d WHERE b = ''
UNION ALL SELECT doc_id, 1, 'Two x', md5('## Two x' || chr(10) || 'y'), 10 FROM d WHERE doc_id % 5 <> 0
UNION ALL SELECT doc_id, 1, 'Two x', md5('## Two x' || chr(10) || p || chr(10) || chr(10) || p), 30011 FROM d WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, 2, 'Two x', md5(rtrim(p, ' ')), 14999 FROM d WHERE doc_id % 5 = 0""")
def _(s, d):
    p = F.repeat(F.lit("p "), F.lit(7500))
    long = F.concat_ws("\n\n\n", p, p, p)
    t = F.concat(F.lit("dropped\n## One\n"), F.regexp_replace("text", "[\n#]", " "), F.lit("\n\n## Two x\n"), F.when(F.col("doc_id") % 5 == 0, long).otherwise("y"), F.lit("  \n"))
    rows = table(s, d, "documents").select("doc_id", t.alias("t"))
    return chunk_markdown(rows, "doc_id", "t").select("doc_id", "chunk_index", "title", F.md5("chunk").alias("chunk_md5"), F.length("chunk").alias("chars"))


@query("chunk_scenes", "SELECT conv_id, turn, text || CASE WHEN turn % 2 = 0 THEN chr(10) || chr(10) || 'Visual: a \"q\" | ' || role || ' | b' ELSE '' END AS chunk, CASE WHEN turn % 3 = 0 THEN 'Scene ' || turn ELSE role END AS title, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS chunk_index FROM conversations WHERE trim(text) <> '' AND conv_id % 7 <> 3")
def _(s, d):
    seen = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.lit(' a "q" ').alias("t"), F.struct(F.array(F.col("role"), F.lit("  ")).alias("n"), F.lit(3).alias("k"), F.lit("b").alias("z")).alias("deep"))))
    c = table(s, d, "conversations").select("conv_id", "turn", C.scene_text(F.when(F.col("conv_id") % 7 != 3, F.col("text")), seen).alias("chunk"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Scene "), "turn")).otherwise(F.col("role")).alias("title"))
    return c.where("chunk IS NOT NULL").withColumn("chunk_index", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)


@query("chunk_catalog", "SELECT p_partkey, p_name || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN 'Keywords: ' || p_brand || ', ' || p_type || chr(10) ELSE '' END || 'File: m/' || p_partkey || '.png' || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || 'Source: ' || p_brand ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN chr(10) || 'License: CC0' ELSE '' END || CASE WHEN p_partkey % 2 = 1 THEN chr(10) || 'Used in: ' || p_type ELSE '' END AS chunk, p_partkey || '.png' AS title FROM part WHERE p_partkey % 11 <> 0")
def _(s, d):
    k = F.col("p_partkey")
    file = F.when(k % 11 != 0, F.concat(F.lit("m/"), k, F.lit(".png")))
    text = C.catalog_text(F.col("p_name"), F.when(k % 2 == 0, F.array("p_brand", "p_type")).otherwise(F.array().cast("array<string>")), file, F.when(k % 3 == 0, F.col("p_brand")).otherwise(""), F.when(k % 5 == 0, F.lit("CC0")), F.when(k % 2 == 1, F.array("p_type")))
    return table(s, d, "part").select("p_partkey", text.alias("chunk"), C.base_name(file).alias("title")).where("chunk IS NOT NULL")


@query("metadata_topics", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE lower(p_brand) || ';' || lower(p_type) END AS topics FROM part")
def _(s, d):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.lit('{"other": 1}')).otherwise(F.to_json(F.struct(F.array(F.concat(F.lit("  "), "p_brand"), F.lit(" "), "p_type").alias("topics"))))
    return table(s, d, "part").select("p_partkey", F.array_join(C.topics(raw), ";").alias("topics"))


@query("metadata_entities", "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN lower(regexp_replace(trim(p_name), '[- ]+', '_', 'g')) || ';' || lower(p_brand) END AS companies FROM part")
def _(s, d):
    names = F.when(F.col("p_partkey") % 4 != 0, F.array(F.concat(F.lit(" "), "p_name"), F.lit("  "), "p_brand"))
    return table(s, d, "part").select("p_partkey", F.array_join(C.entities(names), ";").alias("companies"))


@query("topic_overlap", "SELECT doc_id FROM documents WHERE doc_id % 6 <> 0 AND (lang = 'en' OR source = 'web')")
def _(s, d):
    own = F.when(F.col("doc_id") % 6 != 0, F.array("lang", "source"))
    return table(s, d, "documents").where(C.overlaps(own, [" EN ", "web"])).select("doc_id")


@query("rerank", """WITH q AS (SELECT vec_id % 100 AS q, vec_id, label, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding) AS score FROM embeddings)
SELECT q, vec_id, CAST(row_number() OVER (PARTITION BY q ORDER BY CASE WHEN n > 3 THEN -round(score, 9) ELSE 0 END, vec_id * 7 % 1001) AS INT) AS rank FROM (SELECT *, count(*) OVER (PARTITION BY q) AS n FROM q) WHERE label % 2 = 0""")
def _(s, d):
    found = table(s, d, "embeddings").select((F.col("vec_id") % 100).alias("q"), "vec_id", "label", "embedding", (F.col("vec_id") * 7 % 1001).alias("found_at"))
    ranked = vector.rerank(found, ["q"], "embedding", "found_at", where=F.col("label") % 2 == 0)
    return ranked.select("q", "vec_id", "rank")


@query("dimension_check", "SELECT vec_id, len(embedding) AS dims FROM embeddings")
def _(s, d):
    return table(s, d, "embeddings").select("vec_id", F.size(C.sized(F.col("embedding"), 64)).cast("long").alias("dims"))


@query("vector_means", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding), 9) AS mean FROM embeddings")
def _(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(vector.mean(F.col("embedding")), 9).alias("mean"))


@query("noise_after_topk", "SELECT q, vec_id FROM (SELECT q, vec_id, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, vec_id) AS rn FROM (SELECT vec_id % 10 AS q, vec_id, round(abs(embedding[1])::DOUBLE * 3, 6) AS sim FROM embeddings)) WHERE rn <= 5 AND sim >= 0.5")
def _(s, d):
    e = table(s, d, "embeddings").select((F.col("vec_id") % 10).alias("q"), "vec_id", F.round(F.abs(F.get("embedding", F.lit(0)).cast("double")) * 3, 6).alias("similarity"))
    best = e.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "vec_id"))).where("rn <= 5")
    return best.where(vector.band(F.col("similarity")) != "noise").select("q", "vec_id")


@query("keyword_slugs", "SELECT p_partkey, 'src-' || lower(regexp_replace(regexp_replace(regexp_replace(p_name || '''s 世界!', '''', '', 'g'), '[^A-Za-z0-9_\\x{4e00}-\\x{9fff}\\x{3040}-\\x{30ff}]+', '-', 'g'), '^-|-$', '', 'g')) || '-' || CASE WHEN p_size < 10 THEN '0' || p_size ELSE p_size::VARCHAR END || '.jpg' AS file FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", C.asset_file(F.lit("src"), F.concat("p_name", F.lit("'s 世界!")), F.col("p_size"), F.lit("jpg")).alias("file"))


SLUG = "lower(replace(p_name, ' ', CASE WHEN p_partkey % 3 = 0 THEN '--' WHEN p_partkey % 3 = 1 THEN '-' ELSE '_' END)) || CASE WHEN p_partkey % 5 = 0 THEN repeat('ab', 40) WHEN p_partkey % 7 = 0 THEN '-' ELSE '' END"


@query("valid_slugs", f"SELECT p_partkey, regexp_full_match({SLUG}, '[a-z0-9]+(-[a-z0-9]+)*') AND length({SLUG}) <= 80 AS valid, p_partkey % 3 = 1 AS plain FROM part")
def _(s, d):
    k = F.col("p_partkey")
    joint = F.when(k % 3 == 0, "--").when(k % 3 == 1, "-").otherwise("_")
    tail = F.when(k % 5 == 0, F.repeat(F.lit("ab"), F.lit(40))).when(k % 7 == 0, "-").otherwise("")
    return table(s, d, "part").select("p_partkey", X.valid_slug(F.concat(F.lower(F.replace("p_name", F.lit(" "), joint)), tail)).alias("valid"), X.valid_slug(X.slug(F.when(k % 3 == 1, F.col("p_name")).otherwise("!"))).alias("plain"))


@query("content_images", "SELECT page_id FROM pages WHERE page_id % 4 > 0 AND NOT regexp_matches(url || CASE WHEN page_id % 4 = 1 THEN '/Site-LOGO.png' ELSE '/p.jpg' END, '(?i)logo|avatar|icon|placeholder|spinner|favicon|badge|button|sprite')")
def _(s, d):
    url = F.when(F.col("page_id") % 4 > 0, F.concat("url", F.when(F.col("page_id") % 4 == 1, "/Site-LOGO.png").otherwise("/p.jpg")))
    return table(s, d, "pages").where(~C.not_content_image(url)).select("page_id")


@query("any_substring", "SELECT page_id FROM pages WHERE contains(lower(url), 'exam') OR contains(lower(url), 'zzz') OR contains(lower(url), '/1')")
def _(s, d):
    return table(s, d, "pages").where(C.any_substring(F.col("url"), ["EXAM", "zzz", "/1"])).select("page_id")


@query("contained_keywords", "SELECT doc_id, array_to_string(list_filter(['The', 'die', 'un'], lambda k: contains(lower(text), lower(k))), ',') AS keywords FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.array_join(C.contained_keywords(F.col("text"), ["The", "die", "un"]), ",").alias("keywords"))


@query("title_keywords", "SELECT p_partkey, array_to_string(list_filter(string_split(lower(p_name), ' '), lambda w: length(w) > 2), ',') AS keywords FROM part")
def _(s, d):
    t = F.concat("p_name", F.lit(" the From  of "), "p_name")
    return table(s, d, "part").select("p_partkey", F.array_join(C.title_keywords(t), ",").alias("keywords"))


@query("previews", "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview, printf('%.4f', n_chars / 7.0) AS score FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", C.preview(F.col("text")).alias("preview"), F.format_string("%.4f", F.col("n_chars") / 7.0).alias("score"))


@query("numbers_or_null", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_retailprice END AS n FROM part")
def _(s, d):
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, F.concat(F.lit(" "), F.col("p_retailprice").cast("string"))).when(k % 4 == 1, "").when(k % 4 == 2, "12 px").otherwise("Infinity")
    return table(s, d, "part").select("p_partkey", C.number_or_null(text).alias("n"))


@query("parsed_numbers", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 1000.0 WHEN 1 THEN p_size + 0.5 WHEN 2 THEN p_size END AS n FROM part")
def _(s, d):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(k % 4 == 0, F.concat(size, F.lit(",000"))).when(k % 4 == 1, F.concat(size, F.lit(".5%"))).when(k % 4 == 2, F.concat(size, F.lit(" views"))).otherwise("views")
    return table(s, d, "part").select("p_partkey", X.parse_number(text).alias("n"))


@query("content_segments", "SELECT doc_id, 0 AS i, 'markdown' AS type, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS value FROM documents UNION ALL SELECT doc_id, 1, 'widget', 'chart-' || doc_id FROM documents UNION ALL SELECT doc_id, 2, 'markdown', 'mid' FROM documents UNION ALL SELECT doc_id, 3, 'widget', 'b' FROM documents UNION ALL SELECT doc_id, 4, 'markdown', '' FROM documents")
def _(s, d):
    t = F.concat(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")), F.lit("\n<!-- widget:chart-"), "doc_id", F.lit(" -->\n mid \n<!--widget:b-->"))
    return table(s, d, "documents").select("doc_id", F.posexplode(C.segments(t)).alias("i", "x")).select("doc_id", "i", "x.type", "x.value")


@query("heading_topics", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a-b-' || lang ELSE '' END AS topic FROM documents")
def _(s, d):
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x\n#  A  b "), "lang", F.lit(" \n# C\n"))).otherwise("## no\n")
    return table(s, d, "documents").select("doc_id", C.heading_topic(t).alias("topic"))


PLAIN = "b"
for _pattern, _by in C.MARKUP:
    PLAIN = f"regexp_replace({PLAIN}, '{_pattern}', '{_by.replace('$', chr(92))}', 'g')"
POINTS = (r"(?i)\$\d[\d,.]*\s*(?:billion|million|B|M)?", r"\d[\d,.]*%", r"(?i)\d[\d,.]*\s*(?:billion|million|thousand)", r"\b\d{3,}\b")


@query("article_evaluation", f"""WITH d AS (SELECT doc_id, '## One 1999' || chr(10) || text || chr(10) || '**bold** cost $1.4 billion, `code` 50% of [a link](http://x.org)' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '## Two' || chr(10) || '- item _x_' ELSE '' END AS b FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, b, trim({PLAIN}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM d)
SELECT doc_id, CAST(CASE WHEN t = '' THEN 0 ELSE len(regexp_split_to_array(t, '[ \\t\\n\\x0B\\f\\r]+')) END AS BIGINT) AS words, CAST(len(regexp_extract_all(b, '(?m)^##\\s+')) AS BIGINT) AS chapters, CAST({' + '.join(f"len(regexp_extract_all(b, '{k}'))" for k in POINTS)} AS BIGINT) AS data_points FROM p""")
def _(s, d):
    t = F.concat(F.lit("---\ntitle: 900 [x](y)\n---\n## One 1999\n"), "text", F.lit("\n**bold** cost $1.4 billion, `code` 50% of [a link](http://x.org)"), F.when(F.col("doc_id") % 2 == 0, "\n## Two\n- item _x_").otherwise(""))
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", C.article_figures(t).alias("f")).select("doc_id", "f.*")


@query("episode_plans", "SELECT doc_id, n_chars / 2.5 AS seconds, CASE WHEN n_chars / 2.5 <= 60 THEN 1 WHEN n_chars / 2.5 <= 120 THEN 2 WHEN n_chars / 2.5 <= 180 THEN 3 WHEN n_chars / 2.5 <= 240 THEN 4 ELSE 5 END AS parts, CASE WHEN n_chars / 2.5 <= 60 THEN 'none' WHEN doc_id % 4 >= 2 THEN 'thematic' ELSE 'narrative' END AS split FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", C.episode_plan(F.col("n_chars"), F.col("doc_id") % 4, 2.5).alias("p")).select("doc_id", "p.*")


@query("sentence_heads", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand || '.' WHEN 1 THEN 'One. Two!' ELSE 'aaaa bbbb' END AS head FROM part")
def _(s, d):
    k = F.col("p_partkey")
    t = F.when(k % 3 == 0, F.concat("p_brand", F.lit("."))).when(k % 3 == 1, "One. Two! Threeeeee?").otherwise("aaaa bbbb cccccc dd.")
    return table(s, d, "part").select("p_partkey", C.sentence_head(t, 12).alias("head"))


@query("captions", "SELECT page_id, CASE WHEN length(c) <= 2200 THEN c ELSE left(c, 2200) END AS caption FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'T' || page_id || chr(10) || chr(10) || url ELSE url END AS c FROM pages)")
def _(s, d):
    return table(s, d, "pages").select("page_id", C.caption(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" T"), "page_id", F.lit(" "))), F.concat("url", F.lit("\n"))).alias("caption"))


@query("names_and_tags", "SELECT p_partkey, '#' || lower(replace(p_brand, '#', '')) || 'x' AS tag, upper(left(p_type, 1)) || substr(p_type, 2) || ' McX' AS name FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", C.series_hashtag(F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit("-x"))).alias("tag"), C.entity_name(F.concat("p_type", F.lit("_mcX"))).alias("name")).withColumn("name", F.replace("name", F.lit("McX"), F.lit("McX")))


@query("joined_words", "SELECT p_partkey, p_brand || ', ' || p_type || '!' AS line FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", C.join_words(F.array("p_brand", F.lit(","), "p_type", F.lit("!"))).alias("line"))


LICENCE = "lower(['CC-BY-SA 4.0', 'CC BY 2.0', 'CC0', 'Public Domain', 'GFDL', 'none', 'CC'][CAST(p_partkey % 7 + 1 AS INT)] || ' ' || p_type)"


@query("attribution", f"SELECT p_partkey, contains({LICENCE}, 'cc-by') OR contains({LICENCE}, 'cc by') OR contains({LICENCE}, 'gfdl') OR (contains({LICENCE}, 'cc') AND NOT contains({LICENCE}, 'cc0') AND NOT contains({LICENCE}, 'public domain')) AS needed FROM part")
def _(s, d):
    licence = F.get(F.array(*map(F.lit, ["CC-BY-SA 4.0", "CC BY 2.0", "CC0", "Public Domain", "GFDL", "none", "CC"])), (F.col("p_partkey") % 7).cast("int"))
    return table(s, d, "part").select("p_partkey", C.needs_attribution(F.concat(licence, F.lit(" "), "p_type")).alias("needed"))


@query("platform_urls", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'u.' || user_id WHEN 2 THEN 'p' || user_id END AS handle, CASE event_id % 6 WHEN 0 THEN (7000000 + event_id)::VARCHAR WHEN 3 THEN (9000000 + event_id)::VARCHAR END AS video_id, CASE event_id % 6 WHEN 1 THEN 'AbC' || (10000 + user_id) WHEN 4 THEN 'Zz' || (10000 + user_id) END AS short_code,
CASE event_id % 6 WHEN 0 THEN 'video' WHEN 1 THEN 'short' WHEN 2 THEN 'profile' WHEN 3 THEN 'video' WHEN 4 THEN 'short' ELSE 'unknown' END AS kind,
CASE event_id % 6 WHEN 0 THEN 'https://www.tiktok.com/@u.' || user_id || '/video/' || (7000000 + event_id) WHEN 1 THEN 'https://vm.tiktok.com/AbC' || (10000 + user_id) WHEN 2 THEN 'https://www.tiktok.com/@p' || user_id WHEN 3 THEN 'https://www.tiktok.com/@i/video/' || (9000000 + event_id) WHEN 4 THEN 'www.tiktok.com/t/Zz' || (10000 + user_id) END AS canonical FROM events""")
def _(s, d):
    k, u = F.col("event_id"), F.col("user_id")
    url = (
        F.when(k % 6 == 0, F.concat(F.lit(" m.tiktok.com/@u."), u, F.lit("/video/"), k + 7000000, F.lit("?x=1")))
        .when(k % 6 == 1, F.concat(F.lit("https://vm.tiktok.com/AbC"), u + 10000, F.lit("?s=2"))).when(k % 6 == 2, F.concat(F.lit("https://tiktok.com/@p"), u, F.lit("/?lang=en")))
        .when(k % 6 == 3, (k + 9000000).cast("string")).when(k % 6 == 4, F.concat(F.lit("www.tiktok.com/t/Zz"), u + 10000)).otherwise("https://x.org")
    )
    return table(s, d, "events").select("event_id", C.platform_url(url).alias("p")).select("event_id", "p.*")


PATH = "CASE p_partkey % 5 WHEN 0 THEN '/data/media/' || p_name WHEN 1 THEN p_name || '/c..d.png' WHEN 2 THEN '../' || p_name WHEN 3 THEN p_name || '/../' || p_type ELSE '/etc/' || p_name END"


@query("path_guards", f"SELECT p_partkey, (starts_with({PATH}, '/data/media/') OR NOT starts_with({PATH}, '/')) AND NOT list_contains(string_split({PATH}, '/'), '..') AS inside FROM part")
def _(s, d):
    k, n = F.col("p_partkey") % 5, F.col("p_name")
    path = F.when(k == 0, F.concat(F.lit("/data/media/"), n)).when(k == 1, F.concat(n, F.lit("/c..d.png"))).when(k == 2, F.concat(F.lit("../"), n)).when(k == 3, F.concat(n, F.lit("/../"), "p_type")).otherwise(F.concat(F.lit("/etc/"), n))
    return table(s, d, "part").select("p_partkey", C.inside(path, "/data/media").alias("inside"))


@query("currency_notes", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'pays $' || CAST(floor(p_size * 140 + 0.5) AS BIGINT) || ' (¥' || p_size || ',000 )now' WHEN 1 THEN '$' || CAST(floor(p_size * 0.14 + 0.5) AS BIGINT) || ' billion (' || p_size || ' billion yuan) and $1 (¥8)' WHEN 2 THEN 'costs $5, that is ¥' || p_size ELSE 'nothing' END AS note FROM part")
def _(s, d):
    k = F.col("p_partkey")
    t = F.when(k % 4 == 0, F.concat(F.lit("pays ¥"), "p_size", F.lit(",000 now"))).when(k % 4 == 1, F.concat(F.col("p_size").cast("string"), F.lit(" billion yuan and ¥8"))).when(k % 4 == 2, F.concat(F.lit("costs $5, that is ¥"), "p_size")).otherwise("nothing")
    return table(s, d, "part").select("p_partkey", C.currency_notes(t).alias("note"))


@query("gap_limits", "SELECT DISTINCT l_linenumber % 5 AS attempt, CASE l_linenumber % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 0.6 WHEN 2 THEN 0.7 END AS threshold, CASE l_linenumber % 5 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 END AS frames FROM lineitem")
def _(s, d):
    a = table(s, d, "lineitem").select((F.col("l_linenumber") % 5).alias("attempt")).distinct()
    return a.select("attempt", C.gap_limits(F.col("attempt")).alias("g")).select("attempt", "g.threshold", "g.frames")


@query("bright_pixels", "SELECT p_type, count(*) AS pixels, count(*) FILTER (0.299 * (p_partkey % 256) + 0.587 * (p_size * 5) + 0.114 * 200 > 100) AS bright FROM part WHERE p_size > 3 GROUP BY p_type")
def _(s, d):
    light = C.luminance(F.col("p_partkey") % 256, F.col("p_size") * 5, F.lit(200))
    return table(s, d, "part").where("p_size > 3").groupBy("p_type").agg(F.count(F.lit(1)).alias("pixels"), F.count_if(light > 100).alias("bright"))


@query("day_offsets", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 7 + 1 AS INT) AS VARCHAR) AS day FROM orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 7 + 1).cast("int")).cast("string").alias("day"))


@query("default_names", "SELECT c_custkey, c_name AS name FROM customer")
def _(s, d):
    mail = F.concat("c_name", F.lit("@x.org"))
    return table(s, d, "customer").select("c_custkey", F.split_part(mail, F.lit("@"), F.lit(1)).alias("name"))


def _topic_sql(text: str) -> str:
    some = lambda words: " OR ".join(f"contains({text}, '{w}')" for w in words)
    return "CASE " + " ".join(f"WHEN {some(words)} THEN '{name}'" for name, words in trends.TOPICS) + " ELSE 'industry' END"


@query("topics_of_posts", f"SELECT doc_id, {_topic_sql('t')} AS topic FROM (SELECT doc_id, lower(lang || ' ' || CASE WHEN doc_id % 5 > 0 THEN text ELSE '' END) AS t FROM documents)")
def _(s, d):
    return table(s, d, "documents").select("doc_id", trends.topic_of_post(F.col("lang"), F.when(F.col("doc_id") % 5 > 0, F.col("text"))).alias("topic"))


@query("source_counts", "SELECT source, count(*) AS n FROM (SELECT unnest([source, lang]) AS source FROM documents) GROUP BY source")
def _(s, d):
    return analytics.exploded_counts(table(s, d, "documents").select(F.array("source", "lang").alias("sources")), "sources", "source")


@query("category_arrays", "SELECT event_type AS category, string_agg(event_id, ',' ORDER BY event_id) AS events FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type")
def _(s, d):
    g = analytics.category_arrays(table(s, d, "events"), "event_type", ["click", "view", "never"], "event_id")
    return g.select(F.col("event_type").alias("category"), F.array_join("items", ",").alias("events"))


@query("hit_rate_by_category", "SELECT coalesce(CASE WHEN doc_id % 3 > 0 THEN lang END, 'other') AS category, count(*) AS total, CAST(sum(quality) AS BIGINT) AS hits, CAST(floor(100.0 * sum(quality) / count(*) + 0.5) AS BIGINT) AS hit_rate, floor(100.0 * sum(quality) / count(*) + 0.5) >= 80 AS passed FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1")
def _(s, d):
    named = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").where("quality IS NOT NULL").select(F.coalesce(F.when(F.col("doc_id") % 3 > 0, F.col("lang")), F.lit("other")).alias("category"), (F.col("quality") == 1).alias("hit"))
    return vector.hit_rate(named, ["category"])


@query("log_scale", "SELECT p_partkey, round((ln(p_retailprice) - lo) / (hi - lo), 6) AS scaled FROM part, (SELECT ln(min(p_retailprice)) AS lo, ln(max(p_retailprice)) AS hi FROM part)")
def _(s, d):
    p = table(s, d, "part").select("p_partkey", F.ln("p_retailprice").alias("v"))
    return analytics.min_max(p, "p_partkey", "v").withColumn("scaled", F.round("scaled", 6))


@query("best_and_worst", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN greatest(l_discount, l_tax) ELSE least(l_discount, l_tax) END AS best FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", analytics.best_of(["l_discount", "l_tax"], F.col("l_linenumber") % 2 == 0).alias("best"))


@query("sync_deviations", "SELECT user_id, round(max(abs(value - 50)), 6) AS worst, count(*) FILTER (abs(value - 50) > 30) AS errors, count(*) FILTER (abs(value - 50) > 10 AND abs(value - 50) <= 30) AS warnings FROM events GROUP BY user_id")
def _(s, d):
    return analytics.deviations(table(s, d, "events"), ["user_id"], F.col("value") - 50, 30, 10).withColumn("worst", F.round("worst", 6))


@query("keyword_dedup", "SELECT c_nationkey, string_agg(kw, ',' ORDER BY kw) AS keywords, count(*) AS n FROM (SELECT c_nationkey, arg_min(CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) END, c_custkey) AS kw FROM customer GROUP BY c_nationkey, lower(c_mktsegment)) GROUP BY c_nationkey")
def _(s, d):
    from quillon.operators.index import first_casing

    c = table(s, d, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.initcap("c_mktsegment")).alias("kw"))
    kept = first_casing(c, ["c_nationkey"], "kw", "c_custkey")
    return kept.groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list("kw")), ",").alias("keywords"), F.count(F.lit(1)).alias("n"))


@query("duplicate_names", "SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def _(s, d):
    from quillon.operators.index import duplicates

    return duplicates(table(s, d, "part"), ["p_name"])
