"""Queries of posts, model answers, documents that refer to each other, articles and staged evaluation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.answers import parse_answer
from quillon.operators import captions, cascade, documents
from quillon.operators.scratch import folder
from quillon.plans.twins import registry
from quillon.sources.readers import table

Q, S, query = registry()

BRAND = captions.Brand(("#daily", "#news"), ("#daily", "#report", "#facts"), ("daily", "data"), " | Data Daily", "Did this change your mind? Let me know below", "Follow for more.")
#: The dictionary: words of the benchmark of six letters and more, of two kinds.
WORD = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS w FROM benchmark"
TERMS = f"""t AS (SELECT w, CAST(row_number() OVER (ORDER BY w) - 1 AS INT) AS place FROM ({WORD})),
ent AS (SELECT place, w AS keyword, '#' || left(w, 4) AS tag FROM t WHERE w < 'n'), nam AS (SELECT place, upper(left(w, 1)) || substr(w, 2) AS name FROM t WHERE w >= 'n'),
tag AS (SELECT tag, min(place) AS place FROM ent GROUP BY tag)"""
CUT = "(CASE WHEN length({t}) <= {n} THEN {t} ELSE regexp_replace(CASE WHEN length(regexp_extract(left({t}, {n}), '(?s)^(.*) ', 1)) > 0 THEN regexp_extract(left({t}, {n}), '(?s)^(.*) ', 1) ELSE left({t}, {n}) END, '\\s+$', '') END)"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _dictionary(s, d):
    words = table(s, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), 0)).alias("w")).distinct()
    t = captions.ranked(words, ["w"], ["w"])
    return t.where("w < 'n'").select("place", F.col("w").alias("keyword"), F.concat(F.lit("#"), F.left("w", F.lit(4))).alias("tag")), t.where("w >= 'n'").select("place", F.initcap("w").alias("name"))


SUFFIXED = f"CASE WHEN contains(lower({{c}}), 'daily') OR contains(lower({{c}}), 'data') THEN {{c}} WHEN {{derived}} AND {{c}} = '' THEN '' WHEN {{derived}} AND length({{c}}) <= 47 THEN {{c}} || ' | Data Daily' ELSE {CUT.format(t='{c}', n=47)} || ' | Data Daily' END"


@query("post_texts", rf"""WITH {TERMS}, s AS (SELECT conv_id, turn, role, text, lower(text || ' ' || CASE WHEN turn % 2 = 0 THEN '{{"title":"' || role || '"}}' ELSE '{{}}' END) AS low, regexp_extract_all(text, '\$?[0-9.]+\s*(?:billion|million|B|M)\b', 0, 'i') AS am FROM conversations),
hit AS (SELECT DISTINCT conv_id, place FROM s, t WHERE contains(low, w)),
et AS (SELECT conv_id, list(tag ORDER BY tp) AS tags FROM (SELECT DISTINCT conv_id, tag.tag, tag.place AS tp FROM hit JOIN ent USING (place) JOIN tag ON tag.tag = ent.tag) GROUP BY conv_id),
en AS (SELECT conv_id, list(name ORDER BY place)[1:3] AS names FROM hit JOIN nam USING (place) GROUP BY conv_id),
f AS (SELECT conv_id, arg_min(CASE WHEN turn % 2 = 0 THEN role || ': ' ELSE '' END || trim(string_split(regexp_replace(text, '[.!?]', chr(1), 'g'), chr(1))[1], {BLANKS}), turn) AS made, flatten(list(am ORDER BY turn))[1:3] AS am, arg_min(text, turn) AS voice FROM s GROUP BY conv_id),
g AS (SELECT conv_id, upper(left(made, 1)) || substr(made, 2) AS made, voice, coalesce(list_transform(am, lambda x: regexp_replace(x, '\s+', ' ', 'g')), []) AS am, coalesce(names, []) AS n, list_distinct_in_order AS tags FROM f LEFT JOIN en USING (conv_id) LEFT JOIN (SELECT conv_id, ['#daily', '#news'] || list_filter(tags, lambda x: x NOT IN ('#daily', '#news')) AS list_distinct_in_order FROM et) USING (conv_id)),
k AS (SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN nullif(trim(left(voice, 100), {BLANKS}), '') END AS given, made, CASE WHEN len(am) >= 2 THEN am[1] || ' or ' || am[2] || ' — which surprised you more?' WHEN len(n) >= 2 THEN 'Will ' || n[1] || ' catch up to ' || n[2] || '? Why or why not?' WHEN len(n) = 1 THEN 'What''s your take on ' || n[1] || '? Overhyped or underrated?' ELSE 'Did this change your mind? Let me know below' END AS hook,
 CASE WHEN conv_id % 5 = 0 AND conv_id % 7 > 0 THEN list_transform(range(least(conv_id % 7, 5)), lambda i: '#g' || i) ELSE coalesce(tags, ['#daily', '#news'])[1:5] END AS tags FROM g),
c AS (SELECT *, {CUT.format(t="coalesce(given, made)", n=60)} AS cut FROM k)
SELECT conv_id AS content, CASE WHEN given IS NULL THEN {SUFFIXED.format(c="cut", derived="true")} ELSE {SUFFIXED.format(c="cut", derived="false")} END AS title, array_to_string(CASE len(tags) WHEN 1 THEN tags || ['#daily', '#report'] WHEN 2 THEN tags || CASE WHEN list_contains(tags, '#daily') THEN ['#report'] ELSE ['#daily'] END ELSE tags END, ' ') AS hashtags, hook,
 CASE WHEN conv_id % 3 = 0 THEN hook || chr(10) || chr(10) || 'Full analysis: https://x.org/' || conv_id ELSE hook END AS pinned FROM c""")
def _(s, d):
    c, k = table(s, d, "conversations"), F.col("conv_id")
    scenes = c.select(k.alias("content"), F.col("turn").alias("ordinal"), F.col("text").alias("voiceover"), F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("role").alias("title")))).otherwise("{}").alias("texts"))
    tags = F.when((k % 5 == 0) & (k % 7 > 0), F.transform(F.sequence(F.lit(0).cast("long"), k % 7 - 1), lambda i: F.concat(F.lit("#g"), i)))
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("voice"))
    posts = first.select(
        k.alias("content"), F.when(k % 4 == 0, F.left("voice", F.lit(100))).alias("title"), F.lit(None).cast("string").alias("description"), tags.alias("hashtags"), F.lit(None).cast("string").alias("hook"),
        F.when(k % 3 == 0, F.concat(F.lit(" https://x.org/"), k)).alias("url"), F.lit(None).cast("string").alias("entity"),
    )
    return captions.post_texts(scenes, posts, *_dictionary(s, d), BRAND).select("content", "title", F.array_join("hashtags", " ").alias("hashtags"), "hook", "pinned")


PLAIN = f"trim(regexp_replace(text, '[#`]', ' ', 'g'), {BLANKS})"


@query("model_answers", rf"""WITH d AS (SELECT doc_id, doc_id % 6 AS k, {PLAIN} AS t, lang, source FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(CASE k WHEN 5 THEN '' ELSE t END) AS description_md5, CASE k WHEN 1 THEN lang || '|' || source WHEN 2 THEN lang || '|two' WHEN 3 THEN 'one,' ELSE '' END AS subjects, CASE k WHEN 1 THEN 'Talking' END AS content_kind, CASE k WHEN 1 THEN 'cover' WHEN 2 THEN 'contain' END AS fit, CASE k WHEN 2 THEN 'last' WHEN 5 THEN 'why' END AS reason, CASE k WHEN 3 THEN 'odd_part=x' WHEN 4 THEN '' WHEN 0 THEN '' ELSE '' END AS more FROM d""")
def _(s, d):
    k, t = F.col("doc_id") % 6, F.btrim(F.regexp_replace("text", "[#`]", " "), F.lit(" \t\n\x0b\f\r"))
    section = lambda name, *value: F.concat(F.lit(f"## {name}\n"), *value, F.lit("\n"))
    raw = (
        F.when(k == 1, F.concat(F.lit("```markdown\nnot this\n"), section("Description", t), section("Subjects", "lang", F.lit(" , "), "source"), section("Content Kind", F.lit("Talking")), section("FIT", F.lit(" COVER ")), F.lit("```\n")))
        .when(k == 2, F.concat(section("Reason", F.lit("first")), section("Description", t), section("Subjects", "lang", F.lit("\n two")), section("Fit", F.lit("contain")), section("Reason", F.lit("last"))))
        .when(k == 3, F.concat(section("Description", t), section("Subjects", F.lit("one,")), section("Odd Part", F.lit("x")), section("Fit", F.lit("stretch"))))
        .when(k == 4, F.concat(F.lit("```\n"), t, F.lit("\n```"))).when(k == 5, section("Reason", F.lit("why"))).otherwise(F.concat(F.lit("  "), t, F.lit("\n")))
    )
    a = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", parse_answer(raw).alias("a"))
    more = F.array_join(F.transform(F.map_entries("a.more"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return a.select("doc_id", F.md5("a.description").alias("description_md5"), F.array_join("a.subjects", "|").alias("subjects"), "a.content_kind", "a.fit", "a.reason", more.alias("more"))


def _doc_files(s, d):
    k = F.col("doc_id")
    name = F.concat(F.when(k % 10 == 9, "spec-").otherwise("d"), k, F.lit(".md"))
    link = lambda i: F.concat(F.lit(" [x](./d"), i, F.lit(".md#part)"))
    text = F.concat(
        F.coalesce("text", F.lit("")), F.lit("\n"), link(2 * k + 1), F.when(k % 9 != 5, link(2 * k + 2)).otherwise(""), F.when(k % 10 == 7, link(F.floor((k - 1) / 2).cast("long"))).otherwise(""), F.lit(" [out](https://x.org)\n"),
        F.when(k % 3 == 0, "see docs/research/a\n").otherwise(""), F.when(k % 6 == 0, "##  Design Decisions\n").otherwise(""), F.repeat(F.lit("run: npm run x\n"), (k % 7).cast("int")),
    )
    return table(s, d, "documents").select("doc_id", name.alias("name"), text.alias("content"), (k % 2 + 1).cast("int").alias("level"))


NAMES = "n AS (SELECT doc_id AS k, CASE WHEN doc_id % 10 = 9 THEN 'spec-' ELSE 'd' END || doc_id || '.md' AS name FROM documents)"


@query("doc_lint", f"""WITH {NAMES} SELECT name, 'FAIL' AS level, 'index' AS category, 'docs-index-missing' AS "check", name AS detail FROM n WHERE k % 10 <> 9 AND k % 4 = 1
UNION ALL SELECT name, 'FAIL', 'structure', 'l1-missing-design-decisions', name FROM n WHERE k % 2 = 0 AND k % 10 <> 9 AND k % 3 = 0 AND k % 6 <> 0
UNION ALL SELECT name, 'WARN', 'content', 'l2-execution-instructions', (k % 7)::VARCHAR FROM n WHERE k % 2 = 1 AND k % 7 >= 5""")
def _(s, d):
    docs = _doc_files(s, d)
    lines = docs.where("doc_id % 4 <> 1").select(F.concat(F.lit("- see "), "name", F.lit(" for more")).alias("line"))
    return documents.lint(docs, "name", "content", "level", lines, ("docs/research/",))


GRAPH = f"""{NAMES}, e AS (SELECT DISTINCT name AS a, t AS b FROM (SELECT name, 'd' || (2 * k + 1) || '.md' AS t FROM n UNION ALL SELECT name, 'd' || (2 * k + 2) || '.md' FROM n WHERE k % 9 <> 5 UNION ALL SELECT name, 'd' || CAST(floor((k - 1) / 2) AS BIGINT) || '.md' FROM n WHERE k % 10 = 7)),
r AS (SELECT a, b FROM e WHERE b IN (SELECT name FROM n))"""


@query("doc_graph", f"""WITH RECURSIVE {GRAPH}, seen AS (SELECT name FROM n WHERE name = 'd0.md' UNION SELECT b FROM r JOIN seen ON a = name),
far AS (SELECT a, b FROM r UNION SELECT far.a, r.b FROM far JOIN r ON far.b = r.a), ring AS (SELECT a AS c FROM far WHERE a = b),
mid AS (SELECT name FROM n WHERE name IN (SELECT c FROM ring) OR (EXISTS (SELECT 1 FROM far WHERE b = name AND a IN (SELECT c FROM ring)) AND EXISTS (SELECT 1 FROM far WHERE a = name AND b IN (SELECT c FROM ring))))
SELECT a AS name, 'dead-link' AS "check", 'FAIL' AS level, b AS detail FROM e WHERE b NOT IN (SELECT name FROM n)
UNION ALL SELECT name, 'orphan', 'WARN', '' FROM n WHERE name NOT IN (SELECT name FROM seen) AND name <> 'd0.md' UNION ALL SELECT name, 'circular', 'WARN', '' FROM mid""")
def _(s, d):
    return documents.graph_findings(_doc_files(s, d), "name", "content", "d0.md")


GATE_BODY = "chr(10) || text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '## Sources' || chr(10) || '(a) [x](https://a.org))' ELSE ' Source: none' END || CASE WHEN doc_id % 4 = 1 THEN ' Robust <!-- widget:w-' || doc_id % 8 || ' -->' ELSE '' END"
SPLIT = "regexp_split_to_array(b, '[ \\t\\n\\x0B\\f\\r]+')"


@query("article_gate", rf"""WITH d AS (SELECT doc_id, {GATE_BODY} AS b, doc_id % 4 = 1 AS w, length(lang || repeat('e', CAST(doc_id % 200 AS INT))) AS ex FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 'FAIL' AS level, 'B1' AS category, 'Frontmatter format' AS "check", '' AS detail FROM d WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, 'FAIL', 'B2', 'Language', len(regexp_extract_all(b, '[一-龥]'))::VARCHAR FROM d WHERE len(regexp_extract_all(b, '[一-龥]')) > 0
UNION ALL SELECT doc_id, 'FAIL', 'B3', 'Widget registration', 'w-' || doc_id % 8 FROM d WHERE w AND doc_id % 8 = 5
UNION ALL SELECT doc_id, 'FAIL', 'B4', 'Source citations', '' FROM d WHERE NOT contains(b, '(')
UNION ALL SELECT doc_id, 'FAIL', 'B5', 'Link completeness', len(regexp_extract_all(b, '\[[^\]]+\]\(https?://[^/]+\)\)'))::VARCHAR FROM d WHERE len(regexp_extract_all(b, '\[[^\]]+\]\(https?://[^/]+\)\)')) > 0
UNION ALL SELECT doc_id, 'FAIL', 'B8', 'AI vocabulary', array_to_string(list_filter(['leverage', 'utilize', 'facilitate', 'delve', 'seamless', 'robust'], lambda x: contains(lower(b), x)), ', ') FROM d WHERE len(list_filter(['leverage', 'utilize', 'facilitate', 'delve', 'seamless', 'robust'], lambda x: contains(lower(b), x))) > 0
UNION ALL SELECT doc_id, 'WARN', 'W1', 'Word count', len(list_filter({SPLIT}, lambda x: regexp_full_match(x, '[a-zA-Z]+')))::VARCHAR FROM d WHERE len(list_filter({SPLIT}, lambda x: regexp_full_match(x, '[a-zA-Z]+'))) NOT BETWEEN 800 AND 3000
UNION ALL SELECT doc_id, 'WARN', 'W2', 'Excerpt length', ex::VARCHAR FROM d WHERE ex > 160 AND doc_id % 5 <> 0
UNION ALL SELECT doc_id, 'WARN', 'W4', 'Section count', n::VARCHAR FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(chr(10) || b, '\n## '), lambda x: regexp_replace(x, '\s', '', 'g') <> '')) AS n FROM d) WHERE n NOT BETWEEN 6 AND 10
UNION ALL SELECT doc_id, 'WARN', 'W5', 'SEO keywords', '' FROM d WHERE doc_id % 7 <> 0""")
def _(s, d):
    k = F.col("doc_id")
    excerpt = F.when(k % 5 != 0, F.concat(F.lit("excerpt: "), "lang", F.repeat(F.lit("e"), (k % 200).cast("int")), F.lit("\n"))).otherwise("")
    front = F.concat(F.lit("---\ntitle: T\n# a note: no field\nslug: s"), F.when(k % 7 == 0, "-vision").otherwise(""), F.lit("\n"), excerpt, F.lit("published: true\n---"))
    widget = F.when(k % 4 == 1, F.concat(F.lit(" Robust <!-- widget:w-"), k % 8, F.lit(" -->"))).otherwise("")
    article = F.concat(front, F.lit("\n"), "text", F.when(k % 3 == 0, "\n## Sources\n(a) [x](https://a.org))").otherwise(" Source: none"), widget)
    known = table(s, d, "documents").where("doc_id % 8 = 1").select(F.lit("w-1").alias("widget")).limit(1)
    return documents.article_gate(table(s, d, "documents").where("text IS NOT NULL").select("doc_id", article.alias("text")), "doc_id", "text", known, ("vision", "open source"))


def _stages() -> list[cascade.Stage]:
    score = cascade.Stage("score", ("p_size", "p_brand"), "int", lambda r: r.select("_hash", F.col("p_size").alias("result")), lambda c: c >= 20)
    focus = cascade.Stage("focus", ("p_type",), "string", lambda r: r.select("_hash", F.upper(F.left("p_type", F.lit(3))).alias("result")), lambda c: c != "PRO")
    words = cascade.Stage("words", ("p_name", "focus"), "string", lambda r: r.select("_hash", F.concat("focus", F.lit(":"), F.reverse("p_name")).alias("result")), lambda c: c.isNotNull())
    return [score, focus, words]


RUN = "(SELECT *, p_size >= 20 AS k1, upper(left(p_type, 3)) <> 'PRO' AS k2 FROM part)"


@query("cascade_rows", f"SELECT p_partkey, p_size AS score, CASE WHEN k1 THEN upper(left(p_type, 3)) END AS focus, CASE WHEN k1 AND k2 THEN upper(left(p_type, 3)) || ':' || reverse(p_name) END AS words, CASE WHEN NOT k1 THEN 'score' WHEN NOT k2 THEN 'focus' ELSE 'words' END AS stage FROM {RUN}")
def _(s, d):
    return cascade.run(table(s, d, "part"), _stages(), folder(s, "cascade"))[0].select("p_partkey", "score", "focus", "words", "stage")


@query("cascade_counts", f"""WITH c AS (SELECT 0 AS place, 'score' AS stage, count(*) AS seen, count(DISTINCT (p_size, p_brand)) AS computed, count(*) FILTER (k1) AS passed FROM {RUN}
UNION ALL SELECT 1, 'focus', count(*), count(DISTINCT p_type), count(*) FILTER (k2) FROM {RUN} WHERE k1 UNION ALL SELECT 2, 'words', count(*), count(DISTINCT (p_name, upper(left(p_type, 3)))), count(*) FROM {RUN} WHERE k1 AND k2)
SELECT 1 AS run, * FROM c UNION ALL SELECT 2, place, stage, seen, 0, passed FROM c""")
def _(s, d):
    path = folder(s, "cascade")
    runs = [cascade.run(table(s, d, "part"), _stages(), path)[1].select(F.lit(i).alias("run"), "*") for i in (1, 2)]  # the second computes nothing
    return runs[0].union(runs[1])
