"""Queries of further landed answers, scene and catalog files, validators, gates and rows that are written by rule, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import content as C
from quillon.operators import index, rules
from quillon.operators import validators as V
from quillon.operators.scratch import folder
from quillon.plans.source_queries import _json, _obj, _turns
from quillon.plans.twins import registry
from quillon.sources import apis, landed, readers
from quillon.sources.readers import table

Q, S, query = registry()

NEWS = "SELECT conv_id, turn, 0 AS i, {title} AS title, CASE WHEN turn % 2 = 0 THEN 'https://n.org/' || conv_id ELSE '' END AS url, left(text, 200) AS snippet, '2024-01-0' || (conv_id % 9 + 1) AS published, {author} AS author FROM conversations"


def _news(s, d, service, item):
    return apis.news(table(s, d, "conversations").withColumn("p", _json(**{apis.NEWS[service][0]: F.array(item)})), ["conv_id", "turn"], "p", service)


def _common():
    return {"url": F.when(F.col("turn") % 2 == 0, F.concat(F.lit("https://n.org/"), "conv_id")), "description": F.col("text")}, F.concat(F.lit("2024-01-0"), F.col("conv_id") % 9 + 1)


@query("source_gnews", NEWS.format(title="role", author="CASE WHEN conv_id % 3 = 0 THEN '' ELSE role || 's' END"))
def _(s, d):
    some, day = _common()
    return _news(s, d, "gnews", _obj(title=F.col("role"), publishedAt=day, source=F.when(F.col("conv_id") % 3 != 0, _obj(name=F.concat("role", F.lit("s")))), **some))


@query("source_currents", NEWS.format(title="role", author="CASE WHEN conv_id % 3 = 0 THEN 'cat' ELSE role END"))
def _(s, d):
    some, day = _common()
    return _news(s, d, "currents", _obj(title=F.col("role"), published=day, author=F.when(F.col("conv_id") % 3 != 0, F.col("role")).otherwise(""), source_category=F.array(F.lit("cat"), F.lit("b")), **some))


@query("source_noozra", NEWS.format(title="CASE WHEN turn % 3 = 0 THEN '' ELSE role END", author="'s' || turn"))
def _(s, d):
    some, day = _common()
    return _news(s, d, "noozra", _obj(headline=F.when(F.col("turn") % 3 != 0, F.col("role")), published_at=day, source=F.concat(F.lit("s"), "turn"), **some))


@query("source_papers", "SELECT doc_id, 0 AS i, lang AS title, CASE doc_id % 3 WHEN 0 THEN 'https://doi.org/' || doc_id WHEN 1 THEN 'https://f.org/' || doc_id ELSE '' END AS url, left(text, 200) AS snippet, CASE WHEN doc_id % 2 = 0 THEN '2023' ELSE '2022' END AS published, source || ', ' || lang AS author FROM documents")
def _(s, d):
    k = F.col("doc_id")
    work = _obj(title=F.col("lang"), abstract=F.col("text"), doi=F.when(k % 3 == 0, k.cast("string")), sourceFulltextUrls=F.when(k % 3 == 1, F.array(F.concat(F.lit("https://f.org/"), k))).otherwise(F.array().cast("array<string>")), publishedDate=F.when(k % 2 == 0, "2023").otherwise(""), depositedDate=F.lit("2022"), authors=F.array(_obj(name=F.col("source")), _obj(name=F.col("lang"))))
    return apis.papers(table(s, d, "documents").withColumn("p", _json(results=F.array(work))), ["doc_id"], "p")


@query("source_atom_updates", "SELECT page_id, 0 AS i, 'T ' || page_id AS title, CASE WHEN page_id % 2 = 0 THEN url ELSE '' END AS url, left('a ' || page_id || repeat(' s', 150), 200) AS snippet, '2024-02-03' AS published FROM pages")
def _(s, d):
    link = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<link href="'), "url", F.lit('" rel="alternate"/>'))).otherwise('<link rel="alternate" href="x"/>')
    x = F.concat(F.lit("<feed><entry><title>\nT "), "page_id", F.lit("</title>"), link, F.lit('<summary type="text">a\n'), "page_id", F.repeat(F.lit("\ns"), F.lit(150)), F.lit("</summary><updated> 2024-02-03 </updated></entry><entry><id>none</id></entry></feed>"))
    return apis.atom_updates(table(s, d, "pages").withColumn("x", x), ["page_id"], "x")


@query("source_pictures", """SELECT p_partkey, 'unsplash' AS service, 0 AS i, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END AS title, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'R' || p_partkey ELSE 'F' || p_partkey END AS url, 'image' AS type, p_size || 'x' || (p_size + 1) AS resolution, NULL AS author FROM part
UNION ALL SELECT p_partkey, 'pixabay', 0, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'R' || p_partkey ELSE 'F' || p_partkey END, 'image', p_size || 'x' || (p_size + 1), p_brand FROM part""")
def _(s, d):
    p, k = table(s, d, "part"), F.col("p_partkey")
    title, big, small = F.when(k % 3 != 0, F.col("p_name")), F.when(k % 4 > 1, F.concat(F.lit("F"), k)), F.when(k % 4 == 1, F.concat(F.lit("R"), k))
    one = _json(results=F.array(_obj(alt_description=title, urls=_obj(full=big, regular=small), width=F.col("p_size"), height=F.col("p_size") + 1)))
    two = _json(hits=F.array(_obj(tags=title, largeImageURL=big, webformatURL=small, imageWidth=F.col("p_size"), imageHeight=F.col("p_size") + 1, user=F.col("p_brand"))))
    made = [apis.pictures(p.withColumn("p", doc), ["p_partkey"], "p", name, F.col("p_type")).withColumn("service", F.lit(name)) for name, doc in (("unsplash", one), ("pixabay", two))]
    return made[0].unionByName(made[1])


@query("source_clips", "SELECT p_partkey, 0 AS i, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END AS title, 'https://cdn.coverr.co/videos/' || p_brand || '/mp4?token=' || CASE WHEN p_partkey % 2 = 0 THEN 'k' ELSE '' END AS url, 'video' AS type, CASE WHEN p_size > 25 THEN 'vertical' ELSE 'horizontal' END AS resolution, p_brand AS base_filename FROM part")
def _(s, d):
    k = F.col("p_partkey")
    doc = F.to_json(F.struct(_obj(userToken=F.when(k % 2 == 0, "k")).alias("params"), F.array(_obj(title=F.when(k % 3 != 0, F.col("p_name")), base_filename=F.col("p_brand"), is_vertical=F.col("p_size") > 25)).alias("hits")))
    return apis.clips(table(s, d, "part").withColumn("p", doc), ["p_partkey"], "p", F.col("p_type"))


@query("parse_by_name", """SELECT conv_id || '/' || turn AS key, 0 AS i, text AS title, CASE WHEN turn % 2 = 0 THEN 'https://x.org/' || conv_id ELSE 'https://news.ycombinator.com/item?id=' || (conv_id * 10 + turn) END AS url, '' AS snippet, strftime(make_timestamp((1600000000 + conv_id) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS published, role AS author FROM conversations WHERE turn % 5 <> 4""")
def _(s, d):
    hit = _obj(title=F.col("text"), url=F.when(F.col("turn") % 2 == 0, F.concat(F.lit("https://x.org/"), "conv_id")), objectID=(F.col("conv_id") * 10 + F.col("turn")).cast("string"), author=F.col("role"), created_at_i=F.lit(1600000000) + F.col("conv_id"))
    payload = F.when(F.col("turn") % 5 == 4, "{broken").otherwise(_json(hits=F.array(hit)))
    return landed.parse(_turns(s, d).select(F.concat_ws("/", "conv_id", "turn").alias("key"), payload.alias("payload")), "hn")[0]


@query("parse_errors", "SELECT conv_id || '/' || turn AS key, CASE WHEN turn % 5 = 4 THEN 'JSONDecodeError' ELSE 'ValueError' END AS error FROM conversations WHERE turn % 5 >= 3")
def _(s, d):
    payload = F.when(F.col("turn") % 5 == 4, "{broken").when(F.col("turn") % 5 != 3, _json(hits=F.array(F.lit(None).cast("string"))))
    bad = landed.parse(_turns(s, d).select(F.concat_ws("/", "conv_id", "turn").alias("key"), payload.alias("payload")), "hn")[1]
    return bad.select("key", F.substring_index("error", ":", 1).alias("error"))


@query("scene_scan", """SELECT CASE WHEN g % 2 = 0 THEN 'p-' || g ELSE 'g=' || g END AS source_id, CAST(row_number() OVER (PARTITION BY g ORDER BY conv_id, turn) - 1 AS INT) AS ordinal, conv_id || '/' || turn AS scene_id, md5(text || CASE WHEN turn % 2 = 0 THEN chr(10) || chr(10) || 'Visual: ' || role ELSE '' END) AS chunk_md5 FROM (SELECT *, conv_id % 20 AS g FROM conversations WHERE trim(text) <> '') WHERE g % 5 <> 4""")
def _(s, d):
    # landed as a file of scenes for each group of conversations, a record beside every other one; one file in five is broken
    c = table(s, d, "conversations").where("trim(text) <> ''").withColumn("g", F.col("conv_id") % 20)
    scene = F.struct(F.concat_ws("/", "conv_id", "turn").alias("id"), F.col("role").alias("name"), F.lit("v").alias("visualType"), F.col("text").alias("voiceover"), F.when(F.col("turn") % 2 == 0, F.struct(F.col("role").alias("a"))).alias("texts"))
    doc = c.groupBy("g").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "turn", scene.alias("s")))), lambda x: x["s"]).alias("scenes"))).alias("doc"))
    at = folder(s, "landed")
    broken = F.when(F.col("g") % 5 == 4, F.concat(F.lit("{"), "doc")).otherwise(F.col("doc"))
    doc.select("g", broken.alias("doc")).write.partitionBy("g").text(f"{at}/scenes")
    doc.where("g % 2 = 0").select("g", F.to_json(F.struct(F.concat(F.lit("p-"), "g").alias("pipelineId"))).alias("doc")).write.mode("append").partitionBy("g").json(f"{at}/scenes")
    rows, _ = readers.scenes(s, f"{at}/scenes", "*.txt", "*.json.none")
    meta = readers.json_files(s, f"{at}/scenes", "*.json").select(F.col("name").alias("source_id"), F.get_json_object(F.get_json_object("text", "$.doc"), "$.pipelineId").alias("_id"))
    named = rows.join(meta, "source_id", "left").withColumn("source_id", F.coalesce("_id", "source_id"))
    return named.select("source_id", "ordinal", "scene_id", F.md5(C.scene_text(F.col("voiceover"), F.col("texts"))).alias("chunk_md5"))


@query("catalog_scan", "SELECT 'm/' || p_partkey || '.png' AS file, p_name AS description, p_brand || ',' || p_type AS keywords FROM part WHERE p_partkey % 40 < 39")
def _(s, d):
    p = table(s, d, "part").withColumn("g", F.col("p_partkey") % 40)
    entry = F.struct(F.concat(F.lit("m/"), "p_partkey", F.lit(".png")).alias("file"), F.lit("image").alias("type"), F.col("p_name").alias("description"), F.array("p_brand", "p_type").alias("keywords"))
    doc = p.groupBy("g").agg(F.to_json(F.collect_list(entry)).alias("doc"))
    at = folder(s, "landed")
    doc.select("g", F.when(F.col("g") == 39, F.substr("doc", F.lit(3))).otherwise(F.col("doc")).alias("doc")).write.partitionBy("g").text(f"{at}/catalog")
    there, none = readers.catalog(s, f"{at}/catalog", "*.txt"), readers.catalog(s, f"{at}/nowhere")
    return there.unionByName(none).select("file", "description", F.array_join("keywords", ",").alias("keywords"))


def _variant(json):
    return F.try_parse_json(json)


def _errors(rows, key, column):
    return rows.select(key, F.array_join(column, ";").alias("errors"))


@query("discovery_errors", """SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'schemaVersion "2" does not match expected "1.0.0"' WHEN 1 THEN 'Missing required field: locale;Field "timeWindow" must be of type object, got string' WHEN 2 THEN 'sources[1] must have at least a url or title' WHEN 3 THEN 'sources[1] must be a plain object;failedSources[0].reason must be a non-empty string' WHEN 4 THEN 'sourceCount (5) does not match sources.length (2)' WHEN 5 THEN 'Input must be a plain object' ELSE '' END AS errors FROM pages""")
def _(s, d):
    k, u = F.col("page_id") % 7, F.to_json(F.struct("url"))
    second = F.when(k == 2, '{"url": "", "title": null}').when(k == 3, "7").otherwise('{"title": "t"}')
    doc = F.concat(
        F.lit('{"schemaVersion": "'), F.when(k == 0, "2").otherwise("1.0.0"), F.lit('", "contentId": "c", "researchRunId": "r", "timeWindow": '), F.when(k == 1, '"w"').otherwise('{"days": 3}'), F.when(k == 1, "").otherwise(', "locale": "en"'),
        F.lit(', "sources": ['), u, F.lit(", "), second, F.lit('], "failedSources": [{"name": "n", "reason": '), F.when(k == 3, '""').otherwise('"why"'), F.lit('}], "sourceCount": '), F.when(k == 4, "5").otherwise("2"), F.lit("}"),
    )
    return _errors(table(s, d, "pages"), "page_id", V.discovery_errors(_variant(F.when(k == 5, F.concat(F.lit("["), doc, F.lit("]"))).otherwise(doc))))


@query("brief_errors", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Field "researchTier" must be one of [standard, deep], got "wild"' WHEN 1 THEN 'claimsToVerify[0].question must be a non-empty string' WHEN 2 THEN 'claimsToVerify[0].riskLevel must be one of [low, medium, high], got "' || lang || '"' WHEN 3 THEN 'Missing required field: candidateSources;Field "knownFacts" must be of type array, got number' ELSE '' END AS errors FROM documents WHERE text IS NOT NULL""")
def _(s, d):
    k = F.col("doc_id") % 5
    claim = F.to_json(F.struct(F.lit("c").alias("claimId"), F.when(k == 1, "").otherwise(F.concat("text", F.lit("?"))).alias("question"), F.when(k == 2, F.col("lang")).otherwise("high").alias("riskLevel")))
    doc = F.concat(F.lit('{"schemaVersion": "1.0.0", "contentId": "c", "researchRunId": "r", "researchQuestion": "q", "researchTier": "'), F.when(k == 0, "wild").otherwise("deep"), F.lit('", "claimsToVerify": ['), claim, F.lit("]"), F.when(k == 3, ', "knownFacts": 3').otherwise(', "candidateSources": []'), F.lit("}"))
    return _errors(table(s, d, "documents").where("text IS NOT NULL"), "doc_id", V.brief_errors(_variant(doc)))


@query("evidence_errors", """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'evidence[0] missing required field: statement' WHEN 1 THEN 'evidence[0].source must be a plain object' WHEN 2 THEN 'evidence[0].source missing required field: publisher;evidence[0].verification.status must be one of [verified, context, analysis, conflicted, rejected, stale], got "odd"' WHEN 3 THEN 'evidence[1] must be a plain object;evidence[1] must be a plain object' WHEN 4 THEN 'evidence[0].sourceType must be one of [primary, authoritative-secondary, independent-secondary, community, analysis], got "rumour"' ELSE '' END AS errors FROM pages""")
def _(s, d):
    k = F.col("page_id") % 6
    source = F.when(k == 1, '["x"]').otherwise(F.concat(F.lit('{"title": "t", "accessedAt": "d", '), F.when(k == 2, "").otherwise('"publisher": "p", '), F.lit('"url": '), F.to_json(F.array("url")), F.lit("}")))
    item = F.concat(F.lit('{"evidenceId": "e", "claimId": "c", '), F.when(k == 0, "").otherwise('"statement": "s", '), F.lit('"sourceType": "'), F.when(k == 4, "rumour").otherwise("primary"), F.lit('", "source": '), source, F.lit(', "verification": {"confidence": 1, "status": "'), F.when(k == 2, "odd").otherwise("verified"), F.lit('"}}'))
    doc = F.concat(F.lit('{"schemaVersion": "1.0.0", "contentId": "c", "researchRunId": "r", "evidence": ['), item, F.when(k == 3, ", []").otherwise(""), F.lit("]}"))
    return _errors(table(s, d, "pages"), "page_id", V.evidence_errors(_variant(doc)))


@query("claim_map_errors", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'claims[0].type must be one of [fact, analysis], got "' || event_type || '"' WHEN 1 THEN 'claims[0].evidenceId must be a non-empty string for fact-type claims' WHEN 2 THEN 'claims[0] missing required field: text;claims[0].claimId must be of type string, got number' ELSE '' END AS errors FROM events""")
def _(s, d):
    k = F.col("event_id") % 4
    claim = F.concat(F.lit('{"claimId": '), F.when(k == 2, F.col("event_id").cast("string")).otherwise('"c"'), F.lit(', "type": "'), F.when(k == 0, F.col("event_type")).when(k == 2, "analysis").otherwise("fact"), F.lit('", '), F.when(k == 2, "").otherwise('"text": "t", '), F.lit('"evidenceId": '), F.when(k == 1, '""').otherwise('"e"'), F.lit("}"))
    return _errors(table(s, d, "events"), "event_id", V.claim_map_errors(_variant(F.concat(F.lit('{"schemaVersion": "1.0.0", "contentId": "c", "researchRunId": "r", "claims": ['), claim, F.lit("]}")))))


@query("media_errors", """SELECT p_partkey, p_partkey % 8 NOT IN (1, 2) AS valid, CASE p_partkey % 8 WHEN 1 THEN 'Invalid media type: "' || p_type || '". Must be "image" or "video".' WHEN 2 THEN 'Media path is required.' ELSE '' END AS errors,
CASE p_partkey % 8 WHEN 3 THEN 'Media file not found: a/' || p_partkey || '. Scene will fall back to CSS background.' WHEN 4 THEN 'Unknown animation preset: "' || p_brand || '". Will use "fade" instead.;ken' WHEN 5 THEN 'ken-burns animation is not supported for video. Will use "fade" instead.' WHEN 6 THEN 'Volume ' || p_size || ' is out of range [0, 1]. Will be clamped at render time.' WHEN 7 THEN 'Unknown media mode: "x". Will use "background" instead.;Unknown fit value: "y". Will use "cover" instead.;Unknown focus value: "z". Will use "center" instead.' ELSE '' END AS warnings FROM part""".replace(";ken'", "'"))
def _(s, d):
    p, k = table(s, d, "part"), F.col("p_partkey") % 8
    media = F.struct(
        F.when(k == 1, F.col("p_type")).when(k == 5, "video").otherwise("image").alias("type"), F.when(k != 2, F.concat(F.lit("a/"), "p_partkey")).alias("path"), F.when(k == 4, F.col("p_brand")).when(k == 5, "ken-burns").alias("animation"), F.when(k == 7, "x").alias("mode"),
        F.when(k == 6, F.col("p_size").cast("double") + 0).otherwise(0.5).alias("volume"), F.when(k == 7, "y").alias("fit"), F.when(k == 7, "z").alias("focus"),
    )
    m = p.where("p_partkey % 8 <> 6 OR p_size > 1").select("p_partkey", V.media_errors(F.when(k != 0, media), k != 3).alias("m"))
    rest = p.where("p_partkey % 8 = 6 AND p_size <= 1").select("p_partkey", F.struct(F.lit(True).alias("valid"), F.array().cast("array<string>").alias("errors"), F.array(F.concat(F.lit("Volume "), "p_size", F.lit(" is out of range [0, 1]. Will be clamped at render time."))).alias("warnings")).alias("m"))
    return m.unionByName(rest).select("p_partkey", "m.valid", F.array_join("m.errors", ";").alias("errors"), F.array_join("m.warnings", ";").alias("warnings"))


GATE = "SELECT p_partkey, {level} AS level, '{category}' AS category, '{check}' AS \"check\" FROM part WHERE {where}"


def _gate_sql() -> str:
    k = "p_partkey"
    known, read = f"{k} % 11 <> 0", f"{k} % 7 <> 0"
    level = lambda ok, bad: f"CASE WHEN {ok} THEN 'pass' ELSE '{bad}' END"
    rows = [GATE.format(level="'error'", category="Meta", check="meta loads", where=f"{k} % 11 = 0")]
    rows += [GATE.format(level=level("true" if f != "article" else f"{k} % 2 = 0", "error"), category="Meta", check=f"meta.{f} exists", where=known) for f in rules.META]
    rows += [GATE.format(level=level("true" if f in ("topics", "keyEntities") else "false", "warning"), category="Meta", check=f"meta.{f} exists (extended)", where=known) for f in rules.META_MORE]
    rows += [GATE.format(level=level("true" if f != "totalParts" else "false", "warning"), category="Meta", check=f"meta.{f} exists (series)", where=f"{known} AND {k} % 3 = 0") for f in rules.META_SERIES]
    rows += [GATE.format(level=level("true" if f != "people" else "false", "error"), category="Meta", check=f"meta.keyEntities.{f} is array", where=known) for f in rules.META_LISTS]
    rows.append(GATE.format(level=level(read, "error"), category="Specs", check="video can be read", where="true"))
    rows.append(GATE.format(level=level(f"{k} % 2 = 0", "error"), category="Specs", check="Resolution 1080×1920 (9:16)", where=read))
    rows.append(GATE.format(level=level("p_size BETWEEN 23 AND 60", "error"), category="Specs", check="Frame rate (23-60fps)", where=read))
    seconds = "floor(p_retailprice * 1000 + 0.5) / 1000"
    rows.append(GATE.format(level=level(f"{seconds} <= 70", "warning"), category="Duration", check="TikTok optimal (60-70s)", where=f"{read} AND {seconds} <= 600"))
    rows.append(GATE.format(level="'error'", category="Duration", check="TikTok max (600s/10min)", where=f"{read} AND {seconds} > 600"))
    rows.append(GATE.format(level=level(f"{k} % 5 > 0", "error"), category="Subtitles", check="All scenes have subtitle timing", where=read))
    rows.append(GATE.format(level="'pass'", category="Subtitles", check="Scene 1 (hook) has subtitles", where=read))
    rows += [GATE.format(level="'manual'", category="Publish", check=c, where=read) for c in rules.BY_HAND]
    return " UNION ALL ".join(rows)


@query("final_gate", _gate_sql())
def _(s, d):
    k = F.col("p_partkey")
    meta = F.concat(F.lit('{"subject": "s", "pipelineId": "p", "title": '), F.to_json(F.struct(F.col("p_name").alias("x"))), F.when(k % 2 == 0, ', "article": "a"').otherwise(', "article": ""'), F.when(k % 3 == 0, ', "seriesId": "a-b", "partNumber": 1').otherwise(""), F.lit(', "topics": ["t"], "keyEntities": {"companies": [], "people": "none", "models": ["m"]}}'))
    probe = F.when(k % 7 != 0, F.struct(F.lit(1080).alias("width"), F.when(k % 2 == 0, 1920).otherwise(1080).alias("height"), F.col("p_size").alias("fps"), F.floor(F.col("p_retailprice") * 1000 + 0.5).alias("duration_ms")))
    return rules.final_gate(table(s, d, "part"), ["p_partkey"], _variant(F.when(k % 11 != 0, meta)), probe, k % 5 > 0, F.lit(True))


@query("updated_rows", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN '2024-06-01 00:00:00' ELSE '2020-01-01 00:00:00' END AS updated_at FROM orders")
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", F.lit("2020-01-01").cast("timestamp").alias("updated_at"))
    to = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("new").alias("o_orderstatus"))
    return index.update_rows(o, to, ["o_orderkey"], F.lit("2024-06-01").cast("timestamp")).withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@query("first_user_is_admin", "SELECT 'none yet' AS start, c_custkey, CASE WHEN c_custkey = (SELECT min(c_custkey) FROM customer) THEN 'admin' ELSE 'user' END AS role FROM customer UNION ALL SELECT 'some', c_custkey, 'user' FROM customer WHERE c_custkey % 2 = 1")
def _(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_name")
    none = index.new_users(c.limit(0), c.union(c.where("c_custkey % 9 = 0")), "c_custkey", ["c_custkey"])[1]
    some = index.new_users(c.where("c_custkey % 2 = 0"), c, "c_custkey", ["c_custkey"])[1]
    return none.select(F.lit("none yet").alias("start"), "*").union(some.select(F.lit("some").alias("start"), "*"))


@query("send_log", "SELECT c_nationkey AS newsletter, c_custkey AS recipient, CASE WHEN c_custkey % 2 = 0 THEN 'before' ELSE 'now' END AS status FROM customer")
def _(s, d):
    c = table(s, d, "customer").select(F.col("c_nationkey").alias("newsletter"), F.col("c_custkey").alias("recipient"))
    log = c.where("recipient % 2 = 0").withColumn("status", F.lit("before"))
    sends = c.withColumn("status", F.lit("now"))
    once = index.append_log(log, sends, ["newsletter", "recipient"])
    return index.append_log(once, sends, ["newsletter", "recipient"])  # again: nothing is added
