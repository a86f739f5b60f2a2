"""Queries over the star schema, events, embeddings and labels, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import analytics, assets, evidence, index, rankings, timeline, trends, vector
from quillon.sources.readers import table

Q: dict = {}
S: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


RAW = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
SIM = f"round({RAW}, 6)"
PROBE = "(SELECT embedding FROM embeddings WHERE vec_id = 7)"


def _probe(s, d):
    return table(s, d, "embeddings").where("vec_id = 7")  # one row


@query("vector_topk", f"SELECT a.vec_id, {SIM} AS similarity, CASE WHEN {SIM} >= 0.6 THEN 'high' WHEN {SIM} >= 0.5 THEN 'low' ELSE 'noise' END AS band FROM embeddings a, {PROBE} b WHERE {RAW} > 0.1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(s, d):
    return vector.topk(table(s, d, "embeddings"), _probe(s, d), 10, 0.1).select("vec_id", "similarity", vector.band(F.col("similarity")).alias("band"))


@query("vector_topk_filtered", f"SELECT a.vec_id, a.label, {SIM} AS similarity FROM embeddings a, {PROBE} b WHERE a.label IN (2, 3) AND {RAW} > 0 ORDER BY 3 DESC, 1 LIMIT 10")
def _(s, d):
    return vector.topk(table(s, d, "embeddings"), _probe(s, d), 10, 0.0, F.col("label").isin(2, 3)).select("vec_id", "label", "similarity")


BATCH = f"""(SELECT q AS query_id, vec_id, similarity, rank FROM (SELECT b.vec_id AS q, a.vec_id, {SIM} AS similarity, row_number() OVER (PARTITION BY b.vec_id ORDER BY {SIM} DESC, a.vec_id) AS rank
FROM embeddings a JOIN embeddings b ON b.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 5)"""


def _batch(s, d):
    e = table(s, d, "embeddings")
    return vector.batch_topk(e, e.where("vec_id % 50 = 0"), 5)


@query("vector_batch_topk", f"SELECT * FROM {BATCH}")
def _(s, d):
    return _batch(s, d)


@query("vector_confidence_bands", f"SELECT query_id, count(*) FILTER (similarity >= 0.6) AS high, count(*) FILTER (similarity >= 0.5 AND similarity < 0.6) AS low, count(*) FILTER (similarity < 0.5) AS noise FROM {BATCH} GROUP BY 1")
def _(s, d):
    b = vector.band(F.col("similarity"))
    return analytics.band_counts(_batch(s, d), ["query_id"], {x: b == x for x in ("high", "low", "noise")})


@query("retrieval_hit_rate", f"""SELECT category, count(*) AS total, CAST(sum(hit::INT) AS BIGINT) AS hits, CAST(floor(100 * sum(hit::INT) / count(*) + 0.5) AS BIGINT) AS hit_rate, floor(100 * sum(hit::INT) / count(*) + 0.5) >= 80 AS passed
FROM (SELECT query_id, q.label AS category, bool_or(v.label = q.label) AS hit FROM {BATCH} t JOIN embeddings q ON q.vec_id = query_id JOIN embeddings v ON v.vec_id = t.vec_id GROUP BY 1, 2) GROUP BY category""")
def _(s, d):
    e = table(s, d, "embeddings")
    named = _batch(s, d).join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("category")), "query_id").join(e.select("vec_id", "label"), "vec_id")
    return vector.hit_rate(named.groupBy("query_id", "category").agg(F.bool_or(F.col("label") == F.col("category")).alias("hit")), ["category"])


@query("vector_centroids", "SELECT label, pos, round(avg(x), 5) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY label, pos")
def _(s, d):
    x = table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return x.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


DAILY = "(SELECT user_id, CAST(ts AS DATE) AS day, CAST(floor(avg(value)) AS BIGINT) AS position FROM events WHERE event_type <> 'error' GROUP BY 1, 2)"


def _daily(s, d):
    # added up in the order of events, as a scan of the table does: another order can put an average at a whole number on its other side
    e = table(s, d, "events").where("event_type <> 'error'").select("user_id", F.to_date("ts").alias("day"), "event_id", "value")
    return analytics.ordered_averages(e, ["user_id", "day"], "event_id", "value").select("user_id", "day", F.floor("average").cast("long").alias("position"))


LATEST = f"(SELECT * FROM (SELECT user_id, day, position, lead(position) OVER w AS previous_position, row_number() OVER w AS rn FROM {DAILY} WINDOW w AS (PARTITION BY user_id ORDER BY day DESC)) WHERE rn = 1)"


@query("rank_latest_prev", f"SELECT user_id, CAST(day AS VARCHAR) AS day, position, previous_position, previous_position - position AS delta FROM {LATEST}")
def _(s, d):
    return rankings.latest_and_previous(_daily(s, d), "user_id", "day", "position").withColumn("day", F.col("day").cast("string"))


@query("rank_alerts", f"SELECT user_id, CASE WHEN previous_position IS NULL THEN false WHEN position IS NULL THEN true ELSE position - previous_position >= 10 END AS dropped FROM {LATEST}")
def _(s, d):
    r = rankings.latest_and_previous(_daily(s, d), "user_id", "day", "position")
    return r.select("user_id", rankings.is_drop(F.col("position"), F.col("previous_position"), 10, True).alias("dropped"))


@query("rank_history30", f"SELECT user_id, count(*) AS n, string_agg(position, ',' ORDER BY day) AS history FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS rn FROM {DAILY}) WHERE rn <= 30 GROUP BY user_id")
def _(s, d):
    h = rankings.history(_daily(s, d), "user_id", "day", "position", 30)
    return h.select("user_id", F.size("history").cast("long").alias("n"), F.nullif(F.array_join(F.transform("history", lambda x: x.position.cast("string")), ","), F.lit("")).alias("history"))


@query("asof_prior", f"SELECT user_id, arg_max(position, day) AS prior_position, CAST(max(day) AS VARCHAR) AS prior_day FROM {DAILY} WHERE day < DATE '2024-01-20' GROUP BY user_id")
def _(s, d):
    return rankings.prior(_daily(s, d), "user_id", "day", "position", F.lit("2024-01-20").cast("date")).withColumn("prior_day", F.col("prior_day").cast("string"))


@query("metric_totals", "SELECT event_type, count(*) AS n, round(sum(coalesce(value, 0)), 2) AS total_value FROM events GROUP BY event_type")
def _(s, d):
    return analytics.totals(table(s, d, "events"), ["event_type"], ["value"]).withColumn("total_value", F.round("total_value", 2))


@query("ab_best_variant", "SELECT variable, variant, score FROM (SELECT *, count(*) OVER (PARTITION BY variable) AS n, row_number() OVER (PARTITION BY variable ORDER BY score DESC, variant) AS rn FROM (SELECT o_orderpriority AS variable, o_orderstatus AS variant, round(avg(o_totalprice), 2) * count(*) AS score FROM orders GROUP BY 1, 2)) WHERE rn = 1 AND n >= 2")
def _(s, d):
    r = table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("variable"), F.col("o_orderstatus").alias("variant")).agg(F.round(F.avg("o_totalprice"), 2).alias("a"), F.count(F.lit(1)).alias("c"))
    return analytics.best_variant(r, "variable", "variant", F.col("a") * F.col("c"))


@query("source_stats", "SELECT source, count(*) AS n, count(DISTINCT lang) AS langs FROM documents GROUP BY source")
def _(s, d):
    return table(s, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lang").alias("langs"))


@query("source_pivot", "SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY source")
def _(s, d):
    return table(s, d, "documents").groupBy("source").pivot("lang", ["en", "fr", "de", "es"]).count().na.fill(0)


@query("conditional_counts", "SELECT user_id, count(*) FILTER (event_type = 'purchase') AS sent, count(*) FILTER (event_type = 'error') AS failed, CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'sent' WHEN count(*) FILTER (event_type = 'purchase') = 0 THEN 'failed' ELSE 'partial' END AS status FROM events GROUP BY user_id")
def _(s, d):
    c = analytics.band_counts(table(s, d, "events"), ["user_id"], {"sent": F.col("event_type") == "purchase", "failed": F.col("event_type") == "error"})
    return c.withColumn("status", F.when(F.col("failed") == 0, "sent").when(F.col("sent") == 0, "failed").otherwise("partial"))


@query("fresh_events", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY")
def _(s, d):
    return trends.fresh(table(s, d, "events"), F.col("ts"), F.lit("2024-01-30").cast("timestamp"), 7).select("event_id")


@query("time_window_keep_undated", "SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN ts END AS t FROM events) WHERE t IS NULL OR t >= TIMESTAMP '2024-01-30' - INTERVAL 3 DAY")
def _(s, d):
    e = table(s, d, "events").select("event_id", F.when(F.col("event_id") % 9 != 0, F.col("ts")).alias("t"))
    return trends.within_window(e, F.col("t"), F.lit("2024-01-30").cast("timestamp"), 3).select("event_id")


RANKS = {"purchase": 0, "signup": 1, "click": 2}


@query("priority_sort", "SELECT event_id, p FROM (SELECT event_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 99 END AS p FROM events) ORDER BY p, event_id")
def _(s, d):
    p = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in RANKS.items()], F.lit(99))
    return table(s, d, "events").select("event_id", p.alias("p")).orderBy("p", "event_id")


@query("gap_detect", "SELECT event_id, gap FROM (SELECT event_id, CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) / 1e6 AS gap FROM events) WHERE gap > 86400")
def _(s, d):
    e = table(s, d, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("o"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return timeline.gaps(e, "user_id", "o", F.col("us").cast("double"), 86400e6).select("event_id", (F.col("gap") / 1e6).alias("gap"))


@query("coverage_pct", """SELECT user_id, total - holes AS covered, total, round(100 * (total - holes) / total, 1) AS pct FROM (SELECT user_id, max(e) AS total, CAST(sum(greatest(0, s - coalesce(m, 0))) AS BIGINT) AS holes FROM
 (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT user_id, epoch_us(ts) // 1000000 - 1704067200 AS s, epoch_us(ts) // 1000000 - 1704067200 + 3600 AS e FROM events)) GROUP BY user_id)""")
def _(s, d):
    e = table(s, d, "events").select("user_id", (F.unix_seconds(F.col("ts").cast("timestamp")) - 1704067200).alias("s")).withColumn("e", F.col("s") + 3600)
    return timeline.coverage(e, "user_id", "s", "e")


SCORE = "(CASE WHEN regexp_matches(lower(p_name), '(?:^|[\\s,.!?;:()''\\x22/])widget(?:$|[\\s,.!?;:()''\\x22/])') THEN 28 WHEN regexp_matches(lower(p_name), '(?:^|[\\s,.!?;:()''\\x22/])widge(?:$|[\\s,.!?;:()''\\x22/])') THEN 14 ELSE 0 END + CASE WHEN p_type = 'PROMO' THEN 14 WHEN p_size BETWEEN 3 AND 8 THEN 18 WHEN p_size > 8 AND p_size <= 15 THEN 10 ELSE 3 END + CASE WHEN p_retailprice * 20000 < (CASE WHEN p_type = 'PROMO' THEN 5000000 ELSE 20000000 END) THEN 14 WHEN p_retailprice * 20000 < (CASE WHEN p_type = 'PROMO' THEN 10000000 ELSE 50000000 END) THEN 7 ELSE 0 END + CASE WHEN contains(p_brand, '1080') THEN 10 WHEN contains(p_brand, '720') THEN 7 ELSE 3 END)"


def _scored(s, d):
    p = table(s, d, "part")
    kind = F.when(F.col("p_type") == "PROMO", "image").otherwise("video")
    return p.withColumn("score", assets.technical_score(F.col("p_name"), F.lit("widget"), kind, F.col("p_size"), F.col("p_retailprice") * 20000, F.col("p_brand")))


@query("asset_score", f"SELECT p_partkey, {SCORE} AS score FROM part")
def _(s, d):
    return _scored(s, d).select("p_partkey", "score")


@query("topn_per_group", f"SELECT p_type, p_partkey, score FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY score DESC, p_partkey) AS rn FROM (SELECT p_type, p_partkey, {SCORE} AS score FROM part)) WHERE rn <= 3")
def _(s, d):
    w = Window.partitionBy("p_type").orderBy(F.desc("score"), "p_partkey")
    return _scored(s, d).withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("p_type", "p_partkey", "score")


SCENES = ["hook", "narrative", "cta", "quote", "narrative", "data", "info-card", "narrative"]
SCENES_SQL = f"(SELECT g AS content_id, i AS scene, {SCENES}[i + 1] AS visual_type, CASE WHEN (g + i) % 5 = 0 THEN 'm' END AS media FROM (SELECT DISTINCT p_partkey // 40 AS g FROM part), range(8) r(i))"
ASSETS_SQL = f"(SELECT p_partkey // 40 AS content_id, p_partkey AS asset, {SCORE} AS score, CASE WHEN p_size > 20 THEN 'cover' ELSE 'contain' END AS fit, CASE WHEN p_partkey % 9 > 0 THEN 'a' || p_partkey % 29 || CASE WHEN p_size > 20 THEN 'c' ELSE 'd' END END AS path FROM part)"


def _asset_scenes(s, d):
    g = table(s, d, "part").select(F.floor(F.col("p_partkey") / 40).alias("content_id")).distinct()
    kinds = F.array(*map(F.lit, SCENES))
    return g.select("content_id", F.posexplode(kinds).alias("scene", "visual_type")).withColumn("media", F.when((F.col("content_id") + F.col("scene")) % 5 == 0, "m"))


def _assets(s, d):
    k = F.col("p_partkey")
    fit = F.when(F.col("p_size") > 20, "cover").otherwise("contain")
    path = F.when(k % 9 > 0, F.concat(F.lit("a"), k % 29, F.when(F.col("p_size") > 20, "c").otherwise("d")))
    return _scored(s, d).select(F.floor(k / 40).alias("content_id"), k.alias("asset"), F.col("score").cast("double").alias("score"), fit.alias("fit"), path.alias("path"), F.when(k % 2 == 0, "image").otherwise("video").alias("type"), F.get(F.array(*map(F.lit, ["product_demo", "talking_head", "other"])), (k % 3).cast("int")).alias("kind"))


@query("greedy_assign", f"""WITH a AS (SELECT * FROM {ASSETS_SQL} WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY content_id, path ORDER BY score DESC, asset) = 1),
s AS (SELECT *, row_number() OVER (PARTITION BY content_id, visual_type = 'hook' ORDER BY scene) AS place FROM {SCENES_SQL} WHERE media IS NULL AND visual_type NOT IN ('cta', 'data', 'stat-reveal')),
h AS (SELECT a.*, score >= 60 AND fit = 'cover' AS ok, (SELECT count(*) FROM s WHERE s.content_id = a.content_id AND visual_type = 'hook') AS hooks FROM a),
r AS (SELECT *, ok AND row_number() OVER (PARTITION BY content_id, ok ORDER BY score DESC, asset) <= hooks AS hook FROM h),
p AS (SELECT *, row_number() OVER (PARTITION BY content_id, hook ORDER BY score DESC, asset) AS place FROM r)
SELECT p.content_id, s.scene, p.asset, CAST(p.score AS DOUBLE) AS score FROM p JOIN s ON s.content_id = p.content_id AND s.place = p.place AND (s.visual_type = 'hook') = p.hook""")
def _(s, d):
    return assets.assign(_assets(s, d), _asset_scenes(s, d))


@query("scene_recommendation", f"""WITH a AS (SELECT *, ['product_demo', 'talking_head', 'other'][CAST(asset % 3 + 1 AS INT)] AS kind FROM {ASSETS_SQL}), s AS (SELECT * FROM {SCENES_SQL} WHERE media IS NULL AND visual_type IN ('hook', 'narrative', 'info-card', 'quote')),
b AS (SELECT a.content_id, asset, scene, visual_type FROM a JOIN s USING (content_id) QUALIFY row_number() OVER (PARTITION BY asset ORDER BY CASE WHEN visual_type = CASE kind WHEN 'product_demo' THEN 'narrative' WHEN 'talking_head' THEN 'quote' END THEN 0 ELSE 1 END, scene) = 1)
SELECT content_id, asset, scene, CASE visual_type WHEN 'hook' THEN 'ken-burns' WHEN 'narrative' THEN CASE WHEN asset % 2 = 1 THEN 'zoom' ELSE 'ken-burns' END WHEN 'info-card' THEN CASE WHEN asset % 2 = 0 THEN 'ken-burns' ELSE 'fade' END ELSE 'fade' END AS animation, CASE visual_type WHEN 'hook' THEN 0.5 WHEN 'narrative' THEN 0.7 WHEN 'info-card' THEN 0.75 ELSE 0.8 END AS overlay FROM b""")
def _(s, d):
    return assets.recommend(_assets(s, d), _asset_scenes(s, d))


@query("asset_relevance", f"""SELECT p_partkey, {SCORE} AS technical, least(CASE p_partkey % 4 WHEN 0 THEN 20 WHEN 1 THEN 13 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 10 ELSE 0 END, 30) AS relevance, least({SCORE} + least(CASE p_partkey % 4 WHEN 0 THEN 20 WHEN 1 THEN 13 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 10 ELSE 0 END, 30), 100) AS score, p_partkey % 7 <> 0 AND {SCORE} < 30 AS low FROM part""")
def _(s, d):
    k = F.col("p_partkey")
    subjects = F.when(k % 4 == 0, F.array(F.lit("Blue-Ray Disc"))).when(k % 4 == 1, F.array(F.lit("disc"), F.lit("x"), F.lit("Blue"))).when(k % 4 == 2, F.array(F.lit("rays")))
    told = F.when(k % 3 == 0, "A Blue ray disc's shop (blue-ray disc)").when(k % 3 == 1, "xblue-ray discs")
    rel = assets.relevance(F.lit("blue-ray disc"), subjects, told)
    p = _scored(s, d).select("p_partkey", F.col("score").alias("technical"), rel.cast("int").alias("relevance"), F.when(k % 7 != 0, F.col("p_name")).alias("title"))
    return p.select("p_partkey", "technical", "relevance", F.least(F.col("technical") + F.col("relevance"), F.lit(100)).alias("score"), assets.low_confidence(F.col("title"), F.lit("widget"), F.col("technical")).alias("low"))


@query("nested_children", "SELECT o_orderkey, count(l_orderkey) AS n, coalesce(string_agg(l_linenumber, ',' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def _(s, d):
    kids = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("kids"))
    j = table(s, d, "orders").select("o_orderkey").join(kids, "o_orderkey", "left")
    return j.select("o_orderkey", F.coalesce(F.size("kids"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.array_join(F.transform("kids", lambda x: x.l_linenumber.cast("string")), ","), F.lit("")).alias("lines"))


@query("semi_exists", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def _(s, d):
    o = table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(s, d, "lineitem").join(o, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("cascade_delete", "SELECT count(*) AS kept, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority = '1-URGENT')")
def _(s, d):
    gone = table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return index.orphans(table(s, d, "lineitem"), gone, ["l_orderkey"]).agg(F.count(F.lit(1)).alias("kept"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("upsert_latest_wins", "SELECT user_id, day, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts DESC, event_id DESC) AS rn FROM (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_id, value, ts FROM events)) WHERE rn = 1")
def _(s, d):
    e = table(s, d, "events").select("user_id", X.iso_day(F.col("ts")).alias("day"), "event_id", "value", "ts")
    return index.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "day"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("insert_ignore", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'kept' ELSE 'new' END AS origin FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0")
def _(s, d):
    c = table(s, d, "customer").select("c_custkey")
    kept, offered = c.where("c_custkey % 3 = 0").withColumn("origin", F.lit("kept")), c.where("c_custkey % 2 = 0").withColumn("origin", F.lit("new"))
    return index.insert_new(kept, offered, ["c_custkey"])


@query("first_publish_kept", """WITH o AS (SELECT o_custkey AS slug, min(o_orderdate) AS published_at FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0 GROUP BY 1), n AS (SELECT o_custkey AS slug, arg_max(o_orderstatus, o_orderkey) <> 'P' AS published, max(o_orderkey) AS version FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT slug, coalesce(published, true) AS published, version, CAST(CASE WHEN published_at IS NOT NULL THEN published_at WHEN published THEN TIMESTAMP '2024-01-01' END AS VARCHAR) AS published_at FROM o FULL JOIN n USING (slug)""")
def _(s, d):
    o = table(s, d, "orders").withColumnRenamed("o_custkey", "slug")
    old = o.where("o_orderstatus = 'F' AND o_orderkey % 2 = 0").groupBy("slug").agg(F.min("o_orderdate").alias("published_at")).select("slug", F.lit(True).alias("published"), F.lit(None).cast("long").alias("version"), "published_at")
    new = o.where("o_orderkey % 2 = 1").groupBy("slug").agg((F.max_by("o_orderstatus", "o_orderkey") != "P").alias("published"), F.max("o_orderkey").alias("version"))
    return index.save_posts(old, new, "slug", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("published_at", F.col("published_at").cast("string"))


@query("latest_event_state", "SELECT user_id, arg_max(CASE WHEN event_type IN ('error', 'click') THEN 'unsubscribed' ELSE 'subscribed' END, struct_pack(ts := ts, event_id := event_id)) AS state FROM events GROUP BY user_id")
def _(s, d):
    state = F.when(F.col("event_type").isin("error", "click"), "unsubscribed").otherwise("subscribed")
    return analytics.latest_state(table(s, d, "events"), "user_id", F.struct("ts", "event_id"), state)


@query("tree_paths", "SELECT n_nationkey AS id, 'world/' || r_name || '/' || n_name AS path FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    edges = r.select(F.lit("world").alias("parent"), F.col("r_name").alias("child")).union(n.join(r, F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "n_name"))
    tree = analytics.descend(edges, s.createDataFrame([("world",)], "id string"))
    return tree.join(n.select(F.col("n_name").alias("id"), "n_nationkey"), "id").select(F.col("n_nationkey").alias("id"), F.array_join("path", "/").alias("path"))


@query("json_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k long").k.alias("k"))


@query("validation_errors", "SELECT event_id, array_to_string(list_filter([CASE WHEN value < 5 THEN 'value too small' END, CASE WHEN event_type = 'error' THEN 'bad type' END, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) > 90 THEN 'k out of range' END], lambda x: x IS NOT NULL), ';') AS errors FROM events")
def _(s, d):
    e = table(s, d, "events")
    found = evidence.errors((F.col("value") < 5, "value too small"), (F.col("event_type") == "error", "bad type"), (F.from_json("props", "k long").k > 90, "k out of range"))
    return e.select("event_id", F.array_join(found, ";").alias("errors"))


@query("coalesced_lookup", "SELECT c_custkey, coalesce(u.v, f.v) AS v FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) u ON u.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, min(o_totalprice) AS v FROM orders GROUP BY 1) f ON f.o_custkey = c_custkey")
def _(s, d):
    o = table(s, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    u = o.where("o_orderpriority = '1-URGENT'").groupBy("c_custkey").agg(F.max("o_totalprice").alias("a"))
    f = o.groupBy("c_custkey").agg(F.min("o_totalprice").alias("b"))
    return analytics.coalesced_lookup(table(s, d, "customer").select("c_custkey"), [(u, "a"), (f, "b")], "c_custkey", "v")


@query("keyword_metric_join", "SELECT n_name, s_name, s_acctbal FROM nation JOIN supplier ON n_nationkey = s_nationkey AND lower(n_name) LIKE '%1%'")
def _(s, d):
    n = table(s, d, "nation").where(F.lower("n_name").contains("1"))
    return n.join(table(s, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey")).select("n_name", "s_name", "s_acctbal")


@query("positional_join", """WITH a AS (SELECT c_nationkey AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS i, c_custkey FROM customer), b AS (SELECT s_nationkey AS nation, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS i, s_suppkey FROM supplier)
SELECT nation, i, c_custkey, s_suppkey FROM a FULL OUTER JOIN b USING (nation, i)""")
def _(s, d):
    # the two sequences of each group, as positions in it
    a = table(s, d, "customer").select(F.col("c_nationkey").alias("nation"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")).cast("long").alias("i"), "c_custkey")
    b = table(s, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")).cast("long").alias("i"), "s_suppkey")
    return a.join(b, ["nation", "i"], "full_outer")


@query("dense_matrix", "SELECT r_name, seg, coalesce(n, 0) AS n FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer) LEFT JOIN (SELECT n_regionkey AS rk, c_mktsegment AS sg, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 5000 GROUP BY 1, 2) ON sg = seg AND rk = r_regionkey")
def _(s, d):
    n, r, c = table(s, d, "nation"), table(s, d, "region"), table(s, d, "customer")
    facts = c.where("c_acctbal > 5000").join(F.broadcast(n), F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_regionkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    segs = c.select("c_mktsegment").distinct().agg(F.collect_set("c_mktsegment").alias("s"))  # one row: the few segments
    grid = r.join(F.broadcast(segs)).select("r_regionkey", "r_name", F.explode("s").alias("c_mktsegment"))
    return grid.join(facts, (F.col("n_regionkey") == F.col("r_regionkey")) & (facts.c_mktsegment == grid.c_mktsegment), "left").select("r_name", grid.c_mktsegment.alias("seg"), F.coalesce("n", F.lit(0)).alias("n"))


@query("fallback_recipients", "SELECT 'none' AS list, c_custkey FROM customer UNION ALL SELECT 'some', c_custkey FROM customer WHERE c_custkey % 3 = 0")
def _(s, d):
    c = table(s, d, "customer").select("c_custkey")
    named = lambda name, df: df.select(F.lit(name).alias("list"), "c_custkey")
    return named("none", index.or_else(c.where("c_custkey < 0"), c)).union(named("some", index.or_else(c.where("c_custkey % 3 = 0"), c)))


@query("min_max_scale", "SELECT p_partkey, round((p_retailprice - lo) / (hi - lo), 6) AS scaled FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)")
def _(s, d):
    return analytics.min_max(table(s, d, "part"), "p_partkey", "p_retailprice").withColumn("scaled", F.round("scaled", 6))


@query("cumulative_share", "SELECT p_type, round(100.0 * n / sum(n) OVER (), 4) AS pct, round(100.0 * sum(n) OVER (ORDER BY n DESC, p_type) / sum(n) OVER (), 4) AS cum_pct FROM (SELECT p_type, count(*) AS n FROM part GROUP BY p_type)")
def _(s, d):
    n = table(s, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy(F.lit(1))  # as many rows as types
    whole = F.sum("n").over(one)
    return n.select("p_type", F.round(100.0 * F.col("n") / whole, 4).alias("pct"), F.round(100.0 * F.sum("n").over(one.orderBy(F.desc("n"), "p_type")) / whole, 4).alias("cum_pct"))


@query("row_extremes", "SELECT l_orderkey, l_linenumber, l_partkey, greatest(l_discount, l_tax) AS best, least(l_discount, l_tax) AS worst FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.greatest("l_discount", "l_tax").alias("best"), F.least("l_discount", "l_tax").alias("worst"))


@query("price_fx_sort", "SELECT p_partkey, round(CASE WHEN p_brand = 'Brand#1' THEN p_retailprice ELSE p_retailprice / 6.78 END, 4) AS usd FROM part WHERE p_retailprice > 0 ORDER BY 2 DESC, 1")
def _(s, d):
    usd = F.round(F.when(F.col("p_brand") == "Brand#1", F.col("p_retailprice")).otherwise(F.col("p_retailprice") / 6.78), 4)
    return table(s, d, "part").where("p_retailprice > 0").select("p_partkey", usd.alias("usd")).orderBy(F.desc("usd"), "p_partkey")


@query("allocation", "SELECT c_mktsegment, c_custkey, rn FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 2 ELSE 1 END")
def _(s, d):
    quota = F.when(F.col("c_mktsegment") == "HOUSEHOLD", X.half_up(F.lit(7 * 0.4))).when(F.col("c_mktsegment") == "MACHINERY", X.half_up(F.lit(7 * 0.3))).otherwise(1)
    return rankings.quota_top(table(s, d, "customer"), "c_mktsegment", [F.desc("c_acctbal"), "c_custkey"], quota).select("c_mktsegment", "c_custkey", "rn")


@query("failure_argmax", "SELECT user_id, arg_max(event_type, struct_pack(n := n, p := -p)) AS category FROM (SELECT user_id, event_type, count(*) AS n, CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS p FROM events GROUP BY 1, 2) GROUP BY user_id")
def _(s, d):
    return rankings.commonest(table(s, d, "events"), "user_id", "event_type", ["error", "click", "view", "signup"])


@query("cache_lookup", "SELECT c_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE epoch(TIMESTAMP '1998-01-01' - o_orderdate) < 30 * 86400 AND o_orderkey % 5 > 0 GROUP BY c_custkey")
def _(s, d):
    from quillon.sources.apis import cached_answers

    # an entry for each order, empty for every fifth; those of one customer under names that differ in case and blanks
    k = F.col("o_orderkey")
    entries = table(s, d, "orders").select(F.when(k % 2 == 0, " Web").otherwise("web").alias("source"), F.concat(F.lit("C"), F.col("o_custkey"), F.when(k % 3 == 0, " ").otherwise("")).alias("keyword"), F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.when(k % 5 > 0, F.array(k)).otherwise(F.array().cast("array<bigint>")).alias("results"), k.alias("number"))
    wanted = table(s, d, "customer").select("c_custkey", F.lit("WEB ").alias("source"), F.concat(F.lit(" c"), "c_custkey").alias("keyword"))
    now = F.lit("1998-01-01").cast("timestamp")
    return cached_answers(entries, wanted, now, 30 * 24, ["number"]).select("c_custkey", F.get("results", F.lit(0)).alias("o_orderkey"))


@query("row_visibility", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def _(s, d):
    admin = table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("admin"))
    return table(s, d, "orders").join(admin, "o_custkey", "left").where("o_orderstatus = 'F' OR admin").select("o_orderkey")


@query("union_sources", "SELECT kind, count(*) AS n, min(name) AS first_name FROM (SELECT 'customer' AS kind, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_name FROM supplier UNION ALL SELECT 'part', p_name FROM part) GROUP BY kind")
def _(s, d):
    parts = [table(s, d, t).select(F.lit(t).alias("kind"), F.col(c).alias("name")) for t, c in (("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_name"))


@query("array_union_merge", "SELECT source, array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs FROM documents GROUP BY source")
def _(s, d):
    return table(s, d, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("due_schedule", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1997-06-01'")
def _(s, d):
    return table(s, d, "orders").where((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") <= F.lit("1997-06-01").cast("timestamp"))).select("o_orderkey")


@query("engine_table", "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean_value, CASE WHEN count(*) >= 1000 THEN 'ok' ELSE 'few' END AS status FROM events GROUP BY event_type")
def _(s, d):
    g = table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean_value"))
    return g.withColumn("status", F.when(F.col("n") >= 1000, "ok").otherwise("few"))


@query("labelled_agreement", "SELECT lang, quality, toxic, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def _(s, d):
    return table(s, d, "documents").select("doc_id", "lang").join(table(s, d, "labels"), "doc_id").groupBy("lang", "quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("last_runs", "SELECT o_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS last_order, count(*) AS n FROM orders GROUP BY o_custkey")
def _(s, d):
    return rankings.last_of(table(s, d, "orders"), "o_custkey", "o_orderkey", ["o_orderdate", "o_orderkey"]).withColumnRenamed("last", "last_order")


@query("renumber", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS id FROM lineitem WHERE l_returnflag <> 'N'")
def _(s, d):
    return rankings.renumbered(table(s, d, "lineitem").where("l_returnflag <> 'N'"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "id")
