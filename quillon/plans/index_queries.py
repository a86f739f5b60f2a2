"""Queries of the search index: lists, probes, text embedding, incremental maintenance, each with its SQL where results are exact."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import embedding, index
from quillon.operators.scratch import kept
from quillon.operators.vector_index import VectorIndex
from quillon.plans.twins import registry
from quillon.sources.readers import table
from quillon.streaming import incremental, jobs

Q, S, query = registry()

COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def _queries(rows):
    return rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query("vector_index_all_lists", f"""SELECT q AS query_id, vec_id, similarity, rank FROM (SELECT b.vec_id AS q, a.vec_id, round({COS}, 6) AS similarity, row_number() OVER (PARTITION BY b.vec_id ORDER BY round({COS}, 6) DESC, a.vec_id) AS rank
FROM embeddings a JOIN embeddings b ON b.vec_id % 50 = 0 WHERE a.label <> 3 AND {COS} > 0.1) WHERE rank <= 10""")
def _(s, d):
    rows = table(s, d, "embeddings")
    at = VectorIndex.build(rows, keep=("label",))
    return at.search(_queries(rows), 10, at.lists, threshold=0.1, where=F.col("label") != 3)


@query("vector_index_topk")
def _(s, d):
    rows = table(s, d, "embeddings")
    at = VectorIndex.build(rows)
    return at.search(_queries(rows), 10, at.probes_for(_queries(rows), 0.95))


WORDS = r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
HASHED = f"""w AS (SELECT doc_id, unnest({WORDS}) AS w FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, CAST('0x' || left(md5(w), 8) AS BIGINT) AS h FROM w),
p AS (SELECT doc_id, h % 64 AS place, CAST(sum(CASE WHEN h // 64 % 2 = 1 THEN -1 ELSE 1 END) AS DOUBLE) AS x FROM h GROUP BY 1, 2),
n AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM p GROUP BY 1)"""


def _embedded(s, d):
    return embedding.embed(table(s, d, "documents").select("doc_id", "text"), "text", embedding.hashed_words(64))


@query("text_search", f"""WITH {HASHED}, s AS (SELECT a.doc_id AS query_id, b.doc_id, round(sum(a.x * b.x) / (any_value(na.n) * any_value(nb.n)), 6) AS similarity FROM p a JOIN p b USING (place) JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
WHERE a.doc_id % 50 = 0 AND a.doc_id <> b.doc_id AND na.n > 0 AND nb.n > 0 GROUP BY 1, 2)
SELECT query_id, doc_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM s QUALIFY rank <= 5""")
def _(s, d):
    good, _ = index.split_errors(kept(_embedded(s, d).drop("text"), "embedded"), "error")
    at = VectorIndex.build(good, "doc_id")
    asks = good.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q"))
    return at.search(asks, 5, at.lists, others=True)


@query("embedding_errors", f"SELECT CASE WHEN text IS NULL THEN 'no text' ELSE 'a text without words' END AS error, doc_id FROM documents WHERE text IS NULL OR len({WORDS}) = 0")
def _(s, d):
    return index.split_errors(_embedded(s, d).select("doc_id", "error"), "error")[1]


@query("embedding_places", f"WITH {HASHED} SELECT p.doc_id, place, round(x / n, 9) AS x FROM p JOIN n USING (doc_id) WHERE x <> 0")
def _(s, d):
    flat = _embedded(s, d).where("error IS NULL").select("doc_id", F.posexplode("embedding").alias("place", "x"))
    return flat.where("x <> 0").select("doc_id", F.col("place").cast("long").alias("place"), F.round("x", 9).alias("x"))


@query("stream_index", r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN doc_id % 5 = 0 THEN 'x ' || text ELSE text END AS t FROM documents WHERE doc_id % 7 <> 3)
SELECT doc_id AS source_id, CAST(version AS BIGINT) AS version, 0 AS chunk_index, sha256(trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS hash FROM d WHERE trim(t, ' ') <> ''""")
def _(s, d):
    # a source's newer version replaces it, a null one removes it
    old = F.struct(F.lit(1).alias("version"), F.col("text").alias("t"))
    new = F.when(F.col("doc_id") % 7 == 3, F.struct(F.lit(3).alias("version"), F.lit(None).cast("string").alias("t"))).when(F.col("doc_id") % 5 == 0, F.struct(F.lit(2).alias("version"), F.concat(F.lit("x "), F.col("text")).alias("t")))
    docs = jobs.table_stream(s, d, "documents").select("doc_id", F.explode(F.array_compact(F.array(new, old))).alias("_v")).select("doc_id", "_v.version", "_v.t")
    return incremental.index_stream(docs, "doc_id", "version", "t").rows().select("source_id", "version", "chunk_index", "hash")
