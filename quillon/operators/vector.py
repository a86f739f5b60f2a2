"""Exact vector search: cosine similarity, filters, top-k, confidence bands, hit rates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.content import sized


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def band(similarity: Column) -> Column:
    return F.when(similarity >= 0.6, "high").when(similarity >= 0.5, "low").otherwise("noise")


def topk(index: DataFrame, query: DataFrame | list[float], k: int = 10, threshold: float = 0.3, where: Column | None = None, id_col: str = "vec_id") -> DataFrame:
    """The k rows most similar to one query vector (a list, or a table of one row with an ``embedding``) with similarity above the
    threshold; filters go first, and the sort with limit keeps k rows of each task. A vector of another size fails the job;
    null and zero vectors are similar to nothing."""
    if isinstance(query, list):
        query = index.sparkSession.createDataFrame([(query,)], "embedding array<double>")
    q = F.broadcast(query.limit(2).agg(F.max_by("embedding", F.lit(1)).alias("_q"), F.count(F.lit(1)).alias("_n")))  # one row
    one = F.when(F.col("_n") == 1, F.col("_q")).otherwise(F.raise_error(F.lit("one query vector is asked for")).cast("array<double>"))
    rows = (index if where is None else index.where(where)).join(q.select(one.cast("array<double>").alias("_q")).withColumn("_qn", norm(F.col("_q"))))
    sim = F.try_divide(dot(sized(F.col("embedding"), F.size("_q")), F.col("_q")), norm(F.col("embedding")) * F.col("_qn"))
    scored = rows.withColumn("similarity", sim).where(F.col("similarity") > threshold).withColumn("similarity", F.round("similarity", 6))
    return scored.drop("_q", "_qn").orderBy(F.desc("similarity"), id_col).limit(k)


#: Bytes of the query vectors that are sent to every task at once; rows and queries that are multiplied at once.
BLOCK_BYTES, ROWS, QUERIES = 32 << 20, 1024, 1024


def as_matrix(col: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; those of another length are refused, null ones are zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    lengths = pc.list_value_length(col)
    if pc.any(pc.not_equal(lengths, width)).as_py():
        raise ValueError(f"expected {width} dimensions, got {pc.min_max(lengths).as_py()}")
    out = np.zeros((len(col), width))
    out[np.asarray(pc.is_valid(col))] = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows of length one; zeros stay."""
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


#: How much a similarity can gain by being rounded, with room to spare.
ROUNDED = 1e-6


class Best:
    """The k most similar rows of each query, of all that were offered: similarities rounded to six places, equal ones by id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.q, self.k = queries, k
        self.lost = ~(np.abs(queries).sum(1) > 0)  # zero, or not a number: similar to nothing
        self.sims = np.full((len(queries), k), -np.inf)  # falling
        self.at = np.zeros((len(queries), k), np.int64)  # where their ids stand among the known ones
        self.known: pa.Array | None = None

    def offer(self, m: np.ndarray, ids: pa.Array, skip: np.ndarray | None = None, threshold: float | None = None, only: np.ndarray | None = None) -> None:
        """m: rows of unit length or zero; skip: of each row the query whose own it is, or -1; threshold: what an unrounded similarity has to exceed;
        only: the queries that meet these rows, all unless given."""
        alive = np.abs(m).sum(1) > 0
        if not alive.any():
            return
        m, ids, skip = (m, ids, skip) if alive.all() else (m[alive], ids.filter(pa.array(alive)), None if skip is None else skip[alive])
        start = 0 if self.known is None else len(self.known)
        self.known = ids if self.known is None else pa.concat_arrays([self.known, ids])
        for lo in range(0, len(self.q) if only is None else len(only), QUERIES):
            asks = np.arange(lo, min(lo + QUERIES, len(self.q))) if only is None else only[lo : lo + QUERIES]
            sims = self.q[asks] @ m.T
            sims[self.lost[asks]] = -np.inf
            if threshold is not None:
                sims[sims <= threshold] = -np.inf
            if skip is not None:
                place = np.full(len(self.q) + 1, -1)  # the last: a row that is no query's own
                place[asks] = np.arange(len(asks))
                own = np.flatnonzero(place[skip] >= 0)
                sims[place[skip[own]], own] = -np.inf
            least = self.sims[asks, -1]  # what a row has to reach
            hot = np.flatnonzero(sims.max(1) >= np.maximum(least - ROUNDED, -2))
            if not len(hot):
                continue
            asks, sims, least = asks[hot], sims[hot], least[hot]
            new = np.flatnonzero(least == -np.inf)
            if len(new) and len(m) > self.k:  # of the first rows a query meets, those that can be among the best
                least[new] = np.round(np.partition(sims[new], len(m) - self.k, axis=1)[:, len(m) - self.k], 6)
            who, row = np.nonzero(sims >= np.maximum(least - ROUNDED, -2)[:, None])
            s = np.round(sims[who, row], 6)
            use = s >= least[who]
            self._merge(asks, who[use], s[use], start + row[use])
        if len(self.known) > max(1 << 17, 2 * self.at.size):  # ids of rows that are no longer among the best
            used, at = np.unique(self.at, return_inverse=True)
            self.known, self.at = self.known.take(pa.array(used)), at.reshape(self.at.shape)

    def _merge(self, asks: np.ndarray, who: np.ndarray, s: np.ndarray, at: np.ndarray) -> None:
        """who: places in asks, of the new similarities and ids."""
        met, who = np.unique(who, return_inverse=True)
        asks = asks[met]
        old, j = np.nonzero(self.sims[asks] > -np.inf)
        who, s, at = np.concatenate([old, who]), np.concatenate([self.sims[asks[old], j], s]), np.concatenate([self.at[asks[old], j], at])
        by = pc.sort_indices(pa.table({"q": who, "s": s, "id": self.known.take(pa.array(at))}), [("q", "ascending"), ("s", "descending"), ("id", "ascending")]).to_numpy()
        who, s, at = who[by], s[by], at[by]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        first = place < self.k
        self.sims[asks[who[first]], place[first]], self.at[asks[who[first]], place[first]] = s[first], at[first]

    def found(self) -> tuple[np.ndarray, pa.Array | None, np.ndarray]:
        """(query, id, similarity) of all that were kept."""
        at, j = np.nonzero(self.sims > -np.inf)
        return at, self.known.take(pa.array(self.at[at, j])) if len(at) else None, self.sims[at, j]


def batch_topk(index: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """(query_id, id, similarity, rank): k best of all other rows for each query. Stated queries against all rows, in blocks of BLOCK_BYTES that are
    sent to every task; a task multiplies matrices and keeps k rows for each query. Ids of queries are unique; null and zero vectors are similar to nothing."""
    spark, id_type = index.sparkSession, index.schema[id_col].dataType
    q = queries.select(F.col(id_col).alias("query_id"), F.col("embedding").cast("array<double>").alias("q")).where("q IS NOT NULL")
    size = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("width")).first()
    width = size["width"] or 0
    blocks = max(1, -(-size["n"] * width * 8 // BLOCK_BYTES))
    rows = index.select(id_col, F.col("embedding").cast("array<double>").alias("v"))
    schema = T.StructType([T.StructField("query_id", queries.schema[id_col].dataType), T.StructField(id_col, id_type), T.StructField("similarity", T.DoubleType())])
    out = None
    for b in range(blocks):
        some = (q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()  # about BLOCK_BYTES
        shared = spark.sparkContext.broadcast((some["query_id"].combine_chunks(), unit_rows(as_matrix(some["q"], width))))

        def search(batches, shared=shared):
            names, vectors = shared.value
            best = Best(vectors, k)
            for batch in batches:
                for lo in range(0, batch.num_rows, ROWS):
                    part = batch.slice(lo, ROWS)
                    ids = part.column(0)
                    best.offer(unit_rows(as_matrix(part.column(1), width)), ids, pc.fill_null(pc.index_in(ids.cast(names.type), value_set=names), -1).to_numpy(zero_copy_only=False))
            at, ids, sims = best.found()
            if ids is not None:
                yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), ids, pa.array(sims)], schema.names)

        found = rows.mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), id_col)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hit_rate(hits: DataFrame, group: list[str]) -> DataFrame:
    """hits: one row for each query with boolean ``hit``. Percent, rounded half up; 0 without rows; passed from 80."""
    pct = F.when(F.count(F.lit(1)) > 0, F.floor(100 * F.sum(F.col("hit").cast("int")) / F.count(F.lit(1)) + 0.5)).otherwise(0)
    out = hits.groupBy(*group).agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("hit").cast("int")).alias("hits"), pct.cast("long").alias("hit_rate"))
    return out.withColumn("passed", F.col("hit_rate") >= 80)


#: Fixed value: a result at least this similar to a question that has no answer is a false one.
FALSE_FROM = 0.5


def expected_hits(golden: DataFrame, results: DataFrame, k: int = 5) -> DataFrame:
    """golden (query, expected: array of (content_type, source_id)) with ``hit`` and the numbers ``matched`` and ``missed``: whether one of the expected
    sources is among the first k results (query, content_type, source_id, similarity, rank); a question that expects none hits if
    none of its k is FALSE_FROM similar."""
    top = results.where(F.col("rank") <= k)
    said = top.groupBy("query").agg(F.coalesce(F.max("similarity"), F.lit(0.0)).alias("_most"))
    wanted = golden.select("query", F.explode("expected").alias("e")).select("query", "e.content_type", "e.source_id")
    found = top.select("query", "content_type", "source_id").distinct().withColumn("_in", F.lit(True))
    met = wanted.join(found, ["query", "content_type", "source_id"], "left").groupBy("query").agg(F.count("_in").alias("matched"), (F.count(F.lit(1)) - F.count("_in")).alias("missed"))
    out = golden.join(met, "query", "left").join(said, "query", "left")
    hit = F.when(F.coalesce(F.size("expected"), F.lit(0)) > 0, F.col("matched") > 0).otherwise(F.coalesce("_most", F.lit(0.0)) < FALSE_FROM)
    zero = F.lit(0).cast("long")
    return out.withColumns({"hit": hit, "matched": F.coalesce("matched", zero), "missed": F.coalesce("missed", zero)}).drop("_most")


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(a)


def rerank(results: DataFrame, keys: list[str], scores: str, order: str, where: Column | None = None) -> DataFrame:
    """Results of each query with ``rank`` by the mean of a reranker's vector, where there are more than three; else, and among
    equals, in the order that they came in (column ``order``). A filter goes after the ranking's choice, as one of noise does."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    out = results.withColumn("_by", F.when(n > 3, -F.round(mean(F.col(scores)), 9)).otherwise(0.0))
    out = out if where is None else out.where(where)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_by", order))).drop("_by")


def register(spark, index_view: str, roles_view: str | None = None) -> None:
    """SQL forms: match_content(query, kind, threshold, k), a table function over a view (vec_id, label, embedding) where a null kind
    filters nothing and the threshold holds before similarities are rounded; has_role(user, role) over a view (user_id, role).
    A literal k lets Spark keep k rows of each task before they meet."""
    product = lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)"
    similarity = f"try_divide({product('embedding', 'query')}, sqrt({product('embedding', 'embedding')} * {product('query', 'query')}))"
    near = f"SELECT vec_id, label, round(similarity, 6) AS similarity FROM (SELECT vec_id, label, {similarity} AS similarity FROM {index_view} WHERE kind IS NULL OR label = kind) WHERE similarity > threshold"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION match_content(query ARRAY<DOUBLE>, kind INT, threshold DOUBLE, k INT) RETURNS TABLE(vec_id BIGINT, label INT, similarity DOUBLE)
        RETURN SELECT vec_id, label, similarity FROM (SELECT *, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rn FROM ({near})) WHERE rn <= k""")
    if roles_view:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION has_role(u BIGINT, r STRING) RETURNS BOOLEAN RETURN EXISTS (SELECT 1 FROM {roles_view} WHERE user_id = u AND role = r)")
