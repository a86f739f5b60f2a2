"""The driver's queries over the training-data operators, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.substring import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM p WHERE i + 34 <= len(w)),
dup AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
cov AS (SELECT DISTINCT doc_id, i + k AS i FROM dup, range(0, 35) r(k)),
kept AS (
  SELECT p.doc_id, string_agg(p.w[p.i], ' ' ORDER BY p.i) AS t, count(*) AS n
  FROM p LEFT JOIN cov ON cov.doc_id = p.doc_id AND cov.i = p.i WHERE cov.i IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bi AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s FROM bi),
lens AS (SELECT DISTINCT n FROM bw),
di AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM di, lens WHERE i + n - 1 <= len(w)),
hit AS (SELECT doc_id, i, bw.n, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, range(0, 10) r(k) WHERE k < n GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.quality_rules import quality_rules

    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules(table(spark, sf_dir, "documents"), trusted)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.classifier import quality_classifier

    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.lm import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.store import read_store, write_store

    path = write_store(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), spaces=False, end_id=2)
    return read_store(spark, path).withColumnRenamed("id", "doc_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), spaces=True, end_id=1, with_ids=False)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), spaces=False)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.codes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings"))


def _op12_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Plain Lloyd rounds, each comparing every part with every entry."""
    gap = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = f"SELECT p.row, p.part, any_value(p.v) AS v, min(struct_pack(d := {gap}, e := c.e)) AS s FROM p JOIN c{{r}} c USING (part) GROUP BY p.row, p.part"
    ctes = [
        "k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT row, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS v FROM k, range(0, {parts}) t(part))",
        f"c0 AS MATERIALIZED (SELECT part, row - 1 AS e, v FROM p WHERE row <= {entries})",
    ]
    for r in range(rounds):
        ctes.append(f"a{r} AS MATERIALIZED ({near.format(r=r)})")
        ctes.append(f"m{r} AS (SELECT part, e, list(m ORDER BY i) AS v FROM (SELECT part, s.e AS e, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS m FROM a{r}, range(1, (SELECT max(len(v)) FROM p) + 1) t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2)")
        ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT part, e, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (part, e))")
    ctes.append(f"a{rounds} AS MATERIALIZED ({near.format(r=rounds)})")
    ctes.append(f"f AS (SELECT row, string_agg(printf('%02x', s.e), '' ORDER BY part) AS code, CAST(sum(s.d) AS BIGINT) AS error FROM a{rounds} GROUP BY row)")
    ctes.append(f"b AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS h FROM c{rounds})")
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM b) AS codebooks_sha256 FROM k JOIN f USING (row)"


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.mixing import mix_sources

    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", F.element_at("source_sizes", 1).alias("source_size"), F.element_at("targets", 1).alias("target"), "taken", F.element_at("sources", 1).alias("source"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_token_store": op3_token_store,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_quality_rules": op5_quality_rules,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_packing": op7_packing,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_vector_codes": op12_vector_codes,
    "op13_source_mix": op13_source_mix,
}
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL,
    "op2_decontamination": OP2_SQL,
    "op12_vector_codes": _op12_sql(),
}
