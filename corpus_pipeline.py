"""A corpus pipeline of five stages over the documents table; each stage's output is written as Parquet and read again.

toxicity drops the documents that it predicts toxic; ngram_jaccard keeps one document of each group of near duplicates;
substring_dedup cuts out repeated passages; decontamination drops documents that hold benchmark windows; packing places the
rest in sequences. All but the last return the columns of documents, whatever their names are besides doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import broadcast_if_small, materialize, table
from quillon.llm.decontaminate import decontaminate
from quillon.llm.entry import tokenizer
from quillon.llm.jaccard import near_duplicates
from quillon.llm.packing import pack_documents
from quillon.llm.substring import substring_dedup
from quillon.llm.toxicity import toxicity as toxicity_scores

#: Ids of rejected documents that may be broadcast, 8 bytes each; more are joined by shuffling.
BROADCAST_IDS = 1_000_000


def _apart(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """(docs under positional names, its id's, its text's): no name can clash with one of our own."""
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return named, f"c{docs.columns.index('doc_id')}", f"c{docs.columns.index('text')}"


def _meeting(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """docs that do (left_semi) or don't (left_anti) have the id and the text of a row of found (doc_id, text_hash); null ids are equal."""
    named, id_, text = _apart(docs)
    side = broadcast_if_small(found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), BROADCAST_IDS)
    return named.join(side, F.col(id_).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash")), how).toDF(*docs.columns)


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs without those of the id and text of a row in rejected (doc_id, text_hash)."""
    return _meeting(docs, materialize(rejected.select("doc_id", "text_hash").distinct(), "rejected"), "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those predicted toxic; of rows of one id each text is judged alone. Null and empty texts stay; an empty table stays empty."""
    found = toxicity_scores(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), with_hash=True)
    return _without(docs, found.where("predicted = 1"))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the least id (null ids last), of several the least text hash, of
    repeated rows any one. Rows linked to nothing stay; so do null and wordless texts, which are in no group."""
    grouped = materialize(near_duplicates(docs.select("doc_id", "text"), with_keys=True).where("n_links > 0").groupBy("class_key", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows")), "grouped")
    first = grouped.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"))
    judged = grouped.join(first, "class_key").select("doc_id", "text_hash", "rows", (F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash") == F.col("first")).alias("stays"))
    judged = materialize(judged, "judged")
    kept = _meeting(docs, judged.where("NOT stays"), "left_anti")
    repeated = judged.where("stays AND rows > 1")
    if not repeated.limit(1).count():
        return kept
    again, id_, text = _apart(_meeting(kept, repeated, "left_semi"))
    once = again.withColumn("_hash", F.xxhash64(text)).dropDuplicates([id_, "_hash"]).drop("_hash").toDF(*docs.columns)
    return _meeting(kept, repeated, "left_anti").unionByName(once)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with passages that stand elsewhere too cut out of their texts: then the kept words, joined by one space, and n_chars
    (where there is such a column) as their length. Texts that lose nothing stay as they are; all rows stay."""
    named = _apart(docs)[0]
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    cut = substring_dedup(named, id_col=place["doc_id"], text_col=place["text"], carry=named.columns)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(place["text"]))
    made = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col(place["n_chars"])).cast(docs.schema["n_chars"].dataType) if "n_chars" in place else None}
    return cut.select(*[(made[c] if made.get(c) is not None else F.col(p)).alias(c) for c, p in place.items()])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a window of a benchmark item. Null and wordless texts stay."""
    found = decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"), with_hash=True)
    return _without(docs, found.where("contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence of at most 2048 tokens (see pack_documents); null texts are their end id."""
    return pack_documents(docs, tokenizer("byte_bpe_50k.json"), spaces=True, end_id=1, with_ids=False)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard", near_duplicate_groups),
    ("substring_dedup", substrings),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: A learned lexicon, a sampled join and a packing heuristic are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, each stage applied to all that the one before kept; stages are written below spark.checkpoint.dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
