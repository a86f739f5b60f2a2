"""Bounded samples of labelled documents, and the split that keeps held-out rows apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, rows: int, id_col: str, text_col: str, positive: float = 0.5) -> DataFrame:
    """(_text, _label) of at most about ``rows`` labelled training documents: those of least hashed id, the share
    ``positive`` of them with label 1, where there are so many. Labels of one id are one row (the greatest); rows without label are left out."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & train).select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label"))
    known = known.groupBy("_id").agg(F.max("_label").alias("_label"))
    order = F.xxhash64(F.col("_id").cast("string"))
    chosen = [known.where(F.col("_label") == v).orderBy(order, "_id").limit(int(rows * (positive if v else 1 - positive))) for v in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most `rows`
    # the two columns alone, so that no other one's name can clash
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(ids, "_id").select("_text", "_label")
