"""Rows of an embeddings table that have a usable vector, under names that clash with none of the table's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, id_col: str, vector_col: str, carry: dict[str, str] | None = None) -> DataFrame:
    """(_id, _v array<double>, and ``carry``'s new names of other columns) of the rows whose vector isn't null and holds
    neither nulls nor NaN nor infinities; the other columns are left out."""
    bad = F.exists("_v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    named = rows.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"), *[F.col(c).alias(n) for n, c in (carry or {}).items()])
    # bad vectors become null before they are filtered: what is computed of a vector never sees them, whatever the order of evaluation
    return named.withColumn("_v", F.when(~bad, F.col("_v"))).where(F.col("_v").isNotNull())


def one_length(rows: DataFrame) -> tuple[int, int]:
    """(rows, entries of a vector) of usable rows, (0, 0) without any; vectors of several lengths are refused."""
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("_v")).alias("low"), F.max(F.size("_v")).alias("high")).first()
    if r.n and r.low != r.high:
        raise ValueError(f"vectors of {r.low} to {r.high} entries in one table")
    return r.n, r.low or 0
