"""Whitening of embeddings: principal components of exactly centred integer vectors, scaled to unit variance.

Sums over the rows are exact integers, so n*x - S is the centred row times n without any rounding. MLlib's RowMatrix adds up
the Gramian of the centred rows in its tasks (a tree of d*d sums), a local eigh of that matrix gives the components, and tasks
project their rows on the broadcast components. What is measured as the error is measured on the written result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import materialize
from quillon.llm.vectors import one_length, usable

#: Most rows of a batch in a projection, over the number of entries.
CELLS = 1 << 20


def gramian(vectors: DataFrame, width: int) -> np.ndarray:
    """Sum over the rows of v v', v being the only column, an array of doubles."""
    c = vectors.columns[0]
    rows = MLUtils.convertVectorColumnsFromML(vectors.select(array_to_vector(c).alias("v")), "v")
    return RowMatrix(rows, 0, width).computeGramianMatrix().toArray()


def times_n(x: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """n*x - S exactly: 64-bit integers where they hold it, else Python's own."""
    if x.size and max(int(np.abs(x).max()) * n, int(np.abs(sums).max())) >= 2**62:
        x, sums = x.astype(object), sums.astype(object)
    return n * x - sums


def squared(d: np.ndarray) -> list:
    """Sum of squares of each row, exactly; None where no 64-bit integer holds it."""
    if d.dtype != object and (not d.size or (d.astype(float) ** 2).sum(1).max() < 2**62):
        return (d * d).sum(1).tolist()
    out = [sum(int(v) * int(v) for v in row) for row in d.tolist()]
    return [v if v < 2**63 else None for v in out]


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every usable row and each of its components.

    Rows whose vector is null or holds null or non-finite entries are left out of everything. Each entry c of the others
    becomes x = floor(scale*c) + shift; all of them, repeated rows included, are fitted. Components are the unit eigenvectors of the
    covariance of x (divisor n), numbered from 1 by falling eigenvalue, ``components`` at most. deviation is the exact sum
    of (n*x - S)^2, null where no long holds it; whitened the row's centred projection over the eigenvalue's root; explained
    the eigenvalue's share of the trace; identity_error the largest entry of |covariance of whitened - identity|.

    A direction without variance (an eigenvalue that is zero to rounding: copies of one vector, fewer rows than entries) has
    explained 0 and whitened null, and is no part of identity_error; where no direction has any, explained and identity_error are
    null too. Null ids and repeated rows are rows like others; extra columns are ignored, whatever their names; an empty table, or
    one of empty vectors, gives no rows. Vectors of several lengths, and entries whose x isn't a long, fail the job.
    """
    spark, id_type = rows.sparkSession, rows.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error"))])
    x = usable(rows, id_col, vector_col).withColumn("_v", F.transform("_v", lambda c: F.floor(c * F.lit(float(scale))).cast("long") + F.lit(shift).cast("long")))
    n, width = one_length(x)
    if not n * width:
        return spark.createDataFrame([], schema)
    # a sum for each place: tasks send one row a place
    summed = x.select(F.posexplode("_v").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("s")).collect()
    sums = [r.s for r in sorted(summed, key=lambda r: r["at"])]

    whole, rest = [s // n for s in sums], [s % n / n for s in sums]  # S/n as an integer and a fraction: x minus the integer is exact

    def centred(v: Column) -> Column:
        near = F.zip_with(v, F.lit(whole).cast("array<long>"), lambda a, b: (a - b).cast("double"))
        return F.zip_with(near, F.lit(rest).cast("array<double>"), lambda a, b: a - b)

    values, vectors = np.linalg.eigh(gramian(x.select(centred(F.col("_v")).alias("v")), width) / n)
    order = np.argsort(-values, kind="stable")[:components]
    top = values[order]
    trace = float(values.sum())
    alive = top > max(float(values.max()), 0.0) * width * np.finfo(float).eps
    root = np.where(alive, np.sqrt(np.where(alive, top, 1.0)), np.inf)
    shared = spark.sparkContext.broadcast((vectors[:, order] / root, np.array(sums, np.int64), np.array(whole, np.int64), np.array(rest)))  # width * components doubles

    def project(frames):
        basis, exact, q, r = shared.value
        step = max(1, CELLS // width)
        for f in frames:
            for lo in range(0, len(f), step):
                part = f.iloc[lo : lo + step]
                v = np.stack(part["_v"].to_numpy()).astype(np.int64)
                yield pd.DataFrame({"_id": part["_id"], "deviation": pd.array(squared(times_n(v, exact, n)), dtype="Int64"), "w": list(((v - q) - r) @ basis)})

    made = T.StructType([T.StructField("_id", T.StringType()), T.StructField("deviation", T.LongType()), T.StructField("w", T.ArrayType(T.DoubleType()))])
    # ids go through pandas as text, which holds any of them
    white = materialize(x.withColumn("_id", F.col("_id").cast("string")).mapInPandas(project, made), "whitened")
    k = len(order)
    # rows are centred exactly, so only rounding can have moved the mean of their projections: it is taken off nonetheless
    means = sorted(white.select(F.posexplode("w").alias("at", "v")).groupBy("at").agg(F.avg("v").alias("m")).collect(), key=lambda r: r["at"])
    mean = F.lit([float(r.m) for r in means]).cast("array<double>")
    spread = gramian(white.select(F.zip_with("w", mean, lambda a, b: a - b).alias("w")), k) / n - np.eye(k)
    error = float(np.abs(spread[np.ix_(alive, alive)]).max()) if alive.any() else None
    share = [float(e) / trace if a else 0.0 if alive.any() else None for e, a in zip(top, alive, strict=True)]
    out = white.select(F.col("_id").cast(id_type).alias(id_col), "deviation", F.posexplode("w").alias("_at", "_w"))
    at = F.col("_at") + 1
    return out.select(
        id_col, at.cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(F.element_at(F.lit([bool(a) for a in alive]), at), F.col("_w")).alias("whitened"), F.element_at(F.lit(share).cast("array<double>"), at).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )

