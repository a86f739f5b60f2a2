"""Embedding texts in batches, with what fails set aside; a deterministic hashing embedder to do so without a model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed value: texts of one batch.
BATCH = 100


def hashed_words(width: int) -> Callable[[pa.Array], np.ndarray]:
    """An embedder: each word (between ASCII white space, A-Z lower-cased) adds 1 or -1 to one place, both from its MD5; rows get unit length.

    The place is the first 32 bits of the digest modulo ``width``, the sign their quotient's parity. A text without words is refused.
    """

    def embed(texts: pa.Array) -> np.ndarray:
        low = pc.replace_substring_regex(pc.ascii_lower(texts), r"[\x20\x09-\x0D]+", " ")
        words = pc.split_pattern(pc.utf8_trim(low, " "), " ")
        owner = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy())
        coded = words.flatten().dictionary_encode()
        h = np.array([int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") for w in coded.dictionary.to_pylist()], np.int64)  # once for each distinct word
        filled = np.array([bool(w) for w in coded.dictionary.to_pylist()])
        at = coded.indices.to_numpy()
        out = np.zeros((len(words), width))
        np.add.at(out, (owner, h[at] % width), (1 - 2 * (h[at] // width % 2)) * filled[at])
        n = np.sqrt((out * out).sum(1, keepdims=True))
        if len(words) and not np.bincount(owner, filled[at], len(words)).all():
            raise ValueError("a text without words")
        return np.divide(out, n, out=out, where=n > 0)

    return embed


def embed(rows: DataFrame, text_col: str, embedder: Callable[[pa.Array], np.ndarray], batch: int = BATCH) -> DataFrame:
    """rows with ``embedding`` and ``error``: a batch of texts goes to the embedder at once; where that raises, its texts are tried one by one, so
    that those at fault alone have the message and no embedding. Null texts are at fault. ``split_errors`` tells both kinds apart."""
    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())])
    at = rows.columns.index(text_col)

    def one(texts: pa.Array) -> tuple[list, list]:
        if texts.null_count and len(texts) == 1:
            return [None], ["no text"]
        try:
            if texts.null_count:
                raise ValueError("no text")
            return embedder(texts).tolist(), [None] * len(texts)
        except Exception as e:  # the embedder's failure is the row's, not the job's
            if len(texts) == 1:
                return [None], [str(e)[:200]]
            parts = [one(texts.slice(i, 1)) for i in range(len(texts))]
            return [p[0][0] for p in parts], [p[1][0] for p in parts]

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                some = b.slice(lo, batch)
                vectors, errors = one(some.column(at))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(vectors, pa.list_(pa.float64())), pa.array(errors, pa.string())], schema.names)

    return rows.mapInArrow(run, schema)
