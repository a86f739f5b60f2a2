"""Token counts without token ids: each distinct pre-token is counted once, and its count joined to the texts' pre-tokens.

Blocks of documents send the distinct pre-tokens that they hold to buckets by hash; a bucket meets each one from all blocks,
has the library count it once, and answers every block in the order it asked; a block sums the answers over each text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.blocks import ASK, answer, buckets_for, meet, pack_blocks, unpack
from quillon.llm.common import text_sizes
from quillon.llm.encoder import encoder


def pack_texts(texts: list[str]) -> bytes:
    """Texts as one compressed buffer: how many, their lengths in bytes, their bytes."""
    raw = [t.encode() for t in texts]
    plain = np.array([len(raw), *map(len, raw)], "<u4").tobytes() + b"".join(raw)
    return len(plain).to_bytes(4, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def unpack_texts(data: bytes) -> pa.Array:
    plain = pa.decompress(data[4:], decompressed_size=int.from_bytes(data[:4], "little"), codec="zstd")
    n = int(np.frombuffer(plain, "<u4", 1)[0])
    off = np.concatenate(([0], np.cumsum(np.frombuffer(plain, "<u4", n, 4), dtype=np.int32))).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(off), plain.slice(4 + 4 * n)])


def checksum(pieces: list[str]) -> bytes:
    return zlib.crc32("\0".join(pieces).encode()).to_bytes(4, "little")


def by_bucket(pieces: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the pieces by bucket, bucket of each in that order)."""
    b = np.fromiter((zlib.crc32(p.encode()) % buckets for p in pieces), np.int64, len(pieces))
    order = np.argsort(b, kind="stable")
    return order, b[order]


def token_counts(docs: DataFrame, tokenizer: str, spaces: bool, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text, as the tokenizer file's library gives it.

    Texts of every script are cut into pre-tokens; a special token's string is one token, as the library's default has it.
    Null counts as empty: 0 bytes, 0 tokens. Repeated rows each give a row; other columns are ignored; an empty table gives
    an empty one. docs is to be a stored table: should an executor be lost, rows that come in another order fail the job.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    buckets = buckets_for(docs.sparkSession, total, 0.6)
    # shuffled by block once, for the asking and for the answers
    blocks = pack_blocks(docs.select(*dict.fromkeys([id_col, text_col])), text_col, stored=False).select("block", "data")

    def ask(key, t):
        data = unpack(t["data"][0])
        _, _, pieces, _ = encoder(tokenizer, spaces).pieces(data[text_col].combine_chunks())
        order, bucket = by_bucket(pieces, buckets)
        at = np.flatnonzero(np.diff(bucket, prepend=-1))
        lists = [pack_texts([pieces[k] for k in order[i:j].tolist()]) for i, j in zip(at, [*at[1:], len(order)], strict=False)]
        return pa.table([pa.array(bucket[at].astype(np.int32)), pa.array(np.full(len(at), key[0].as_py(), np.int64)), pa.array(lists, pa.binary()), pa.array([checksum(pieces)] * len(at), pa.binary())], names=["bucket", "block", "keys", "extra"])

    def reply(keys: list[bytes], sums: list[bytes]) -> list[bytes]:
        lists = [unpack_texts(k) for k in keys]
        whole = pa.chunked_array(lists, pa.string()).combine_chunks()
        coded = (pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole).dictionary_encode()
        n = encoder(tokenizer, spaces).lengths(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        n = n.astype("<u1" if n.max(initial=0) < 256 else "<u4")
        ends = np.cumsum([len(x) for x in lists])
        return [c + n.itemsize.to_bytes(1, "little") + n[e - len(x) : e].tobytes() for e, x, c in zip(ends, lists, sums, strict=True)]

    def count(_, t: pa.Table, got: list[bytes]) -> pa.Table:
        texts = t[text_col].combine_chunks()
        doc, place, pieces, special = encoder(tokenizer, spaces).pieces(texts)
        order, _ = by_bucket(pieces, buckets)
        each = np.zeros(len(pieces), np.int64)
        if got and got[0][:4] != checksum(pieces):
            raise ValueError("the documents' rows came in another order when they were read again; store them first")
        if got:
            each[order] = np.concatenate([np.frombuffer(x, f"<u{x[4]}", offset=5) for x in got])
        n = pa.array(np.bincount(doc, each[place], len(texts)).astype(np.int64)[: len(texts)] + special)
        return pa.table([t[id_col], pa.array(text_sizes(texts)), n, pc.greater(n, limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    counted = answer(blocks.groupBy("block").applyInArrow(ask, ASK), reply)
    return meet(blocks, counted, count, schema)
