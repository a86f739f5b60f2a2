"""Exact substring deduplication over words by difference-cover anchors.

A window is ``window`` consecutive words of a document. With the difference cover D of
period 21, any two positions i, j have a shift d < 21 such that i + d and j + d both lie,
modulo 21, in D. So two equal windows share an aligned anchor of ``window - 20`` words
that starts at a cover position in both. Only those anchors (5 of 21 positions) are
hashed and exchanged; where an anchor occurs again, the windows around it are hashed at
their full length with 128 bits and exchanged, which extends and verifies the match.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillon.llm.blocks import ASK, answer, bits, bucket_count, bucket_of, meet, pack_blocks, repeated, split_by_bucket, unpack
from quillon.llm.common import materialize
from quillon.llm.hashing import U64, doc_bounds, segment_hashes, window_hashes, words

PERIOD = 21
#: A perfect difference set modulo 21.
COVER = np.zeros(PERIOD, bool)
COVER[[0, 1, 6, 8, 18]] = True


class _Block:
    """The words of a block's documents and what is derived from them."""

    def __init__(self, docs: pa.Table, text_col: str, window: int):
        self.window = window
        self.data, _, self.start, self.end, self.doc = words(docs[text_col])
        self.n_docs = docs.num_rows
        self.bounds = doc_bounds(self.doc, self.n_docs)
        self.h = segment_hashes(self.data, self.start, self.end, 0)
        self.last = self.bounds[1:][self.doc]  # end of each word's document

    def anchors(self):
        """Positions of anchors and, by hash, unique keys, inverse and which occur here more than once."""
        length = self.window - PERIOD + 1
        w = window_hashes(self.h, length, 0) & U64(0xFFFFFFFFFFFF)
        i = np.arange(len(w))
        at = np.flatnonzero(COVER[(i - self.bounds[:-1][self.doc[: len(w)]]) % PERIOD] & (i + length <= self.last[: len(w)]))
        keys, inv, n = np.unique(w[at], return_inverse=True, return_counts=True)
        return at, keys, inv, n > 1

    def candidates(self, at: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Starts of whole windows that hold a repeated anchor."""
        n = len(self.h) - self.window + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        mark = np.zeros(len(self.h) + 1, np.int32)
        mark[at[hit] + 1] = 1
        seen = np.cumsum(mark)
        i = np.arange(n)
        return np.flatnonzero((seen[i + PERIOD] > seen[i]) & (i + self.window <= self.last[:n]))

    def windows(self, at: np.ndarray):
        """128-bit keys of the windows at the given starts: unique [n, 2], inverse, occur more than once."""
        h2 = segment_hashes(self.data, self.start, self.end, 1)
        both = np.stack([window_hashes(self.h, self.window, 0)[at], window_hashes(h2, self.window, 1)[at]], 1) if len(at) else np.zeros((0, 2), U64)
        order = np.lexsort((both[:, 1], both[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (both[order[1:]] != both[order[:-1]]).any(1)
        group = np.cumsum(new) - 1
        inv = np.empty(len(order), np.int64)
        inv[order] = group
        return both[order[new]], inv, np.bincount(group, minlength=int(new.sum())) > 1


def _sizes(high: np.ndarray, buckets: int) -> np.ndarray:
    b = bucket_of(high, buckets)
    return np.diff(np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1], [True])))) if len(b) else b


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, carry: list[str] | None = None, block_bytes: int = 4 << 20) -> DataFrame:
    """Remove each word covered by a window whose word sequence also starts anywhere else.

    Words are maximal runs of non-space (ASCII white space) characters. Windows are judged
    on the input. Returns a row for every input row: the carried columns (``id_col`` alone
    by default), n_words, n_removed, kept_text (kept words joined by one space).

    Null or empty text: 0 words, kept_text ''. Texts under ``window`` words lose nothing.
    Repeated rows (equal ids too) are rows of their own, and repeats of each other. Empty
    table: empty result. Other columns are ignored; a carried column named like an output
    gives way to it.
    """
    if window <= PERIOD:
        raise ValueError(f"window must exceed {PERIOD} words")
    out_fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
    names = {f.name for f in out_fields}
    carried = [c for c in (carry or [id_col]) if c not in names]
    need = list(dict.fromkeys([*carried, text_col]))
    blocks = pack_blocks(docs.select(*need), text_col, block_bytes)
    n1, n2 = bucket_count(blocks, 0.3), bucket_count(blocks, 1.0)
    fields = [docs.schema[c] for c in carried]
    schema = T.StructType(fields + out_fields)

    def spread(keys):  # 48 bits to the top of 64, ordered alike
        return keys << U64(16)

    def ask_anchors(batches):
        for b in batches:
            for name, data in zip(b["block"].to_pylist(), b["data"], strict=True):
                _, keys, _, _ = _Block(unpack(data), text_col, window).anchors()
                six = np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :6])
                yield split_by_bucket(name, six, spread(keys), n1)

    first = answer(blocks.select("block", "data").mapInArrow(ask_anchors, ASK), lambda keys, _: repeated(keys, 6))

    def ask_windows(name, t, got):
        block = _Block(t, text_col, window)
        at, keys, inv, local = block.anchors()
        hit = (bits(got, _sizes(spread(keys), n1)) | local)[inv] if len(keys) else np.zeros(0, bool)
        cand = block.candidates(at, hit)
        both, winv, many = block.windows(cand)
        rows = split_by_bucket(name, both, both[:, 0], n2)
        own = pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([name], pa.int64()), pa.array([_pack(cand)], pa.binary()), pa.array([b""], pa.binary())], ["bucket", "block", "keys", "extra"])
        return pa.Table.from_batches([rows, own])

    asked = materialize(meet(blocks, first, ask_windows, ASK), "windows")
    # bucket -1 carries a block's candidate starts on to its last step
    kept = asked.where("bucket = -1").selectExpr("block", "bucket", "keys AS answer")
    second = answer(asked.where("bucket >= 0"), lambda keys, _: repeated(keys, 16)).unionByName(kept)

    def remove(name, t, got):
        block = _Block(t, text_col, window)
        cand = _unpack(got[0]) if got else np.zeros(0, np.int64)
        both, winv, many = block.windows(cand)
        hit = (bits(got[1:], _sizes(both[:, 0], n2)) | many)[winv] if len(cand) else np.zeros(0, bool)
        step = np.zeros(len(block.h) + 1, np.int32)
        starts = cand[hit]
        np.add.at(step, starts, 1)
        np.add.at(step, starts + window, -1)
        gone = np.cumsum(step[:-1]) > 0
        b = block.bounds
        removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[b])
        texts = _kept_texts(block, ~gone)
        cols = [t[c] for c in carried] + [pa.array(np.diff(b)), pa.array(removed), texts]
        return pa.table(cols, names=[f.name for f in schema.fields])

    return meet(blocks, second, remove, schema)


def _pack(a: np.ndarray) -> bytes:
    """Ascending positions, as the differences' bytes (compressed by the table they are stored in)."""
    return np.diff(a, prepend=0).astype(np.int32).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(b, np.int32), dtype=np.int64)


def _kept_texts(block: _Block, keep: np.ndarray) -> pa.Array:
    """The kept words of each document joined by one space, built at once for the whole block."""
    s, e = block.start[keep], block.end[keep]
    doc = block.doc[keep]
    n = e - s + 1  # and a space
    last = np.ones(len(doc), bool)
    last[:-1] = doc[1:] != doc[:-1]
    n = n - last
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    out = np.full(total, 32, np.uint8)
    if total:
        length = e - s
        src = np.repeat(s - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(int(length.sum()))
        dst = np.repeat((ends - n) - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(int(length.sum()))
        out[dst] = block.data[src]
    per = np.bincount(doc, weights=n, minlength=block.n_docs).astype(np.int64)
    off = np.concatenate(([0], np.cumsum(per)))
    kind = pa.string() if total < 2**31 - 1 else pa.large_string()
    return pa.Array.from_buffers(kind, block.n_docs, [None, pa.py_buffer(off.astype(np.int32 if kind == pa.string() else np.int64)), pa.py_buffer(out)])
