"""Blocks: bounded groups of documents with a stable name, and key exchanges between them.

Several operators must ask, for very many hashed keys, what the rest of the corpus holds
under the same key. A row for each key and document costs far more bytes than the key.
Here a block (a few MB of documents, stored once as compressed Arrow) sends each key it
holds once, packed by bucket of the key space; a bucket sees every block's keys, answers
each block in the order it asked, and the block, met again by its name, has the answer.
A key that a third of all documents share costs a bucket one entry for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import give_back, materialize, shuffle_partitions

BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 24 << 20


def sealed(t: pa.Table) -> bytes:
    """A table as compressed Arrow."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t.combine_chunks())
    return sink.getvalue().to_pybytes()


def pack_blocks(docs: DataFrame, text_col: str, block_bytes: int = BLOCK_BYTES, stored: bool = True, seal: Callable[[pa.Table], bytes] = sealed) -> DataFrame:
    """Table (block, n_bytes, data): all of docs' columns, or what ``seal`` makes of them, of about block_bytes of text.

    A text longer than that is a block of its own. Row order in a block is fixed by the stored table. A table that isn't
    stored serves one query that shuffles it by block and uses that shuffle wherever it needs the blocks.
    """
    at = docs.columns.index(text_col)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def flush():
            nonlocal name, size
            out = pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([size], pa.int64()), pa.array([seal(pa.Table.from_batches(held))], pa.binary())], ["block", "n_bytes", "data"])
            held.clear()
            name, size = name + 1, 0
            return out

        for b in batches:
            lens = np.asarray(pc.fill_null(pc.binary_length(b.column(at)), 0), np.int64) + 16
            ends, i = np.cumsum(lens), 0
            while i < len(lens):
                room = block_bytes - size + (ends[i - 1] if i else 0)
                j = int(np.searchsorted(ends, room, "right"))
                j = max(j, i + (not held))
                if j > i:
                    held.append(b.slice(i, j - i))
                    size += int(ends[j - 1] - (ends[i - 1] if i else 0))
                if j < len(lens) or size >= block_bytes:
                    yield flush()
                i = j
        if held:
            yield flush()

    packed = docs.mapInArrow(pack, "block long, n_bytes long, data binary")
    return materialize(packed, "blocks") if stored else packed


def unpack(data) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data.as_py() if hasattr(data, "as_py") else data)).read_all().combine_chunks()


def bucket_count(blocks: DataFrame, bytes_per_text_byte: float) -> int:
    """So many that a bucket's keys take about BUCKET_BYTES; a few for each shuffle partition at least."""
    return buckets_for(blocks.sparkSession, blocks.agg(F.sum("n_bytes")).first()[0] or 0, bytes_per_text_byte)


def buckets_for(spark, total: int, bytes_per_text_byte: float) -> int:
    return max(4 * shuffle_partitions(spark), int(total * bytes_per_text_byte / BUCKET_BYTES) + 1)


def split_by_bucket(block: int, keys: np.ndarray, high: np.ndarray, buckets: int, extra: np.ndarray | None = None):
    """Rows (bucket, block, keys, extra) for unique keys [n, bytes] ordered by ``high``, their top 64 bits."""
    b = bucket_of(high, buckets)
    cut = np.flatnonzero(np.diff(b)) + 1
    lo, hi = np.concatenate(([0], cut)), np.concatenate((cut, [len(b)]))
    if not len(b):
        lo = hi = np.zeros(0, np.int64)
    cols = [pa.array(b[lo].astype(np.int32)), pa.array(np.full(len(lo), block, np.int64)), pa.array([keys[i:j].tobytes() for i, j in zip(lo, hi, strict=True)], pa.binary())]
    cols.append(pa.array([extra[i:j].tobytes() for i, j in zip(lo, hi, strict=True)] if extra is not None else [b""] * len(lo), pa.binary()))
    return pa.RecordBatch.from_arrays(cols, ["bucket", "block", "keys", "extra"])


def bucket_of(high: np.ndarray, buckets: int) -> np.ndarray:
    """Monotone in high, so keys ordered by it are ordered by bucket too."""
    return ((high >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


ASK = "bucket int, block long, keys binary, extra binary"
ANSWER = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("answer", pa.binary())])


def answer(asked: DataFrame, reply: Callable[[list[bytes], list[bytes]], list[bytes]]) -> DataFrame:
    """(block, bucket, answer): reply(keys, extra of all blocks) gives each block's answer, for each bucket."""

    def one(t: pa.Table) -> pa.Table:
        give_back()  # of the group before
        out = reply(t["keys"].to_pylist(), t["extra"].to_pylist())
        return pa.table([t["block"], t["bucket"], pa.array(out, pa.binary())], schema=ANSWER)

    return asked.groupBy("bucket").applyInArrow(one, "block long, bucket int, answer binary")


def meet(blocks: DataFrame, answers: DataFrame, then: Callable[[int, pa.Table, list[bytes]], pa.Table], schema, unseal: Callable = unpack) -> DataFrame:
    """then(name, documents or what was sealed, answers in bucket order) for each block."""

    def one(key, left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()  # of the block before
        right = right.sort_by("bucket")
        return then(key[0].as_py(), unseal(left["data"][0]), right["answer"].to_pylist())

    return blocks.select("block", "data").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(one, schema)


def repeated(parts: list[bytes], width: int) -> list[bytes]:
    """For lists of unique keys of 6 or 16 bytes: a bit for each key, set if another list has it."""
    sizes = [len(p) // width for p in parts]
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, width)
    if width == 16:
        two = np.ascontiguousarray(raw).view("<u8").reshape(-1, 2)
        order = np.lexsort((two[:, 1], two[:, 0]))
        same = (two[order[1:]] == two[order[:-1]]).all(1)
    else:
        one = np.zeros((len(raw), 8), np.uint8)
        one[:, :width] = raw
        one = one.view("<u8").ravel()
        order = np.argsort(one, kind="stable")
        same = one[order[1:]] == one[order[:-1]]
    hit = np.zeros(len(raw), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    ends = np.cumsum(sizes)
    return [np.packbits(hit[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)]


def bits(answers: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The bits of all answers one after another; sizes: keys asked of each bucket that was asked."""
    if not len(sizes):
        return np.zeros(0, bool)
    return np.concatenate([np.unpackbits(np.frombuffer(a, np.uint8), count=int(n)) for a, n in zip(answers, sizes, strict=True)]).astype(bool)
