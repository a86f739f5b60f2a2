"""Compression of vectors to codes of 4 bits a part, with codebooks from exact integer Lloyd rounds that rescan few parts.

A vector is cut into parts; each part position has its own codebook. Every part is in a heap of its entry, keyed by how far
the second nearest entry lies beyond its own (lower bound minus upper bound) plus the entry's drift so far. An update of the
codebook moves entries; a part can only change its entry when the drift since its key was made has used up that slack, so a
round pops those parts alone and compares them with all entries exactly. Vectors are written once, as blocks in buckets; each
round writes the blocks' heaps anew, in the same buckets, and sends the driver the change of sums and counts of the entries.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.buckets import Bucketed
from quillon.llm.common import broadcast_if_small, give_back, map_arrow, materialize, shuffle_partitions
from quillon.llm.vectors import one_length, usable

BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 64 << 20
#: Room for rounding in bounds: far above a double's, far below any distance that matters.
SPARE = 1e-12
STATE = "block long, state binary, moved array<bigint>"
#: Labels whose sums may be broadcast; rows of the commonest labels meet theirs so, the others by a shuffle.
COMMON_LABELS = 100_000


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances [rows, entries] of integer vectors."""
    width = x.shape[1]
    most = int(np.abs(x).max(initial=0)) + int(np.abs(entries).max(initial=0))
    if width * most * most < 2**52:  # products and sums are exact as doubles
        a, b = x.astype(float), entries.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    if width * most * most >= 2**63:
        raise OverflowError("squared distances that no 64-bit integer holds")
    return sum((x[:, j, None] - entries[None, :, j]) ** 2 for j in range(width))


def nearest(x: np.ndarray, entries: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry of each row, the lower of equals; its key): slack to the second nearest, plus the entry's drift so far."""
    d = distances(x, entries)
    own = d.argmin(1)
    at = np.arange(len(d))
    one = np.sqrt(d[at, own].astype(float))
    if d.shape[1] == 1:
        return own, np.full(len(d), np.inf)
    d[at, own] = np.iinfo(np.int64).max
    two = np.sqrt(d.min(1).astype(float))
    key = two - one + drift[own]
    return own, key - SPARE * (one + two + drift[own])


class Heaps:
    """The parts of one block: their entries, and a heap of (key, row) for each part position and entry."""

    def __init__(self, own: np.ndarray, heaps: list[list[tuple[np.ndarray, np.ndarray]]]):
        self.own, self.heaps = own, heaps

    @classmethod
    def of(cls, x: np.ndarray, books: np.ndarray) -> Heaps:
        """All parts of x [rows, parts, width] compared with all entries of books [parts, entries, width]."""
        parts, k = books.shape[:2]
        own, heaps = np.zeros((parts, len(x)), np.uint8), []
        for p in range(parts):
            own[p], key = nearest(x[:, p], books[p], np.zeros(k))
            order = np.lexsort((key, own[p]))  # an ascending list is a heap
            ends = np.searchsorted(own[p][order], np.arange(k + 1))
            heaps.append([(key[order[a:b]], order[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)])
        return cls(own, heaps)

    def step(self, x: np.ndarray, books: np.ndarray, drift: np.ndarray) -> np.ndarray:
        """Rescan the parts whose slack is used up; gives each part position's rows that changed entry, as (part, row, from)."""
        changed = []
        for p, heaps in enumerate(self.heaps):
            open_, popped = {}, []
            for e, (keys, rows) in enumerate(heaps):
                if not len(keys) or keys[0] > drift[p, e]:
                    continue
                heap = open_[e] = list(zip(keys.tolist(), rows.tolist(), strict=True))
                while heap and heap[0][0] <= drift[p, e]:
                    popped.append(heapq.heappop(heap)[1])
            if not popped:
                continue
            rows = np.sort(np.array(popped))
            own, key = nearest(x[rows, p], books[p], drift[p])
            was = self.own[p, rows]
            for e, k, r in zip(own.tolist(), key.tolist(), rows.tolist(), strict=True):
                if e not in open_:
                    open_[e] = list(zip(*(a.tolist() for a in heaps[e]), strict=True))
                heapq.heappush(open_[e], (k, r))
            for e, heap in open_.items():
                heaps[e] = (np.array([h[0] for h in heap], float), np.array([h[1] for h in heap], np.int64))
            self.own[p, rows] = own
            moved = rows[own != was]
            changed.append(np.stack([np.full(len(moved), p), moved, was[own != was]]))
        return np.concatenate(changed, axis=1) if changed else np.zeros((3, 0), np.int64)

    def pack(self) -> bytes:
        sizes = np.array([[len(k) for k, _ in h] for h in self.heaps], "<u4")
        flat = [h for hs in self.heaps for h in hs]
        return self.own.tobytes() + sizes.tobytes() + np.concatenate([k for k, _ in flat]).astype("<f8").tobytes() + np.concatenate([r for _, r in flat]).astype("<u4").tobytes()

    @classmethod
    def unpack(cls, data: bytes, rows: int, parts: int, k: int) -> Heaps:
        at = parts * rows
        own = np.frombuffer(data, np.uint8, at).reshape(parts, rows).copy()
        ends = np.cumsum(np.frombuffer(data, "<u4", parts * k, at))
        at += 4 * parts * k
        keys, of = np.frombuffer(data, "<f8", parts * rows, at), np.frombuffer(data, "<u4", parts * rows, at + 8 * parts * rows)
        cut = list(zip(np.split(keys, ends[:-1]), np.split(of, ends[:-1]), strict=True))
        return cls(own, [cut[i : i + k] for i in range(0, parts * k, k)])


def change(x: np.ndarray, own: np.ndarray, moved: np.ndarray | None, books: np.ndarray) -> list[int]:
    """What sums and counts of entries [parts, entries, width + 1] gain; moved: (part, row, from) of parts that were in another entry."""
    parts, k, width = books.shape
    out = np.zeros((parts, k, width + 1), np.int64)
    for p in range(parts):
        if moved is None:
            rows, was = np.arange(len(x)), None
        else:
            rows, was = moved[1][moved[0] == p], moved[2][moved[0] == p]
        v = np.column_stack([x[rows, p], np.ones(len(rows), np.int64)])
        np.add.at(out[p], own[p, rows], v)
        if was is not None:
            np.subtract.at(out[p], was, v)
    return out.ravel()


def vector_codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every usable row.

    Rows whose vector is null or holds null or non-finite components are left out. Components become floor(scale*x); vectors are cut into
    ``parts`` equal parts. A part position's codebook starts as that part of the ``entries`` smallest ids (of equal ids the least
    vector first, null ids last; fewer rows make a smaller codebook). Each round assigns every part to the nearest entry, ties to
    the lower index, then sets entries to the floor of their parts' mean; entries without parts stay. code: two hex digits a
    part; error: squared distances to the final entries, summed; label_error: error summed over rows of equal label (nulls are one).

    Ties are never decided by a bound: equal distances leave no slack, so such parts are compared exactly in every round. Null ids
    and repeated rows are rows like others, each with a row of its own; extra columns are ignored, whatever their names; an
    empty table gives no rows. Vectors of several lengths, or of a length that ``parts`` doesn't divide, and distances that no long
    holds fail the job.
    """
    spark, id_type = rows.sparkSession, rows.schema[id_col].dataType
    fields = [T.StructField("_id", id_type), T.StructField("_label", rows.schema[label_col].dataType)]
    usable_rows = usable(rows, id_col, vector_col, {"_label": label_col})
    n, size = one_length(usable_rows)
    if not n:
        return spark.createDataFrame([], T.StructType([T.StructField(id_col, id_type), T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("label_error", T.LongType()), T.StructField("codebooks_sha256", T.StringType())]))
    if size % parts:
        raise ValueError(f"vectors of {size} entries can't be cut into {parts} equal parts")
    width = size // parts

    def whole(v: np.ndarray) -> np.ndarray:
        v = np.floor(v * scale)
        if np.abs(v).max(initial=0) >= 2**53:
            raise OverflowError("components beyond the integers that a double tells apart")
        return v.astype(np.int64)

    first = usable_rows.orderBy(F.col("_id").asc_nulls_last(), "_v").limit(entries).collect()
    books = whole(np.array([r["_v"] for r in first], float)).reshape(-1, parts, width).transpose(1, 0, 2)
    k = books.shape[1]
    block_rows = max(1, BLOCK_BYTES // max(4 * size, 64))

    def pack(batches):
        name = TaskContext.get().partitionId() << 32
        for b in batches:
            for lo in range(0, b.num_rows, block_rows):
                t = b.slice(lo, block_rows)
                x = whole(t["_v"].flatten().to_numpy(zero_copy_only=False)).astype("<i8")
                x = x.astype("<i4") if np.abs(x).max(initial=0) < 2**31 else x
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, t.select(["_id", "_label"]).schema) as w:
                    w.write_batch(t.select(["_id", "_label"]))
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([t.num_rows], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["block", "rows", "named", "data"])
                name += 1

    def matrix(t) -> np.ndarray:
        rows, data = t["rows"][0].as_py(), t["data"][0].as_py()
        kind = "<i8" if len(data) == 8 * rows * size and size else "<i4"
        return np.frombuffer(data, kind).astype(np.int64).reshape(rows, parts, width)

    count = max(shuffle_partitions(spark), -(-4 * n * size // BUCKET_BYTES))
    blocks = Bucketed(map_arrow(usable_rows, pack, "block long, rows int, named binary, data binary"), "block", count, "blocks")

    def row(block, heaps: Heaps, delta) -> dict:
        return {"block": [block], "state": [heaps.pack()], "moved": [delta.tolist()]}

    kinds = pa.schema([("block", pa.int64()), ("state", pa.binary()), ("moved", pa.list_(pa.int64()))])

    def begin(key, t):
        give_back()
        x = matrix(t)
        heaps = Heaps.of(x, books)
        return pa.table(row(key[0].as_py(), heaps, change(x, heaps.own, None, books)), schema=kinds)

    state = Bucketed(blocks.rows.select("block", "rows", "data").groupBy("block").applyInArrow(begin, STATE), "block", count, "state", dealt=True)
    start, sums, drift = books, np.zeros((parts, k, width + 1), object), np.zeros((parts, k))
    for turn in range(rounds):
        for r in state.rows.select(F.posexplode("moved").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect():  # parts * entries * (width + 1)
            sums.ravel()[r["at"]] += r.x
        moved_to = books.copy()
        for p, e in np.argwhere(sums[:, :, -1] > 0):
            moved_to[p, e] = [s // sums[p, e, -1] for s in sums[p, e, :-1]]
        by = np.sqrt(((moved_to - books).astype(float) ** 2).sum(2)) * (1 + SPARE)
        others = np.array([[max((by[p, j] for j in range(k) if j != e), default=0.0) for e in range(k)] for p in range(parts)])
        books, drift = moved_to, (drift + by + others) * (1 + SPARE)

        def go_on(key, left, right):  # runs within this turn
            give_back()
            x = matrix(left)
            heaps = Heaps.unpack(right["state"][0].as_py(), len(x), parts, k)
            moved = heaps.step(x, books, drift)
            return pa.table(row(key[0].as_py(), heaps, change(x, heaps.own, moved, books)), schema=kinds)

        met = blocks.rows.select("block", "rows", "data").groupBy("block").cogroup(state.rows.select("block", "state").groupBy("block"))
        after = Bucketed(met.applyInArrow(go_on, STATE), "block", count, "state", dealt=True)
        state.remove()
        state = after
    final = books if rounds else start

    def finish(key, left, right):
        give_back()
        x = matrix(left)
        own = Heaps.unpack(right["state"][0].as_py(), len(x), parts, k).own
        error = np.zeros(len(x), np.int64)
        for p in range(parts):
            gap = x[:, p] - final[p][own[p]]
            error += (gap * gap).sum(1)
        digits = np.array([f"{e:02x}" for e in range(k)])
        code = ["".join(c) for c in digits[own.T]]
        named = pa.ipc.open_stream(left["named"][0].as_buffer()).read_all()
        return pa.table([named["_id"], named["_label"], pa.array(code, pa.string()), pa.array(error)], names=["_id", "_label", "code", "error"])

    made = T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    met = blocks.rows.groupBy("block").cogroup(state.rows.select("block", "state").groupBy("block"))
    coded = materialize(met.applyInArrow(finish, made), "codes")
    blocks.remove()
    state.remove()
    digest = hashlib.sha256(",".join(str(int(v)) for v in final.ravel()).encode()).hexdigest()

    by_label = materialize(coded.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_rows")), "label_errors")

    def beside(some: DataFrame, sums: DataFrame) -> DataFrame:
        named = sums.select(F.col("_label").alias("_of"), "label_error")
        return some.join(named, F.col("_label").eqNullSafe(F.col("_of")))

    if by_label.limit(COMMON_LABELS + 1).count() <= COMMON_LABELS:
        out = beside(coded, F.broadcast(by_label))
    else:  # rows of common labels stay where they are, so no label left to the shuffle has more than a small share of all rows
        common = materialize(by_label.orderBy(F.desc("_rows"), "_label").limit(COMMON_LABELS), "common")
        is_common = coded.join(broadcast_if_small(common.select(F.col("_label").alias("_of")), COMMON_LABELS), F.col("_label").eqNullSafe(F.col("_of")), "left_anti")
        rare = by_label.join(F.broadcast(common.select(F.col("_label").alias("_of"))), F.col("_label").eqNullSafe(F.col("_of")), "left_anti")
        out = beside(coded, F.broadcast(common)).unionByName(beside(is_common, rare))
    return out.select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
