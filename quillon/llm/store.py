"""A content-addressed store of token ids: chunks by digest, document recipes, Merkle manifests.

Files below the store's folder:

* ``entries/kind=0``: unique chunks (key: 16-byte BLAKE2b digest of the ids, n, data: little-endian ids of ``width`` bytes);
* ``recipes``: a row for each document in ascending id order (part, place, id, start, n_tokens,
  data: 16-byte digest and 4-byte length of each chunk), one folder of parts ordered by id;
* ``manifest``: for each part its first place, documents, tokens and the Merkle root of its recipes.

A rolling hash over 16 ids cuts each document's stream where the hash's low bits are zero, so
passages that documents share are cut alike wherever they stand.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import by_bytes, map_arrow, scratch_dir, shuffle_partitions
from quillon.llm.encoder import ENCODE_BYTES, encoder, forget
from quillon.llm.hashing import U64, mix, window_hashes

WINDOW = 16


def cut_points(ids: np.ndarray, off: np.ndarray, average: int, longest: int) -> np.ndarray:
    """Ascending chunk bounds, document bounds among them."""
    h = window_hashes(mix(ids.astype(U64) + U64(1)), WINDOW, 0)
    at = np.flatnonzero((h & U64(average - 1)) == 0) + WINDOW
    at = at[at - off[np.searchsorted(off, at, "left") - 1] >= WINDOW] if len(at) else at  # whole window in one document
    at = np.unique(np.concatenate([at, off]))
    gap = np.diff(at)
    more = (gap - 1) // longest
    long = np.flatnonzero(more > 0)
    if len(long):
        extra = [at[i] + longest * np.arange(1, more[i] + 1) for i in long]
        at = np.unique(np.concatenate([at, *extra]))
    return at


def _root(leaves: list[bytes]) -> bytes:
    """Merkle root; an odd last node moves up as it is."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=32).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + b"".join(level[i : i + 2]), digest_size=32).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else bytes(32)


def write_store(docs: DataFrame, tokenizer: str, spaces: bool, end_id: int, id_col: str = "doc_id", text_col: str = "text", average: int = 512, longest: int = 8192, width: int = 2) -> str:
    """Encode every whole text (null: empty), append end_id, write the store, return its folder.

    Each distinct chunk's bytes are shuffled and stored once (once for each task on the way), and
    rows of one hot digest are as few as the tasks that met it. Rows with equal ids are documents
    of their own, ordered among themselves by their recipe. width 2 holds ids under 65,536. An empty table makes a store without
    documents.
    """
    spark = docs.sparkSession
    path = f"{scratch_dir(spark)}/token-store-{uuid.uuid4().hex}"
    kind = np.dtype("<u2" if width == 2 else "<u4")
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("key", T.BinaryType()), T.StructField("doc", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("data", T.BinaryType())])

    def encode(batches):
        task, row, seen = TaskContext.get().partitionId(), 0, set()
        arrow_id = None
        for b in by_bytes(batches, 1, 4 * ENCODE_BYTES):  # more at once, which costs less time: nothing else is held here
            arrow_id = b.column(0).type
            ids, off = encoder(tokenizer, spaces).encode(b.column(1))
            docs_n = len(off) - 1
            ids, off = np.insert(ids, off[1:], end_id), off + np.arange(docs_n + 1)
            if width == 2 and len(ids) and int(ids.max()) >= 65536:
                raise ValueError("an id needs more than two bytes")
            at = cut_points(ids, off, average, longest)
            raw, size = ids.astype(kind).tobytes(), np.diff(at)
            bounds = (at * width).tolist()
            digests = [hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(bounds, bounds[1:], strict=False)]
            fresh = []
            for k, d in enumerate(digests):
                if d not in seen:
                    seen.add(d)
                    fresh.append(k)
            if len(seen) > 2_000_000:  # a later copy is dropped at the digest's partition
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(fresh), np.int32)), pa.array([digests[k] for k in fresh], pa.binary()), pa.nulls(len(fresh), arrow_id), pa.array(size[fresh].astype(np.int64)), pa.array([raw[bounds[k] : bounds[k + 1]] for k in fresh], pa.binary())], schema.names)
            first = np.searchsorted(at, off)
            parts = [d + int(n).to_bytes(4, "little") for d, n in zip(digests, size, strict=True)]
            recipes = [b"".join(parts[i:j]) for i, j in zip(first, first[1:], strict=False)]
            names = [task.to_bytes(8, "little") + (row + i).to_bytes(8, "little") for i in range(docs_n)]
            row += docs_n
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(docs_n, np.int32)), pa.array(names, pa.binary()), b.column(0), pa.array(np.diff(off)), pa.array(recipes, pa.binary())], schema.names)

    def once(batches):
        """Rows in the order of their keys, each key once; the names of recipes are keys of their own."""
        last = None
        for b in batches:
            key = b.column(1)
            new = np.ones(b.num_rows, bool)
            if b.num_rows:
                new[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
                new[0] = key[0].as_py() != last
                last = key[-1].as_py()
            yield b.filter(pa.array(new))

    # sorted outside memory, so a partition may hold any number of chunks
    entries = map_arrow(docs.select(id_col, text_col), encode, schema, forget).repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key").mapInArrow(once, schema)
    entries.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/entries")
    stored = spark.read.schema(schema).parquet(f"{path}/entries").where("kind = 1").select("key", "doc", "n", "data")
    # the order column of a part: by id, then recipe, for rows of equal id
    ordered = stored.repartitionByRange(shuffle_partitions(spark), "doc", "data").sortWithinPartitions("doc", "data", "key").withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
    ordered.write.option("compression", "zstd").parquet(f"{path}/ordered")
    ordered = spark.read.parquet(f"{path}/ordered")
    # as many rows as parts
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ordered.groupBy("part").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs"), F.min("place").alias("first_place")).withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    within = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    recipes = ordered.join(F.broadcast(sums.select("part", "base")), "part").select("part", "place", F.col("doc").alias("id"), (F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("start"), F.col("n").alias("n_tokens"), "data")
    recipes.write.option("compression", "zstd").parquet(f"{path}/recipes")
    recipes = spark.read.parquet(f"{path}/recipes")
    roots(recipes).join(sums.select("part", "tokens", "docs", "first_place"), "part").write.parquet(f"{path}/manifest")
    return path


def roots(recipes: DataFrame, leaf_docs: int = 4096) -> DataFrame:
    """(part, root): Merkle root over each part's recipes in order; leaves cover runs of leaf_docs documents."""
    row = F.sha2(F.concat(F.concat_ws(",", "place", "start", "n_tokens").cast("binary"), F.lit(b"\0"), "data"), 256)
    leaf = recipes.select("part", F.floor(F.col("place") % (1 << 33) / leaf_docs).alias("leaf"), "place", row.alias("h")).groupBy("part", "leaf").agg(F.array_sort(F.collect_list(F.struct("place", "h"))).alias("hs"))
    leaf = leaf.select("part", "leaf", F.sha2(F.array_join(F.transform("hs", lambda x: x.h), ","), 256).alias("leaf_hash"))

    def merkle(t: pa.Table) -> pa.Table:
        t = t.sort_by("leaf")
        return pa.table([t["part"].slice(0, 1), pa.array([_root([x.encode() for x in t["leaf_hash"].to_pylist()])], pa.binary())], names=["part", "root"])

    return leaf.groupBy("part").applyInArrow(merkle, "part int, root binary")


def _links(recipes: DataFrame) -> DataFrame:
    """(place, idx, key, n, after): a row for each chunk of each document; after: ids behind it."""

    def spread(batches):
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = len(data) // 20
                raw = np.frombuffer(data, np.uint8).reshape(n, 20)
                size = np.ascontiguousarray(raw[:, 16:]).view("<u4").ravel().astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p)), pa.array(np.arange(n, dtype=np.int32)), pa.array([data[20 * i : 20 * i + 16] for i in range(n)], pa.binary()), pa.array(size), pa.array(size.sum() - np.cumsum(size))], ["place", "idx", "key", "n", "after"])

    def gathered(batches):
        held, rows = [], 0
        for b in spread(batches):
            held.append(b)
            rows += b.num_rows
            if rows > 20_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return recipes.select("place", "data").mapInArrow(gathered, "place long, idx int, key binary, n long, after long")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key binary, n long, data binary, kind int").parquet(f"{path}/entries").where("kind = 0")  # an empty store has no file to infer from


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids): every document's ids put together again from its chunks."""
    recipes = spark.read.parquet(f"{path}/recipes")
    whole = _links(recipes).join(_chunks(spark, path).select("key", "data"), "key").groupBy("place").agg(F.array_sort(F.collect_list(F.struct("idx", "data"))).alias("c"))
    return recipes.drop("data", "part").join(whole, "place").select("id", "start", "n_tokens", F.aggregate("c", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x.data)).alias("ids"))


_SHIFTS: list[np.ndarray] = []


def shift_crc(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """crc32 values as if so many zero bytes' worth of length followed: crc(a + b) = shift(crc(a), len(b)) ^ crc(b)."""
    if not _SHIFTS:
        one = np.array([0xEDB88320] + [1 << i for i in range(31)], np.uint32)  # one zero bit
        for _ in range(3):
            one = _apply(one, one)  # one zero byte
        _SHIFTS.append(one)
    out, n, k = crc.astype(np.uint32), zeros.copy(), 0
    while n.any():
        if k == len(_SHIFTS):
            _SHIFTS.append(_apply(_SHIFTS[-1], _SHIFTS[-1]))
        odd = (n & 1).astype(bool)
        out[odd] = _apply(_SHIFTS[k], out[odd])
        n >>= 1
        k += 1
    return out


def _apply(matrix: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.zeros_like(v)
    for i in range(32):
        out ^= np.where(v >> np.uint32(i) & np.uint32(1), matrix[i], np.uint32(0))
    return out


def read_store(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) from the files; ids_crc32 is over the document's ids as little-endian uint32.

    Every chunk is read and held against its digest, the recipes against the manifest's Merkle roots;
    a difference fails the job. Chunk checksums are combined along the recipes, so no ids are shuffled.
    """
    recipes = spark.read.parquet(f"{path}/recipes")
    kind = np.dtype("<u2" if width == 2 else "<u4")

    def check(batches):
        for b in batches:
            crc, keys = [], b.column(0).to_pylist()
            for key, data in zip(keys, b.column(1).to_pylist(), strict=True):
                if hashlib.blake2b(data, digest_size=16).digest() != key:
                    raise ValueError("a chunk differs from its digest")
                crc.append(zlib.crc32(np.frombuffer(data, kind).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(crc, pa.int64())], ["key", "crc"])

    def shift(batches):
        for b in batches:
            out = shift_crc(b.column(1).to_numpy(), 4 * b.column(2).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.astype(np.int64)), b.column(3)], ["place", "crc", "n"])

    crcs = _chunks(spark, path).select("key", "data").mapInArrow(check, "key binary, crc long")
    whole = _links(recipes).join(crcs, "key").select("place", "crc", "after", "n").mapInArrow(shift, "place long, crc long, n long").groupBy("place").agg(F.bit_xor("crc").alias("crc"), F.sum("n").alias("n"))
    now = roots(recipes).withColumnRenamed("root", "root_now")
    kept = spark.read.parquet(f"{path}/manifest")
    sound = kept.join(now, "part", "left").select(F.coalesce(F.sum(F.when(F.col("root").eqNullSafe(F.col("root_now")), 0).otherwise(1)), F.lit(0)).alias("bad"))
    if sound.first()["bad"]:
        raise ValueError("recipes differ from the manifest")
    n = F.when(F.col("n") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document lacks chunks")).cast("long"))
    return recipes.join(whole, "place", "left").select("id", "start", n.alias("n_tokens"), F.col("crc").alias("ids_crc32"))
