"""Near-duplicate join on word shingles (Jaccard >= threshold) by chosen paths.

A run starts with every set in one node. In a node, each token of a set is chosen with
probability 1 / (rate * |set|) by a hash that all sets share, and the set goes on to a child
for each token it chose; so sets with much in common stay together on some path, and others
part. A node of at most ``SMALL`` sets is a bucket whose sets are compared by brute force; a
larger node is split again, unless its sets are near copies on the whole, which no token can part.
In such nodes, and in what is still large at the last level, every set is compared with the node's least, and only
those apart from it with the others, in blocks. Independent runs repeat until a pair at the threshold meets in some
bucket with at least the target recall.

Sets that are equal are one class throughout. In buckets, sketches of a few bytes decide which
sets may be near (the gates follow the threshold); groups so linked are then compared exactly: a small one set
against set, a large one through a pivot. What a set lacks of the pivot and has besides bounds its similarity to any other
set, so pairs of sets close to the pivot are links by that alone and are counted by sums over the group; only pairs
with a set farther off are compared, in blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type as to_arrow

from quillon.llm.common import broadcast_if_small, by_bytes, map_arrow, materialize
from quillon.llm.graph import components
from quillon.llm.hashing import U64, doc_bounds, mix, segment_hashes, window_hashes, words

LEVELS = 5
RATE = 0.8
#: Tokens (least hashes) of a set that deeper levels choose from.
SAMPLE = 64
#: One byte for each bin of a one-permutation minimum-hash sketch; 0 is an empty bin.
BINS = 48
#: Standard errors of a sketch's estimate by which a pair may fall short of the threshold.
SLACK = 5.2
SMALL = 128
#: Mean similarity within a node from which its sets are near copies on the whole.
DENSE = 0.5
_SIGNS = np.random.default_rng(8).integers(0, 2, (BINS, 256))
BLOCK = 1024
#: Members of a large group that are tried as its pivot.
PIVOTS = 4
#: Shingles that a block of exact comparison holds, about.
BLOCK_SHINGLES = 4 << 20
BROADCAST_KEYS = 1_000_000
_SEEDS = np.random.default_rng(7).integers(0, 2**64, 256, dtype=U64)


def runs_for(recall: float, threshold: float) -> int:
    """Runs until a pair of equal-sized sets at the threshold shares a path to the last level with that recall."""
    shared = 2 * threshold / (1 + threshold) / RATE
    meet = 1.0
    for _ in range(LEVELS):
        meet = 1 - math.exp(-shared * meet)
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def shingles(col: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): each text's distinct word shingles, ascending; a text of fewer words has one, a wordless text none."""
    data, _, start, end, doc = words(col)
    n_docs = len(col)
    b = doc_bounds(doc, n_docs)
    h = segment_hashes(data, start, end, 0)
    w = window_hashes(h, size, 0)
    i = np.arange(len(w))
    ok = i + size <= b[1:][doc[: len(w)]]
    parts, owners = [w[ok]], [doc[: len(w)][ok]]
    n = np.diff(b)
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        if len(short):
            parts.append(window_hashes(h, k, 0)[b[short]] ^ _SEEDS[k])
            owners.append(short)
    v, d = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((v, d))
    v, d = v[order], d[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return doc_bounds(d[keep], n_docs), v[keep]


def set_keys(bounds: np.ndarray, v: np.ndarray) -> list[bytes | None]:
    """16 bytes for each set, equal for equal sets; None for the empty set."""
    sums = [np.concatenate(([U64(0)], np.cumsum(mix(v ^ s)))) for s in _SEEDS[100:102]]
    n = np.diff(bounds).astype(U64)
    two = np.stack([mix(c[bounds[1:]] - c[bounds[:-1]] + n) for c in sums], 1)
    raw = two.tobytes()
    return [raw[16 * i : 16 * i + 16] if k else None for i, k in enumerate(n.tolist())]


def sketches(bounds: np.ndarray, v: np.ndarray) -> np.ndarray:
    n = len(bounds) - 1
    d = np.repeat(np.arange(n), np.diff(bounds))
    m = mix(v ^ _SEEDS[110])
    low = np.full(n * BINS, np.iinfo(np.uint64).max, U64)
    np.minimum.at(low, d * BINS + ((m >> U64(40)) % U64(BINS)).astype(np.int64), m & U64(0xFFFFFFFFFF))
    out = (low % U64(255) + U64(1)).astype(np.uint8)
    out[low == np.iinfo(np.uint64).max] = 0
    return out.reshape(n, BINS)


def sketch_floor(threshold: float) -> float:
    """Share of equal bins from which two sketches may be those of sets at the threshold."""
    return max(0.0, threshold - SLACK * math.sqrt(threshold * (1 - threshold) / BINS))


def signs(sketch: np.ndarray, k: list[bytes]) -> np.ndarray:
    """A set's random sign for each bin's value as 48 bits (an empty bin's is the set's own), and above them the number of bins that aren't empty.

    The square of the signs' mean over a node's sets is, bin by bin, about the chance that two of them agree there.
    """
    own = np.frombuffer(b"".join(k), "<u8").reshape(-1, 2)[:, :1] >> np.arange(BINS, dtype=U64) & U64(1)
    bit = np.where(sketch > 0, _SIGNS[np.arange(BINS), sketch].astype(U64), own)
    return ((bit << np.arange(BINS, dtype=U64)).sum(1, dtype=U64) | (sketch > 0).sum(1).astype(U64) << U64(BINS)).view(np.int64)


def similarity_within() -> Column:
    """Mean similarity of the sets of a node, from their signs (an aggregate)."""
    m = F.count(F.lit(1))
    mean = [2 * F.sum(F.shiftright("signs", i).bitwiseAND(F.lit(1))) / m - 1 for i in range(BINS)]
    return sum((F.greatest(x * x - 1 / m, F.lit(0.0)) for x in mean), F.lit(0.0)) / F.avg(F.shiftright("signs", BINS))


def _choose(d, v, seed, size):
    """Of tokens v of sets d (each with its node's seed), the chosen ones, as (index, child path)."""
    limit = np.where(RATE * size <= 1, 2.0**64 * (1 - 2**-53), 2.0**64 / np.maximum(RATE * size, 1)).astype(U64)
    i = np.flatnonzero(mix(v ^ seed) < limit[d])
    return i, mix(v[i] + seed[i] * U64(0x9E3779B97F4A7C15))


def first_paths(bounds: np.ndarray, v: np.ndarray, runs: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, path) of every run's first level, ordered by set."""
    n = np.diff(bounds)
    d = np.repeat(np.arange(len(n)), n)
    found = [_choose(d, v, np.full(len(v), _SEEDS[r]), n) for r in range(runs)]
    s, p = np.concatenate([d[i] for i, _ in found]), np.concatenate([p for _, p in found])
    order = np.argsort(s, kind="stable")
    return s[order], p[order]


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, runs: int) -> DataFrame:
    """(doc, h, k) for every row, h a hash of its text; for each set that a task meets, once a row of (k, n, sketch, signs, sample, path)."""
    schema = T.StructType([
        T.StructField("doc", docs.schema[id_col].dataType), T.StructField("h", T.LongType()), T.StructField("k", T.BinaryType()), T.StructField("n", T.LongType()),
        T.StructField("sketch", T.BinaryType()), T.StructField("signs", T.LongType()), T.StructField("sample", T.BinaryType()), T.StructField("path", T.ArrayType(T.LongType())),
    ])

    def sign(batches):
        seen: set[bytes | None] = {None}
        for b in by_bytes(batches, 1):
            bounds, v = shingles(b.column(1), size)
            k = set_keys(bounds, v)
            first = []
            for i, x in enumerate(k):
                if x not in seen:
                    seen.add(x)
                    first.append(i)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(k, pa.binary()), *(pa.nulls(len(k), to_arrow(f.dataType)) for f in schema.fields[3:])], schema.names)
            if len(seen) > 500_000:
                seen = {None}
            if not first:
                continue
            n = np.diff(bounds)[first]
            sub = np.concatenate(([0], np.cumsum(n)))
            v = v[np.repeat(bounds[:-1][first] - sub[:-1], n) + np.arange(int(n.sum()))]
            s, p = first_paths(sub, v, runs)
            off = pa.array(np.searchsorted(s, np.arange(len(first) + 1)).astype(np.int32))
            sample = [v[i : i + min(c, SAMPLE)].tobytes() for i, c in zip(sub.tolist(), n.tolist(), strict=False)]
            names, sketch = [k[i] for i in first], sketches(sub, v)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(first), b.column(0).type), pa.nulls(len(first), pa.int64()), pa.array(names, pa.binary()), pa.array(n), pa.array([x.tobytes() for x in sketch], pa.binary()), pa.array(signs(sketch, names)), pa.array(sample, pa.binary()), pa.ListArray.from_arrays(off, pa.array(p.view(np.int64)))],
                schema.names,
            )

    return map_arrow(docs.select(id_col, text_col, F.xxhash64(text_col).alias("_h")), sign, schema)


def split(nodes: DataFrame, samples: DataFrame) -> DataFrame:
    """(p, k, signs): the children of nodes (p, k, signs), whose sets (k, sample) choose among their sampled tokens."""

    def choose(batches):
        for b in batches:
            v = np.frombuffer(b"".join(b.column(3).to_pylist()), U64)
            size = np.asarray(pc.binary_length(b.column(3)), np.int64) // 8
            row = np.repeat(np.arange(len(size)), size)
            i, child = _choose(row, v, b.column(0).to_numpy().view(U64)[row], size)
            row = pa.array(row[i])
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), b.column(1).take(row), b.column(2).take(row)], ["p", "k", "signs"])

    return map_arrow(nodes.join(samples, "k").select("p", "k", "signs", "sample"), choose, "p long, k binary, signs long").distinct()


def by_group(df: DataFrame, keys: list[str], work, schema, rows: int = 4096) -> DataFrame:
    """work(table of whole groups, start of each group, and the end) over bounded groups of df, a group ordered by k."""

    def run(batches):
        held: list[pa.Table] = []

        def cut(t: pa.Table) -> np.ndarray:
            new = np.zeros(max(t.num_rows - 1, 0), bool)
            for k in keys:
                c = t[k].combine_chunks()
                new |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            return np.concatenate(([0], np.flatnonzero(new) + 1, [t.num_rows]))

        for b in batches:
            held.append(pa.Table.from_batches([b]))
            if sum(t.num_rows for t in held) < rows:
                continue
            t = pa.concat_tables(held).combine_chunks()
            at = cut(t)
            held = [t.slice(int(at[-2]))]
            if len(at) > 2:
                yield from work(t.slice(0, int(at[-2])), at[:-1]).to_batches()
        if held and (t := pa.concat_tables(held).combine_chunks()).num_rows:
            yield from work(t, cut(t)).to_batches()

    return map_arrow(df.repartition(*keys).sortWithinPartitions(*keys, "k"), run, schema)


def _blocks(df: DataFrame, group: str, count: str, block: int) -> DataFrame:
    """A row for each pair of blocks (x <= y) that the row's block is of; groups of one block stay as they are."""
    n = F.ceil(F.col(count) / block).cast("int")
    own = F.pmod(F.xxhash64("k", group), n).cast("int")
    return df.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("other")


def _cells(far: DataFrame, near: DataFrame, group: str) -> DataFrame:
    """A row for each pair of blocks (x <= y) of which one at least is of far rows: all pairs with a far row meet in one. Both have the
    numbers of their group's blocks, _fars and _nears; blocks of near rows are numbered after those of far ones."""
    def own(n: str) -> Column:
        return F.pmod(F.xxhash64("k", group), F.greatest(n, F.lit(1))).cast("int")

    out = far.withColumn("own", own("_fars")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_fars") + F.col("_nears") - 1)))
    met = near.withColumn("own", F.col("_fars") + own("_nears")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_fars") - 1)))
    return out.unionByName(met).withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("other", "_fars", "_nears")


def _within(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        was = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == was).all():
            return root


def _stars(k: list[bytes], a: np.ndarray, b: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """(centre, member) for links between rows a and b: each component's least k with each of its others, a k once."""
    raw = np.frombuffer(b"".join(k), ">u8").reshape(-1, 2)
    order = np.lexsort((raw[:, 1], raw[:, 0]))
    new = np.ones(len(k), np.int64)
    new[1:] = (raw[order[1:]] != raw[order[:-1]]).any(1)
    place = np.empty(len(k), np.int64)
    place[order] = np.cumsum(new) - 1
    names = order[new.astype(bool)]
    root = _roots(len(names), place[a], place[b])
    i = np.flatnonzero(root != np.arange(len(names)))
    return [k[j] for j in names[root[i]]], [k[j] for j in names[i]]


def _loose(threshold: float):
    """Star edges (a, b) of sets in a bucket whose sketches may belong to near sets. Only what hangs together matters, so
    in a larger bucket every set is compared with the first, and with others only where it isn't near that."""
    floor = sketch_floor(threshold)

    def work(t: pa.Table, at: np.ndarray) -> pa.Table:
        k = t["k"].to_pylist()
        own, x, y = (t[c].to_numpy() for c in ("own", "x", "y"))
        sk = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, BINS)
        size = t["n"].to_numpy().astype(float)
        left, right = [], []

        def near(a, b) -> np.ndarray:
            same = (sk[a] == sk[b]) & (sk[a] > 0)
            either = (sk[a] > 0) | (sk[b] > 0)
            ok = (same.sum(1) >= floor * either.sum(1)) & (np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9)
            left.append(a[ok])
            right.append(b[ok])
            return ok

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if e - s < 2:
                continue
            if e - s <= 64 and x[s] == y[s]:
                a, b = _within(e - s)
                held.append((a + s, b + s))
                if len(held) > 500:
                    near(*(np.concatenate(z) for z in zip(*held, strict=True)))
                    held = []
                continue
            rest = np.arange(s + 1, e)
            ok = near(np.full(len(rest), s), rest)
            apart = np.zeros(e - s, bool)
            apart[1:] = ~ok
            for i in rest[~ok]:
                others = ~apart
                others[i - s + 1 :] = True
                others[i - s] = False
                if x[s] != y[s]:
                    others &= own[s:e] != own[i]
                b = np.flatnonzero(others) + s
                near(np.full(len(b), i), b)
        if held:
            near(*(np.concatenate(z) for z in zip(*held, strict=True)))
        a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (left, right))
        one, two = _stars(k, a, b)
        return pa.table([pa.array(one, pa.binary()), pa.array(two, pa.binary())], names=["a", "b"])

    return work


def _near_first(threshold: float):
    """Of sets of large nodes (p, k, n, sketch; first, n0, sketch0 of their node's least): whether each may be near that one."""
    floor = sketch_floor(threshold)

    def work(batches):
        for b in batches:
            c = dict(zip(b.schema.names, b.columns, strict=True))
            one, two = (np.frombuffer(b"".join(c[x].to_pylist()), np.uint8).reshape(-1, BINS) for x in ("sketch", "sketch0"))
            n, n0 = (c[x].to_numpy().astype(float) for x in ("n", "n0"))
            same, either = ((one == two) & (one > 0)).sum(1), ((one > 0) | (two > 0)).sum(1)
            near = (same >= floor * either) & (np.minimum(n, n0) >= threshold * np.maximum(n, n0) - 1e-9)
            yield pa.RecordBatch.from_arrays([c["p"], c["k"], c["n"], c["sketch"], c["first"], pa.array(near)], ["p", "k", "n", "sketch", "first", "near"])

    return work


def _large_nodes(buckets: DataFrame, feats: DataFrame, threshold: float) -> DataFrame:
    """Star edges (a, b) of the sets of nodes (p, k, members) over BLOCK: each set that may be near its node's least with that one; those apart
    with whatever they may be near, in blocks. A node of near copies ships each of its rows once."""
    feats = feats.select("k", "n", "sketch").dropDuplicates(["k"])
    first = buckets.groupBy("p").agg(F.min("k").alias("first")).join(feats.select(F.col("k").alias("first"), F.col("n").alias("n0"), F.col("sketch").alias("sketch0")), "first")
    first = broadcast_if_small(materialize(first, "firsts"), BROADCAST_KEYS)
    met = buckets.select("p", "k").join(feats, "k").join(first, "p")
    judged = materialize(map_arrow(met, _near_first(threshold), "p long, k binary, n long, sketch binary, first binary, near boolean"), "judged")
    edges = judged.where("near AND k <> first").select(F.col("first").alias("a"), F.col("k").alias("b"))
    blocks = [F.ceil(F.count_if(c) / BLOCK).cast("int").alias(n) for n, c in (("_fars", ~F.col("near")), ("_nears", F.col("near")))]
    counts = broadcast_if_small(materialize(judged.groupBy("p").agg(*blocks).where("_fars > 0"), "apart"), BROADCAST_KEYS)
    rows = judged.join(counts, "p")
    cells = _cells(rows.where("NOT near").drop("first", "near"), rows.where("near").drop("first", "near"), "p")
    return edges.union(by_group(cells.select("p", "x", "y", "own", "k", "n", "sketch"), ["p", "x", "y"], _loose(threshold), "a binary, b binary"))


def _exact(threshold: float):
    def work(t: pa.Table, at: np.ndarray) -> pa.Table:
        """Links of each set in a group (weighted by the other's copies) and star edges between linked sets; where sets have a distance
        ``w`` from a pivot, pairs within ``limit`` of each other by that are counted elsewhere."""
        k, raw, copies = t["k"].to_pylist(), t["tokens"].to_pylist(), t["copies"].to_numpy()
        w, limit = t["w"].to_numpy(), t["limit"].to_numpy()
        own, x, y = (t[c].to_numpy() for c in ("own", "x", "y"))
        left, right = [], []
        for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            g = np.arange(s, e)
            n = len(g)
            if n < 2:
                continue
            parts = [np.frombuffer(raw[j], U64) for j in g]
            size = np.array([len(p) for p in parts])
            _, token, many = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(n), size)
            shared = many > 1
            col = np.cumsum(shared) - 1
            keep = shared[token]
            row, token, width = row[keep], col[token[keep]], int(shared.sum())
            order = np.argsort(token, kind="stable")
            row, token = row[order], token[order]
            both = np.zeros((n, n), np.float32)
            for lo in range(0, width, 4096):
                i, j = np.searchsorted(token, [lo, lo + 4096])
                m = np.zeros((n, min(4096, width - lo)), np.float32)
                m[row[i:j], token[i:j] - lo] = 1
                both += m @ m.T
            union = size[:, None] + size[None, :] - both
            a, b = np.nonzero(np.triu(both >= threshold * union - 1e-4 * (union > 0), 1))
            exact = both[a, b].astype(np.int64)
            ok = exact >= threshold * (size[a] + size[b] - exact) - 1e-9
            if x[s] != y[s]:
                ok &= own[g[a]] != own[g[b]]
            ok &= w[g[a]] + w[g[b]] > limit[s]
            left.append(g[a[ok]])
            right.append(g[b[ok]])
        a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (left, right))
        links = np.bincount(a, weights=copies[b], minlength=len(k)) + np.bincount(b, weights=copies[a], minlength=len(k))
        one, two = _stars(k, a, b)
        d = np.flatnonzero(links)
        return pa.table(
            [pa.array(one + [k[j] for j in d], pa.binary()), pa.array(two + [None] * len(d), pa.binary()), pa.array([0] * len(one) + links[d].astype(int).tolist(), pa.int64())],
            names=["a", "b", "links"],
        )

    return work


def _differences(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of each set of a part of a group (root, k, copies, tokens) and each of the group's pivots: how many tokens it lacks, and has besides."""
    pivots = [np.frombuffer(x, U64) for x in right.sort_by("place")["tokens"].to_pylist()]
    lacks, more = [], []
    for x in left["tokens"].to_pylist():
        v = np.frombuffer(x, U64)
        for c in pivots:
            both = int((c[np.minimum(np.searchsorted(c, v), len(c) - 1)] == v).sum())
            lacks.append(len(c) - both)
            more.append(len(v) - both)
    off = pa.array(np.arange(left.num_rows + 1, dtype=np.int32) * len(pivots))
    arrays = [pa.ListArray.from_arrays(off, pa.array(z, pa.int64())) for z in (lacks, more)]
    n = pa.array([len(x) // 8 for x in left["tokens"].to_pylist()], pa.int64())
    return pa.table([left["root"], left["k"], left["copies"], n, *arrays], names=["root", "k", "copies", "n", "lacks", "more"])


def _certain(t: pa.Table) -> pa.Table:
    """(root, w, certain): of a group's distances w with their copies, the copies within its limit of each."""
    t = t.sort_by("w")
    w, upto = t["w"].to_numpy(), np.concatenate(([0], np.cumsum(t["copies"].to_numpy())))
    return pa.table([t["root"], t["w"], pa.array(upto[np.searchsorted(w, t["limit"].to_numpy() - w, "right")], pa.int64())], names=["root", "w", "certain"])


def _large_groups(group: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links) as _exact gives, of groups (k, root, members, copies) of more than a block.

    For sets A and B and the pivot c, |A n B| >= |c| - lacks(A) - lacks(B). So with w = lacks + threshold * more, a pair is a
    link for certain if w(A) + w(B) <= (1 - threshold) |c|. Those links are counted by sums over w, and all sets that have one are
    linked to the set of the least w. Other pairs have a set with w over half the limit; these are compared exactly, in blocks, with
    each other and with the sets that are far enough.
    """
    own = materialize(group.join(sets, "k").select("root", "k", "copies", "members", "tokens"), "large")
    pick = [F.min(F.struct(F.xxhash64("k", F.lit(i)).alias("h"), "k")).alias(f"c{i}") for i in range(PIVOTS)]
    sizes = own.groupBy("root").agg(F.max("members").alias("members"), *pick)
    parts = F.ceil(F.col("members") / BLOCK).cast("int")
    chosen = sizes.select("root", parts.alias("parts"), F.posexplode(F.array(*[F.col(f"c{i}.k") for i in range(PIVOTS)])).alias("place", "k"))
    pivots = materialize(chosen.join(own.select("root", "k", "tokens"), ["root", "k"]).select("root", "place", "tokens", "parts"), "pivots")
    pivots = pivots.select("root", "place", "tokens", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    left = own.select("root", "k", "copies", "tokens", F.pmod(F.xxhash64("k", F.lit(99)), parts).cast("int").alias("part"))
    kind = T.StructType([T.StructField("root", T.BinaryType()), T.StructField("k", T.BinaryType()), T.StructField("copies", T.LongType()), T.StructField("n", T.LongType()), T.StructField("lacks", T.ArrayType(T.LongType())), T.StructField("more", T.ArrayType(T.LongType()))])
    diffs = materialize(left.groupBy("root", "part").cogroup(pivots.groupBy("root", "part")).applyInArrow(_differences, kind), "differences")

    def far(i: int) -> tuple[Column, Column]:
        lacks, more = F.get("lacks", F.lit(i)), F.get("more", F.lit(i))
        return lacks + threshold * more, (1 - threshold) * (F.col("n") - more + lacks) - 1e-6  # a little is left to the exact comparison

    heavy = [F.count_if(2 * far(i)[0] > far(i)[1]).alias(f"h{i}") for i in range(PIVOTS)]
    best = diffs.groupBy("root").agg(*heavy).select("root", F.array_min(F.array(*[F.struct(F.col(f"h{i}").alias("h"), F.lit(i).alias("i")) for i in range(PIVOTS)]))["i"].alias("i"))
    best = broadcast_if_small(materialize(best, "best"), BROADCAST_KEYS)
    w, limit = (F.get(F.array(*[far(i)[j] for i in range(PIVOTS)]), F.col("i")) for j in (0, 1))
    placed = materialize(diffs.join(best, "root").select("root", "k", "copies", "n", w.alias("w"), limit.alias("limit")), "placed")

    # certain links: sums over the distances within the limit, of which there are as many as the pivot has tokens at most
    sums = placed.where("w <= limit").groupBy("root", "w", "limit").agg(F.sum("copies").alias("copies"))
    certain = materialize(sums.groupBy("root").applyInArrow(_certain, "root binary, w double, certain long"), "certain")
    centre = placed.groupBy("root").agg(F.min_by("k", F.struct("w", "k")).alias("centre"))
    centre = broadcast_if_small(materialize(centre, "centres"), BROADCAST_KEYS)
    counted = placed.join(broadcast_if_small(certain, BROADCAST_KEYS), ["root", "w"]).join(centre, "root")
    links = F.col("certain") - F.when(2 * F.col("w") <= F.col("limit"), F.col("copies")).otherwise(0)
    counted = counted.select("k", "centre", links.cast("long").alias("links")).where("links > 0")
    none = F.lit(None).cast("binary")
    sure = counted.select(F.col("k").alias("a"), none.alias("b"), "links").union(counted.where("k <> centre").select(F.col("centre").alias("a"), F.col("k").alias("b"), F.lit(0).cast("long")))

    # what is left: pairs with a set far from the pivot
    is_far = 2 * F.col("w") > F.col("limit")
    bounds = placed.groupBy("root").agg(F.max("w").alias("most"), F.max("limit").alias("limit")).where(2 * F.col("most") > F.col("limit")).select("root", (F.col("limit") - F.col("most")).alias("from"))
    bounds = broadcast_if_small(materialize(bounds, "bounds"), BROADCAST_KEYS)
    open_ = placed.join(bounds, "root").where(is_far | (F.col("w") > F.col("from"))).withColumn("far", is_far).drop("from")
    room = lambda c: F.ceil(F.greatest(F.count_if(c) / (BLOCK // 2), F.sum(F.when(c, F.col("n")).otherwise(0)) / BLOCK_SHINGLES)).cast("int")
    counts = open_.groupBy("root").agg(room(F.col("far")).alias("_fars"), room(~F.col("far")).alias("_nears"))
    rows = materialize(open_.join(broadcast_if_small(materialize(counts, "open"), BROADCAST_KEYS), "root").select("root", "k", "w", "limit", "far", "_fars", "_nears"), "far")
    met = rows.join(own.select("root", "k", "copies", "tokens"), ["root", "k"])
    cells = _cells(met.where("far").drop("far"), met.where("NOT far").drop("far"), "root")
    return sure.union(by_group(cells.select("root", "x", "y", "own", "k", "copies", "tokens", "w", "limit"), ["root", "x", "y"], _exact(threshold), "a binary, b binary, links long", rows=BLOCK))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, recall: float = 0.999, with_keys: bool = False) -> DataFrame:
    """(id, class_id, n_links) for every row; with_keys: also text_hash (xxhash64 of the text) and class_key, which names the class
    even where its ids are null or stand for several texts.

    class_id is the least id of the row's connected component of documents linked by Jaccard >=
    threshold of their sets of ``size``-word shingles; n_links counts the other rows it is linked to,
    copies included. Links between unequal sets are found with the target recall (of a pair at the
    threshold; more alike, more surely), and no found link is dropped.

    A text of fewer words has one shingle, of all of them. Null and wordless texts are linked to
    nothing: class_id is their own id. Rows of equal id are rows of their own. Ids may be null; a
    class of null ids alone has a null class_id. Other columns are ignored; an empty table gives one.
    """
    sig = materialize(signatures(docs, id_col, text_col, size, runs_for(recall, threshold)), "signatures")
    rows, feats = sig.where("n IS NULL").select("doc", "h", "k"), sig.where("n IS NOT NULL").drop("doc", "h")
    keys = materialize(rows.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("copies"), F.min("doc").alias("doc"), F.min(F.struct("doc", "h")).alias("rep")), "sets")

    # level by level: nodes of some sets become buckets, larger ones are split unless they are dense
    node = feats.select(F.explode("path").alias("p"), "k", "signs").distinct()
    buckets = None
    for level in range(LEVELS):
        node = materialize(node, "nodes")
        # written, so that the join is between two plain shuffles, which a large node's rows can be split in
        counts = materialize(node.groupBy("p").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "counts")
        met = materialize(node.join(counts, "p"), "met")
        big = met.where(F.col("members") > SMALL)
        last = level == LEVELS - 1 or not big.limit(1).count()
        if last:
            here = met
        else:
            dense = materialize(big.groupBy("p").agg(similarity_within().alias("within")).where(F.col("within") >= DENSE).select("p"), "dense")
            dense = broadcast_if_small(dense, BROADCAST_KEYS)
            here = met.where(F.col("members") <= SMALL).unionByName(big.join(dense, "p", "left_semi"))
            node = split(big.join(dense, "p", "left_anti"), feats.select("k", "sample").dropDuplicates(["k"]))
        here = here.select("p", "k", "members")
        buckets = here if buckets is None else buckets.union(here)
        if last:
            break
    sketched = _blocks(buckets.where(F.col("members") <= BLOCK), "p", "members", BLOCK).join(feats.select("k", "n", "sketch").dropDuplicates(["k"]), "k")
    edges = by_group(sketched.select("p", "x", "y", "own", "k", "n", "sketch"), ["p", "x", "y"], _loose(threshold), "a binary, b binary")
    large = buckets.where(F.col("members") > BLOCK)
    loose = components(edges.union(_large_nodes(large, feats, threshold)) if large.limit(1).count() else edges)

    # exact comparison within each loosely linked group, in blocks bounded by sets and by shingles
    sizes = feats.groupBy("k").agg(F.first("n").alias("n"))
    named = loose.join(keys, "k").join(sizes, "k")
    weights = named.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    weights = weights.select("root", F.greatest("members", F.ceil(F.col("shingles") * (BLOCK // 2) / BLOCK_SHINGLES)).alias("members"))
    group = materialize(named.join(weights, "root").select("k", "root", "members", "copies", "rep"), "groups")
    wanted = broadcast_if_small(group.select(F.col("rep.doc").alias("_doc"), F.col("rep.h").alias("_h"), "k"), BROADCAST_KEYS)

    def tokens(batches):
        for b in by_bytes(batches, 0):
            bounds, v = shingles(b.column(0), size)
            keep = [i for i, (k, w) in enumerate(zip(set_keys(bounds, v), b.column(1).to_pylist(), strict=True)) if k == w]
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(keep, pa.int64())), pa.array([v[bounds[i] : bounds[i + 1]].tobytes() for i in keep], pa.binary())], ["k", "tokens"])

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    texts = texts.join(wanted, F.col("_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("_text") == F.col("_h"))).select("_text", "k")
    # rows that repeat an id and its text bring a set again
    sets = map_arrow(texts, tokens, "k binary, tokens binary").dropDuplicates(["k"])
    is_small = F.col("members") <= BLOCK // 2
    full = _blocks(group.where(is_small), "root", "members", BLOCK // 2).join(sets, "k").select("root", "x", "y", "own", "k", "copies", "tokens", F.lit(float("inf")).alias("w"), F.lit(0.0).alias("limit"))
    compared = by_group(full, ["root", "x", "y"], _exact(threshold), "a binary, b binary, links long", rows=BLOCK)
    large = group.where(~is_small)
    found = materialize(compared.union(_large_groups(large, sets, threshold)) if large.limit(1).count() else compared, "links")
    linked = components(found.where("b IS NOT NULL").select("a", "b"))
    degree = found.where("b IS NULL").groupBy(F.col("a").alias("k")).agg(F.sum("links").alias("links"))

    named = keys.join(linked, "k", "left").join(degree, "k", "left").select("k", "copies", "doc", F.coalesce("root", "k").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    classes = named.groupBy("root").agg(F.min("doc").alias("class_id"))
    per = named.join(classes, "root").select("k", "root", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    out = rows.join(per, "k", "left")
    own = F.when(F.col("k").isNull(), F.col("doc")).otherwise(F.col("class_id"))
    more = [F.col("h").alias("text_hash"), F.col("root").alias("class_key")] if with_keys else []
    return out.select(F.col("doc").alias(id_col), own.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), *more)
