"""The inverted-file index, embedding in batches, and the incremental index as a stream of versions."""

from __future__ import annotations

import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.operators import embedding, index, vector
from quillon.operators.buckets import BucketTable
from quillon.operators.vector_index import VectorIndex, recall
from quillon.sources.readers import chunk_markdown
from quillon.streaming import incremental

ROWS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """Vectors around 30 centres, a third of them copies of one; a null and a zero vector."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (30, 24))
    v = np.repeat(centres, 60, axis=0) + rng.normal(0, 0.35, (1800, 24))
    v[:600] = v[0]
    rows = [(i, [float(x) for x in r], i % 4) for i, r in enumerate(v)] + [(1800, None, 1), (1801, [0.0] * 24, 1)]
    path = str(tmp_path_factory.mktemp("rows") / "t")
    spark.createDataFrame(rows, ROWS).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


def asked(rows):
    return rows.where("vec_id % 50 = 0 AND embedding IS NOT NULL").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def brute(rows, k, threshold=None, where=lambda r: True):
    kept = [r for r in rows.collect() if r.embedding is not None and any(r.embedding)]
    m = np.array([r.embedding for r in kept], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    out = []
    for q, v in zip(kept, m, strict=True):
        if q.vec_id % 50 == 0:
            sims = [(-round(float(s), 6), r.vec_id) for r, s in zip(kept, m @ v, strict=True) if where(r) and (threshold is None or s > threshold)]
            out += [(q.vec_id, i, -s, n + 1) for n, (s, i) in enumerate(sorted(sims)[:k])]
    return out


def close(got, want):
    got, want = sorted(map(tuple, got)), sorted(want)
    return len(got) == len(want) and all(a[0] == b[0] and a[1] == b[1] and a[3] == b[3] and abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want, strict=True))


def test_all_lists_give_the_exact_answer(spark, clustered, monkeypatch):
    monkeypatch.setattr("quillon.operators.vector_index.PART_ROWS", 100)  # the hot list is several parts
    monkeypatch.setattr("quillon.operators.vector_index.QUERY_BLOCK", 8)
    at = VectorIndex.build(clustered, keep=("label",), lists=20)
    assert spark.read.parquet(f"{at.path}/lists").count() == 1802 and 1 < at.lists <= 20
    assert spark.read.parquet(f"{at.path}/lists").groupBy("list", "part").count().agg(F.max("count")).first()[0] < 600  # copies alone share a part
    assert close(at.search(asked(clustered), 10, at.lists).collect(), brute(clustered, 10))
    some = at.search(asked(clustered), 7, at.lists, threshold=0.2, where=F.col("label") != 2)
    assert close(some.collect(), brute(clustered, 7, 0.2, lambda r: r.label != 2))
    again = VectorIndex(spark, at.path)
    assert close(again.search(asked(clustered), 3, 99).collect(), brute(clustered, 3))


@pytest.mark.parametrize("probes", [6, 20])
def test_a_query_is_written_once_and_meets_a_unit_once(spark, clustered, monkeypatch, probes):
    from quillon.operators import scratch

    at = VectorIndex.build(clustered, lists=20)
    n, before = asked(clustered).count(), len(scratch._MADE)
    found = at.search(asked(clustered), 10, probes)
    assert sum(spark.read.parquet(p).count() for p in scratch._MADE[before:]) == n  # before: once for each list
    assert found.groupBy("query_id").count().agg(F.max("count")).first()[0] == 10
    unit_of, parts_of = at._units()
    assert len(unit_of) == at.lists and parts_of == [1]  # 1,802 rows are one task's
    monkeypatch.setattr("quillon.operators.vector_index.PART_ROWS", 100)
    unit_of, parts_of = at._units()
    sizes = {r["list"]: r["n"] for r in spark.read.parquet(f"{at.path}/sizes").collect()}
    for u in range(len(parts_of)):
        mine = [sizes.get(i, 0) for i in range(at.lists) if unit_of[i] == u]
        assert mine and (sum(mine) <= 100 or len([m for m in mine if m]) == 1)


def test_probed_lists_are_exact_in_units_and_blocks(spark, clustered, monkeypatch):
    at = VectorIndex.build(clustered, lists=20)
    plain = at.search(asked(clustered), 10, 6, threshold=0.1).collect()
    monkeypatch.setattr("quillon.operators.vector_index.PART_ROWS", 150)
    monkeypatch.setattr("quillon.operators.vector_index.QUERY_BLOCK", 8)
    monkeypatch.setattr("quillon.operators.vector_index.ROWS", 7)
    assert close(at.search(asked(clustered), 10, 6, threshold=0.1).collect(), [tuple(r) for r in plain])
    list_of = {r.vec_id: r.list for r in at.rows.collect()}
    near = {}
    for r in asked(clustered).collect():
        q = np.array(r.q) / (np.linalg.norm(r.q) or 1)
        near[r.query_id] = set(np.argsort(-(at.centers @ q), kind="stable")[:6].tolist())
    want = [(q, i, s) for q, i, s, _ in brute(clustered, 2000, 0.1) if list_of[i] in near[q]]
    want = [(q, i, s, sum(w[0] == q for w in want[:n]) + 1) for n, (q, i, s) in enumerate(want)]
    assert close(plain, [w for w in want if w[3] <= 10])


def test_best_rows_of_ties_strings_and_zeros(monkeypatch):
    monkeypatch.setattr("quillon.operators.vector.QUERIES", 4)
    rng = np.random.default_rng(5)
    m = vector.unit_rows(rng.integers(-1, 2, (400, 5)).astype(float))  # many equal ones, some zeros
    q = vector.unit_rows(np.concatenate([rng.integers(-1, 2, (9, 5)).astype(float), np.zeros((1, 5)), np.full((1, 5), np.nan)]))
    m[17] = np.nan
    names = pa.array([f"r{i * 37 % 400}" for i in range(400)])
    own = np.where(np.arange(400) % 31 == 3, np.arange(400) % 9, -1)
    only = np.array([0, 2, 3, 7, 8, 9, 10])
    best = vector.Best(q, 6)
    for lo in range(0, 400, 23):
        best.offer(m[lo : lo + 23], names.slice(lo, 23), own[lo : lo + 23], 0.2, only)
    at, ids, sims = best.found()
    sim = np.round(m @ q.T, 6)
    want = []
    for i in only.tolist():
        some = sorted((-sim[r, i], names[r].as_py()) for r in range(400) if own[r] != i and m[r] @ q[i] > 0.2)
        want += [(i, n, -s) for s, n in some[:6]]
    assert list(zip(at.tolist(), ids.to_pylist(), sims.tolist(), strict=True)) == want and want


def test_few_probes_find_most_and_read_few_lists(spark, clustered):
    at = VectorIndex.build(clustered, lists=30)
    exact = at.search(asked(clustered), 10, at.lists)
    probes = at.probes_for(asked(clustered), 0.95)
    assert probes < at.lists
    assert recall(at.search(asked(clustered), 10, probes), exact, "vec_id") >= 0.9
    one = asked(clustered).where("query_id = 50")
    plan = at.search(one, 10, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "list" in plan.split("PartitionFilters")[1][:60]


def test_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    at = VectorIndex.build(rows)
    exact = vector.batch_topk(rows, rows.where("vec_id % 50 = 0"), 10)
    found = at.search(asked(rows), 10, at.probes_for(asked(rows), 0.95), others=True)
    assert recall(found, exact, "vec_id") >= 0.9


def test_index_of_nothing(spark):
    empty = spark.createDataFrame([], ROWS)
    at = VectorIndex.build(empty)
    assert at.search(asked(empty), 3).count() == 0
    none = spark.createDataFrame([(1, None, 1), (2, [0.0, 0.0], 1)], ROWS)
    at = VectorIndex.build(none)
    assert at.rows.count() == 2 and at.search(none.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 3).count() == 0
    with pytest.raises(Exception, match="dimensions"):
        VectorIndex.build(spark.createDataFrame([(1, [1.0], 1), (2, [1.0, 2.0], 1)], ROWS))


def test_failed_texts_go_to_the_side_output(spark):
    plain, sizes = embedding.hashed_words(16), []

    def brittle(texts: pa.Array) -> np.ndarray:
        sizes.append(len(texts))
        if any("bad" in t for t in texts.to_pylist()):
            raise RuntimeError("model refused")
        return plain(texts)

    rows = [(i, "bad word" if i == 30 else None if i == 31 else "" if i == 32 else f"word{i} Word{i} x") for i in range(250)]
    out = embedding.embed(spark.createDataFrame(rows, "id int, text string").coalesce(1), "text", brittle)
    good, failed = index.split_errors(out, "error")
    assert {r.id: r.error for r in failed.collect()} == {30: "model refused", 31: "no text", 32: "a text without words"}
    vectors = {r.id: r.embedding for r in good.collect()}
    assert len(vectors) == 247 and all(abs(sum(x * x for x in v) - 1) < 1e-12 for v in vectors.values())
    import hashlib

    for i in (0, 249):
        want = np.zeros(16)
        for w in (f"word{i}", f"word{i}", "x"):
            h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
            want[h % 16] += -1 if h // 16 % 2 else 1
        assert np.allclose(vectors[i], want / np.linalg.norm(want))
    many = [embedding.hashed_words(16)(pa.array([t])).tolist()[0] for t in ("a b\tc", "A  b\nC ")]
    assert many[0] == many[1]


SOURCES = "doc string, v int, t string"
TWO = "## One\na\n\n## Two\nb"
BATCHES = [[("x", 1, TWO), ("y", 1, "plain"), ("z", 1, "stays"), ("gone", 1, "text")], [("x", 2, "## One\na\n\n## Two\nB"), ("gone", 2, None)], [("x", 3, "## One\na"), ("y", 0, "too old"), ("w", 1, "late one")]]


def feed(spark, folder, rows):
    spark.createDataFrame(rows, SOURCES).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.05)


def as_stream(spark, folder):
    return spark.readStream.schema(SOURCES).parquet(folder)


def chunks_of(rows):
    return sorted((r.source_id, r.version, r.chunk_index, r.title, r.chunk) for r in rows.collect())


def files_of(table, bucket):
    return sorted((str(f), f.stat().st_mtime_ns) for f in Path(table.path.removeprefix("file:")).glob(f"data/v{table.manifest()[bucket]}/bucket={bucket}/*.parquet"))


def test_index_stream_goes_on_and_rewrites_only_what_it_touches(spark, tmp_path):
    inbox, job = str(tmp_path / "in"), str(tmp_path / "job")
    feed(spark, inbox, BATCHES[0])
    table = incremental.index_stream(as_stream(spark, inbox), "doc", "v", "t", job, buckets=16)
    assert chunks_of(table.rows()) == [("gone", 1, 0, None, "text"), ("x", 1, 0, "One", "## One\na"), ("x", 1, 1, "Two", "## Two\nb"), ("y", 1, 0, None, "plain"), ("z", 1, 0, None, "stays")]
    before = {b: files_of(table, b) for b in table.manifest()}
    bucket = {(r.source_id, r.chunk_index): r.b for r in table.rows().select("source_id", "chunk_index", F.pmod(F.xxhash64("source_id", "chunk_index"), F.lit(16)).cast("int").alias("b")).collect()}
    feed(spark, inbox, BATCHES[1])
    table = incremental.index_stream(as_stream(spark, inbox), "doc", "v", "t", job, buckets=16)  # another run, from the checkpoint
    # the first chunk of x has the same text: it is not written again and keeps its version
    assert chunks_of(table.rows()) == [("x", 1, 0, "One", "## One\na"), ("x", 2, 1, "Two", "## Two\nB"), ("y", 1, 0, None, "plain"), ("z", 1, 0, None, "stays")]
    touched = {bucket["x", 1], bucket["gone", 0]}
    assert all(files_of(table, b) == before[b] for b in table.manifest() if b not in touched)
    assert any(b not in touched for b in table.manifest())
    feed(spark, inbox, BATCHES[2])
    table = incremental.index_stream(as_stream(spark, inbox), "doc", "v", "t", job, buckets=16)
    latest = spark.createDataFrame([("x", TWO.split("\n\n")[0]), ("y", "plain"), ("z", "stays"), ("w", "late one")], "doc string, t string")
    twin = sorted((r.doc, r.chunk_index, r.title, r.chunk) for r in chunk_markdown(latest, "doc", "t").collect())
    assert [(r[0], *r[2:]) for r in chunks_of(table.rows())] == twin
    same = incremental.index_stream(as_stream(spark, inbox), "doc", "v", "t", job, buckets=16)  # nothing new
    assert chunks_of(same.rows()) == chunks_of(table.rows()) and same.versions() == table.versions()


def test_bucket_table_versions(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, at int, v string").schema
    t = BucketTable(spark, str(tmp_path / "t"), schema, ["k"], 4)
    assert t.rows().count() == 0 and t.versions() == [] and t.manifest() == {}
    add = lambda n, *rows: t.merge(spark.createDataFrame(list(rows), "at int, k long, v string, extra int"), n, [F.desc("at")], F.col("v") == "drop")
    add(0, (1, 1, "a", 0), (1, 2, "b", 0), (1, None, "null key", 0))
    for _ in range(2):  # a batch that runs again
        assert len(add(1, (2, 1, "a2", 0), (1, 1, "old", 0))) == 1
        assert sorted((r.k or 0, r.v) for r in t.rows().collect()) == [(0, "null key"), (1, "a2"), (2, "b")]
    add(2, (9, 2, "drop", 0))
    assert sorted((r.k or 0, r.v) for r in t.rows().collect()) == [(0, "null key"), (1, "a2")]
    assert sorted((r.k or 0, r.v) for r in t.rows(0).collect()) == [(0, "null key"), (1, "a"), (2, "b")]
    assert add(3) == set()
    t.vacuum(keep=1)
    assert t.versions() == [3] and sorted((r.k or 0, r.v) for r in t.rows().collect()) == [(0, "null key"), (1, "a2")]
