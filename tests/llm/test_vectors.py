"""Whitening, vector codes and the mix of sources against brute force: nulls, ties, repeated rows, clashing columns, empty tables, rank and size extremes."""

from __future__ import annotations

import hashlib
import math
import random
import re
from itertools import product

import numpy as np
import pytest

from quillon.llm import mixing
from quillon.llm.codes import Heaps, nearest, vector_codes
from quillon.llm.flow import Flow
from quillon.llm.mixing import mix_sources, route, targets
from quillon.llm.whitening import squared, times_n, whiten

VECTORS = "vec_id long, embedding array<float>, label int, _id string, _v int, component int, block long, n string"
TAIL = ("x", 1, 9, 4, "n")


def vectors(n=150, width=16, seed=5):
    rng = np.random.default_rng(seed)
    v = (rng.normal(0, 0.2, (n, width)) @ np.diag(np.linspace(1, 0.05, width)) + 0.3).astype(np.float32)
    v[n // 2 : n // 2 + 30] = v[3]  # a group of copies
    rows = [(int(i) * 7 % 1000, [float(x) for x in v[i]], int(i) % 3 if i % 5 else None, *TAIL) for i in range(n)]
    odd = [[None, *rows[0][1][1:]], [float("nan"), *rows[0][1][1:]], [float("inf"), *rows[0][1][1:]], None]
    rows += [(9000 + i, x, 1, *TAIL) for i, x in enumerate(odd)]
    return rows + [rows[4], rows[4], (None, rows[6][1], None, *TAIL)]


def good(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def test_whitening(spark):
    rows = vectors()
    kept = good(rows)
    got = whiten(spark.createDataFrame(rows, VECTORS).repartition(5), components=6).collect()
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in r[1]] for r in kept], object)
    n, s = len(kept), x.sum(0)
    d = n * x - s
    centred = d.astype(float) / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    assert len(got) == 6 * n and {r.n for r in got} == {n}
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    for c in range(6):
        own = sorted((r.vec_id is None, r.vec_id or 0, r.deviation, r.whitened) for r in got if r.component == c + 1)
        w = centred @ vecs[:, c] / math.sqrt(values[c])
        for sign in (1, -1):
            want = sorted((r[0] is None, r[0] or 0, int((e * e).sum()), sign * v) for r, e, v in zip(kept, d, w, strict=True))
            close = [a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6 for a, b in zip(own, want, strict=True)]
            if all(close):
                break
        else:
            raise AssertionError(f"component {c + 1}")
        assert {r.explained for r in got if r.component == c + 1} == {next(r.explained for r in got if r.component == c + 1)}
        assert abs(next(r.explained for r in got if r.component == c + 1) - values[c] / values.sum()) < 1e-9


def test_whitening_without_variance(spark):
    assert whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whiten(spark.createDataFrame([(1, [], 1, *TAIL), (2, None, 1, *TAIL)], VECTORS)).count() == 0
    one = whiten(spark.createDataFrame([(1, [0.5, 1.0], 1, *TAIL)] * 3, VECTORS)).collect()
    assert len(one) == 6 and {(r.whitened, r.explained, r.identity_error, r.deviation) for r in one} == {(None, None, None, 0)}
    line = whiten(spark.createDataFrame([(i, [i / 8, i / 4], 1, *TAIL) for i in range(8)], VECTORS)).collect()  # one direction of two
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True)} and line[0].identity_error < 1e-9
    assert {round(r.explained, 12) for r in line} == {0.0, 1.0}
    with pytest.raises(ValueError, match="entries"):
        whiten(spark.createDataFrame([(1, [0.5], 1, *TAIL), (2, [0.5, 1.0], 1, *TAIL)], VECTORS))


def test_exact_sums_beyond_64_bits():
    x = np.array([[2**40, -(2**40)], [3, 4]])
    assert times_n(x, np.array([5, 7]), 2**30).tolist() == [[2**70 - 5, -(2**70) - 7], [3 * 2**30 - 5, 4 * 2**30 - 7]]
    assert squared(np.array([[2**40, 0], [3, 4]])) == [None, 25]
    assert squared(times_n(np.array([[3], [1]]), np.array([4]), 2)) == [4, 4]


def lloyd(rows, parts=8, entries=16, rounds=6):
    """Plain Lloyd rounds over Python integers."""
    kept = sorted(good(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[math.floor(4096 * c) for c in r[1]] for r in kept]
    w = len(x[0]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for v in x]
    books = [[cut[e][p] for e in range(min(entries, len(cut)))] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [near(v[p], books[p])[1] for v in cut]
            books[p] = [[sum(col) // len(col) for col in zip(*(v[p] for v, o in zip(cut, own, strict=True) if o == e), strict=True)] if e in own else c for e, c in enumerate(books[p])]
    found = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    error = [sum(d for d, _ in f) for f in found]
    label = {}
    for r, e in zip(kept, error, strict=True):
        label[r[2]] = label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{e:02x}" for _, e in f), d, label[r[2]], sha) for r, f, d in zip(kept, found, error, strict=True))


@pytest.mark.parametrize("n,entries,common", [(150, 16, 100_000), (150, 5, 1), (9, 16, 100_000)])
def test_vector_codes_are_lloyds(spark, monkeypatch, n, entries, common):
    monkeypatch.setattr("quillon.llm.codes.COMMON_LABELS", common)
    monkeypatch.setattr("quillon.llm.codes.BLOCK_BYTES", 64 * 20)  # many blocks
    rows = vectors(n) if n > 100 else vectors(150)[:n]
    got = vector_codes(spark.createDataFrame(rows, VECTORS).repartition(4), entries=entries).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == lloyd(rows, entries=entries)


def test_vector_codes_at_their_edges(spark):
    assert vector_codes(spark.createDataFrame([], VECTORS)).count() == 0
    same = vector_codes(spark.createDataFrame([(1, [0.5] * 8, None, *TAIL)] * 40, VECTORS)).collect()
    assert {(r.code, r.error, r.label_error) for r in same} == {("00" * 8, 0, 0)} and len(same) == 40
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes(spark.createDataFrame([(1, [0.5] * 9, 1, *TAIL)], VECTORS))


def test_heaps_rescan_few_parts_and_lose_none():
    rng = np.random.default_rng(3)
    x = rng.integers(-900, 900, (2000, 2, 3))
    books = x[:16].transpose(1, 0, 2).copy()
    heaps, drift, scanned = Heaps.of(x, books), np.zeros((2, 16)), []
    import quillon.llm.codes as codes

    def counting(v, *rest, plain=nearest):
        scanned[-1] += len(v)
        return plain(v, *rest)

    for _ in range(8):
        moved = np.array([[x[heaps.own[p] == e, p].mean(0) if (heaps.own[p] == e).any() else books[p, e] for e in range(16)] for p in range(2)]).astype(int)
        by = np.sqrt(((moved - books) ** 2).sum(2))
        drift, books = drift + by + np.array([[max(np.delete(by[p], e)) for e in range(16)] for p in range(2)]), moved
        scanned.append(0)
        codes.nearest = counting
        try:
            heaps.step(x, books, drift)
        finally:
            codes.nearest = nearest
        for p in range(2):
            assert (heaps.own[p] == ((x[:, p, None] - books[p]) ** 2).sum(2).argmin(1)).all()
        heaps = Heaps.unpack(heaps.pack(), 2000, 2, 16)
    assert scanned[-1] < 2000  # of 4000 parts


def test_flow_is_the_cheapest_of_the_largest():
    rng = random.Random(1)
    for _ in range(60):
        arcs = [(a, b, rng.randint(1, 2), rng.randint(0, 3)) for a in range(4) for b in range(4) if a != b and rng.random() < 0.6][:8]
        net = Flow()
        ids = [net.arc(*a) for a in arcs]
        sent = net.solve(0, 3)
        cost = sum(net.carried(i) * a[3] for i, a in zip(ids, arcs, strict=True))
        best = (0, 0)
        for f in product(*(range(a[2] + 1) for a in arcs)):
            out = [sum(x for x, a in zip(f, arcs, strict=True) if a[0] == v) - sum(x for x, a in zip(f, arcs, strict=True) if a[1] == v) for v in range(4)]
            if out[1] == out[2] == 0 and out[0] >= 0:
                best = max(best, (out[0], -sum(x * a[3] for x, a in zip(f, arcs, strict=True))))
        assert (sent, -cost) == best


DOCS = "doc_id long, text string, source string, _id int, _key string, taken string"


def documents():
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.choice((1, 5, 40, 300)))), rng.choice(("b", "a", "é", "Z", "a", "a", None)), 1, "k", "t") for i in range(400)]
    rows += [(900, None, "a", 1, "k", "t"), (901, "", "only empty", 1, "k", "t"), (902, " \t\n", "b", 1, "k", "t"), (None, "null id here", "b", 1, "k", "t"), (None, "null id here", "b", 1, "k", "t"), (903, "one", "tiny", 1, "k", "t")]
    return rows + [rows[3]] * 30 + [(904, "x " * 20_000, "a", 1, "k", "t")]


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_mix_comes_to_its_targets(spark):
    rows = documents()
    df = spark.createDataFrame(rows, DOCS)
    got = mix_sources(df.repartition(6)).collect()
    assert len(got) == len(rows)
    size = {}
    for r in rows:
        size[r[2]] = size.get(r[2], 0) + words(r[1])
    order = sorted(size, key=lambda s: (s is None, s or ""))
    # targets by the rule's own words: cut off, and deal the excess again
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = {s: sum(size.values()) * weight[s] / sum(weight.values()) for s in order}
    while over := [s for s in order if target[s] > 3 * size[s] + 1e-9]:
        excess = sum(target[s] - 3 * size[s] for s in over)
        for s in over:
            target[s] = 3 * size[s]
        rest = [s for s in order if target[s] < 3 * size[s] - 1e-9]
        for s in rest:
            target[s] += excess * weight[s] / sum(weight[x] for x in rest)
    took = {}
    for r in got:
        (s,) = r.sources
        assert r.source_sizes == [size[s]] and abs(r.targets[0] - target[s]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        took[s] = took.get(s, 0) + r.taken
    for s in order:
        assert abs(took[s] - target[s]) <= 32  # 31 equal rows at most share what is left
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((r[0] or -1, words(r[1])) for r in rows)
    again = mix_sources(df.repartition(3).orderBy("text")).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sorted(map(str, mix_sources(df, seed=14).collect())) != sorted(map(str, got))


def test_mix_of_nothing(spark):
    assert mix_sources(spark.createDataFrame([], DOCS)).count() == 0
    none = mix_sources(spark.createDataFrame([(1, None, "a", 1, "k", "t"), (2, " ", None, 1, "k", "t")], DOCS)).collect()
    assert {(r.size, r.targets[0], r.taken) for r in none} == {(0, 0.0, 0)}
    with pytest.raises(ValueError, match="patterns"):
        mix_sources(spark.createDataFrame(documents(), DOCS), most_patterns=2)


def test_equal_rows_share_what_is_left(spark):
    rows = [(1, "a b c d e", "s", 1, "k", "t")] * 10 + [(2, "x", "t", 1, "k", "t")]
    got = mix_sources(spark.createDataFrame(rows, DOCS), weights=(25, 26), costs=(0, 1)).collect()
    assert {r.taken for r in got if r.sources == ["s"]} == {4}  # of 49 words, an equal part each
    assert [r.taken for r in got if r.sources == ["t"]] == [2]


def test_overlapping_sources_share_their_documents(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate([["a"]] * 4 + [["a", "b", "a"]] * 10 + [["b"]] * 2 + [["b", "c", None]] * 3 + [[]] * 2 + [None] * 2)]
    out, routes = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source array<string>"), weights=(3, 2, 1), with_routes=True)
    got = {r.doc_id: r for r in out.collect()}
    assert got[4].sources == ["a", "b"] and got[16].sources == ["b", "c", None] and got[21].sources == [None]
    assert all(got[i].taken == 0 and got[i].targets == [] for i in (19, 20))
    given, taken = {}, {}
    for r in routes.collect():
        given[r.source] = given.get(r.source, 0) + r.words
        taken[tuple(r.sources)] = taken.get(tuple(r.sources), 0) + r.words
    goal = {s: t for r in got.values() for s, t in zip(r.sources, r.targets, strict=True)}
    assert all(abs(given[s] - goal[s]) <= 1 for s in goal)  # these can all be met
    assert all(abs(sum(r.taken for r in got.values() if tuple(r.sources) == p) - n) <= 1 for p, n in taken.items())


def test_nothing_is_repeated_while_fresh_words_are_left():
    taken, gives = route({("a",): 10, ("a", "b"): 10, ("b",): 30}, {"a": 15, "b": 35}, (0, 1, 2))
    assert taken == {("a",): 10, ("a", "b"): 10, ("b",): 30} and gives[("a", "b"), "b"] == 5
    taken, _ = route({("a",): 10, ("b",): 30}, {"a": 25, "b": 15}, (0, 1, 2))
    assert taken == {("a",): 25, ("b",): 15}
    assert targets({"b": 10, "a": 1, None: 5}, 16, (5, 2, 1), 3) == {"a": 3.0, "b": 26 / 3, None: 13 / 3}
    assert mixing.BITS == 8
