"""The chosen-path join beyond the common fixture: other thresholds, large groups of near copies, null ids, recall on a whole table."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from quillon.llm import jaccard
from quillon.llm.graph import components
from quillon.llm.jaccard import near_duplicates, sketch_floor

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, size=5):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))) if w else frozenset()


def test_a_lower_threshold_gives_its_links(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(104)]
    # 100 shingles against the first 65 of them: Jaccard 0.65
    rows = [(1, " ".join(base)), (2, " ".join(base[:69])), (3, " ".join(f"x{i}" for i in range(90)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(docs, threshold=0.6).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0)}
    assert {r.n_links for r in near_duplicates(docs, threshold=0.8).collect()} == {0}


def test_gates_follow_the_threshold():
    assert sketch_floor(0.6) < sketch_floor(0.8) < 0.8 and sketch_floor(0.0) == 0.0


def test_links_of_a_large_group_grow_with_its_size(spark, monkeypatch):
    made = {}
    for m in (200, 800, 2000):
        rng = random.Random(m)
        base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        rows = []
        for i in range(m):
            w = list(base)
            w[rng.randrange(150)] = f"other{i}"
            rows.append((i, " ".join(w)))
        seen = []

        def counted(edges, seen=seen):
            from quillon.llm.graph import contract

            seen.append(contract(edges).count())
            return components(edges)

        monkeypatch.setattr(jaccard, "components", counted)
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.class_id for r in got} == {0} and {r.n_links for r in got} == {m - 1}
        made[m] = max(seen)
    assert all(n <= 3 * m for m, n in made.items()), made


def copies_of(base, rng, m, edits):
    rows = []
    for i in range(m):
        w = list(base)
        for j in rng.sample(range(len(w)), rng.choice(edits)):
            w[j] = f"other{i}x{j}"
        rows.append((i, " ".join(w)))
    return rows


def test_shipped_rows_of_near_copies_grow_with_their_number(spark, monkeypatch):
    shipped: list = []

    def counted(df, *rest, plain=jaccard.by_group, **more):
        shipped.append(df.count())
        return plain(df, *rest, **more)

    monkeypatch.setattr(jaccard, "by_group", counted)
    per = {}
    for m in (1000, 4000, 16_000):
        rng = random.Random(m)
        shipped.clear()
        rows = copies_of([f"w{rng.randrange(10**6)}" for _ in range(120)], rng, m, [1])
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
        assert {r.class_id for r in got} == {0} and {r.n_links for r in got} == {m - 1}
        per[m] = sum(shipped) / m
    assert per[16_000] <= 2 * per[1000] + 2, per


def test_large_groups_are_compared_as_by_brute_force(spark, monkeypatch):
    """Groups of many blocks, some of whose sets are far from any pivot, with copies among them; pairs on either side of the threshold."""
    for name, size in (("BLOCK", 32), ("SMALL", 16)):
        monkeypatch.setattr(jaccard, name, size)
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    other = base[:40] + [f"v{rng.randrange(10**6)}" for _ in range(20)]
    rows = copies_of(base, rng, 150, [0, 1, 1, 2, 3]) + [(i + 200, t) for i, t in copies_of(other, rng, 60, [0, 1, 2])]
    rows += [(i + 300, " ".join(base[: rng.randint(45, 60)])) for i in range(60)] + [(i + 400, rows[i][1]) for i in range(40)]
    sets = {i: grams(t) for i, t in rows}
    want = {i: sum(len(a & b) >= 0.8 * len(a | b) for j, b in sets.items() if j != i) for i, a in sets.items()}
    got = {r.doc_id: r.n_links for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want and len(set(want.values())) > 20


def test_similarity_within_a_node(spark):
    """The signs tell near copies from sets that share a part, whatever the number of their shingles."""
    rng = np.random.default_rng(2)
    for size, shared in ((200, 190), (200, 60), (12, 11), (12, 3), (200, 0)):
        v = np.concatenate([np.sort(np.concatenate([np.arange(1, shared + 1), rng.integers(10**9, 2**62, size - shared)])).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(400)])
        bounds = np.arange(0, len(v) + 1, size)
        found = jaccard.signs(jaccard.sketches(bounds, v), jaccard.set_keys(bounds, v))
        within = spark.createDataFrame([(int(x),) for x in found], "signs long").agg(jaccard.similarity_within().alias("x")).first()["x"]
        assert abs(within - shared / (2 * size - shared)) < 0.2, (size, shared, within)


def test_rows_of_null_ids_and_repeats(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(None, one)] * 300 + [(None, two)] * 200 + [(7, two), (7, two), (7, one + " more"), (8, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in got) == sorted([(0, 7, 300)] * 300 + [(0, 7, 201)] * 200 + [(7, 7, 201)] * 2 + [(7, 7, 300), (8, 8, 0)])


def test_components_of_chains_and_stars(spark):
    edges = [(f"{i:04d}", f"{i + 1:04d}") for i in range(60)] + [("1000", f"{i}") for i in range(2000, 2100)] + [("x", "x")]
    got = {r.k: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {**{f"{i:04d}": "0000" for i in range(61)}, **{f"{i}": "1000" for i in [1000, *range(2000, 2100)]}}


@pytest.mark.parametrize("threshold", [0.8])
def test_recall_on_a_table(spark, threshold):
    """Every pair of unequal texts at the threshold, found by joining on shingles (all of them) on the driver."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: grams(r.text) for r in docs.collect()}
    holders: dict = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    pairs = {(a, b) for ids in holders.values() for k, b in enumerate(ids) for a in ids[:k]}
    linked = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    links = dict.fromkeys(sets, 0)
    for a, b in linked:
        links[a] += 1
        links[b] += 1
    got = {r.doc_id: r for r in near_duplicates(docs, threshold=threshold).collect()}
    found = sum(min(got[i].n_links, n) for i, n in links.items())
    print("recall of links", found, "of", sum(links.values()))
    assert linked and found >= 0.99 * sum(links.values())
    assert all(got[i].n_links <= n for i, n in links.items())
