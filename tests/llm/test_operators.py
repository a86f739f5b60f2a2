"""Each training-data operator against a brute-force version on a small fixture: nulls, empty and long texts, ties,
repeated rows, clashing columns and empty tables among its cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import decontaminate as decontamination
from quillon.llm import lm
from quillon.llm.classifier import quality_classifier
from quillon.llm.counts import token_counts
from quillon.llm.decontaminate import decontaminate
from quillon.llm.entry import tokenizer
from quillon.llm.jaccard import near_duplicates
from quillon.llm.lm import END, lm_scores, named_model
from quillon.llm.packing import conversation_parts, dot_product_pack, pack_documents
from quillon.llm.quality_rules import quality_rules
from quillon.llm.store import read_ids, read_store, write_store
from quillon.llm.substring import substring_dedup
from quillon.llm.toxicity import Trie, learn, toxicity

SCHEMA = "doc_id long, text string, lang string, n_words long, block long, keys string, score double"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [f"{a}{b}{c}" for a in "bdfglm" for b in "aeiou" for c in ("", "n", "rt", "'s", "é", ",")]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def texts() -> list[tuple]:
    rng = random.Random(3)
    shared = prose(rng, 60)
    base = prose(rng, 120).split(" ")
    out = [None, "", " \n\t ", "one", "It's 3rd  Ünïcode x 漢字 don't <|endoftext|> 😀", prose(rng, 30_000), "a b c " * 60, "x\n" * 40 + "y\ny\n"]
    out += [prose(rng, rng.randint(1, 200)) for _ in range(60)]
    out += [f"{prose(rng, 40)} {shared} {prose(rng, 20)}" for _ in range(8)]
    for k in (0, 0, 1, 2, 40):  # near copies of one text, and one far from it
        copy = list(base)
        for i in rng.sample(range(120), k):
            copy[i] = "other"
        out.append(" ".join(copy))
    out += [out[20]] * 6
    rows = [(i, t, "en", 7, 1, "k", 0.5) for i, t in enumerate(out)]
    return rows + [rows[10], rows[10], (None, out[11], "en", 7, 1, "k", 0.5), (None, None, None, None, None, None, None)]


ROWS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(70)] + [(None, 1, True), (5, None, None)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))


def bag(rows):
    return Counter(tuple(r) for r in rows)


def test_substring_dedup(docs, empty):
    window, words = 35, [SPACED.findall(t or "") for _, t, *_ in ROWS]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    want = []
    for (i, *_), w in zip(ROWS, words, strict=True):
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] > 1:
                gone[s : s + window] = [True] * window
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    assert sum(x[2] for x in want) > 1000
    for block in (4 << 20, 2000):
        assert bag(substring_dedup(docs, block_bytes=block).collect()) == bag(want)
    assert substring_dedup(empty).count() == 0
    with pytest.raises(ValueError):
        substring_dedup(docs, window=20)


@pytest.mark.parametrize("broadcast", [300_000, 0])
def test_decontaminate(spark, docs, empty, broadcast, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", broadcast)
    words = [[x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x] for _, t, *_ in ROWS]
    items = [("a", " ".join(words[20][5:40])), ("b", "one"), ("c", None), ("d", "..."), ("e", "never seen here"), ("f", " ".join(words[20][5:40]).upper()), ("g", " ".join(words[70][:9])), ("g", "one")]
    want = []
    for (i, *_), w in zip(ROWS, words, strict=True):
        hit, found = set(), set()
        for name, t in items:
            iw = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
            for s in range(max(len(iw) - 9, 1) if iw else 0):
                part = iw[s : s + 10]
                for at in range(len(w) - len(part) + 1):
                    if w[at : at + len(part)] == part:
                        hit.update(range(at, at + len(part)))
                        found.add(name)
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert sum(x[5] for x in want) > 5
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id string, text string, n_words int")
    assert bag(decontaminate(docs, bench).collect()) == bag(want)
    assert decontaminate(empty, bench).count() == 0
    assert not decontaminate(docs, bench.limit(0)).where("contaminated").count()


def test_token_store(spark, docs, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    path = write_store(docs, tokenizer("word_bpe_49k.json"), spaces=False, end_id=2, average=64)
    ids = {(r.id, r.ids) for r in read_ids(spark, path).collect()}
    full = [(i, np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u2").tobytes()) for i, t, *_ in ROWS]
    assert ids == set(full)
    rows = sorted(read_store(spark, path).collect(), key=lambda r: r.start)
    order = [(-1 if r.id is None else r.id) for r in rows]
    assert order == sorted(order) and [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    assert Counter((r.id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((i, len(x) // 2, zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes())) for i, x in full)
    stored = spark.read.parquet(f"{path}/entries").where("kind = 0")
    assert stored.count() == stored.select("key").distinct().count()
    assert read_store(spark, write_store(empty, tokenizer("word_bpe_49k.json"), spaces=False, end_id=2)).count() == 0


def test_near_duplicates(docs, empty):
    def grams(t):
        w = SPACED.findall(t or "")
        return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()

    sets = [grams(t) for _, t, *_ in ROWS]
    n = len(sets)
    link = [[j for j in range(n) if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        root = [min([root[i], *(root[j] for j in link[i])]) for i in range(n)]
    least = {}
    for i, r in enumerate(root):
        least[r] = min([x for x in (least.get(r), ROWS[i][0]) if x is not None], default=None)
    want = [(ROWS[i][0], least[root[i]], len(link[i])) for i in range(n)]
    assert sum(map(len, link)) > 40
    assert bag(near_duplicates(docs).collect()) == bag(want)
    assert near_duplicates(empty).count() == 0


def test_quality_rules(docs, empty, labels):
    got = quality_rules(docs, labels.where("quality = 1").select("doc_id")).collect()
    want = []
    for i, t, *_ in ROWS:
        t = t or ""
        w = SPACED.findall(t)
        triples = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k in range(len(w) - 2) if triples[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if SPACED.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    assert bag(r[:7] for r in got) == bag(want)
    assert quality_rules(empty, labels.limit(0).select("doc_id")).count() == 0


@pytest.mark.parametrize("buckets", [64, 65536])
def test_log_ratio_by_brute_force(docs, labels, buckets):
    def grams(t):
        w = [x.encode() for x in SPACED.findall(t or "")]
        one = [xxhash.xxh64_intdigest(x, 42) for x in w]
        h = one + [xxhash.xxh64_intdigest(y, a) for a, y in zip(one, w[1:], strict=False)]
        return [(x - (x >> 63 << 64)) % buckets for x in h]

    trusted = {i for i in range(70) if i % 2}
    raw, good = Counter(), Counter()
    for i, t, *_ in ROWS:
        raw.update(grams(t))
        if i in trusted:
            good.update(grams(t))
    n, m = sum(raw.values()), sum(good.values())
    ratio = {g: math.log((good[g] + 1) / (m + buckets)) - math.log((raw[g] + 1) / (n + buckets)) for g in raw}
    mean = [(i, sum(ratio[g] for g in own) / len(own) if (own := grams(t)) else 0.0) for i, t, *_ in ROWS]
    key = lambda x: (-1 if x[0] is None else x[0], x[1])
    got = quality_rules(docs, labels.where("quality = 1").select("doc_id"), buckets=buckets).collect()
    for (i, x), r in zip(sorted(mean, key=key), sorted(got, key=lambda r: key((r.doc_id, r.log_ratio))), strict=True):
        assert i == r.doc_id and abs(x - r.log_ratio) < 1e-5
        assert r.kept == (not r.base_failed and r.log_ratio >= -0.12)


def test_equal_texts_get_equal_verdicts(docs, labels):
    got = {}
    for r in quality_rules(docs, labels.where("quality = 1").select("doc_id")).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert got.setdefault(r.text, (r.kept, r.log_ratio)) == (r.kept, r.log_ratio)


@pytest.mark.parametrize("share", [0, 7])
def test_packing(docs, empty, share):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    limits = {"max_segments": 4} if share else {}
    rows = pack_documents(docs, tokenizer("byte_bpe_50k.json"), spaces=True, end_id=1, **limits).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        assert r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    once = {i: t for i, t, *_ in ROWS if i not in (10, None)}
    for i, t in once.items():
        parts = sorted(by_doc[i], key=lambda r: r.start)
        assert [r.start for r in parts] == [0, *np.cumsum([r.length for r in parts])[:-1].tolist()]
        assert np.frombuffer(b"".join(r.ids for r in parts), "<u4").tolist() == lib.encode(t or "", add_special_tokens=False).ids + [1]
        assert {r.doc_tokens for r in parts} == {sum(r.length for r in parts)}
    assert sum(r.length for r in by_doc[10]) == 3 * by_doc[10][0].doc_tokens
    padding = 0
    for parts in by_seq.values():
        parts.sort(key=lambda r: r.offset)
        used = sum(r.length for r in parts)
        assert [r.offset for r in parts] == [0, *np.cumsum([r.length for r in parts])[:-1].tolist()] and used <= 2048
        assert len(parts) <= limits.get("max_segments", 512)
        padding += 0 if used & (used - 1) == 0 else 2048 - used
    if not share:
        assert padding <= 0.01 * sum(r.length for r in rows)
    assert pack_documents(empty, tokenizer("byte_bpe_50k.json"), spaces=True, end_id=1).count() == 0


@pytest.mark.parametrize("limits", [{"max_loss": 300}, {"max_loss": 700, "max_segments": 3}, {"max_tokens": 256, "max_loss": 100}])
def test_packing_keeps_a_binding_loss_limit(spark, docs, limits):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    rng = random.Random(11)
    parts = {i: [(prose(rng, rng.randint(0, 120)), bool(k % 2)) for k in range(rng.randint(0, 7))] for i in range(120)}
    parts |= {900: [(prose(rng, 4000), True)], 901: [(prose(rng, 4000), False), (prose(rng, 900), True)], 902: None, 903: [(None, True), ("a", None)], 904: [("only asked", False)]}
    table = spark.createDataFrame(list(parts.items()), "doc_id long, parts array<struct<text:string,loss:boolean>>").repartition(3)
    rows = pack_documents(table, tokenizer("byte_bpe_50k.json"), spaces=True, end_id=1, parts_col="parts", **limits).collect()
    most = {"max_tokens": 2048, "max_segments": 512, "max_loss": 2048} | limits
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, own in parts.items():
        ids, bears = [], []
        for t, loss in own or []:
            ids += (new := lib.encode(t or "", add_special_tokens=False).ids)
            bears += [bool(loss)] * len(new)
        ids, bears = ids + [1], bears + [bool(own and own[-1][1])]
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist() == ids
        assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1].tolist()]
        assert all(r.loss_tokens == sum(bears[r.start + 1 : r.start + r.length]) for r in pieces)
    sums = [(sum(r.length for r in p), len(p), sum(r.loss_tokens for r in p)) for p in by_seq.values()]
    for k, name in enumerate(("max_tokens", "max_segments", "max_loss")):
        assert max(x[k] for x in sums) <= most[name]
    assert max(x[2] for x in sums) > 0.9 * most["max_loss"]
    plain = pack_documents(docs, tokenizer("byte_bpe_50k.json"), spaces=True, end_id=1, **limits).groupBy("sequence_id").agg(F.sum("length"), F.count("*"), F.sum("loss_tokens")).collect()
    assert all(r[1] <= most["max_tokens"] and r[2] <= most["max_segments"] and r[3] <= most["max_loss"] for r in plain)


def test_conversations_bear_loss_in_answers(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, "c"), (1, 2, "assistant", None)], "conv_id long, turn int, role string, text string")
    got = {r.conv_id: [tuple(p) for p in r.parts] for r in conversation_parts(turns).collect()}
    assert got == {1: [("a", False), ("b", True), (None, True)], 2: [("c", False)]}


def test_dot_product_rule_keeps_every_limit():
    rng = np.random.default_rng(1)
    tokens = rng.integers(1, 900, 400)
    loss = np.minimum(tokens, rng.integers(0, 500, 400))
    bins = dot_product_pack(tokens, loss, (1000, 5, 600))
    assert (np.bincount(bins, tokens) <= 1000).all() and (np.bincount(bins) <= 5).all() and (np.bincount(bins, loss) <= 600).all()
    with pytest.raises(ValueError):
        dot_product_pack(np.array([1001]), np.array([1]), (1000, 5, 600))


@pytest.mark.parametrize(("name", "spaces"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_token_counts(spark, empty, name, spaces):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer(name))
    odd = ["It’s “quoted” — naïve…", "漢字とかな、混ざった text 12 months", "Ἀθῆναι İstanbul ǅ e\u0301 \u212b", "<|endoftext|>a<|endoftext|><|startoftext|> b", "x\x00y\x1fz\u200d👩\u200d👩 مرحبا हिन्दी", "  \n\n lead\u00a0trail \t", "don’t DON'T we'll 'S's", "a" * 300]
    rng = random.Random(9)
    odd += ["".join(rng.choice("ab 'sS漢é\n<|>0１ÅİßǅΣς\u0301\u3000") for _ in range(60)) for _ in range(60)]
    rows = ROWS + [(1000 + i, t, "en", 7, 1, "k", 0.5) for i, t in enumerate(odd)]
    n = [len(lib.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in rows]
    want = [(i, len((t or "").encode()), k, k > 2048) for (i, t, *_), k in zip(rows, n, strict=True)]
    assert bag(token_counts(spark.createDataFrame(rows, SCHEMA).repartition(4), tokenizer(name), spaces).collect()) == bag(want)
    assert token_counts(empty, tokenizer(name), spaces).count() == 0


def test_lm_scores(docs, empty):
    tokens = [[*SPACED.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), 0] for _, t, *_ in ROWS]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, *_ in ROWS]
    count = Counter(x for t, h in zip(tokens, held, strict=True) if not h for x in t)
    n, v = sum(count.values()), len(count)
    want = bag((i, h, len(t), sum(count[x] > 0 for x in t), n, round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), 6)) for (i, *_), t, h in zip(ROWS, tokens, held, strict=True))
    got = lm_scores(docs).collect()
    assert bag((*r[:5], round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm_scores(empty).count() == 0


def test_lm_is_normalised():
    rng = np.random.default_rng(0)
    words = [(int(h) << 6 | int(h) % 64, int(n)) for h, n in zip(range(1, 300), rng.integers(10, 500, 299), strict=True)] + [(int(END), 400)]
    shape_n, shape_v = np.zeros(64), np.zeros(64)
    for h, n in words:
        shape_n[h & 63] += n + 30
        shape_v[h & 63] += 4
    m = named_model(sorted(words), shape_n, shape_v)
    size = len(words) + 64
    assert m.classes == 3 and abs(m.share.sum() - 3) < 1e-9 and (m.mass > 0).sum() == size
    c, d = rng.integers(0, size, 5000), np.sort(rng.integers(0, 50, 5000))
    for i in np.flatnonzero(rng.random(4999) < 0.8) + 1:  # a chain that can be learned
        c[i] = (c[i - 1] + 1) % size
    ctx = m.contexts(c, d)
    before = m.log_probs(c, ctx).mean()
    for whole in (False, True):
        total = sum(np.exp(m.log_probs(np.full(100, k), ctx[:100])) for k in range(size))
        assert np.allclose(total, 1, atol=1e-4), whole
        changes, rows, _ = m.train(c, ctx, 1, batch=128, passes=10)
        assert rows.any()
        m.parts = [x + y for x, y in zip(m.parts, changes, strict=True)]
    assert m.log_probs(c, ctx).mean() > before + 0.5


def skewed_model(size):
    """A model of words whose counts fall as their rank rises, and tokens drawn by those counts: (model, places, contexts)."""
    rng = np.random.default_rng(5)
    words = [(64 * i + i % 64, 10 + 200_000 // i) for i in range(1, size)] + [(int(END), 3000)]
    shape_n, shape_v = np.bincount([h & 63 for h, _ in words], [n + 7 for _, n in words], 64), np.bincount([h & 63 for h, _ in words], minlength=64) + 5.0
    m = named_model(sorted(words), shape_n, shape_v)
    c = rng.choice(len(m.mass), 20_000, p=m.mass / m.mass.sum())
    return m, c, m.contexts(c, np.sort(rng.integers(0, 50, len(c))))


def plain_training(m, c, ctx, seed, noise, batch, rate):
    """What ``Model.train`` changes, by one token, one noise word and one double after another."""
    rng = np.random.default_rng(seed)
    parts = context, word, word_bias, cls, cls_bias, position = [x.astype(float) for x in m.parts]
    past = [np.full(x.shape, 1e-6) for x in parts]
    some = rng.permutation(len(c))
    by_class = [some[c[some] // 128 == k] for k in range(m.classes)]
    steps = [(k, of[lo : lo + batch]) for k, of in enumerate(by_class) for lo in range(0, len(of), batch)]
    for s in rng.permutation(len(steps)):
        k, tokens = steps[s]
        noises = [(rng.choice(128, noise, p=m.share[k]) + 128 * k, m.share.ravel(), word, word_bias, 1), (rng.choice(m.classes, noise, p=m.prior), m.prior, cls, cls_bias, 3)]
        grads = [np.zeros(x.shape) for x in parts]
        for t in tokens:
            h = sum(context[ctx[t, j]] * position[j] for j in range(4))
            dh = np.zeros(16)
            for (drawn, share, q, b, at), own in zip(noises, (c[t], k), strict=True):
                for place, label in [(own, 1), *((z, 0) for z in drawn)]:
                    e = (label - 1 / (1 + np.exp(-(h @ q[place] + b[place] - np.log(noise * share[place]))))) / len(tokens)
                    dh += e * q[place]
                    grads[at][place] += e * h
                    grads[at + 1][place] += e
            for j in range(4):
                grads[0][ctx[t, j]] += dh * position[j]
                grads[5][j] += dh * context[ctx[t, j]]
        for x, p, g, scale in zip(parts, past, grads, (1, 1, 0.3, 1, 0.3, 1), strict=True):
            p += g * g
            x += rate * scale * g / np.sqrt(p)
    return [x - y for x, y in zip(parts, m.parts, strict=True)]


def test_lm_trains_as_plain_loops_do():
    m, c, ctx = skewed_model(300)
    c, ctx = c[:200], ctx[:200]
    got, context_rows, word_rows = m.train(c, ctx, 7, noise=20, batch=32)
    want = plain_training(m, c, ctx, 7, 20, 32, 0.1)
    for x, y in zip(got, want, strict=True):
        assert x.shape == y.shape and np.abs(y).max() > 1e-3 and np.allclose(x, y, atol=2e-4)
    assert set(np.flatnonzero(context_rows)) == set(ctx.ravel())
    assert set(c) <= set(np.flatnonzero(word_rows))


def test_lm_computes_noise_drawn_twice_once(monkeypatch):
    """With three classes a token needs exponentials for these, for the class's distinct noise words and for its own word and class, not for each draw."""
    m, c, ctx = skewed_model(300)
    n = 0

    class Counting:
        def __getattr__(self, name):
            return getattr(np, name)

        def exp(self, x, **kwargs):
            nonlocal n
            n += np.size(x)
            return np.exp(x, **kwargs)

    monkeypatch.setattr(lm, "np", Counting())
    m.train(c, ctx, 7)
    assert 0 < n <= len(c) * (64 + 3 + 2)


def test_lm_of_unknown_words_shares_out_its_shape():
    """All words of a text's end, counted or not, add up to one: named words, and each shape's others with one unseen word."""
    words = [(64 * i + i % 64, 50) for i in range(1, 200)] + [(int(END), 10)]
    shape_n, shape_v = np.bincount([h & 63 for h, _ in words], [n + 7 for _, n in words], 64), np.bincount([h & 63 for h, _ in words], minlength=64) + 5.0
    m = named_model(sorted(words), shape_n, shape_v)
    rest = m.mass[m.shapes]
    assert np.allclose(rest, shape_n - np.bincount([h & 63 for h, _ in words], [n for _, n in words], 64) + 0.1 * (5 + 1))


def test_lm_beats_counts_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = lm_scores(docs).groupBy("held_out").agg((F.sum("score") / F.sum("n_tokens")).alias("score"), (F.sum("base_score") / F.sum("n_tokens")).alias("base")).collect()
    print("log10 a token", [(r.held_out, round(r.score, 4), round(r.base, 4)) for r in rows])
    assert all(r.score > r.base + 0.1 for r in rows)


@pytest.mark.parametrize(("operator", "modulus", "rest"), [(quality_classifier, 5, 0), (toxicity, 3, 1)])
def test_classifiers_on_odd_rows(docs, empty, labels, operator, modulus, rest):
    got = operator(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % modulus == rest) for r in got)
    assert operator(empty, labels).count() == 0
    assert len({r.score for r in operator(docs, labels.limit(0)).where("doc_id < 3").collect()}) == 1


@pytest.mark.parametrize(("operator", "label", "least"), [(quality_classifier, "quality", 0.9), (toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, operator, label, least):
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = operator(docs, known).where("held_out").join(known, "doc_id").where(F.col(label).isNotNull()).select("score", "predicted", label).collect()
    pos, neg = ([r.score for r in rows if r[2] == v] for v in (1, 0))
    auc = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    right = np.mean([r.predicted == r[2] for r in rows])
    print(operator.__name__, "AUC", auc, "accuracy", right, "rows", len(rows))
    assert auc >= least and right >= 0.8


def test_trie_catches_one_edit():
    t = Trie({"vermin": (2.0, False), "idio": (1.5, True)}, frozenset({"vermis"}))
    for w, want in [("vermin", (2.0, False)), ("idiotic", (1.5, False)), ("vermmin", (2.0, True)), ("vrmin", (2.0, True)), ("vermon", (2.0, True)), ("vermis", (0.0, False)), ("vrmon", (0.0, True)), ("cat", (0.0, False))]:
        assert t.find(w) == want, w


def edits(a: str, b: str) -> int:
    """Levenshtein distance by the textbook's table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_automaton_finds_what_edit_distance_finds():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(3, 8)))
    terms = {word(): (rng.randint(1, 9) / 2, rng.random() < 0.3) for _ in range(40)}
    trie = Trie(terms, frozenset({"abcab", "cabba"}))
    for w in {word() for _ in range(1500)} | set(terms) | {"abcab", "cabba"}:
        exact = max([v for t, (v, stem) in terms.items() if t == w or stem and w.startswith(t)], default=0.0)
        near = max([v for t, (v, stem) in terms.items() if not stem and edits(t, w) <= 1], default=0.0)
        want = (exact, False) if exact or len(w) < 4 or w in ("abcab", "cabba") else (near, True)
        assert trie.find(w) == want, w


@pytest.mark.parametrize("work", [quality_classifier, toxicity])
def test_learned_operators_take_any_names_and_id_types(spark, labels, work):
    named = spark.createDataFrame([("1", "some words", "x", 1, 2, 3), (None, None, "x", 1, 2, 3)], "doc_id string, text string, _text string, _id int, _label int, text_hash int")
    own = labels.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("_id", F.lit(1)).withColumn("_label", F.lit(0))
    got = work(named, own).collect()
    assert {r.doc_id for r in got} == {"1", None} and all(0 <= r.score <= 1 for r in got)


def test_quotation_weighs_less(spark, labels):
    rows = [(1, "you are scum you moron"), (2, 'the report said "scum" is a slur term')]
    got = {r.doc_id: r.score for r in toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels.limit(0)).collect()}
    assert got[1] > 0.7 > got[2]


def test_edits_inside_a_learned_stem_are_caught(spark):
    endings = ["ian", "heit", "es", "los"]
    rows = [(f"so ein grob{endings[i % 4]} hier", 1) for i in range(40)] + [("ruhig wie immer hier", 0)] * 60
    terms, known = learn(spark.createDataFrame(rows, "_text string, _label int"))
    assert terms["grob"][1]
    t = Trie(terms, known)
    for w in ["grobian", "grobneu"]:
        assert t.find(w) == (terms["grob"][0], False), w
    for w in ["grubian", "gobheit", "grroblos", "trobian"]:
        assert t.find(w) == (terms["grob"][0], True), w
    assert t.find("ruhig") == (0.0, True)
