"""The pipeline's stages on a small folder of tables, each held against its operator's rule."""

from __future__ import annotations

import re

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        assert out.columns == columns and out.dtypes == docs.dtypes
        assert not out.select("doc_id").join(docs, "doc_id", "left_anti").count()
        if name == "ngram_jaccard":
            sets = {r.doc_id: w for r in out.collect() if (w := shingles(r.text))}
            ids = sorted(sets)
            assert not [(a, b) for k, a in enumerate(ids) for b in ids[:k] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
        docs = out
    packed = corpus_pipeline.packing(spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_odd_rows_pass(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept_text string"
    tail = ("en", "s", 9, "w", "kept")
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [
        (1, None, None, None, None, None, None), (2, "", *tail), (None, "alone here", *tail), (3, "same text", *tail), (3, "same text", *tail), (None, "same text", *tail),
        (None, "null twins", *tail), (None, "null twins", *tail), (4, f"a b {passage}", *tail), (5, f"{passage} c d " + " ".join(f"x{i}" for i in range(40)), *tail), (6, "holds some words of an item here", *tail), (None, "again some words of an item", *tail),
    ]
    for own in ([], rows):
        d = f"{tmp_path}/{len(own)}"
        spark.createDataFrame(own, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([("a", "some words of an item")], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.materialize(stage(spark, docs, d), name)
            assert docs.schema == spark.read.parquet(f"{d}/documents.parquet").schema
        kept = sorted((r.doc_id or 0, r.text or "") for r in docs.collect())
        want = [(0, "alone here"), (0, "null twins"), (1, ""), (2, ""), (3, "same text"), (4, "a b"), (5, "c d " + " ".join(f"x{i}" for i in range(40)))]
        assert kept == (want if own else [])
        assert {(r.n_words, r.kept_text) for r in docs.collect()} <= {("w", "kept"), (None, None)}
        assert {r.doc_id or 0 for r in corpus_pipeline.packing(spark, docs, d).collect()} == {x[0] for x in kept}


def test_any_names_and_id_types_pass(spark, tmp_path):
    schema = "text string, _id string, doc_id string, _gone int, _hash long, text_hash string, _text string, c0 int"
    tail = (1, 2, "h", "t", 0)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [("clean words of one", "q", "id a", *tail), ("you are scum you moron and scum", "q", "id a", *tail), ("twins of five words here", "q", "x", *tail), ("twins of five words here", "q", "y", *tail), (None, None, None, *tail), (f"{passage} a", "q", "z1", *tail), (f"other {passage}", "q", None, *tail), ("holds some words of an item", "q", "id b", *tail), ("and does not hold it", "q", "id b", *tail)]
    d = str(tmp_path)
    spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id string, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([("a", "some words of an item")], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, d), name)
        assert docs.schema == spark.read.parquet(f"{d}/documents.parquet").schema
    # of two texts of one id, the clean one stays
    assert sorted((r.doc_id or "", r.text or "") for r in docs.collect()) == [("", ""), ("id a", "clean words of one"), ("id b", "and does not hold it"), ("x", "twins of five words here"), ("z1", f"{passage} a")]
    assert corpus_pipeline.packing(spark, docs, d).count() >= 6


def test_each_stage_by_brute_force(spark, tmp_path):
    """Substring dedup and decontamination as sets of words say; packing as an exact round trip of lengths."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spaced = re.compile(r"[^\x20\x09-\x0D]+")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    seen: dict = {}
    for t in texts.values():
        w = spaced.findall(t)
        for i in range(len(w) - 34):
            seen[tuple(w[i : i + 35])] = seen.get(tuple(w[i : i + 35]), 0) + 1
    want = {}
    for k, t in texts.items():
        w = spaced.findall(t)
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want[k] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t
    assert {r.doc_id: r.text or "" for r in corpus_pipeline.substrings(spark, docs, SF).collect()} == want

    bench = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    windows = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (w := bench(r.text)) for i in range(max(len(w) - 9, 1))}
    sizes = {len(w) for w in windows}
    clean = {k for k, t in texts.items() if not any(tuple(w[i : i + n]) in windows for n in sizes for w in [bench(t)] for i in range(len(w) - n + 1))}
    assert {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, SF).collect()} == clean

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(corpus_pipeline.tokenizer("byte_bpe_50k.json"))
    got: dict = {}
    for r in corpus_pipeline.packing(spark, docs, SF).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == {k: len(lib.encode(t, add_special_tokens=False).ids) + 1 for k, t in texts.items()}

    from quillon.llm.toxicity import toxicity as scored

    toxic = {r.doc_id for r in scored(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("score >= 0.7").collect()}
    assert {r.doc_id for r in corpus_pipeline.toxicity(spark, docs, SF).collect()} == set(texts) - toxic
