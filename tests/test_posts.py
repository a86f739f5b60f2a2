"""Post texts, dictionaries, answers, cascades, parsers by name and written rows at their edges."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from quillon.functions.answers import parse_answer
from quillon.operators import captions, cascade, dictionary, documents, index
from quillon.operators import validators as V
from quillon.sources import landed, readers

BRAND = captions.Brand(("#daily", "#news"), ("#daily", "#report", "#facts"), ("daily", "data"), " | Data Daily", "Changed your mind?", "Follow for more.")


def test_ten_thousand_terms_in_one_pass(spark, monkeypatch):
    words = [f"w{i}x" for i in range(10_000)]
    texts = ["W1X and w9999x", "w1xw2xw33x", "none", None, "", "w12x" * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    terms = spark.createDataFrame([(w, i) for i, w in enumerate(words)] + [("", 1), (None, 2), ("W1x", 77)], "term string, number int")
    want = {i: sorted({k for k, w in enumerate(words) if t and w in t.lower()} | ({77} if t and "w1x" in t.lower() else set())) for i, t in enumerate(texts)}
    for part in (100_000, 1500):  # in one automaton, and in seven
        monkeypatch.setattr(dictionary, "PART", part)
        out = dictionary.find_terms(rows, "text", terms)
        assert {r.id: r.found for r in out.collect()} == want
    assert {r.found[0] if r.found else None for r in dictionary.find_terms(rows, "text", spark.createDataFrame([("W1X", "big")], "term string, number string"), fold=False).collect()} == {"big", None}
    assert all(r.found == [] for r in dictionary.find_terms(rows, "text", terms.limit(0)).collect())


def cut_word(s, n):
    if len(s) <= n:
        return s
    head = s[:n]
    at = head.rfind(" ")
    return (head[:at] if at > 0 else head).rstrip()


def cut_sentence(s, n):
    if len(s) <= n:
        return s
    out = ""
    for x in re.split(r"(?<=[.!?\n])\s+", s):
        if len((out + " " + x).strip()) > n:
            break
        out = (out + " " + x).strip()
    return out or cut_word(s, n)


def test_cuts(spark):
    texts = ["short", "one two three four", "onelongwordwithoutend", " leading blank here", "A first. A second one! And a third? Last", "No sentence ends in here at all", "x\ny z\n\nw. v", ""]
    for n in (1, 5, 9, 16, 24, 100):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", captions.cut_at_word(F.col("t"), n).alias("w"), captions.cut_at_sentence(F.col("t"), n).alias("s")).collect()
        assert [(r.w, r.s) for r in rows] == [(cut_word(t, n), cut_sentence(t, n)) for t in texts], n


def test_descriptions_hooks_and_tags(spark):
    long = "A sentence of some words that goes on"
    scenes = [("a", 1, "First part here. More", "{}"), ("a", 2, "Acme spent $5 billion and 3.2M on it!", '{"x": "Bolt"}'), ("a", 0, "zero comes first? yes", '{"n": 3, "title": "Lead", "deep": {"y": "z"}}'), ("b", 0, None, None), ("b", 1, "only acme", "{}")]
    scenes += [("c", i, f"{long} {i}. tail", "{}") for i in range(80)] + [("d", 0, "acme, bolt and crux", "{}")]
    ent = [(0, "acme", "#acme"), (1, "bolt", "#bolt"), (2, "crux", "#crux"), (3, "five", "#five"), (4, "billion", "#acme"), (5, "part", "#part")]
    posts = [("a", None, None, None, None, " https://x ", "Zed"), ("b", "  ", " Given text ", ["#one"], None, None, None), ("c", "t" * 70, None, [f"#{i}" for i in range(9)], " own hook ", None, ""), ("d", "all about data and more data words that go beyond the limit", "Please SUBSCRIBE", [], None, "", None), ("e", None, None, None, None, None, None)]
    out = captions.post_texts(
        spark.createDataFrame(scenes, "content string, ordinal int, voiceover string, texts string"),
        spark.createDataFrame(posts, "content string, title string, description string, hashtags array<string>, hook string, url string, entity string"),
        spark.createDataFrame(ent, "place int, keyword string, tag string"), spark.createDataFrame([(0, "Crux"), (1, "Acme"), (2, "Bolt")], "place int, name string"), BRAND,
    )
    got = {r.content: r for r in out.collect()}
    hooks = {"a": "$5 billion or 3.2M — which surprised you more?", "b": "What's your take on Acme? Overhyped or underrated?", "c": "own hook", "d": "Will Crux catch up to Acme? Why or why not?", "e": "Changed your mind?"}
    assert {k: r.hook for k, r in got.items()} == hooks
    assert {k: r.hashtags for k, r in got.items()} == {"a": ["#daily", "#news", "#acme", "#bolt", "#part"], "b": ["#one", "#daily", "#report"], "c": ["#0", "#1", "#2", "#3", "#4"], "d": ["#daily", "#news", "#acme", "#bolt", "#crux"], "e": ["#daily", "#news", "#report"]}
    assert got["a"].title == "Lead: zero comes first | Data Daily" and got["c"].title == "t" * 47 + " | Data Daily" and got["d"].title == cut_word(posts[3][1], 60) and got["e"].title == ""
    assert got["a"].description == f"Zed analysis.\nzero comes first\nFirst part here\nAcme spent $5 billion and 3\n\n{hooks['a']}\nFollow for more."
    assert got["b"].description == f"Given text\n\n{hooks['b']}\nFollow for more." and got["d"].description == f"Please SUBSCRIBE\n\n{hooks['d']}"
    body = "\n".join(f"{long} {i}" for i in range(80))
    assert got["c"].description == cut_sentence(body, 2200 - len("\nFollow for more.") - len("\n\nown hook")) + "\n\nown hook\nFollow for more." and len(got["c"].description) <= 2200
    assert got["a"].pinned == f"{hooks['a']}\n\nFull analysis: https://x" and got["d"].pinned == hooks["d"]


def parsed(raw):
    """The rule told in plain Python."""
    out = {"description": None, "subjects": [], "content_kind": None, "fit": None, "critical_edge_text": None, "reason": None}
    text = (raw or "").strip()
    if text.startswith("```"):
        text = text[text.find("\n") + 1 :] if "\n" in text else text
        text = text.rstrip()
        text = (text[:-3].rstrip() if text.endswith("```") else text).strip()
    if "## " not in text:
        return out | {"description": text, "more": {}}
    have = {}
    for s in text[text.find("## ") :].split("## "):
        if s.strip():
            key, _, value = s.strip().partition("\n")
            have[key.strip().lower().replace(" ", "_")] = value.strip()
    subjects = [s.strip() for s in have.get("subjects", "").split(",") if s.strip()]
    if len(subjects) <= 1 and have.get("subjects"):
        subjects = [s.strip() for s in have["subjects"].split("\n") if s.strip()]
    fit = have.get("fit", "").lower()
    known = {k: have.get(k) for k in ("content_kind", "critical_edge_text", "reason")}
    return out | known | {"description": have.get("description", ""), "subjects": subjects, "fit": fit if fit in ("cover", "contain") else None, "more": {k: v for k, v in have.items() if k not in out and k != "subjects"}}


def test_answers(spark):
    raws = [
        None, "", "  \n", "just text", "```\nfenced\n```", "```markdown\n## Description\nd\n```", "```open\nnever closed ## Fit\n COVER", "pre\n## Description\nx\n## Description\ny\n## Fit\nbad", "## Subjects\na, b ,, c", "## Subjects\na\nb\n\n c", "## Subjects\n", "## Content Kind\nTalking\n## Odd Thing\n1\n## Odd Thing\n2\n## Critical Edge Text\nedge",
        "## Fit\nContain\n## Reason\nbecause ## Why\nnot", "```", "## ", "text with ## Description\ninside",
    ]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, r string").select("i", parse_answer(F.col("r")).alias("a")).collect()
    for r in sorted(rows, key=lambda r: r.i):
        assert r.a.asDict() == parsed(raws[r.i]), raws[r.i]


def test_cascade_computes_each_content_once(spark, tmp_path):
    seen: list = []

    def dear(rows):
        seen.append(sorted(r.v for r in rows.collect()))
        return rows.select("_hash", F.when(F.col("v") != 3, F.col("v") * 10).alias("result"))

    stages = [cascade.Stage("cheap", ("v",), "int", lambda r: r.select("_hash", F.col("v").alias("result")), lambda c: c > 1), cascade.Stage("dear", ("v",), "int", dear, lambda c: c.isNotNull())]
    rows = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, 3), (5, None), (6, 5)], "id int, v int")
    out, counts = cascade.run(rows, stages, str(tmp_path / "c"))
    assert {r.id: (r.cheap, r.dear, r.stage) for r in out.collect()} == {1: (1, None, "cheap"), 2: (2, 20, "dear"), 3: (2, 20, "dear"), 4: (3, None, "dear"), 5: (None, None, "cheap"), 6: (5, 50, "dear")}
    assert [tuple(r)[1:] for r in counts.orderBy("place").collect()] == [("cheap", 6, 5, 4), ("dear", 4, 3, 3)]
    more = rows.union(spark.createDataFrame([(7, 5), (8, 9)], rows.schema))
    _, counts = cascade.run(more, stages, str(tmp_path / "c"))
    assert [tuple(r)[1:] for r in counts.orderBy("place").collect()] == [("cheap", 8, 1, 6), ("dear", 6, 1, 5)]
    assert seen == [[2, 3, 5], [9]]  # the failure too is kept


def test_parsers_by_name_and_of_ones_own(spark):
    rows = spark.createDataFrame([("a", '{"hits": [{"title": "T", "objectID": 5, "created_at_i": 0}]}'), ("b", "nothing"), ("c", None), ("d", '{"hits": {}}'), ("e", "{}")], "key string, payload string")
    good, bad = landed.parse(rows, "hn")
    assert [tuple(r) for r in good.collect()] == [("a", 0, "T", "https://news.ycombinator.com/item?id=5", "", "", "")]
    assert {r.key: r.error.split(":")[0] for r in bad.collect()} == {"b": "JSONDecodeError", "c": "ValueError", "d": "ValueError"}
    own, bad = landed.parse(rows, "lines", {"lines": lambda p: ({"title": x} for x in p.split(" "))})
    assert {(r.key, r.title) for r in own.collect()} >= {("b", "nothing"), ("e", "{}")} and {r.key for r in bad.collect()} == {"c"}
    assert {r.error for r in landed.parse(rows, "odd")[1].collect()} == {"ValueError: no parser odd"}


def test_scans_degrade_to_nothing(spark, tmp_path):
    for name, scenes, meta in (("one", {"scenes": [{"id": 1, "voiceover": "v", "texts": {"a": "b"}}]}, {"pipelineId": "p", "topics": ["t"]}), ("two", {"scenes": "none"}, None), ("three", "{", None), ("_test-fixtures", {"scenes": [{"id": 9}]}, None), ("four", {"scenes": [{"id": "x"}]}, {})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "scene-data.json").write_text(scenes if isinstance(scenes, str) else json.dumps(scenes))
        if meta is not None:
            (tmp_path / name / "meta.json").write_text(json.dumps(meta))
    rows, errors = readers.scenes(spark, str(tmp_path))
    assert sorted((r.source_id, r.scene_id, r.voiceover, r.texts, r.topics) for r in rows.collect()) == [("four", "x", None, None, None), ("p", "1", "v", '{"a":"b"}', ["t"])]
    assert [r.path.split("/")[-2] for r in errors.collect()] == ["three"]
    assert readers.scenes(spark, str(tmp_path / "nowhere"))[0].count() == 0
    for text, n in (("[", 0), ("{}", 0), ("[]", 0), ('[{"file": "a"}, {"type": "t"}]', 1), ("null", 0)):
        (tmp_path / "catalog.json").write_text(text)
        assert readers.catalog(spark, str(tmp_path)).count() == n, text


def test_graph_of_documents(spark):
    docs = [("i.md", "[a](a.md) [b](./b.md#x) [out](https://o) [mail](mailto:x)"), ("a.md", "[b](b.md) [gone](gone.md)"), ("b.md", "[c](c.md 'title')"), ("c.md", "[b](b.md)"), ("lone.md", "[self](lone.md)"), ("far.md", ""), ("nul.md", None)]
    got = {tuple(r) for r in documents.graph_findings(spark.createDataFrame(docs, "name string, content string"), "name", "content", "i.md").collect()}
    assert got == {("a.md", "dead-link", "FAIL", "gone.md"), ("lone.md", "orphan", "WARN", ""), ("far.md", "orphan", "WARN", ""), ("nul.md", "orphan", "WARN", ""), ("b.md", "circular", "WARN", ""), ("c.md", "circular", "WARN", ""), ("lone.md", "circular", "WARN", "")}


def test_validators_of_odd_documents(spark):
    def told(f, doc):
        return spark.range(1).select(f(F.try_parse_json(F.lit(doc if isinstance(doc, str) else json.dumps(doc)))).alias("e")).first().e

    base = {"schemaVersion": "1.0.0", "contentId": "c", "researchRunId": "r"}
    for f in (V.discovery_errors, V.brief_errors, V.evidence_errors, V.claim_map_errors):
        assert told(f, "[]") == told(f, "7") == told(f, "null") == ["Input must be a plain object"]
        assert told(f, "{}") == ['schemaVersion "undefined" does not match expected "1.0.0"']
    assert told(V.claim_map_errors, base | {"claims": "x"}) == ['Field "claims" must be of type array, got string']
    assert told(V.claim_map_errors, base | {"claims": [3, {"claimId": "", "type": "fact", "text": "t", "riskLevel": "huge"}]}) == ["claims[0] must be a plain object", 'claims[1].riskLevel must be one of [low, medium, high], got "huge"', "claims[1].evidenceId must be a non-empty string for fact-type claims"]
    assert told(V.claim_map_errors, base | {"claims": []}) == told(V.evidence_errors, base | {"evidence": []}) == []
    assert told(V.evidence_errors, base | {"evidence": [None]}) == ["evidence[0] must be a plain object"] * 2


def test_written_rows(spark):
    rows = spark.createDataFrame([(1, "a", "old"), (2, "b", "old")], "k int, v string, updated_at string")
    out = index.update_rows(rows, spark.createDataFrame([(1, None), (9, "x")], "k int, v string"), ["k"], F.lit("new"))
    assert {tuple(r) for r in out.collect()} == {(1, None, "new"), (2, "b", "old")}
    none = spark.createDataFrame([], "id string, at int")
    users, roles = index.new_users(none, spark.createDataFrame([("b", 2), ("a", 1), ("a", 1)], none.schema), "id", ["at", "id"])
    assert {tuple(r) for r in roles.collect()} == {("a", "admin"), ("b", "user")} and users.count() == 2
    with pytest.raises(Exception, match="one query vector"):
        from quillon.operators import vector

        e = spark.createDataFrame([(1, [1.0])], "vec_id int, embedding array<float>")
        vector.topk(e, e.union(e)).collect()


def test_scratch_folders_can_be_cleared(spark, tmp_path):
    from pathlib import Path

    from quillon.operators import scratch

    made = list(scratch._MADE)
    scratch._MADE.clear()  # other tests' results still read theirs
    try:
        rows = scratch.kept(spark.range(3).toDF("x"), "gone")
        (at,) = scratch._MADE
        assert rows.count() == 3 and Path(at.removeprefix("file:")).exists()
        assert scratch.clear(spark) == 1 and not Path(at.removeprefix("file:")).exists() and scratch.clear(spark) == 0
    finally:
        scratch._MADE.extend(made)


def test_a_document_graph_is_not_sent_through_the_driver(spark, monkeypatch):
    from quillon.operators import documents

    plans, made = [], documents.kept
    monkeypatch.setattr(documents, "kept", lambda df, *x: plans.append(df._jdf.queryExecution().executedPlan().toString()) or made(df, *x))
    docs = spark.createDataFrame([(f"d{i}.md", f"[x](d{i + 1}.md) [y](d{i // 2}.md)") for i in range(6)] + [("lone.md", "")], "name string, content string")
    out = documents.graph_findings(docs, "name", "content", "d0.md")
    got = sorted((r.name, r.check, r.detail) for r in out.collect())
    assert got == [*((f"d{i}.md", "circular", "") for i in range(5)), ("d5.md", "circular", ""), ("d5.md", "dead-link", "d6.md"), ("lone.md", "orphan", "")]
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 8 and not any("Broadcast" in p for p in plans)
