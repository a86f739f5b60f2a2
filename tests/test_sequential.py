"""The operators that SQL can't say, on hand-made rows."""

from __future__ import annotations

import pandas as pd

from quillon.operators import assets, cues, trends


def test_greedy_merge_keeps_the_longest_title(spark):
    rows = [("b", 1, "Acme raises $5 million for robots", "x", "u1", "data"), ("b", 2, "Acme raises $7 million for robots today", "y", "u2", "data"), ("b", 3, "Weather stays dry", "x", "u3", "data"), ("c", 4, "Acme raises $5 million for robots", "x", "u4", "data")]
    got = {(r.block, r.title): (r.sources, r.urls) for r in trends.merge_topics(spark.createDataFrame(rows, "block string, ordinal long, title string, source string, url string, category string")).collect()}
    assert got == {("b", "Acme raises $7 million for robots today"): (["x", "y"], ["u1", "u2"]), ("b", "Weather stays dry"): (["x"], ["u3"]), ("c", "Acme raises $5 million for robots"): (["x"], ["u4"])}


def test_words_are_grouped_into_lines():
    assert cues.group("a b. c d e f g h i".split()) == [[0, 1], [2, 3, 4, 5, 6, 7], [8]]
    assert cues.group("a b c d e f g".split()) == [[0, 1, 2, 3, 4, 5], [6]]
    assert cues.group(["WWWWWWWWWW", "WWWW", "i"]) == [[0], [1, 2]]  # over the width, and a lone last word goes back
    assert cues.group(["Yes.", "Exactly."]) == [[0, 1]]
    assert cues.joined(["a", ",", "b", "!"]) == "a, b!"


def test_short_cues_borrow_time_and_are_laid_out():
    cue = lambda scene, words, a, b: {"scene": scene, "words": words, "from": a, "to": b, "clip_end": 10.0}
    merged = cues.borrow([cue(1, ["a"], 0.0, 0.2), cue(1, ["b"], 0.3, 0.5), cue(1, ["c"], 3.0, 3.2), cue(2, ["d"], 3.3, 3.6)])
    assert [c["words"] for c in merged] == [["a", "b"], ["c"], ["d"]]
    times = cues.lay_out(merged)
    assert times[0][0] == 0.0 and abs(times[0][1] - 1.0) < 1e-9  # held, and the next is far
    assert all(b - a >= 1 / 30 - 1e-9 for a, b in times) and all(x[1] <= y[0] + 1e-9 for x, y in zip(times, times[1:], strict=False))
    near = cues.lay_out([cue(1, ["a"], 1.0, 2.0), cue(1, ["b"], 2.8, 3.0)])
    assert abs(near[0][1] - (2.8 - 2 / 30 - 2 / 30)) < 1e-9  # joined to the next over a short pause


def test_phrases_end_at_sentences_commas_and_length(spark):
    text = "one two, three four, five six seven eight nine ten eleven. one two, three four,"
    words = [(1, i, t, i * 0.5, i * 0.5 + 0.4) for i, t in enumerate(text.split())]
    got = [r.text for r in sorted(cues.phrases(spark.createDataFrame(words, "scene long, i long, text string, start double, end double")).collect(), key=lambda r: r.phrase)]
    assert got == ["one two, three four,", "five six seven eight nine ten eleven."]


def test_hook_scene_takes_only_a_strong_cover(spark):
    scenes = spark.createDataFrame([(1, 0, "hook", None), (1, 1, "narrative", None), (1, 2, "cta", None), (1, 3, "quote", "m")], "content_id long, scene long, visual_type string, media string")
    rows = [(1, 10, 90.0, "contain", "a"), (1, 11, 60.0, "cover", "b"), (1, 12, 59.0, "cover", "c"), (1, 13, 95.0, "contain", None), (1, 14, 80.0, "contain", "a")]
    got = sorted((r.scene, r.asset) for r in assets.assign(spark.createDataFrame(rows, "content_id long, asset long, score double, fit string, path string"), scenes).collect())
    assert got == [(0, 11), (1, 10)]


def test_assignment_as_a_loop_would(spark):
    import random

    rng = random.Random(6)
    kinds = ["hook", "narrative", "cta", "quote"]
    scenes = [(c, i, rng.choice(kinds), rng.choice([None, None, "m"])) for c in range(30) for i in range(rng.randint(0, 8))]
    rows = [(c, a, float(rng.randint(40, 80)), rng.choice(["cover", "contain"])) for c in range(30) for a in range(rng.randint(0, 8))]
    rows = [(*r, rng.choice([None, f"{r[3]}{rng.randint(0, 4)}"])) for r in rows]
    want = []
    for c in range(30):
        taken, used = set(), set()
        for _, a, score, fit, path in sorted((r for r in rows if r[0] == c), key=lambda r: (-r[2], r[1])):
            if not path or path in used:
                continue
            own = sorted(x for x in scenes if x[0] == c and x[1] not in taken and x[3] is None)
            pick = next((x for x in own if x[2] == "hook" and score >= 60 and fit == "cover"), None) or next((x for x in own if x[2] not in ("hook", "cta")), None)
            if pick:
                taken.add(pick[1])
                used.add(path)
                want.append((c, pick[1], a))
    got = assets.assign(spark.createDataFrame(rows, "content_id long, asset long, score double, fit string, path string"), spark.createDataFrame(scenes, "content_id long, scene long, visual_type string, media string"))
    assert sorted((r.content_id, r.scene, r.asset) for r in got.collect()) == sorted(want)


def test_top_k_is_a_prefix_of_the_whole_order(spark):
    from quillon.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    top = [(r.vec_id) for r in QUERIES["vector_topk"](spark, sf).collect()]
    assert len(top) == len(set(top)) == 10


def test_long_sections_are_packed_by_paragraph(spark):
    from quillon.sources.readers import chunk_markdown

    big, huge = "x" * 16_000, "y" * 40_000
    text = f"gone\n## A\n\n{big}\n\n\n{big}\n\n{huge}\n\n \n\nend\n## B\nshort\n"
    rows = [(1, text), (2, huge + "\n\n" + huge), (3, " ")]
    got = sorted(tuple(r) for r in chunk_markdown(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect())
    assert got == [(1, 0, "A", f"## A\n\n{big}\n\n{big}"), (1, 1, "A", huge), (1, 2, "A", "end"), (1, 3, "B", "## B\nshort"), (2, 0, None, huge + "\n\n" + huge)]


def test_topics_merge_across_sources_as_one_ordered_list_would(spark):
    import random

    rng, words = random.Random(4), [f"w{c}" for c in "abcdefghijkl"]
    titles = [" ".join(rng.sample(words, rng.choice([1, 3, 5, 6, 9]))) + rng.choice(["", " now"]) for _ in range(60)] + ["", "!!"]
    rows = [(i, rng.choice(titles), f"s{i % 5}", f"u{i % 90}", "data") for i in range(400)]
    whole = trends.greedy_merge(pd.DataFrame([("all", *r) for r in rows], columns=["block", "ordinal", "title", "source", "url", "category"]))
    want = sorted((r.title, r.sources, r.urls, r.category) for r in whole.itertuples())
    got = trends.merge_all_topics(spark.createDataFrame(rows, "ordinal long, title string, source string, url string, category string"))
    assert sorted((r.title, r.sources, r.urls, r.category) for r in got.collect()) == want


def test_many_similar_titles_merge_by_their_pairs_alone():
    import random
    import time

    # 60,000 articles of 3,000 titles that share their tokens with one another but are alike in pairs only
    rng, n = random.Random(5), 3000
    titles = [f"t{i // 2} " + " ".join(f"w{j}" for j in rng.sample(range(40), 12)) + " x" * (i % 2) for i in range(n)]
    pdf = pd.DataFrame({"title": titles, "k": [float(i) for i in range(n)], "ordinals": [list(range(i, 20 * n, n)) for i in range(n)]})
    t = time.time()
    got = trends.ordered_merge(pdf, pd.DataFrame({"a": range(0, n, 2), "b": range(1, n, 2)}))
    assert time.time() - t < 20
    assert sorted(set(got.topic)) == list(range(0, n, 2)) and all(r.topic == r.ordinal % n // 2 * 2 for r in got.itertuples())
    assert all(r.title == titles[r.topic + (len(titles[r.topic + 1]) > len(titles[r.topic]))] for r in got.itertuples() if r.ordinal == r.topic)


def test_near_dup_greedy_merges_equal_titles_of_all_hosts(spark):
    from quillon.plans.registry import QUERIES
    from quillon.plans.text_queries import X, url_host

    sf = "/root/testdata/sf0.01"
    p = spark.read.parquet(f"{sf}/pages.parquet")
    p = p.selectExpr("'all' AS block", "page_id AS ordinal", "html", "url", "'fermenting' AS category").withColumn("title", X.html_title(p["html"])).withColumn("source", url_host(p["url"])).drop("html")
    want = sorted((r.title, r.sources, r.urls) for r in trends.greedy_merge(p.toPandas()).itertuples())
    assert sorted((r.title, r.sources, r.urls) for r in QUERIES["near_dup_greedy"](spark, sf).collect()) == want


def test_titles_that_share_one_rare_token_are_not_compared(spark, monkeypatch):
    import random

    rng, met = random.Random(8), []
    one = lambda: [f"c{chr(97 + x % 26)}{chr(97 + x // 26)}" for x in rng.sample(range(300), 12)]
    texts = [" ".join([*one(), "rare"]) for _ in range(60)] + [" ".join(one()[:3]) for _ in range(30)]
    texts += [" ".join(rng.sample(t.split(), 12)) for t in texts[:20]] + [t.upper() + " 7a 8" for t in texts[:20]] + ["", "!!", None, "rare"]
    made = trends.candidates
    monkeypatch.setattr(trends, "candidates", lambda *x: met.append(made(*x)) or met[-1])
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r.a, r.b): (r.jaccard, r.containment) for r in trends.similar_titles(rows, "id", "text").collect()}
    classes: dict = {}
    for i, t in enumerate(texts):
        classes.setdefault(frozenset(trends._tokens(t or "")), i)
    sets, want = {i: t for t, i in classes.items() if t}, {}
    for a, x in sets.items():
        for b, y in sets.items():
            j, c = len(x & y) / len(x | y), len(x & y) / min(len(x), len(y))
            if a < b and (j >= 0.8 or c >= 0.9):
                want[a, b] = (round(j, 6), round(c, 6))
    assert got == want and len(want) > 100
    assert met[0].count() < len(want) + 200  # 60 sets and those made of them share the token: over 4,000 pairs


def test_cue_grouping_covers_every_turn(spark):
    from quillon.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    said: dict = {}
    for r in sorted(QUERIES["cue_grouping"](spark, sf).collect(), key=lambda r: (r.content, r.cue)):
        said.setdefault((r.content, r.scene), []).append(r.text)
    turns = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    assert len({(r.conv_id, r.turn) for r in turns}) == len(turns) == len(said)
    assert all(" ".join(said[r.conv_id, r.turn]).split() == r.text.split() for r in turns)
