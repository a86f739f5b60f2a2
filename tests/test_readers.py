"""Readers of files: Markdown folders, articles, CSV with drifting headers; functions that the queries' tables can't show."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon.functions import content as C
from quillon.functions.text import clean_title
from quillon.functions.urls import normalize_url
from quillon.sources import readers


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_articles_are_published_ones_with_a_slug(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.md").write_text('---\ntitle: "One"\nslug: first\npublished: true\n---\nText\n')
    (tmp_path / "deep" / "b.md").write_text("---\ntitle: Two\npublished: true\n---\nMore")
    (tmp_path / "c.md").write_text("---\ntitle: Three\npublished: false\n---\nHidden")
    (tmp_path / "d.md").write_text("no block")
    got = sorted((r.slug, r.title, r.excerpt, r.text) for r in readers.articles(spark, str(tmp_path)).collect())
    assert got == [("b", "Two", None, "More"), ("first", "One", None, "Text\n")]
    assert sorted(r.text for r in readers.markdown(spark, str(tmp_path), ("deep",)).collect())[0].startswith("---")
    assert readers.markdown(spark, str(tmp_path), ("deep",)).count() == 3


def test_metrics_files_with_other_headers(spark, tmp_path):
    path = str(tmp_path / "m.csv")
    (tmp_path / "m.csv").write_text('Video Title,Total Views,播放,Watch %,点赞\n"a, ""b""","1,234",9,45%,7\nshort\n')
    rows = readers.metrics_csv(spark, path).collect()
    assert (rows[0].title, rows[0].views, rows[0].completionRate, rows[0].likes, rows[0].saves) == ('a, "b"', 1234.0, 45.0, 7.0, None)
    assert readers.csv_rows(spark, path).collect()[1]["播放"] == ""
    assert [readers.match_column(h) for h in ("Post Time", "平均观看时长", "!!", "Shares (all)")] == ["postedAt", "views", None, "shares"]


def test_functions_at_their_edges(spark):
    lit = F.lit
    assert one(spark, clean_title(lit("x ##a#b# y #c 【z】"))) == "x y c"
    assert one(spark, clean_title(lit("C# vs F# compared"))) == "C vs F compared"
    assert one(spark, clean_title(lit("a 🇩🇪 b ☂️ c 🔥"))) == "a b c"
    assert one(spark, clean_title(lit("#热点#AI芯片突破#国产芯片#"))) == "AI芯片突破"
    assert one(spark, clean_title(lit("#" * 400 + "a#b" + "#" * 400))) == ""
    assert one(spark, clean_title(lit(None).cast("string"))) == ""
    assert one(spark, normalize_url(lit("HTTPS://Ex.org:443/a/?b=2&a=1&b=1&utm_source=x#f"))) == "https://ex.org/a?a=1&b=2&b=1"
    assert one(spark, normalize_url(lit("/relative"))) == "/relative"
    assert one(spark, C.string_leaves(lit('{"a": {"b": ["x", " ", 3, {"c": "y: \\"z\\""}]}, "d": "e"}'))) == ["x", 'y: "z"', "e"]
    assert one(spark, C.segments(lit(None).cast("string"))) == [("markdown", "")]
    # dollars within thirty characters before an amount will do; here they stand 29 and 31 before the second
    assert one(spark, C.currency_notes(lit("¥445 million, 2 thousand yuan"))) == "$62 million (¥445 million), 2 thousand yuan"
    assert one(spark, C.currency_notes(lit("¥445 million and 2 thousand yuan"))) == "$62 million (¥445 million) and $0 thousand (2 thousand yuan)"
    assert one(spark, C.platform_url(lit(None).cast("string")))["kind"] == "unknown"
    assert one(spark, C.topics(lit('{"topics": null}'))) == []
    for bad in ('{"topics": "a"}', '{"topics": [1]}'):
        with pytest.raises(Exception, match="array of strings"):
            one(spark, C.topics(lit(bad)))
    with pytest.raises(Exception, match="dimensions"):
        one(spark, C.sized(F.array(lit(1.0).cast("float")), 2))


def test_works_are_indexed_within_their_rows(spark):
    from quillon.plans.registry import QUERIES
    from quillon.sources.apis import inverted_index

    rows = spark.createDataFrame([(1, "b a b c a b".split()), (2, []), (3, None), (4, ["x"])], "id long, w array<string>")
    got = {r.id: r.m for r in rows.select("id", inverted_index(F.col("w")).alias("m")).collect()}
    assert got == {1: {"a": [1, 4], "b": [0, 2, 5], "c": [3]}, 2: {}, 3: None, 4: {"x": [0]}}
    plan = QUERIES["source_works"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # words are not shuffled
