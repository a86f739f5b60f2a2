"""Edge cases of the media functions and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import media as M
from quillon.operators import rules


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_scalars(spark):
    lit = F.lit
    assert one(spark, M.url_slug(lit("https://Ex.org/a//b?q=1#f"))) == "ex-org-a-b"
    assert one(spark, M.truncate_at_word(lit("aaa bbb ccc"), 6)) == "aaa…"
    assert one(spark, M.truncate_at_word(lit("aaaaaaaa"), 6)) == "aaaaaa…"
    assert one(spark, M.media_type(lit("x.WebP"))) == "image/webp"
    assert one(spark, M.media_type(lit(""))) == "application/octet-stream"
    assert one(spark, M.since_seconds(lit("7h"))) == 25200
    assert one(spark, M.since_seconds(lit("7x"))) is None
    assert one(spark, M.fnv1a(lit("a"))) == 0xE40C292C
    assert one(spark, M.fnv1a(lit(""))) == 2166136261
    assert one(spark, M.subtitle_time(lit(3725.678))) == "1:02:05.68"
    assert abs(one(spark, M.subtitle_seconds(lit("1:02:05.68"))) - 3725.68) < 1e-9
    assert one(spark, M.speech_seconds(lit(""))) == 0.5
    assert one(spark, M.text_width(lit("im"), {"i": 222}, 556, 10.0)) == 7.78
    assert one(spark, M.text_width(lit(""), {"i": 222}, 556, 10.0)) == 0
    assert one(spark, M.percentage(lit(5), lit(0))) == 0


def test_rules_see_nulls(spark):
    rows = rules.scenes(spark.createDataFrame([(1, 0, None), (1, 1, "Hello — you")], "v long, o long, t string"), "v", "o", "t")
    assert rules.verdicts(rows, ["v"], rules.scene_rules()).first()["verdict"] == "fail"
    assert {r["check"] for r in rules.findings(rows, ["v"], rules.scene_rules()).collect()} >= {"scene_count", "no_em_dashes"}
