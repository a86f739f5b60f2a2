"""Quality rules in DataFrame operations: counts of each text, then a hashed n-gram likelihood ratio.

Two multinomials over hashed n-grams, of trusted documents and of all documents, give each n-gram
a log ratio. A document's verdict is the mean ratio of its n-grams (their sum, normalised by
their number) against a fixed threshold, so equal texts always get equal verdicts. The n-grams are
all words and all pairs of neighbouring words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = r"[#*$%&|<>]"
#: Trusted ids that may be broadcast: 16 bytes each.
BROADCAST_IDS = 1_000_000


def split_words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def bucket(buckets: int, *words: Column) -> Column:
    """Of an n-gram: 64-bit hash, modulo."""
    return F.pmod(F.xxhash64(*words), F.lit(buckets)).cast("int")


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str, buckets: int) -> list[float]:
    """Log of trusted over raw probability of each bucket (add-one smoothing), from all documents; its size is fixed."""
    ids = trusted.select(F.col(trusted.columns[0]).alias("_trusted")).where("_trusted IS NOT NULL").distinct()
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    words = docs.join(ids, F.col(id_col) == F.col("_trusted"), "left").select(F.col("_trusted").isNotNull().cast("long").alias("t"), F.explode(F.transform("w", lambda x, i: F.struct(x.alias("a"), F.get("w", i + 1).alias("b")))).alias("g"))
    both = F.array(bucket(buckets, F.col("g.a")), F.when(F.col("g.b").isNotNull(), bucket(buckets, F.col("g.a"), F.col("g.b"))))
    counts = words.select("t", F.explode(both).alias("b")).where("b IS NOT NULL").groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t"))
    whole = F.sum("n").over(_all()), F.sum("t").over(_all())
    ratio = F.log((F.col("t") + 1) / (whole[1] + buckets)) - F.log((F.col("n") + 1) / (whole[0] + buckets))
    out = [0.0] * buckets
    for r in counts.select("b", F.round(ratio, 6).alias("r")).collect():  # at most `buckets` rows
        out[r.b] = r.r
    return out


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 65536, least_words: int = 50, repeat_percent: int = 50, threshold: float = -0.12) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_ratio) of every row.

    base_failed: fewer than least_words words, or more than repeat_percent % of them in a 3-word
    window found twice or more in the text. kept: not base_failed and mean log ratio >= threshold.
    trusted: one column of ids; an id that no document has, or repeated, adds nothing. Null counts
    as empty: no words, base_failed. Repeated rows each give a row. Empty table: empty result. With
    no trusted documents every ratio follows from smoothing alone. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    w = docs.select(F.col(id_col), text.alias("t"), split_words(text).alias("w"))
    ratios = log_ratios(w.select(id_col, "w"), trusted, id_col, buckets)
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded to a constant

    n = F.size("w")
    triples = F.when(n > 2, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    # each word adds its own ratio and that of its pair with the next
    of = lambda *x: F.get(table, bucket(buckets, *x))
    sums = F.transform("w", lambda x, i: F.when(i + 1 < n, of(x) + of(x, F.get("w", i + 1))).otherwise(of(x)))
    ratio = F.when(n > 0, F.round(F.aggregate(sums, F.lit(0.0), lambda a, b: a + b) / (2 * n - 1), 6)).otherwise(0.0)
    one = w.select(
        id_col, n.cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), lines.alias("lines"), triples.alias("triples"), ratio.alias("ratio"),
    )
    placed = F.when(F.size(F.array_distinct("triples")) < F.size("triples"), F.sort_array(F.transform("triples", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    two = one.select("*", placed.alias("placed"))
    again = F.transform("placed", lambda x, k: F.when((x.h == F.get("placed", k - 1).h) | (x.h == F.get("placed", k + 1).h), x.i))
    three = two.select("*", F.sort_array(F.filter(again, lambda i: i.isNotNull())).alias("again"))
    covered = F.aggregate("again", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda a, i: F.struct((a.n + i + 3 - F.greatest(i, a.to)).alias("n"), (i + 3).alias("to")), lambda a: a.n.cast("long"))
    four = three.select(
        id_col, "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered.alias("n_repeat_words"),
        F.col("ratio").alias("log_ratio"),
    )
    failed = (F.col("n_words") < least_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(repeat_percent) * F.col("n_words"))
    return four.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("log_ratio") >= threshold)).alias("kept"), "log_ratio")
