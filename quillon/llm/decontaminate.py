"""Benchmark decontamination as a prefix-filtered containment join, in DataFrame operations only.

A benchmark item is cut into windows of ``window`` consecutive words (a shorter item is one
window). For exact containment (overlap = the window's size) the prefix filter leaves one
token: a text that holds the window holds its rarest word. So the words of all documents meet
only the windows whose rarest word (by frequency in all documents) they are; the word's place
in the window and the text's length bound where the window could stand, and the words there
are compared with the window's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separators after lower-casing A-Z; in a text as it is, A-Z are word characters too.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Windows of a benchmark that may be broadcast: about 300 bytes each, so under 100 MB.
BROADCAST_WINDOWS = 300_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def item_windows(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item, win, ws): the distinct windows of each item; win is their words joined by a space."""
    w = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("ws")).select("item", F.array_join("ws", " ").alias("win"), "ws").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, with_hash: bool = False) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for every input row; with_hash: also text_hash, xxhash64 of the text.

    n_hit counts the words inside any occurrence of a window, n_items the items with an occurring
    window. Null and wordless texts have no words and no hits; wordless items have no windows.
    Repeated rows each get the same result; rows of equal id and unlike text are told apart.
    No documents or no items: no hits. Other columns of either table are ignored. A benchmark of
    more than BROADCAST_WINDOWS windows is joined by shuffling instead of broadcast.
    """
    iw = materialize(item_windows(items, item_col, item_text_col, window), "windows")
    small = iw.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    near = F.broadcast if small else (lambda df: df)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col), F.xxhash64(id_col, text).alias("k1"), F.hash(text).alias("k2"), F.col(text_col).alias("text"))
    bag = keyed.select("k1", "k2", words(F.col("text")).alias("w"))

    # the frequency in all documents of each word that some window holds
    vocabulary = iw.select(F.explode("ws").alias("word")).distinct()
    # written, so that the join below is between two plain shuffles, which a frequent word's rows can be split in
    seen = materialize(bag.select(F.explode("w").alias("word")).join(near(vocabulary), "word").groupBy("word").agg(F.count(F.lit(1)).alias("seen")), "seen")
    placed = iw.select("win", "ws").distinct().select("win", "ws", F.posexplode("ws").alias("at", "word"))
    # an inner join: a window with a word that no document has can't occur
    complete = placed.join(seen, "word", "left").groupBy("win").agg(F.first("ws").alias("ws"), F.min(F.struct("seen", "word", "at")).alias("rarest"), F.bool_and(F.col("seen").isNotNull()).alias("all_seen"))
    # written, for plans below read it more than once and it stands for a pass over all documents
    probe = materialize(complete.where("all_seen").select("win", "ws", F.col("rarest.word").alias("word"), F.col("rarest.at").alias("at"), F.size("ws").alias("len")), "probe")

    start = F.col("pos") - F.col("at")
    if small:
        met = bag.select("k1", "k2", "w", F.posexplode("w").alias("pos", "word"))
        fits = (F.col("probe.word") == F.col("met.word")) & (start >= 0) & (start + F.col("len") <= F.size("w")) & (F.slice("w", start + 1, F.col("len")) == F.col("ws"))
        hits = met.alias("met").join(near(probe).alias("probe"), fits).select("k1", "k2", start.alias("s"), (start + F.col("len")).alias("e"), "win").distinct()
    else:
        # words travel alone, and a text's words once, to meet the places where windows may stand in it
        alone = bag.select("k1", "k2", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word"))
        may = alone.join(probe.select("word", "at", "len", "win"), "word").where((start >= 0) & (start + F.col("len") <= F.col("n"))).select("k1", "k2", start.alias("s"), (start + F.col("len")).alias("e"), "win").distinct()
        stands = F.array_join(F.slice("w", F.col("s") + 1, F.col("e") - F.col("s")), " ") == F.col("win")
        hits = may.join(bag, ["k1", "k2"]).where(stands).select("k1", "k2", "s", "e", "win").distinct()

    spans = hits.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans"), F.collect_set("win").alias("wins"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda a, x: F.struct((a.n + F.greatest(x.e - F.greatest(x.s, a.to), F.lit(0))).alias("n"), F.greatest(a.to, x.e).alias("to")), lambda a: a.n)
    covered = materialize(spans.select("k1", "k2", covered.alias("n_hit"), "wins"), "hits")
    found = covered.select("k1", "k2", F.explode("wins").alias("win")).join(near(iw.select("win", "item")), "win").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    per = covered.select("k1", "k2", "n_hit").join(found, ["k1", "k2"])
    more = [F.xxhash64("text").alias("text_hash")] if with_hash else []
    counted = keyed.select(id_col, "k1", "k2", *more, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return counted.join(per, ["k1", "k2"], "left").select(
        id_col, "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), *(["text_hash"] if with_hash else []),
    )
