"""Mixing sources to target weights: how many words of each document a mix takes, so that every source comes to its share.

A document may belong to several sources. Documents that belong to the same ones form a pattern, and only patterns' word counts
reach the driver, where a min-cost flow routes them to the sources' targets: a first pass over a pattern's words costs
nothing, a second one more than the first, a third more than the second, so nothing is repeated while fresh words are left that
serve the same sources. A pattern's flow is then whole passes over it and a rest, which goes to its documents in the
order of a seeded hash: the last of them is found by refining bins of the hash, never by sorting a pattern's documents.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize
from quillon.llm.flow import Flow

#: Bits of the hash that one refinement fixes.
BITS = 8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict, total: int, weights: Sequence[float], most: float) -> dict[object, float]:
    """Each source's share of ``total`` words by weight, at most ``most`` times its own size; what that cuts off goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))  # by code point, null last
    weigh = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    out: dict = {}
    left = float(total)
    while len(out) < len(order):
        rest = [s for s in order if s not in out]
        whole = math.fsum(weigh[s] for s in rest)
        full = [s for s in rest if left * weigh[s] / whole > most * sizes[s]]
        if not full:
            return out | {s: left * weigh[s] / whole for s in rest}
        for s in full:
            out[s] = float(most * sizes[s])
        left = max(left - math.fsum(out[s] for s in full), 0.0)
    return out


def route(patterns: dict[tuple, int], goal: dict, costs: Sequence[int]) -> tuple[dict[tuple, int], dict[tuple, int]]:
    """(words taken of each pattern, words that it gives each source): least cost of repetition among the mixes that come nearest to the goals.

    patterns: their sources and words; costs: of a word's first, second, ... pass, rising; as many passes as there are costs.
    """
    net = Flow()
    passes = {p: [net.arc("from", ("pattern", p), words, c) for c in costs] for p, words in patterns.items()}
    gives = {(p, s): net.arc(("pattern", p), ("source", s), words * len(costs)) for p, words in patterns.items() for s in p}
    for s, words in goal.items():
        net.arc(("source", s), "to", round(words))
    net.solve("from", "to")
    return {p: sum(net.carried(i) for i in arcs) for p, arcs in passes.items()}, {k: net.carried(i) for k, i in gives.items()}


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1),
    costs: Sequence[int] = (0, 1, 2), seed: int = 13, most_patterns: int = 100_000, with_routes: bool = False,
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """(id, sources, size, source_sizes, targets, taken) of every document.

    size: words of the text, 0 for null. source_col: a text, or an array of texts where documents belong to several sources; a null
    source is a source of its own, an empty array none (its document is never taken). sources: distinct, ascending, null last; source_sizes
    and targets stand in that order; targets share out the words of all documents that have a source. weights repeat over the sources in order of code points, null last. taken: words the mix takes
    of the document, repetitions counted, ``len(costs)`` times its size at most. Each source's words come to its target rounded, as far as overlaps let
    them: where sources share documents their limits are joint, and the flow fills as much as can be.
    with_routes: also a DataFrame (sources, source, words) of what each pattern of sources gives each of its sources.

    Equal rows share equally: rows of one id and text at the end of a pattern's rest take equal parts of what is left, rounded
    down, so that source may lack a word for each such row. A rerun takes the same, whatever the partitioning. Repeated rows and null ids are
    documents like others; extra columns are ignored, whatever their names; an empty table gives no rows; without any word
    targets are 0. ``most_patterns``: so many distinct patterns are handled (their graph is built on the driver); more fail the job, none is dropped.
    """
    spark = docs.sparkSession
    several = docs.schema[source_col].dataType.typeName() == "array"
    of = F.col(source_col)
    named = F.when(of.isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.array_sort(F.array_distinct(of.cast("array<string>")))) if several else F.array(of.cast("string"))
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    sized = materialize(docs.select(F.col(id_col).alias("_id"), named.alias("_sources"), word_count(F.col(text_col)).alias("_size"), key.alias("_key")), "sized")

    found = sized.groupBy("_sources").agg(F.sum("_size").alias("words")).limit(most_patterns + 1).collect()
    if len(found) > most_patterns:
        raise ValueError(f"more than {most_patterns} patterns of sources")
    patterns = {tuple(r["_sources"]): r.words for r in found}
    sizes: dict = {}
    for p, words in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + words
    goal = targets(sizes, sum(words for p, words in patterns.items() if p), weights, len(costs))
    taken, gives = route(patterns, goal, costs)

    def rows(schema: str, data: list[tuple]) -> DataFrame:
        return F.broadcast(spark.createDataFrame(data, schema))  # a row a pattern, most_patterns at most

    rest = {p: taken[p] % words for p, words in patterns.items() if words and taken[p] % words}
    plan = rows(
        "_of array<string>, _times long, _rest boolean, source_sizes array<bigint>, targets array<double>",
        [(list(p), taken[p] // words if words else 0, p in rest, [sizes[s] for s in p], [goal[s] for s in p]) for p, words in patterns.items()],
    )
    last = _last_taken(sized.where("_size > 0"), rest, rows)
    met = sized.join(plan, F.col("_sources").eqNullSafe(F.col("_of"))).drop("_of")
    met = met.join(rows("_of array<string>, _last long, _left long, _group long", last), F.col("_sources").eqNullSafe(F.col("_of")), "left")
    end = F.col("_last")
    share = F.floor(F.col("_left").cast("decimal(38,0)") * F.col("_size") / F.col("_group")).cast("long")
    extra = F.when(~F.col("_rest") | (F.col("_size") == 0), 0).when(F.col("_key") < end, F.col("_size")).when(F.col("_key") == end, share).otherwise(0)
    out = met.select(F.col("_id").alias(id_col), F.col("_sources").alias("sources"), F.col("_size").alias("size"), "source_sizes", "targets", (F.col("_size") * F.col("_times") + extra).cast("long").alias("taken"))
    if not with_routes:
        return out
    return out, spark.createDataFrame([(list(p), s, w) for (p, s), w in gives.items()], "sources array<string>, source string, words long")


def _last_taken(sized: DataFrame, rest: dict[tuple, int], rows) -> list[tuple]:
    """(pattern, key, left, group) for each pattern with a rest: documents of lesser keys are taken, those of that key (``group`` words) to ``left`` words.

    Each refinement sums the words of a pattern by the next bits of the key, finds the bin in which the rest ends, and goes on with that bin's rows alone.
    """
    done, open_ = [], [(list(p), words) for p, words in rest.items()]
    left = sized.select("_sources", "_key", "_size")
    for shift in range(64 - BITS, -1, -BITS):
        if not open_:
            break
        goal = rows("_of array<string>, _need long", open_)
        # the top bits count as signed, as keys are compared
        bin_ = F.shiftright("_key", shift)
        by = left.join(goal, F.col("_sources") == F.col("_of")).groupBy("_sources", bin_.alias("_bin"), "_need").agg(F.sum("_size").alias("words"), F.min("_key").alias("low"), F.max("_key").alias("high"))
        w = Window.partitionBy("_sources").orderBy("_bin")  # 2**BITS bins of a pattern at most
        ends = by.withColumn("upto", F.sum("words").over(w)).where("upto >= _need AND upto - words < _need").collect()  # one a pattern
        open_, bins = [], []
        for r in ends:
            need = r["_need"] - (r.upto - r.words)
            if r.low == r.high:
                done.append((r["_sources"], r.low, need, r.words))
            else:
                open_.append((r["_sources"], need))
                bins.append((r["_sources"], r["_bin"]))
        if open_:
            kept = rows("_of array<string>, _at long", bins)
            left = materialize(left.join(kept, (F.col("_sources") == F.col("_of")) & (bin_ == F.col("_at"))).select("_sources", "_key", "_size"), "rest")
    return done
