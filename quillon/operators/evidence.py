"""Evidence: canonical-URL deduplication, claim audit, validation as error lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.urls import normalize_url


#: Weight of a source's kind; any other kind has none.
SOURCE_PRIORITY = {"primary": 4, "authoritative-secondary": 3, "independent-secondary": 2, "community": 1}


def priority(kind: Column) -> Column:
    out = F.create_map(*[F.lit(x) for kv in SOURCE_PRIORITY.items() for x in kv])
    return F.coalesce(F.try_element_at(out, kind), F.lit(0))


def dedup_sources(rows: DataFrame, url: str, priority: Column, ordinal: str) -> DataFrame:
    """One row for each canonical URL: the highest priority, then the first."""
    w = Window.partitionBy("norm_url").orderBy(F.desc("_p"), ordinal)
    return rows.withColumn("norm_url", normalize_url(F.col(url))).withColumn("_p", priority).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_p")


def audit(claims: DataFrame, evidence: DataFrame, now: Column, tier: str = "standard", order: str | None = None) -> DataFrame:
    """claims(claim_id, evidence_id, type, risk) held against evidence(evidence_id, status, valid_until, source_type,
    cross_ids): a row for each failing claim with the first reason that applies.

    Of items that share an id the last in ``order`` counts, without an order the greatest row. Analysis claims need no evidence. High-risk claims need 1 independent source (standard) or 2 and a primary one (deep).
    """
    least, primary = (2, True) if tier == "deep" else (1, False)
    fields = ["status", "valid_until", "source_type", "cross_ids"]
    last = F.max_by(F.struct(*fields), F.struct(*([order] if order else []), *fields))
    item = evidence.groupBy("evidence_id").agg(last.alias("_i")).select("evidence_id", "_i.*")
    # cross ids that exist in the pack count, each time they are named
    cross = item.select("evidence_id", F.explode("cross_ids").alias("x")).join(item.select(F.col("evidence_id").alias("x"), F.col("source_type").alias("xt")), "x")
    cross = cross.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("others"), F.max((F.col("xt") == "primary").cast("int")).alias("other_primary"))
    facts = claims.where("type <> 'analysis'").join(item.join(cross, "evidence_id", "left"), "evidence_id", "left")
    stale = (F.col("status") == "stale") | F.coalesce(F.col("valid_until") < now, F.lit(False))
    sources = F.coalesce("others", F.lit(0)) + 1
    has_primary = (F.col("source_type") == "primary") | (F.coalesce("other_primary", F.lit(0)) == 1)
    high = F.coalesce("risk", F.lit("medium")) == "high"
    reason = (
        F.when(F.col("evidence_id").isNull() | (F.col("evidence_id").cast("string") == ""), "no evidence mapping")
        .when(F.col("source_type").isNull(), "evidence not found").when(F.col("status") == "rejected", "rejected").when(stale, "stale")
        .when(F.col("status").isin("conflicted", "context", "analysis"), F.col("status")).when(~F.col("status").eqNullSafe("verified"), "not verified")
        .when(high & (sources < least), "too few sources").when(high & F.lit(primary) & ~has_primary, "no primary source")
    )
    return facts.select("claim_id", reason.alias("reason")).where("reason IS NOT NULL")


def errors(*checks: tuple[Column, str]) -> Column:
    """The messages of the checks that hold, as an array."""
    return F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in checks]))
