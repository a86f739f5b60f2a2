"""Incremental maintenance: hash diffs, upserts, orphans, cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.dictionary import find_terms


def hash_diff(current: DataFrame, existing: DataFrame, keys: list[str], hash_col: str = "chunk_hash") -> DataFrame:
    """current rows with ``state``: new, changed or unchanged against existing hashes (null-safe)."""
    old = existing.select(*keys, F.col(hash_col).alias("_old"), F.lit(True).alias("_have"))
    state = F.when(F.col("_have").isNull(), "new").when(F.col(hash_col).eqNullSafe(F.col("_old")), "unchanged").otherwise("changed")
    return current.join(old, keys, "left").withColumn("state", state).drop("_old", "_have")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Union by key; the row that is first in ``order`` wins. One shuffle on the key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return target.unionByName(updates, allowMissingColumns=True).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def orphans(index: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Index rows whose source is gone; an empty current set orphans every row."""
    return index.join(current.select(*keys).distinct(), keys, "left_anti")


def retained(index: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    return index.join(current.select(*keys).distinct(), keys, "left_semi")


def insert_new(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """target and the rows whose key it lacks."""
    return target.unionByName(rows.join(target.select(*keys), keys, "left_anti"))


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Exact duplicates by key, the first in a stated order kept."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def first_casing(rows: DataFrame, keys: list[str], word: str, ordinal: str) -> DataFrame:
    """Words that are equal but for their case once for each key, as first written."""
    return keep_first(rows.withColumn("_low", F.lower(word)), [*keys, "_low"], [ordinal]).drop("_low")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys that stand more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def save_posts(stored: DataFrame, saved: DataFrame, slug: str, now) -> DataFrame:
    """Stored posts (slug, published, version, published_at) after saving others (slug, published, version): a post's first time of publication
    stays, one that is published for the first time gets ``now``."""
    was = stored.select(slug, F.col("published").alias("_p"), F.col("version").alias("_v"), F.col("published_at").alias("_at"))
    both = saved.join(was, slug, "full_outer")
    at = F.when(F.col("_at").isNotNull(), F.col("_at")).when(F.col("published"), now)
    return both.select(slug, F.coalesce("published", "_p").alias("published"), F.coalesce("version", "_v").alias("version"), at.alias("published_at"))


def or_else(rows: DataFrame, others: DataFrame) -> DataFrame:
    """rows, or the others if there are none."""
    none = rows.limit(1).agg((F.count(F.lit(1)) == 0).alias("_none")).where("_none")  # one row or none
    return rows.unionByName(others.join(F.broadcast(none)).drop("_none"))


def record_artifacts(manifest: DataFrame, written: DataFrame) -> DataFrame:
    """Manifest rows (run, filename, written_at, ...) with the newly written ones; a file written again replaces its row."""
    return upsert(manifest.withColumn("_new", F.lit(0)), written.withColumn("_new", F.lit(1)), ["run", "filename"], [F.desc("_new")]).drop("_new")


def split_errors(rows: DataFrame, error: str) -> tuple[DataFrame, DataFrame]:
    """(rows without an error, rows with one): a job goes on with the first and logs the second."""
    return rows.where(F.col(error).isNull()).drop(error), rows.where(F.col(error).isNotNull())


#: Kinds of events that end a subscription; the one that begins it again.
ENDS, BEGINS = ("unsubscribed", "bounced", "complaint"), "resubscribed"


def subscription_times(subscribers: DataFrame, events: DataFrame) -> DataFrame:
    """Subscribers (email, unsubscribed_at) after events (email, type, at): the last one that matters sets the time or clears it."""
    last = events.where(F.col("type").isin(*ENDS, BEGINS)).groupBy("email").agg(F.max_by(F.struct("type", "at"), F.struct("at", "type")).alias("e"))
    at = F.when(F.col("e").isNull(), F.col("unsubscribed_at")).when(F.col("e.type") != BEGINS, F.col("e.at"))
    return subscribers.join(last, "email", "left").select("email", at.alias("unsubscribed_at"))


def patch_field(rows: DataFrame, key: str, field: str, patches: DataFrame, order: str | None = None) -> DataFrame:
    """rows with one field taken from patches (key, value) where there is one, null values included; of several patches of a key the last in
    ``order``, without an order the greatest value."""
    last = F.struct(F.col(order or "value"), F.col("value"))
    side = patches.groupBy(key).agg(F.max_by(F.struct("value"), last)["value"].alias("_to"), F.lit(True).alias("_have"))
    return rows.join(side, key, "left").withColumn(field, F.when(F.col("_have"), F.col("_to")).otherwise(F.col(field))).drop("_to", "_have")


def only_one(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that are alone with their key; a second one fails the job."""
    counted = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return counted.where(F.when(F.col("_n") > 1, F.raise_error(F.lit("more than one row"))).otherwise(F.lit(True)).cast("boolean")).drop("_n")


def lookup_or_fail(rows: DataFrame, side: DataFrame, key: str, value: str) -> DataFrame:
    """rows with the side's value; a key that the side lacks fails the job."""
    named = side.select(key, F.col(value), F.lit(True).alias("_have"))
    checked = F.when(F.col("_have"), F.col(value)).otherwise(F.raise_error(F.concat(F.lit("unknown key "), F.col(key).cast("string"))).cast(side.schema[value].dataType))
    return rows.join(named, key, "left").withColumn(value, checked).drop("_have")


def apply_media(scenes: DataFrame, patches: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(scenes after the patches, receipt): scenes (content, scene, media_type, media_path); patches (content, scene, ordinal, status, media_type,
    media_path), a scene's first assigned one counts. Receipt: (content, added, replaced, already, conflicts, missing, skipped)."""
    first = Window.partitionBy("content", "scene", F.col("status") == "assigned").orderBy("ordinal")
    p = patches.select("content", "scene", "status", F.col("media_type").alias("_t"), F.col("media_path").alias("_p"), F.row_number().over(first).alias("_rn"))
    met = p.join(scenes.withColumn("_have", F.lit(True)), ["content", "scene"], "left")
    same = F.col("media_type").eqNullSafe(F.col("_t")) & F.col("media_path").eqNullSafe(F.col("_p"))
    fate = F.when(F.col("status") != "assigned", "skipped").when(F.col("_have").isNull(), "missing").when(F.col("_rn") > 1, "conflict").when(F.col("media_path").isNull(), "added").when(same, "already").otherwise("replaced" if force else "conflict")
    judged = met.withColumn("fate", fate)
    receipt = judged.groupBy("content").agg(*[F.count_if(F.col("fate") == f).alias(n) for n, f in (("added", "added"), ("replaced", "replaced"), ("already", "already"), ("conflicts", "conflict"), ("missing", "missing"), ("skipped", "skipped"))])
    done = judged.where(F.col("fate").isin("added", "replaced")).select("content", "scene", "_t", "_p")
    out = scenes.join(done, ["content", "scene"], "left").select("content", "scene", F.coalesce("_t", "media_type").alias("media_type"), F.coalesce("_p", "media_path").alias("media_path"))
    return out, receipt


def update_rows(rows: DataFrame, updates: DataFrame, keys: list[str], now) -> DataFrame:
    """rows after updates (keys, some of the other columns): each updated row has ``updated_at`` set to now, changed or not, as a trigger does."""
    changed = [c for c in updates.columns if c not in keys]
    side = updates.select(*keys, *[F.col(c).alias(f"_to_{c}") for c in changed], F.lit(True).alias("_have"))
    out = rows.join(side, keys, "left")
    to = {c: F.when(F.col("_have"), F.col(f"_to_{c}")).otherwise(F.col(c)) for c in changed}
    return out.withColumns(to | {"updated_at": F.when(F.col("_have"), now).otherwise(F.col("updated_at"))}).select(*rows.columns)


def new_users(profiles: DataFrame, signups: DataFrame, key: str, order: list) -> tuple[DataFrame, DataFrame]:
    """(profiles with the new ones, their roles (key, role)): whoever comes when there is no profile yet is admin, everyone else user."""
    fresh = signups.join(profiles.select(key), key, "left_anti").dropDuplicates([key])
    none = profiles.limit(1).agg((F.count(F.lit(1)) == 0).alias("_none"))
    first = fresh.orderBy(*order).limit(1).select(key, F.lit(True).alias("_first"))
    roles = fresh.join(first, key, "left").join(F.broadcast(none)).select(key, F.when(F.col("_none") & F.col("_first"), "admin").otherwise("user").alias("role"))
    return profiles.unionByName(fresh.select(*profiles.columns)), roles


def append_log(log: DataFrame, sends: DataFrame, keys: list[str]) -> DataFrame:
    """The log with the sends whose keys it lacks, each once; a dispatch that runs again adds nothing."""
    return log.unionByName(sends.dropDuplicates(keys).join(log.select(*keys), keys, "left_anti").select(*log.columns))


def keywords_of(contents: DataFrame, named: DataFrame, wished: DataFrame, scenes: DataFrame, known: DataFrame) -> DataFrame:
    """(content, ordinal, keyword): each content's keywords, once whatever their case, as first written. They are those named in its record and those wished
    for (content, ordinal, keyword), in this order; where there are neither, the known names (place, name) that its scenes (content, scene, voiceover)
    speak of, by scene and place."""
    given = named.select("content", F.lit(0).alias("tier"), F.col("ordinal").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "keyword").unionByName(wished.select("content", F.lit(1).alias("tier"), F.col("ordinal").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "keyword"))
    silent = contents.select("content").distinct().join(given.select("content").distinct(), "content", "left_anti")
    said = find_terms(scenes.join(silent, "content", "left_semi").select("content", "scene", "voiceover"), "voiceover", known.select(F.col("name").alias("term"), F.col("place").alias("number")))
    told = said.select("content", "scene", F.explode("found").alias("place")).join(F.broadcast(known.select("place", "name")), "place")
    told = told.select("content", F.lit(2).alias("tier"), F.col("scene").cast("long").alias("a"), F.col("place").cast("long").alias("b"), F.col("name").alias("keyword"))
    once = first_casing(given.unionByName(told).withColumn("_o", F.struct("tier", "a", "b", "keyword")), ["content"], "keyword", "_o")
    return once.select("content", (F.row_number().over(Window.partitionBy("content").orderBy("_o")) - 1).alias("ordinal"), "keyword")
