"""Titles, descriptions, hashtags and comment hooks of posts, derived from their scenes where none are given.

Scenes are rows (content, ordinal, voiceover, texts: JSON); a brand's own words are parameters. What entities a content speaks of comes from one
automaton over the dictionary of keywords, in one pass over its scenes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.dictionary import find_terms

#: Lengths of titles and descriptions, numbers of hashtags, names and amounts that a hook takes.
TITLE, DESCRIPTION, FEWEST_TAGS, MOST_TAGS, NAMES, AMOUNTS = 60, 2200, 3, 5, 3, 3
AMOUNT = r"(?i)\$?[\d.]+\s*(?:billion|million|B|M)\b"
BLANK = " \t\n\r\x0b\f"


@dataclass(frozen=True)
class Brand:
    """A channel's own words: tags that every post has, tags to fill up with, what a title must hold one of and is given if not, the last hook, the call."""

    always: tuple[str, ...]
    fill: tuple[str, ...]
    keywords: tuple[str, ...]
    suffix: str
    last_hook: str
    call: str


def cut_at_word(text: Column, longest: Column | int) -> Column:
    """At most so many characters, never ending within a word unless there is one alone."""
    n = longest if isinstance(longest, Column) else F.lit(longest)
    head = F.left(text, n)
    at = F.length(F.regexp_extract(head, r"(?s)^(.*) ", 1))
    return F.when(F.length(text) <= n, text).otherwise(F.regexp_replace(F.when(at > 0, F.left(head, at)).otherwise(head), r"\s+$", ""))


def cut_at_sentence(text: Column, longest: Column | int) -> Column:
    """Whole sentences from the beginning, at most so many characters; where the first alone is longer, words."""
    n = longest if isinstance(longest, Column) else F.lit(longest)
    start = F.struct(F.lit("").alias("t"), F.lit(False).alias("full"))

    def step(s: Column, x: Column) -> Column:
        more = F.btrim(F.concat(s["t"], F.lit(" "), x), F.lit(BLANK))
        full = s["full"] | (F.length(more) > n)
        return F.struct(F.when(full, s["t"]).otherwise(more).alias("t"), full.alias("full"))

    kept = F.aggregate(F.split(text, r"(?<=[.!?\n])\s+"), start, step, lambda s: s["t"])
    return F.when(F.length(text) <= n, text).when(kept == "", cut_at_word(text, n)).otherwise(kept)


def _given(text: Column) -> Column:
    """The text without blanks at its ends, null for an empty one."""
    return F.nullif(F.btrim(text, F.lit(BLANK)), F.lit(""))


def _first_sentence(voice: Column) -> Column:
    return F.btrim(F.get(F.split(F.coalesce(voice, F.lit("")), "[.!?]"), F.lit(0)), F.lit(BLANK))


def titled(title: Column, given: Column, brand: Brand, entity: Column) -> Column:
    """A title of TITLE characters at most that holds one of the brand's keywords or the entity, or else ends with the brand's suffix."""
    text = cut_at_word(title, TITLE)
    low = F.lower(text)
    known = F.coalesce(F.contains(low, F.lower(entity)) & (entity != ""), F.lit(False))
    for k in brand.keywords:
        known = known | low.contains(k)
    room = TITLE - len(brand.suffix)
    # a derived title that has room is not cut again; a given one is
    short = F.when(~given & (F.length(text) <= room), text).otherwise(cut_at_word(text, room))
    return F.when(known | (~given & (text == "")), text).otherwise(F.concat(short, F.lit(brand.suffix)))


def capped(tags: Column, brand: Brand) -> Column:
    """Tags in their order, filled up to FEWEST_TAGS, MOST_TAGS at most."""
    some = F.slice(tags, 1, MOST_TAGS)
    for t in brand.fill:
        some = F.when((F.size(some) < FEWEST_TAGS) & ~F.array_contains(some, t), F.array_append(some, F.lit(t))).otherwise(some)
    return some


def post_texts(scenes: DataFrame, posts: DataFrame, entities: DataFrame, names: DataFrame, brand: Brand) -> DataFrame:
    """(content, title, description, hashtags, hook, pinned) of posts (content, title, description, hashtags, hook, url, entity: given ones or null).

    scenes: (content, ordinal, voiceover, texts). entities: (place, keyword, tag): tags are taken in the order of their places.
    names: (place, name): companies for the hook, in that order. A post without scenes has an empty derived title and body.
    """
    terms = entities.select(F.col("keyword").alias("term"), (F.col("place") * 2).alias("number")).union(names.select("name", F.col("place") * 2 + 1))
    voice, texts = F.coalesce("voiceover", F.lit("")), F.coalesce("texts", F.lit("{}"))
    both = scenes.select("content", "ordinal", "voiceover", "texts", F.concat(voice, F.lit(" "), texts).alias("_all"))
    found = find_terms(both, "_all", terms, name="_found").withColumn("_amounts", F.transform(F.regexp_extract_all("_all", F.lit(AMOUNT), 0), lambda m: F.regexp_replace(m, r"\s+", " ")))
    line = _first_sentence(F.col("voiceover"))
    # of a scene's texts the first that is a string and not empty
    values = F.transform(F.map_entries(F.from_json("texts", "map<string, variant>")), lambda e: F.when(F.schema_of_variant(e["value"]) == "STRING", F.try_variant_get(e["value"], "$", "string")))
    word = F.get(F.filter(values, lambda v: v != ""), F.lit(0))
    per = found.groupBy("content").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_found")))).alias("_found"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "_amounts"))), lambda s: s["_amounts"])).alias("_amounts"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(line != "", F.struct("ordinal", line.alias("line"))))), lambda s: s["line"]), "\n").alias("_body"),
        F.min_by(F.struct(line.alias("line"), word.alias("word")), "ordinal").alias("_first"),
    )
    tags = entities.groupBy(F.col("tag")).agg(F.min("place").alias("place"))
    listed = F.explode("_found").alias("_n")
    of_entities = per.select("content", listed).where("_n % 2 = 0").join(F.broadcast(entities.select((F.col("place") * 2).alias("_n"), "tag").distinct()), "_n").join(F.broadcast(tags), "tag")
    of_entities = of_entities.groupBy("content").agg(F.transform(F.array_sort(F.collect_set(F.struct("place", "tag"))), lambda s: s["tag"]).alias("_tags"))
    of_names = per.select("content", listed).where("_n % 2 = 1").join(F.broadcast(names.select((F.col("place") * 2 + 1).alias("_n"), "place", "name")), "_n")
    of_names = of_names.groupBy("content").agg(F.slice(F.transform(F.array_sort(F.collect_set(F.struct("place", "name"))), lambda s: s["name"]), 1, NAMES).alias("_names"))
    out = posts.join(per.drop("_found"), "content", "left").join(of_entities, "content", "left").join(of_names, "content", "left")

    a, n = F.coalesce(F.slice("_amounts", 1, AMOUNTS), F.array().cast("array<string>")), F.coalesce("_names", F.array().cast("array<string>"))
    hook = (
        F.when(_given(F.col("hook")).isNotNull(), _given(F.col("hook")))
        .when(F.size(a) >= 2, F.concat(F.get(a, F.lit(0)), F.lit(" or "), F.get(a, F.lit(1)), F.lit(" — which surprised you more?")))
        .when(F.size(n) >= 2, F.concat(F.lit("Will "), F.get(n, F.lit(0)), F.lit(" catch up to "), F.get(n, F.lit(1)), F.lit("? Why or why not?")))
        .when(F.size(n) == 1, F.concat(F.lit("What's your take on "), F.get(n, F.lit(0)), F.lit("? Overhyped or underrated?")))
        .otherwise(brand.last_hook)
    )
    first = F.coalesce("_first.line", F.lit(""))
    made = F.when(F.col("_first.word").isNotNull(), F.concat("_first.word", F.lit(": "), first)).otherwise(first)
    made = F.concat(F.upper(F.left(made, F.lit(1))), F.substr(made, F.lit(2)))
    named = _given(F.col("title"))
    title = titled(F.coalesce(named, made), named.isNotNull(), brand, F.col("entity"))
    own = F.concat(_given(F.col("description")), F.lit("\n\n"), hook)
    own = F.when(own.rlike("(?i)follow|subscribe"), own).otherwise(F.concat(own, F.lit("\n" + brand.call)))
    body = F.coalesce("_body", F.lit(""))
    lacks = (F.coalesce("entity", F.lit("")) != "") & ~F.contains(F.lower(body), F.lower("entity"))
    body = F.when(F.coalesce(lacks, F.lit(False)), F.concat("entity", F.lit(" analysis.\n"), body)).otherwise(body)
    rest = F.lit(DESCRIPTION - len(brand.call) - 3) - F.length(hook)
    description = F.when(_given(F.col("description")).isNotNull(), cut_at_sentence(own, DESCRIPTION)).otherwise(F.concat(cut_at_sentence(body, rest), F.lit("\n\n"), hook, F.lit("\n" + brand.call)))
    given_tags = F.when(F.size("hashtags") > 0, F.col("hashtags"))
    derived = F.array_distinct(F.concat(F.array(*map(F.lit, brand.always)), F.coalesce("_tags", F.array().cast("array<string>"))))
    pinned = F.when(_given(F.col("url")).isNotNull(), F.concat(hook, F.lit("\n\nFull analysis: "), _given(F.col("url")))).otherwise(hook)
    return out.select("content", title.alias("title"), description.alias("description"), capped(F.coalesce(given_tags, derived), brand).alias("hashtags"), hook.alias("hook"), pinned.alias("pinned"))


def ranked(terms: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """terms with their ``place`` in an order, from 0; a dictionary's, which is small."""
    return terms.select(*columns, (F.row_number().over(Window.orderBy(*order)) - 1).alias("place"))
