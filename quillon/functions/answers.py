"""A model's Markdown answer as a structure: sections by name, lists cut, choices checked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import bound

BLANK = " \t\n\r\x0b\f"
#: The sections that have a field, by their heading in lower case with underscores; what fit may say.
FIELDS = ("description", "subjects", "content_kind", "fit", "critical_edge_text", "reason")
FITS = ("cover", "contain")


def _bare(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK))


def unfenced(text: Column) -> Column:
    """The text within a code fence that it begins with; a fence that isn't closed is left off alone."""
    body = F.when(F.contains(text, F.lit("\n")), F.substr(text, F.locate("\n", text) + 1)).otherwise(text)
    body = F.rtrim(body)
    body = F.regexp_replace(body, r"\s+\z", "")
    inner = bound(body, lambda b: F.when(b.endswith("```"), F.left(b, F.length(b) - 3)).otherwise(b))
    return F.when(text.startswith("```"), _bare(inner)).otherwise(text)


def sections(text: Column) -> Column:
    """Array of (key, value) in order: what follows each '## ', its first line as the key. What stands before the first goes."""
    parts = F.split(text, "## ")
    parts = F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: _bare(p) != "")

    def one(p: Column) -> Column:
        return bound(_bare(p), cut)

    def cut(p: Column) -> Column:
        line = F.substring_index(p, "\n", 1)
        rest = F.when(F.contains(p, F.lit("\n")), F.substr(p, F.length(line) + 2)).otherwise("")
        return F.struct(F.replace(F.lower(_bare(line)), F.lit(" "), F.lit("_")).alias("key"), _bare(rest).alias("value"))

    return F.transform(parts, one)


def listed(text: Column) -> Column:
    """Items between commas; where that is one at most, between lines."""
    cut = lambda t, by: F.filter(F.transform(F.split(t, by), _bare), lambda s: s != "")
    return bound(text, lambda t: bound(cut(t, ","), lambda some: F.when((F.size(some) <= 1) & (t != ""), cut(t, "\n")).otherwise(some)))


def parse_answer(raw: Column) -> Column:
    """(description, subjects, content_kind, fit, critical_edge_text, reason, more: map of the other sections). Of sections that repeat the last
    counts; a text without headings is the description; an unknown fit is null; null and blank texts have an empty description."""
    none = F.array().cast("array<struct<key: string, value: string>>")
    have = lambda t: F.when(F.contains(t, F.lit("## ")), sections(t)).otherwise(none)
    return bound(_bare(F.coalesce(raw, F.lit(""))), lambda whole: bound(unfenced(whole), lambda t: bound(have(t), lambda h: _fields(t, h))))


def _fields(text: Column, have: Column) -> Column:
    """The answer of a text and its sections."""
    headed = F.contains(text, F.lit("## "))
    field = lambda name: F.try_element_at(F.transform(F.filter(have, lambda s: s["key"] == name), lambda s: s["value"]), F.lit(-1))
    fit = F.lower(field("fit"))
    others = F.filter(have, lambda s: ~s["key"].isin(*FIELDS))
    keys = F.array_distinct(F.transform(others, lambda s: s["key"]))
    more = F.map_from_arrays(keys, F.transform(keys, lambda k: F.try_element_at(F.transform(F.filter(others, lambda s: s["key"] == k), lambda s: s["value"]), F.lit(-1))))
    return F.struct(
        F.when(headed, F.coalesce(field("description"), F.lit(""))).otherwise(text).alias("description"), F.coalesce(listed(field("subjects")), F.array().cast("array<string>")).alias("subjects"),
        field("content_kind").alias("content_kind"), F.when(fit.isin(*FITS), fit).alias("fit"), field("critical_edge_text").alias("critical_edge_text"), field("reason").alias("reason"), more.alias("more"),
    )
