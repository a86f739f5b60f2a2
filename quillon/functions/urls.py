"""Canonical URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "source", "from", "share", "spm")
SHAPE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _plain(text: Column) -> Column:
    """A form's text decoded; one that isn't well encoded stays, but for its signs for blanks."""
    return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))


def normalize_url(url: Column) -> Column:
    """Lower-case host, no tracking parameters, the rest decoded, sorted by name and encoded again, no fragment, no slash at the end of
    a path; an invalid URL stays as it is and null gives ''."""
    part = [F.regexp_extract(url, SHAPE, i) for i in range(5)]
    given = F.transform(F.filter(F.split(part[4], "&"), lambda p: p != ""), lambda p, i: F.struct(_plain(F.substring_index(p, "=", 1)).alias("name"), i.alias("at"), _plain(F.when(p.contains("="), F.substr(p, F.locate("=", p) + 1)).otherwise("")).alias("value")))
    kept = F.filter(given, lambda p: ~p["name"].isin(*TRACKING))
    # by name, small letters before capitals; those of one name in their order
    placed = F.transform(kept, lambda p: F.struct(F.lower(p["name"]).alias("low"), (p["name"] != F.lower(p["name"])).alias("capital"), p["name"], p["at"], p["value"]))
    query = F.array_join(F.transform(F.array_sort(placed), lambda x: F.concat(F.url_encode(x["name"]), F.lit("="), F.url_encode(x["value"]))), "&")
    path = F.when(F.length(part[3]) > 1, F.regexp_replace(part[3], "/$", "")).when(part[3] == "", "/").otherwise(part[3])
    port = {"http": ":80", "https": ":443"}
    host = F.lower(part[2])
    for scheme, own in port.items():
        host = F.when((F.lower(part[1]) == scheme) & host.endswith(own), F.substring_index(host, ":", 1)).otherwise(host)
    whole = F.concat(F.lower(part[1]), F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url.isNull(), "").when(part[0] == "", url).otherwise(whole)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SHAPE, 2))
