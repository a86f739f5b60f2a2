"""Parsers of landed answers by name, callable from SQL: parse('hn', TABLE(landed)) over rows (key, payload).

What a parser reads is declared as data: where an answer's items are, and which paths in an item give a title, an address and so on. A
parser can be a function too. An answer that can't be read gives one row with the error and nothing else.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

ROWS = "key string, i int, title string, url string, snippet string, published string, author string, error string"
Item = dict[str, str | None]


def look_up(value, path: str):
    """The value at a path of keys and places ('a.b.0'), None where it leads nowhere."""
    for part in path.split("."):
        if isinstance(value, dict):
            value = value.get(part)
        elif isinstance(value, list) and part.isdigit() and int(part) < len(value):
            value = value[int(part)]
        else:
            return None
    return value


@dataclass(frozen=True)
class Fields:
    """items: the path of an answer's array; of each field the paths of which the first given one counts, and words before it; seconds: the time is a number of seconds."""

    items: str
    title: tuple[str, ...] = ("title",)
    url: tuple[str, ...] = ("url",)
    snippet: tuple[str, ...] = ()
    published: tuple[str, ...] = ()
    author: tuple[str, ...] = ()
    before_url: str = ""
    else_url: tuple[str, str] = ("", "")  # words and a path, where no address is given
    seconds: bool = False
    longest: int = 200

    def __call__(self, payload: str) -> Iterator[Item]:
        found = look_up(json.loads(payload), self.items)
        if found is None:
            return
        if not isinstance(found, list):
            raise ValueError(f"{self.items} is no array")
        for x in found:
            first = lambda paths, x=x: next((str(v) for p in paths if (v := look_up(x, p)) not in (None, "")), "")
            url = first(self.url)
            if not url and self.else_url[0]:
                url = self.else_url[0] + str(look_up(x, self.else_url[1]) or "undefined")
            else:
                url = self.before_url + url
            when = first(self.published)
            if self.seconds:
                when = datetime.fromtimestamp(float(when), timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.000Z") if when and float(when) else ""
            yield {"title": first(self.title), "url": url, "snippet": first(self.snippet)[: self.longest], "published": when, "author": first(self.author)}


#: Services by name.
PARSERS: dict[str, Callable[[str], Iterator[Item]]] = {
    "hn": Fields("hits", url=("url",), published=("created_at_i",), author=("author",), else_url=("https://news.ycombinator.com/item?id=", "objectID"), seconds=True),
    "reddit": Fields("data.children", title=("data.title",), url=("data.permalink",), published=("data.created_utc",), author=("data.author",), before_url="https://reddit.com", seconds=True),
    "repositories": Fields("items", title=("full_name", "name"), url=("html_url",), snippet=("description",)),
    "gnews": Fields("articles", snippet=("description",), published=("publishedAt",), author=("source.name",)),
    "currents": Fields("news", snippet=("description",), published=("published",), author=("author", "source_category.0")),
    "noozra": Fields("articles", title=("headline",), snippet=("description",), published=("published_at",), author=("source",)),
}


def register(spark: SparkSession, more: dict[str, Callable[[str], Iterator[Item]]] | None = None, name: str = "parse") -> None:
    """Make ``SELECT * FROM parse('service', TABLE(rows of key and payload))`` known, of PARSERS and more (of equal names, more's)."""
    parsers = {**PARSERS, **(more or {})}

    class Parse:
        def eval(self, service: str, row):
            key, payload = row[0], row[1]
            try:
                if service not in parsers:
                    raise ValueError(f"no parser {service}")
                if payload is None:
                    raise ValueError("no payload")
                found = list(parsers[service](payload))
            except Exception as e:  # a bad answer is a row, not the job's end
                yield (str(key), None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200])
                return
            for i, x in enumerate(found):
                yield (str(key), i, x.get("title"), x.get("url"), x.get("snippet"), x.get("published"), x.get("author"), None)

    spark.udtf.register(name, udtf(Parse, returnType=ROWS))


def parse(landed: DataFrame, service: str, more: dict[str, Callable[[str], Iterator[Item]]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, errors (key, error)) of landed answers (key, payload)."""
    spark = landed.sparkSession
    register(spark, more)
    landed.select("key", "payload").createOrReplaceTempView("quillon_landed")
    out = spark.sql("SELECT * FROM parse(:service, TABLE(quillon_landed))", args={"service": service})
    return out.where("error IS NULL").drop("error"), out.where("error IS NOT NULL").select("key", "error")
