"""Readers of landed payloads: JSON answers of search and media services, feeds, logs and lists, each as rows of one shape.

A payload is a text column of a table; what a service calls missing, empty or zero counts as absent, as in its own clients.
A payload that isn't JSON has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import bound

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def given(x: Column, *others: Column) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (x, *others)), F.lit(""))


def iso_seconds(x: Column) -> Column:
    """Seconds since 1970 as an ISO time in UTC; '' for null or 0."""
    return F.when(F.coalesce(x, F.lit(0)) == 0, "").otherwise(F.date_format(F.timestamp_seconds(x), ISO))


def each(rows: DataFrame, keys: list[str], payload: str, schema: str, path: str) -> DataFrame:
    """(keys, i, x): the elements of an array in the payload, with their places."""
    whole = F.from_json(F.col(payload), schema)
    array = whole
    for part in path.split("."):
        array = array[part]
    return rows.select(*keys, F.posexplode(array).alias("i", "x"))


def reddit_posts(rows: DataFrame, keys: list[str], payload: str) -> DataFrame:
    x = F.col("x.data")
    posts = each(rows, keys, payload, "data struct<children: array<struct<data: struct<title: string, permalink: string, author: string, created_utc: double>>>>", "data.children")
    return posts.select(*keys, "i", given(x["title"]).alias("title"), F.concat(F.lit("https://reddit.com"), given(x["permalink"])).alias("url"), given(x["author"]).alias("author"), iso_seconds(x["created_utc"]).alias("published"))


def hn_hits(rows: DataFrame, keys: list[str], payload: str) -> DataFrame:
    x = F.col("x")
    hits = each(rows, keys, payload, "hits array<struct<title: string, url: string, objectID: string, author: string, created_at_i: long>>", "hits")
    own = F.concat(F.lit("https://news.ycombinator.com/item?id="), F.coalesce(x["objectID"], F.lit("undefined")))
    return hits.select(*keys, "i", given(x["title"]).alias("title"), given(x["url"], own).alias("url"), given(x["author"]).alias("author"), iso_seconds(x["created_at_i"]).alias("published"))


def repositories(rows: DataFrame, keys: list[str], payload: str) -> DataFrame:
    x = F.col("x")
    items = each(rows, keys, payload, "items array<struct<full_name: string, name: string, html_url: string, description: string>>", "items")
    return items.select(*keys, "i", given(x["full_name"], x["name"]).alias("title"), given(x["html_url"]).alias("url"), F.left(given(x["description"]), F.lit(200)).alias("snippet"))


def inverted_index(words: Column) -> Column:
    """A map of each word to its places in the array, as such services give abstracts: sorted by word and place, cut where another word begins."""
    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def cut(s: Column) -> Column:
        begins = lambda e, i: (i == 0) | (F.get(s, i - 1)["w"] != e["w"])
        firsts = F.filter(F.transform(s, lambda e, i: F.when(begins(e, i), i)), lambda i: i.isNotNull())
        spans = lambda at, places: F.transform(at, lambda i, k: F.slice(places, i + 1, F.coalesce(F.get(at, k + 1), F.size(s)) - i))
        return bound(s["i"], lambda places: bound(firsts, lambda at: F.map_from_arrays(F.transform(at, lambda i: F.get(s, i)["w"]), spans(at, places))))

    return bound(placed, cut)


def inverted_abstract(index: Column) -> Column:
    """The words of an inverted index in the order of their first places (a word that comes again stands once)."""
    firsts = F.transform(F.map_entries(index), lambda e: F.struct(F.coalesce(F.get(e["value"], F.lit(0)), F.lit(0)).alias("at"), e["key"].alias("word")))
    return F.coalesce(F.array_join(F.sort_array(firsts)["word"], " "), F.lit(""))


def works(rows: DataFrame, keys: list[str], payload: str) -> DataFrame:
    x = F.col("x")
    found = each(rows, keys, payload, "results array<struct<title: string, display_name: string, doi: string, id: string, publication_date: string, abstract_inverted_index: map<string, array<int>>>>", "results")
    return found.select(*keys, "i", given(x["title"], x["display_name"]).alias("title"), given(x["doi"], x["id"]).alias("url"), F.left(inverted_abstract(x["abstract_inverted_index"]), F.lit(200)).alias("snippet"), given(x["publication_date"]).alias("published"))


def tag_text(item: Column, tag: str) -> Column:
    """Readable text of a feed's element: CDATA and tags away, entities decoded, white space collapsed."""
    out = F.regexp_extract(item, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    for pattern, by in ((r"(?i)^<!\[CDATA\[", ""), (r"(?i)\]\]>$", ""), ("<[^>]+>", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("(?i)&#39;", "'"), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, by)
    return F.btrim(out)


def rss_items(rows: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """(keys, i, title, url, snippet, published); items without title or url go."""
    item = rows.select(*keys, F.posexplode(F.regexp_extract_all(F.col(payload), F.lit(r"(?is)<item(?:\s[^>]*)?>(.*?)</item>"), 1)).alias("i", "x"))
    out = item.select(*keys, "i", tag_text(F.col("x"), "title").alias("title"), tag_text(F.col("x"), "link").alias("url"), F.left(given(tag_text(F.col("x"), "description"), tag_text(F.col("x"), "content:encoded")), F.lit(200)).alias("snippet"), tag_text(F.col("x"), "pubDate").alias("published"))
    return out.where("title <> '' AND url <> ''")


def atom_entries(rows: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """(keys, i, title, url, snippet, published): the alternate link's address, else the id; entries without title or both go."""
    x = F.col("x")
    inner = lambda tag: F.btrim(F.regexp_extract(x, rf"(?s)<{tag}>(.*?)</{tag}>", 1), F.lit(" \t\n\r"))
    line = lambda c: F.regexp_replace(c, "\n", " ")
    entry = rows.select(*keys, F.posexplode(F.regexp_extract_all(F.col(payload), F.lit(r"(?s)<entry>(.*?)</entry>"), 1)).alias("i", "x"))
    url = given(F.regexp_extract(x, r'(?s)<link[^>]*rel="alternate"[^>]*href="([^"]+)"', 1), inner("id"))
    out = entry.where(x.contains("<title>")).select(*keys, "i", line(inner("title")).alias("title"), url.alias("url"), F.left(line(inner("summary")), F.lit(200)).alias("snippet"), inner("published").alias("published"))
    return out.where("url <> ''")


def numbered_list(rows: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """(keys, i, title, url, author) of a numbered list in a text: an entry begins with a bold or quoted title (a plain one only
    before any other), and what follows may give its URL and author."""
    line = rows.select(*keys, F.posexplode(F.split(F.col(payload), "\n")).alias("n", "line"))
    x = F.col("line")
    named = given(F.regexp_extract(x, r"^\*?\d+\.\s*\*\*(.+?)\*\*", 1), F.regexp_extract(x, r'^\*?\d+\.\s*"(.+?)"', 1))
    plain = F.regexp_extract(x, r"^\*?\d+\.\s*(.+)", 1)
    before = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumns({"named": named, "plain": plain})
    line = line.withColumn("begun", F.coalesce(F.max(((F.col("named") != "") | (F.col("plain") != "")).cast("int")).over(before), F.lit(0)) == 1)
    line = line.withColumn("title", F.when(F.col("named") != "", F.col("named")).when((F.col("plain") != "") & ~F.col("begun"), F.col("plain")))
    line = line.withColumn("i", F.sum(F.col("title").isNotNull().cast("int")).over(upto) - 1).where("i >= 0")
    address = r"(https?://[\w./\-?=&]+)"
    marked, any_url = F.regexp_extract(x, rf"(?i)\*\*URL\*\*:\s*{address}", 1), F.regexp_extract(x, address, 1)
    author = F.regexp_extract(x, r"(?i)\*\*Author\*\*:\s*(.+?)(?:\s*\((@\w+)\))?$", 1)
    handle = F.regexp_extract(x, r"(?i)\*\*Author\*\*:\s*(.+?)(?:\s*\((@\w+)\))?$", 2)
    body = F.col("title").isNull()
    last = lambda c: F.max_by(F.when(body & (c != ""), c), F.when(body & (c != ""), F.col("n")))
    first = lambda c: F.min_by(F.when(body & (c != ""), c), F.when(body & (c != ""), F.col("n")))
    out = line.groupBy(*keys, "i").agg(F.max("title").alias("title"), given(last(marked), first(any_url)).alias("url"), given(last(given(handle, author))).alias("author"))
    return out.select(*keys, "i", F.left("title", F.lit(200)).alias("title"), "url", "author")


#: Of each news service the array of its answer, and the fields (several: the first given one) that hold a title, address, snippet, time and author.
NEWS = {
    "gnews": ("articles", ["title"], ["url"], "description", ["publishedAt"], ["source.name"], "title: string, url: string, description: string, publishedAt: string, source: struct<name: string>"),
    "currents": ("news", ["title"], ["url"], "description", ["published"], ["author", "source_category[0]"], "title: string, url: string, description: string, published: string, author: string, source_category: array<string>"),
    "noozra": ("articles", ["headline"], ["url"], "description", ["published_at"], ["source"], "headline: string, url: string, description: string, published_at: string, source: string"),
}


def news(rows: DataFrame, keys: list[str], payload: str, service: str) -> DataFrame:
    """(keys, i, title, url, snippet, published, author) of a news service's answer; missing fields are ''."""
    array, title, url, snippet, published, author, fields = NEWS[service]
    found = each(rows, keys, payload, f"{array} array<struct<{fields}>>", array)

    def of(path: str) -> Column:
        if path.endswith("[0]"):
            return F.get(F.col(f"x.{path[:-3]}"), F.lit(0))
        return F.col(f"x.{path}")

    first = lambda paths: given(*map(of, paths))
    return found.select(*keys, "i", first(title).alias("title"), first(url).alias("url"), F.left(given(of(snippet)), F.lit(200)).alias("snippet"), first(published).alias("published"), first(author).alias("author"))


def papers(rows: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """(keys, i, title, url, snippet, published, author) of a repository of papers: the DOI's address, else the first full text's; authors joined."""
    x = F.col("x")
    found = each(rows, keys, payload, "results array<struct<title: string, abstract: string, doi: string, sourceFulltextUrls: array<string>, publishedDate: string, depositedDate: string, authors: array<struct<name: string>>>>", "results")
    url = F.when(given(x["doi"]) != "", F.concat(F.lit("https://doi.org/"), x["doi"])).otherwise(given(F.get(x["sourceFulltextUrls"], F.lit(0))))
    return found.select(*keys, "i", given(x["title"]).alias("title"), url.alias("url"), F.left(given(x["abstract"]), F.lit(200)).alias("snippet"), given(x["publishedDate"], x["depositedDate"]).alias("published"), given(F.array_join(F.transform(x["authors"], lambda a: F.coalesce(a["name"], F.lit(""))), ", ")).alias("author"))


def atom_updates(rows: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """(keys, i, title, url, snippet, published) of a feed whose links give their address before their kind; entries without title go, the address may be ''."""
    x = F.col("x")
    inner = lambda tag: F.regexp_replace(F.btrim(F.regexp_extract(x, rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1), F.lit(" \t\n\r")), "\n", " ")
    entry = rows.select(*keys, F.posexplode(F.regexp_extract_all(F.col(payload), F.lit(r"(?s)<entry>(.*?)</entry>"), 1)).alias("i", "x"))
    url = F.regexp_extract(x, r'(?s)<link[^>]*href="([^"]+)"[^>]*rel="alternate"', 1)
    return entry.where(x.rlike("(?s)<title>.*?</title>")).select(*keys, "i", inner("title").alias("title"), url.alias("url"), F.left(inner("summary"), F.lit(200)).alias("snippet"), inner("updated").alias("published"))


#: Of each service of pictures the array of its answer, the fields of a title, of addresses, of width and height, of an author.
PICTURES = {
    "unsplash": ("results", "alt_description", ["urls.full", "urls.regular"], ("width", "height"), None, "alt_description: string, urls: struct<full: string, regular: string>, width: int, height: int"),
    "pixabay": ("hits", "tags", ["largeImageURL", "webformatURL"], ("imageWidth", "imageHeight"), "user", "tags: string, largeImageURL: string, webformatURL: string, imageWidth: int, imageHeight: int, user: string"),
}


def pictures(rows: DataFrame, keys: list[str], payload: str, service: str, keyword: Column) -> DataFrame:
    """(keys, i, title, url, type, resolution, author) of a picture service's answer; a picture without a title has the keyword's."""
    array, title, urls, (wide, high), author, fields = PICTURES[service]
    found = each(rows.withColumn("_kw", keyword), [*keys, "_kw"], payload, f"{array} array<struct<{fields}>>", array)
    x = lambda f: F.col(f"x.{f}")
    by = x(author) if author else F.lit(None).cast("string")
    return found.select(*keys, "i", given(x(title), F.col("_kw")).alias("title"), F.nullif(given(*map(x, urls)), F.lit("")).alias("url"), F.lit("image").alias("type"), F.concat_ws("x", x(wide), x(high)).alias("resolution"), by.alias("author"))


def clips(rows: DataFrame, keys: list[str], payload: str, keyword: Column) -> DataFrame:
    """(keys, i, title, url, type, resolution, base_filename) of a service whose clips are known by file name and opened with the answer's token."""
    whole = F.from_json(F.col(payload), "params struct<userToken: string>, hits array<struct<title: string, base_filename: string, is_vertical: boolean>>")
    found = rows.select(*keys, keyword.alias("_kw"), given(whole["params"]["userToken"]).alias("_token"), F.posexplode(whole["hits"]).alias("i", "x"))
    url = F.concat(F.lit("https://cdn.coverr.co/videos/"), F.coalesce(F.col("x.base_filename"), F.lit("undefined")), F.lit("/mp4?token="), F.col("_token"))
    return found.select(*keys, "i", given(F.col("x.title"), F.col("_kw")).alias("title"), url.alias("url"), F.lit("video").alias("type"), F.when(F.coalesce(F.col("x.is_vertical"), F.lit(False)), "vertical").otherwise("horizontal").alias("resolution"), F.col("x.base_filename").alias("base_filename"))


def photos(rows: DataFrame, keys: list[str], payload: str, keyword: Column) -> DataFrame:
    x = F.col("x")
    found = each(rows.withColumn("_kw", keyword), [*keys, "_kw"], payload, "photos array<struct<alt: string, src: struct<original: string, large: string>, width: int, height: int>>", "photos")
    return found.select(*keys, "i", given(x["alt"], F.col("_kw")).alias("title"), F.nullif(given(x["src"]["original"], x["src"]["large"]), F.lit("")).alias("url"), F.lit("image").alias("type"), F.concat_ws("x", x["width"], x["height"]).alias("resolution"))


def videos(rows: DataFrame, keys: list[str], payload: str, keyword: Column) -> DataFrame:
    """One row for each video, of its widest file (of equally wide ones the first)."""
    x = F.col("x")
    found = each(rows.withColumn("_kw", keyword), [*keys, "_kw"], payload, "videos array<struct<user: struct<name: string>, duration: int, video_files: array<struct<link: string, width: int, height: int>>>>", "videos")
    files = F.transform(x["video_files"], lambda f, i: F.struct((-F.coalesce(f["width"], F.lit(0))).alias("rank"), i.alias("at"), f.alias("file")))
    best = F.get(F.array_sort(files), F.lit(0))["file"]
    title = F.when(given(x["user"]["name"]) != "", F.concat(x["user"]["name"], F.lit(" video"))).otherwise(F.col("_kw"))
    return found.select(
        *keys, "i", title.alias("title"), F.nullif(best["link"], F.lit("")).alias("url"), F.lit("video").alias("type"), F.when(best.isNotNull(), F.concat_ws("x", best["width"], best["height"])).alias("resolution"),
        F.when(F.coalesce(x["duration"], F.lit(0)) != 0, F.concat(x["duration"].cast("string"), F.lit("s"))).alias("duration"), x["user"]["name"].alias("author"),
    )


def short_videos(rows: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """(keys, i, title, url, author): entries of either list, an entry's own fields or those below aweme_info; the address is the shared
    one without its query, else made of author and id; entries with neither title nor address go."""
    info = "aweme_id: string, desc: string, share_url: string, author: struct<unique_id: string>"
    entry = f"array<struct<aweme_info: struct<{info}>, {info}>>"
    whole = F.from_json(F.col(payload), f"search_item_list {entry}, data {entry}")
    found = rows.select(*keys, F.posexplode(F.coalesce(whole["search_item_list"], whole["data"])).alias("i", "x"))
    nested = F.col("x.aweme_info").isNotNull()
    field = lambda f: F.coalesce(F.when(nested, F.col(f"x.aweme_info.{f}")).otherwise(F.col(f"x.{f}")), F.lit(""))
    out = found.select(*keys, "i", field("aweme_id").alias("v"), field("desc").alias("d"), field("share_url").alias("s"), field("author.unique_id").alias("author"))
    url = F.when(F.col("s") != "", F.substring_index("s", "?", 1)).when((F.col("author") != "") & (F.col("v") != ""), F.concat(F.lit("https://www.tiktok.com/@"), "author", F.lit("/video/"), "v")).otherwise("")
    out = out.withColumn("url", url).where("d <> '' OR url <> ''")
    return out.select(*keys, "i", given(F.left("d", F.lit(200)), F.concat(F.lit("@"), "author", F.lit(" video "), "v")).alias("title"), "url", "author")


def platform_videos(rows: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Videos of a platform's answer, counts 0 where missing; those without an id go."""
    x = F.col("x")
    found = each(rows, keys, payload, "items array<struct<id: string, text: string, playCount: long, diggCount: long, shareCount: long, commentCount: long>>", "items")
    counts = {"views": "playCount", "likes": "diggCount", "shares": "shareCount", "comments": "commentCount"}
    return found.where(given(x["id"]) != "").select(*keys, "i", x["id"].alias("id"), given(x["text"]).alias("text"), *[F.coalesce(x[f], F.lit(0).cast("long")).alias(n) for n, f in counts.items()])


def platform_comments(rows: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Comments of a platform's answer; those without a text go."""
    x = F.col("x")
    found = each(rows, keys, payload, "items array<struct<text: string, diggCount: long, uniqueId: string>>", "items")
    return found.where(given(x["text"]) != "").select(*keys, "i", x["text"].alias("text"), F.coalesce(x["diggCount"], F.lit(0).cast("long")).alias("likes"), given(x["uniqueId"]).alias("author"))


def metric_rows(rows: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """(keys, i, row: map): rows that are arrays under column names, or objects; all values as text, null as ''."""
    whole = F.from_json(F.col(payload), "data struct<columnNames: array<string>, rows: array<string>>")["data"]
    raw = rows.select(*keys, F.coalesce(whole["columnNames"], F.array().cast("array<string>")).alias("names"), F.posexplode(whole["rows"]).alias("i", "x"))
    listed = F.from_json("x", "array<string>")
    made = F.map_from_arrays("names", F.transform("names", lambda n, i: F.coalesce(F.get(listed, i), F.lit(""))))
    return raw.select(*keys, "i", F.when(F.col("x").startswith("["), made).otherwise(F.transform_values(F.from_json("x", "map<string, string>"), lambda k, v: F.coalesce(v, F.lit("")))).alias("row"))


def probe(payload: Column) -> Column:
    """Duration, frame rate, size, sound and rotation of a media file from its prober's JSON; null without a video stream or a duration."""
    stream = "codec_type: string, r_frame_rate: string, width: int, height: int, tags: struct<rotate: string>, side_data_list: array<struct<rotation: double>>"
    whole = F.from_json(payload, f"streams array<struct<{stream}>>, format struct<duration: string>")
    first = lambda w: F.get(F.filter(w["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    return bound(whole, lambda w: bound(first(w), lambda video: bound(F.split(video["r_frame_rate"], "/"), lambda rate: _probed(w, video, rate))))


def _probed(whole: Column, video: Column, rate: Column) -> Column:
    seconds = F.regexp_extract(whole["format"]["duration"], r"^\s*([+-]?\d*\.?\d+)", 1).try_cast("double")
    one, two = F.get(rate, F.lit(0)).try_cast("double"), F.get(rate, F.lit(1)).try_cast("double")
    fps = F.coalesce(F.when(F.size(rate) == 1, one).when((F.size(rate) == 2) & (two != 0), one / two), F.lit(0.0))
    turned = F.get(F.filter(F.transform(video["side_data_list"], lambda s: s["rotation"]), lambda r: r.isNotNull()), F.lit(0))
    rotation = F.when(given(video["tags"]["rotate"]) != "", F.coalesce(video["tags"]["rotate"].try_cast("double"), F.lit(0.0))).otherwise(F.coalesce(turned, F.lit(0.0)))
    found = F.struct(
        F.floor(seconds * 1000 + 0.5).alias("duration_ms"), (F.floor(fps * 100 + 0.5) / 100).alias("fps"), F.exists(whole["streams"], lambda s: F.coalesce(s["codec_type"] == "audio", F.lit(False))).alias("has_audio"),
        F.coalesce(video["width"], F.lit(0)).alias("width"), F.coalesce(video["height"], F.lit(0)).alias("height"), rotation.alias("rotation"),
    )
    return F.when(video.isNotNull() & seconds.isNotNull(), found)


def packet_times(log: Column) -> Column:
    """The numbers of a packet log, one a line, a comma at the end allowed; other lines go."""
    return F.filter(F.transform(F.split(log, r"\r?\n"), lambda x: F.regexp_replace(F.btrim(x), ",$", "").try_cast("double")), lambda x: x.isNotNull())


def silences(log: Column) -> Column:
    """Array of (start, end): the n-th start with the n-th end, as many as there are of both."""
    starts, ends = (F.regexp_extract_all(log, F.lit(rf"silence_{k}:\s*([\d.]+)"), 1) for k in ("start", "end"))
    n = F.least(F.size(starts), F.size(ends))
    return F.zip_with(F.slice(starts, F.lit(1), n), F.slice(ends, F.lit(1), n), lambda a, b: F.struct(a.cast("double").alias("start"), b.cast("double").alias("end")))


def url_fields(rows: DataFrame, keys: list[str], content: str, path: str) -> DataFrame:
    """(keys, i, url, widget, field) of each url or sourceUrl in a source file; the widget is the folder above data, else the first."""
    parts = F.split(F.col(path), "/")
    at = F.array_position(parts, "data")
    widget = F.when(at > 1, F.get(parts, (at - 2).cast("int"))).otherwise(F.get(parts, F.lit(0)))
    found = rows.select(*keys, widget.alias("widget"), F.posexplode(F.regexp_extract_all(F.col(content), F.lit("(?i)(?:sourceUrl|url)\\s*:\\s*[\"'][^\"']+[\"']"), 0)).alias("i", "x"))
    return found.select(*keys, "i", F.regexp_extract("x", "[\"']([^\"']+)[\"']", 1).alias("url"), "widget", F.when(F.col("x").contains("sourceUrl"), "sourceUrl").otherwise("url").alias("field"))


def json_ld(rows: DataFrame, keys: list[str], html: str) -> DataFrame:
    """(keys, i, doc, parse_error): each ld+json script as a variant; text that isn't JSON gives its first 120 characters as error."""
    scripts = F.regexp_extract_all(F.col(html), F.lit("(?is)<script[^>]+type=[\"']application/ld\\+json[\"'][^>]*>(.*?)</script>"), 1)
    found = rows.select(*keys, F.posexplode(scripts).alias("i", "x"))
    doc = F.try_parse_json(F.btrim("x", F.lit(" \t\n\r")))
    return found.select(*keys, "i", doc.alias("doc"), F.when(doc.isNull(), F.left("x", F.lit(120))).alias("parse_error"))


def first_layer(rows: DataFrame, keys: list[str], layer: str) -> DataFrame:
    """Rows of each key's first layer that has any."""
    return rows.withColumn("_first", F.min(layer).over(Window.partitionBy(*keys))).where(F.col(layer) == F.col("_first")).drop("_first")


def capable(registry: DataFrame, capability: str, paid: bool = False) -> DataFrame:
    """Sources with a capability, those that cost only if asked for."""
    return registry.where(F.array_contains("capabilities", capability) & (F.lit(paid) | ~F.coalesce("paid", F.lit(False))))


def with_images(articles: DataFrame, images: DataFrame) -> DataFrame:
    """Articles with image_url, their own or that of the table (ordinal, url, image_url) by address; of several the one with the least ordinal."""
    side = images.groupBy("url").agg(F.min_by("image_url", "ordinal").alias("_image"))
    return articles.join(side, "url", "left").withColumn("image_url", F.coalesce(F.nullif("image_url", F.lit("")), "_image")).drop("_image")


def source_page(url: Column, widget: Column, title: Column, content: Column) -> Column:
    return F.concat(F.lit("# Source: "), given(title, F.lit("(Untitled)")), F.lit("\n> URL: "), url, F.lit("\n> Extracted from widget: "), widget, F.lit("\n\n"), content, F.lit("\n"))


def stub_page(url: Column, widget: Column, title: Column, reason: Column, summary: Column) -> Column:
    """The page of a source that could not be fetched, with what its widget says."""
    note = F.concat(F.lit("Content could not be fetched ("), reason, F.lit(")."), F.when(given(summary) != "", F.concat(F.lit(" Widget data summary: "), summary, F.lit("."))).otherwise(""))
    return F.concat(F.lit("# Source: "), given(title, F.lit("(Untitled)")), F.lit(" (Stub)\n> URL: "), url, F.lit("\n> Extracted from widget: "), widget, F.lit("\n\n## Note\n"), note, F.lit("\n"))


def widget_summary(content: Column) -> Column:
    """The first five quoted texts of 5 to 80 characters that are no address, colour or import, joined by '; '."""
    found = F.filter(F.regexp_extract_all(content, F.lit("[\"']([^\"']{5,80})[\"']"), 1), lambda x: ~x.startswith("http") & ~x.startswith("#") & ~x.contains("import"))
    return F.array_join(F.slice(found, 1, 5), "; ")


def pointer_files(files: DataFrame, extensions: DataFrame) -> DataFrame:
    """files (name, content) of the extensions (ext) that large-file storage keeps, that hold their content and not a pointer to it."""
    staged = files.withColumn("ext", F.lower(F.substring_index("name", ".", -1))).join(F.broadcast(extensions), "ext", "left_semi")
    return staged.where(~F.col("content").startswith("version https://git-lfs")).drop("ext")


def cached_answers(entries: DataFrame, wanted: DataFrame, now: Column, hours: int = 24, then: list[str] | None = None) -> DataFrame:
    """wanted (source, keyword) with the results of the cache's entry (source, keyword, timestamp, results) of the same names, whatever their case and
    blanks around them, that is younger than so many hours and isn't empty; of several the latest, of equal times the one with the greatest ``then``."""
    name = lambda c: F.lower(F.btrim(c))
    young = entries.where((F.unix_micros(now) - F.unix_micros("timestamp") < hours * 3_600_000_000) & (F.size("results") > 0))
    side = young.groupBy(name("source").alias("_s"), name("keyword").alias("_k")).agg(F.max_by("results", F.struct("timestamp", *(then or []))).alias("results"))
    return wanted.join(side, (name(F.col("source")) == F.col("_s")) & (name(F.col("keyword")) == F.col("_k"))).drop("_s", "_k")
