"""Column functions of content records: metadata, scenes, captions, articles, names, licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import bound, snake_case, xml_escape

BLANK = " \t\n\x0b\f\r"
IDEOGRAPHS = r"\x{4e00}-\x{9fff}\x{3040}-\x{30ff}"


def texts(values: Column) -> Column:
    """Trimmed texts of an array, blank ones left out; null gives none."""
    return F.coalesce(F.filter(F.transform(values, lambda v: F.btrim(v, F.lit(BLANK))), lambda v: v != ""), F.array().cast("array<string>"))


def topics(raw: Column) -> Column:
    """Topics of a metadata object's JSON: lower-cased, blank ones left out; missing gives none, and anything but an array of texts fails."""
    value = F.get_json_object(raw, "$.topics")
    listed = value.rlike(r'^\s*\[\s*(?:"(?:[^"\\]|\\.)*"\s*(?:,\s*"(?:[^"\\]|\\.)*"\s*)*)?\]\s*$')
    return F.when(value.isNull(), F.array().cast("array<string>")).when(listed, texts(F.transform(F.from_json(value, "array<string>"), F.lower))).otherwise(F.raise_error(F.lit("topics must be an array of strings")).cast("array<string>"))


def entities(names: Column) -> Column:
    """Entity names in snake case, blank ones left out; null stays null (a missing key is left out)."""
    return F.transform(F.filter(names, lambda v: F.btrim(v, F.lit(BLANK)) != ""), snake_case)


def overlaps(own: Column, wanted: list[str] | None) -> Column:
    """Whether topics meet the wanted ones; no wish, or an empty one: true. Null topics are none."""
    if not wanted:
        return F.lit(True)
    return F.arrays_overlap(F.coalesce(own, F.array().cast("array<string>")), F.array(*[F.lit(w.strip().lower()) for w in wanted]))


def string_leaves(json: Column) -> Column:
    """Trimmed non-blank texts anywhere in a JSON value, in document order, keys left out."""
    literal = r'"((?:[^"\\]|\\.)*)"'
    found = F.regexp_extract_all(json, F.lit(rf"{literal}\s*:|{literal}"), 2)  # a key is matched too, by the first branch
    return texts(F.transform(found, lambda x: F.get(F.from_json(F.concat(F.lit('["'), x, F.lit('"]')), "array<string>"), F.lit(0))))


def scene_text(voiceover: Column, visual_json: Column) -> Column:
    """A scene's voice-over and its on-screen texts; null where nothing is said."""
    seen = F.coalesce(string_leaves(visual_json), F.array().cast("array<string>"))
    whole = F.when(F.size(seen) > 0, F.concat(voiceover, F.lit("\n\nVisual: "), F.array_join(seen, " | "))).otherwise(voiceover)
    return F.when(F.btrim(voiceover, F.lit(BLANK)) != "", whole)


def catalog_text(description: Column, keywords: Column, file: Column, source: Column, licence: Column, used_in: Column) -> Column:
    """A catalog entry as lines of what it has; null without file or description."""
    line = lambda label, x: F.when(x != "", F.concat(F.lit(f"{label}: "), x))
    joined = lambda xs: F.when(F.size(xs) > 0, F.array_join(xs, ", "))
    whole = F.concat_ws("\n", description, line("Keywords", joined(keywords)), line("File", file), line("Source", source), line("License", licence), line("Used in", joined(used_in)))
    return F.when((file != "") & (description != ""), whole)


def base_name(path: Column) -> Column:
    return F.coalesce(F.nullif(F.substring_index(path, "/", -1), F.lit("")), path)


def keyword_slug(keyword: Column) -> Column:
    """Letters, digits, underscores and East Asian letters joined by single dashes, lower-cased; apostrophes go."""
    out = F.regexp_replace(F.regexp_replace(keyword, "['’]", ""), f"[^A-Za-z0-9_{IDEOGRAPHS}]", "-")
    return F.lower(F.regexp_replace(F.regexp_replace(out, "-+", "-"), "^-|-$", ""))


def asset_file(source: Column, keyword: Column, index: Column, extension: Column) -> Column:
    number = F.when(F.length(index.cast("string")) < 2, F.lpad(index.cast("string"), 2, "0")).otherwise(index.cast("string"))
    return F.concat(source, F.lit("-"), keyword_slug(keyword), F.lit("-"), number, F.lit("."), extension)


#: Parts of an image's address that show it is no content.
NOT_CONTENT = ("logo", "avatar", "icon", "placeholder", "spinner", "favicon", "badge", "button", "sprite")


def not_content_image(url: Column) -> Column:
    """Whether an image's address is missing or that of a logo or the like."""
    return (F.coalesce(url, F.lit("")) == "") | url.rlike("(?i)" + "|".join(NOT_CONTENT))


def any_substring(title: Column, keywords: list[str]) -> Column:
    found = [F.lower(title).contains(k.lower()) for k in keywords]
    return F.coalesce(F.array_contains(F.array(*found), True), F.lit(False)) if found else F.lit(False)


def contained_keywords(title: Column, keywords: list[str]) -> Column:
    """The keywords that a title holds anywhere, in their order."""
    return F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower(title), F.lower(k)))


def title_keywords(title: Column, stop: tuple[str, ...] = ("the", "and", "for", "with", "from")) -> Column:
    """Distinct lower-cased words of more than two letters that aren't stop words."""
    return F.array_distinct(F.filter(F.split(F.lower(title), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*stop)))


def preview(text: Column, longest: int = 200) -> Column:
    return F.when(F.length(text) > longest, F.concat(F.left(text, F.lit(longest)), F.lit("..."))).otherwise(text)


def number_or_null(text: Column) -> Column:
    """A whole text as a finite number; else, and for '', null."""
    value = F.btrim(text).try_cast("double")
    return F.when(text != "", F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value))


def segments(content: Column) -> Column:
    """Array of (type, value): markdown between widget markers, and the widgets' names; markdown first and last, even if empty."""
    parts = F.transform(F.split(F.coalesce(content, F.lit("")), r"<!--\s*widget:\S+\s*-->"), lambda t: F.struct(F.lit("markdown").alias("type"), F.btrim(t, F.lit(BLANK)).alias("value")))
    names = F.transform(F.regexp_extract_all(content, F.lit(r"<!--\s*widget:(\S+)\s*-->"), 1), lambda n: F.struct(F.lit("widget").alias("type"), n.alias("value")))
    mixed = F.flatten(F.zip_with(parts, F.coalesce(names, F.array().cast("array<struct<type:string,value:string>>")), lambda a, b: F.array(a, b)))
    return F.filter(mixed, lambda x: x.isNotNull())


def heading_topic(text: Column) -> Column:
    """The first level-one heading, lower-cased, blanks as dashes; '' without."""
    return F.regexp_replace(F.lower(F.btrim(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1))), r"\s+", "-")


#: Markup that leaves a text, in this order, and what stays of it.
MARKUP = (
    (r"<!--\s*widget:[\w-]+\s*-->", ""), (r"!\[([^\]]*)\]\([^)]+\)", "$1"), (r"\[([^\]]*)\]\([^)]+\)", "$1"), ("`[^`]+`", ""), ("(?s)```.*?```", ""), (r"(?m)^#{1,6}\s+", ""),
    (r"\*{1,3}([^*]+)\*{1,3}", "$1"), ("_{1,3}([^_]+)_{1,3}", "$1"), (r"(?m)^>\s+", ""), (r"(?m)^[-*+]\s+", ""), ("(?m)^---+$", ""),
)
LEADING_BLOCK = r"(?s)\A---\n.*?\n---\n?"


def plain_markdown(text: Column) -> Column:
    """Text of an article without its markup."""
    for pattern, by in MARKUP:
        text = F.regexp_replace(text, pattern, by)
    return F.btrim(text, F.lit(BLANK))


def data_points(text: Column) -> Column:
    """Money, percentages, magnitudes and long numbers, each kind counted by itself."""
    kinds = (r"(?i)\$\d[\d,.]*\s*(?:billion|million|B|M)?", r"\d[\d,.]*%", r"(?i)\d[\d,.]*\s*(?:billion|million|thousand)", r"\b\d{3,}\b")
    return sum((F.regexp_count(text, F.lit(k)) for k in kinds), F.lit(0)).cast("long")


def article_figures(text: Column) -> Column:
    """(words, chapters, data_points) of an article; its leading block counts for nothing."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), LEADING_BLOCK, "")
    plain = plain_markdown(body)
    words = F.when(plain == "", 0).otherwise(F.size(F.split(plain, r"\s+")))
    return F.struct(words.cast("long").alias("words"), F.regexp_count(body, F.lit(r"(?m)^##\s+")).cast("long").alias("chapters"), data_points(body).alias("data_points"))


def episode_plan(words: Column, chapters: Column, per_second: float) -> Column:
    """(seconds, parts, split): one part for each minute that the words take, five at most; split by themes or as one narrative."""
    seconds = words / per_second
    parts = F.least(F.greatest(F.ceil(seconds / 60), F.lit(1)), F.lit(5)).cast("int")
    return F.struct(seconds.alias("seconds"), parts.alias("parts"), F.when(parts <= 1, "none").when(chapters >= 2, "thematic").otherwise("narrative").alias("split"))


def sentence_head(text: Column, longest: int) -> Column:
    """A text within the limit, cut after a sentence; after a word if its first sentence is longer."""
    parts = F.split(text, r"(?<=[.!?\n])\s+")
    step = lambda s, x: F.when(s["full"], s).otherwise(
        F.when(F.length(F.btrim(F.concat(s["t"], F.lit(" "), x), F.lit(BLANK))) > longest, F.struct(s["t"].alias("t"), F.lit(True).alias("full"))).otherwise(F.struct(F.btrim(F.concat(s["t"], F.lit(" "), x), F.lit(BLANK)).alias("t"), F.lit(False).alias("full")))
    )
    whole = F.aggregate(parts, F.struct(F.lit("").alias("t"), F.lit(False).alias("full")), step, lambda s: s["t"])
    cut = F.left(text, F.lit(longest))
    space = F.length(cut) - F.instr(F.reverse(cut), " ")
    by_word = F.rtrim(F.when((F.instr(F.reverse(cut), " ") > 0) & (space > 0), F.left(cut, space.cast("int"))).otherwise(cut))
    return F.when(F.length(text) <= longest, text).when(whole == "", by_word).otherwise(whole)


def caption(title: Column, description: Column, longest: int = 2200) -> Column:
    """Title and description with a blank line between, cut after a sentence."""
    t, d = (F.btrim(F.coalesce(x, F.lit("")), F.lit(BLANK)) for x in (title, description))
    return sentence_head(F.when((t != "") & (d != ""), F.concat(t, F.lit("\n\n"), d)).otherwise(F.concat(t, d)), longest)


def series_hashtag(series_id: Column) -> Column:
    return F.concat(F.lit("#"), F.replace(F.coalesce(series_id, F.lit("")), F.lit("-"), F.lit("")))


def entity_name(raw: Column) -> Column:
    """frontier_security as Frontier Security; letters after the first stay as they are."""
    return F.array_join(F.transform(F.split(raw, "_"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))), " ")


def join_words(words: Column) -> Column:
    """Words joined by blanks, none before a mark."""
    return F.regexp_replace(F.array_join(words, " "), r"\s+([,.;:!?])", "$1")


def needs_attribution(licence: Column) -> Column:
    """Creative Commons and GFDL need it; CC0 and the public domain don't."""
    low = F.lower(F.coalesce(licence, F.lit("")))
    return low.contains("cc-by") | low.contains("cc by") | low.contains("gfdl") | (low.contains("cc") & ~low.contains("cc0") & ~low.contains("public domain"))


HANDLE, CODE = "[A-Za-z0-9_.]{1,24}", "[A-Za-z0-9]{5,20}"


def platform_url(url: Column) -> Column:
    """(handle, video_id, short_code, kind, canonical): a video's, short link's or profile's address, a bare id, or unknown."""
    t = F.btrim(url, F.lit(BLANK))
    got = lambda pattern, i: F.nullif(F.regexp_extract(t, f"(?i){pattern}", i), F.lit(""))
    video = rf"(?:https?://)?(?:www\.|m\.)?tiktok\.com/@({HANDLE})/video/(\d{{6,25}})"
    short = rf"(?:https?://)?(?:vm|vt)\.tiktok\.com/({CODE})|(?:https?://)?(?:www\.)?tiktok\.com/t/({CODE})"
    profile = rf"(?:https?://)?(?:www\.|m\.)?tiktok\.com/@({HANDLE})/?(?:\?.*)?$"
    code, bare, home = F.coalesce(got(short, 1), got(short, 2)), F.nullif(F.regexp_extract(t, r"^(\d{6,25})$", 1), F.lit("")), F.lit("https://www.tiktok.com/@")
    no = F.lit(None).cast("string")
    made = lambda h, v, c, k, u: F.struct(h.alias("handle"), v.alias("video_id"), c.alias("short_code"), F.lit(k).alias("kind"), u.alias("canonical"))
    return (
        F.when(got(video, 2).isNotNull(), made(got(video, 1), got(video, 2), no, "video", F.concat(home, got(video, 1), F.lit("/video/"), got(video, 2))))
        .when(code.isNotNull(), made(no, no, code, "short", F.substring_index(t, "?", 1)))
        .when(got(profile, 1).isNotNull(), made(got(profile, 1), no, no, "profile", F.concat(home, got(profile, 1))))
        .when(bare.isNotNull(), made(no, bare, no, "video", F.concat(home, F.lit("i/video/"), bare))).otherwise(made(no, no, no, "unknown", no))
    )


def inside(path: Column, root: str) -> Column:
    """Whether a relative path stays below a folder: no part is '..', no absolute path elsewhere."""
    return F.coalesce((path.startswith(root.rstrip("/") + "/") | ~path.startswith("/")) & ~path.rlike(r"(^|/)\.\.(/|$)"), F.lit(False))


#: Dollars for a yuan in texts.
DOLLARS = 0.14


def _noted(text: Column, pattern: str) -> Column:
    """Dollars before each yuan amount (groups: number, magnitude) that has none within 30 characters before it."""

    def before(found: Column, rest: Column, i: Column) -> Column:
        """What stands before the i-th amount, of as many pieces as 30 characters can have: an amount has two at least."""
        at = F.greatest(i - 16, F.lit(0))
        return F.array_join(F.flatten(F.zip_with(F.slice(rest, at + 1, i + 1 - at), F.slice(found, at + 1, i - at), lambda a, b: F.array(a, b))), "", "")

    def note(m: Column, before: Column) -> Column:
        n = F.coalesce(F.regexp_extract(F.replace(F.regexp_extract(m, f"(?i){pattern}", 1), F.lit(",")), r"^(\d*\.?\d+|\d+)", 1).try_cast("double"), F.lit(0.0)) * DOLLARS
        unit = F.lower(F.regexp_extract(m, f"(?i){pattern}", 2))
        scale = F.when(unit == "b", 1e9).when(unit == "m", 1e6).when(unit == "k", 1e3).otherwise(1.0)
        word = F.when(unit.isin("billion", "million", "thousand"), F.concat(F.lit(" "), unit)).otherwise("")
        dollars = F.concat(F.lit("$"), F.floor(n * scale + 0.5).cast("string"), word)
        return F.when(F.right(before, F.lit(30)).rlike(r"\$\d"), m).otherwise(F.concat(dollars, F.lit(" ("), m, F.lit(")")))

    def all_noted(text: Column, found: Column, rest: Column) -> Column:
        noted = F.transform(found, lambda m, i: note(m, before(found, rest, i)))
        return F.when(F.size(found) > 0, F.array_join(F.flatten(F.zip_with(rest, noted, lambda a, b: F.array(a, b))), "", "")).otherwise(text)

    amounts = F.lit(f"(?i){pattern}")
    return bound(text, lambda t: bound(F.regexp_extract_all(t, amounts, 0), lambda found: bound(F.split(t, f"(?i){pattern}"), lambda rest: all_noted(t, found, rest))))


def currency_notes(text: Column) -> Column:
    """Dollars beside amounts in yuan, written with the sign or the word."""
    return _noted(_noted(text, r"¥([\d,.]+)\s*(billion|million|thousand|K|B|M)?"), r"(\d[\d,.]*)\s*(billion|million|thousand)\s*yuan")


def gap_limits(attempt: Column) -> Column:
    """(threshold, frames) of subtitle gaps by attempt: wider at the second and third, none after."""
    made = lambda t, f: F.struct(F.lit(t).alias("threshold"), F.lit(f).alias("frames"))
    return F.when(attempt == 0, made(0.5, 2)).when(attempt == 1, made(0.6, 2)).when(attempt == 2, made(0.7, 1))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def sized(embedding: Column, size: int | Column) -> Column:
    """A vector of the wanted size; any other fails the job."""
    wanted = size if isinstance(size, Column) else F.lit(size)
    return F.when(F.size(embedding) == wanted, embedding).when(embedding.isNotNull(), F.raise_error(F.concat(F.lit("expected "), wanted.cast("string"), F.lit(" dimensions, got "), F.size(embedding).cast("string"))).cast("array<float>"))


def series_caption(title: Column, description: Column, series_id: Column, part: Column, parts: Column, longest: int = 2200) -> Column:
    """A caption with a line for the part of its series."""
    line = F.concat(F.lit("Part "), part.cast("string"), F.lit("/"), parts.cast("string"), F.lit(" "), series_hashtag(series_id))
    return sentence_head(F.concat(caption(title, description, longest), F.lit("\n\n"), line), longest)


def credits(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, credits): a section of the texts of attribution (source, author, text, logo, required), each source and author once, in order;
    '' where none is called for."""
    due = F.coalesce("logo", F.lit(False)) | F.coalesce("required", F.lit(False))
    who = F.concat("source", F.coalesce("author", F.lit("")))
    first = rows.select(*keys, F.when(due, F.struct(F.col(order).alias("o"), "text")).alias("t"), who.alias("who")).groupBy(*keys, "who").agg(F.min("t").alias("t"))
    lines = F.transform(F.array_sort(F.collect_list("t")), lambda x: x["text"])
    return first.groupBy(*keys).agg(lines.alias("l")).select(*keys, F.when(F.size("l") > 0, F.concat(F.lit("\n\n--- Credits ---\n"), F.array_join("l", "\n"), F.lit("\n--- /Credits ---"))).otherwise("").alias("credits"))


#: Terms that a search for sounds always has.
SOUND_TERMS = ("news", "breaking news", "tech news", "ai news")


def sound_keywords(title: Column, subject: Column, wish: Column) -> Column:
    """Words of a title, its subject, a wish, and SOUND_TERMS, each once, in lower case."""
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.array(F.lower(c))).otherwise(F.array().cast("array<string>"))
    words = F.coalesce(title_keywords(title), F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, some(subject), some(wish), F.array(*map(F.lit, SOUND_TERMS))))


ENTITY_KINDS = ("companies", "people", "models")


def normalized_metadata(raw: Column) -> Column:
    """A metadata object's JSON with topics lower-cased and the entities' three lists in snake case, all else as it was; what is missing
    stays missing, and a null or other value gives {}. Topics that are no array of texts fail the job."""
    whole = F.from_json(F.when(raw.startswith("{"), raw), "map<string, variant>")
    names = lambda v: F.to_variant_object(F.transform(F.filter(F.try_variant_get(v, "$", "array<string>"), lambda x: F.btrim(x, F.lit(BLANK)) != ""), snake_case))
    listed = lambda v: F.schema_of_variant(v).startswith("ARRAY")
    own = lambda e: F.transform_values(F.from_json(F.to_json(e), "map<string, variant>"), lambda k, v: F.when(k.isin(*ENTITY_KINDS) & listed(v), names(v)).otherwise(v))
    kept = F.map_filter(whole, lambda k, v: (k != "entities") | ~F.coalesce(F.is_variant_null(v), F.lit(True)))
    made = F.transform_values(kept, lambda k, v: F.when(k == "topics", F.to_variant_object(topics(raw))).when((k == "entities") & F.schema_of_variant(v).startswith("OBJECT"), F.to_variant_object(own(v))).otherwise(v))
    return F.coalesce(F.to_json(made), F.lit("{}"))


def parsed_article(text: Column) -> Column:
    """(title, slug, excerpt, content, published, error) of an article's file: leading block and title are needed, the slug comes from the title where
    none is given and has to be a valid one. With an error the rest is null."""
    from quillon.functions.text import slug, valid_slug

    block = r"(?s)\A\s*---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"
    has = F.coalesce(text.rlike(block), F.lit(False))
    front = F.regexp_extract(text, block, 1)
    field = lambda k: F.nullif(F.regexp_replace(F.btrim(F.regexp_extract(front, rf"(?m)^{k}:[ \t]*(.*)$", 1), F.lit(" \t\r")), "^([\"'])(.*)\\1$", "$2"), F.lit(""))
    title = F.nullif(F.btrim(field("title"), F.lit(BLANK)), F.lit(""))
    name = F.coalesce(field("slug"), slug(title))
    error = F.when(~F.coalesce(text.rlike(r"\A\s*---"), F.lit(False)), "Frontmatter is required").when(~has | title.isNull(), "title is required in frontmatter").when(~valid_slug(name), F.concat(F.lit('slug must match [a-z0-9-]+ pattern (got: "'), name, F.lit('")')))
    good = lambda c: F.when(error.isNull(), c)
    body = F.btrim(F.regexp_replace(text, block, ""), F.lit(BLANK))
    return F.struct(good(title).alias("title"), good(name).alias("slug"), good(F.btrim(field("excerpt"), F.lit(BLANK))).alias("excerpt"), good(body).alias("content"), good(F.coalesce(field("published") == "true", F.lit(False))).alias("published"), error.alias("error"))


#: Types of files that may be attached, by extension; bytes of one at most.
ATTACHMENTS = {
    "pdf": "application/pdf", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xls": "application/vnd.ms-excel", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "ppt": "application/vnd.ms-powerpoint", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "txt": "text/plain", "csv": "text/csv", "zip": "application/zip", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp",
}
LARGEST_FILE = 50 * 1024 * 1024


def checked_uploads(files: DataFrame, group: str) -> DataFrame:
    """files (group, path, size: null where there is no such file) with file_name, media_type and error: none there, empty, too large, of a type
    that isn't allowed, or of a name that the group has twice."""
    name = F.substring_index("path", "/", -1)
    types = F.create_map(*[F.lit(x) for kv in ATTACHMENTS.items() for x in kv])
    extension = F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))
    kind = F.try_element_at(types, extension)
    path = F.coalesce("path", F.lit(""))
    megabytes = F.format_string("%.1f", F.col("size") / (1024 * 1024))
    twice = F.count(F.lit(1)).over(Window.partitionBy(group, name)) > 1
    error = (
        F.when(F.btrim(path) == "", F.lit("Invalid file path")).when(F.col("size").isNull(), F.concat(F.lit("File not found: "), path)).when(F.col("size") == 0, F.concat(F.lit("File is empty: "), path))
        .when(F.col("size") > LARGEST_FILE, F.concat(F.lit("File too large: "), path, F.lit(" ("), megabytes, F.lit(" MB). Max: 50 MB"))).when(kind.isNull(), F.concat(F.lit("Unsupported file type: "), path)).when(twice, F.concat(F.lit("Duplicate file names: "), name))
    )
    return files.withColumns({"file_name": name, "media_type": F.coalesce(kind, F.lit("application/octet-stream")), "error": error})


def feed_item(title: Column, link: Column, day: Column) -> Column:
    """An item of a feed."""
    when = F.concat(F.date_format(day, "EEE, dd MMM yyyy"), F.lit(" 00:00:00 GMT"))
    return F.concat(F.lit("<item><title>"), xml_escape(title), F.lit("</title><link>"), link, F.lit("</link><guid>"), link, F.lit("</guid><pubDate>"), when, F.lit("</pubDate></item>"))


def site_entry(link: Column, day: Column) -> Column:
    """An entry of a site map."""
    return F.concat(F.lit("<url><loc>"), link, F.lit("</loc><lastmod>"), day.cast("string"), F.lit("</lastmod></url>"))


def name_of_mail(address: Column) -> Column:
    """What stands before an address's @, the name of a user who gave none."""
    return F.split_part(address, F.lit("@"), F.lit(1))
