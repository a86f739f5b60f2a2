"""Column functions over text. All stay in the JVM; white space classes are spelled out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\n\x0B\f\r]"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row: a column that is named many times within lambdas or conditions would be computed as often."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def snake_case(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.btrim(text), rf"(?:-|{WS})+", "_"))


def slug(text: Column, longest: int = 80) -> Column:
    """Lower-case letters and digits joined by single hyphens."""
    return F.regexp_replace(F.left(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(longest)), "-+$", "")


#: Block elements, blocks to drop, entities in the order they are decoded.
DROPPED = ("script", "style", "nav", "footer")
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))


def html_text(html: Column) -> Column:
    """Readable text of a page: blocks dropped, block tags to newlines, other tags away, entities decoded, blanks collapsed."""
    out = html
    for tag in DROPPED:
        out = F.regexp_replace(out, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    out = F.regexp_replace(out, "(?i)<(?:p|div|h[1-6]|br|li|tr)[^>]*>", "\n")
    out = F.regexp_replace(out, "<[^>]+>", "")
    for code, char in ENTITIES:
        out = F.replace(out, F.lit(code), F.lit(char))
    return F.btrim(F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), "[ \t]+", " "), F.lit(" \t\n\r"))


def valid_slug(text: Column, longest: int = 80) -> Column:
    """Lower-case letters and digits in groups joined by single hyphens, within the limit."""
    return F.coalesce(text.rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$") & (F.length(text) <= longest), F.lit(False))


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, "(?i)<title[^>]*>([^<]+)</title>", 1)


#: White space beyond ASCII too; emoji.
WIDE_WS = r"[ \t\n\x0B\f\r\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
EMOJI = r"[\x{1F300}-\x{1F64F}\x{1F680}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}\x{1F1E6}-\x{1F1FF}\x{1F200}-\x{1F251}]"


def clean_title(title: Column, longest: int = 200) -> Column:
    """Without emoji, paired hashtags, stray #, bracketed prefixes; blanks collapsed; cut to ``longest``. Null gives ''."""
    out = F.regexp_replace(F.coalesce(title, F.lit("")), EMOJI, "")
    # removing a pair may bring another together; every pass that changes a text takes three characters at least
    again = F.when(out.contains("##"), F.sequence(F.lit(0), F.floor(F.length(out) / 3).cast("int"))).otherwise(F.array(F.lit(0)))
    pair = f"#[^#{WIDE_WS[1:-1]}]+#"
    out = F.aggregate(again, out, lambda t, _: F.regexp_replace(t, pair, ""))
    out = F.regexp_replace(F.replace(out, F.lit("#"), F.lit("")), "【[^】]*】", "")
    return F.left(F.regexp_replace(F.regexp_replace(out, f"{WIDE_WS}+", " "), "^ | $", ""), F.lit(longest))


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def file_size(n: Column) -> Column:
    """Human units of 1024 with one decimal from KB on."""
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat((F.floor(n / 102.4 + 0.5) / 10).cast("string"), F.lit(" KB"))).otherwise(F.concat((F.floor(n / 104857.6 + 0.5) / 10).cast("string"), F.lit(" MB")))


def title_tokens(title: Column) -> Column:
    """Distinct lower-case tokens; any with a digit counts as NUM."""
    words = F.regexp_replace(F.lower(title), r"[^a-z0-9_一-鿿]+", " ")
    # a token is looked at from its first character alone, up to its first digit
    named = F.regexp_replace(words, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "NUM")
    return F.array_distinct(F.array_remove(F.split(named, " "), ""))


def whole_word(text: Column, keyword: str) -> Column:
    """A phrase or a non-ASCII keyword as substring, one ASCII word as a whole token of the lower-cased text."""
    k = keyword.lower()
    if " " in k or not (k.isascii() and k.isalnum()):
        return F.lower(text).contains(k)
    return F.array_contains(F.split(F.lower(text), r"[\s,.;:!?'\"\-()\[\]{}]+"), k)


def any_keyword(text: Column, keywords: list[str]) -> Column:
    out = F.lit(False)
    for k in keywords:
        out = out | whole_word(text, k)
    return F.coalesce(out, F.lit(False))


def cascade(text: Column, classes: list[tuple[str, list[str]]], default: str) -> Column:
    """The first class one of whose keywords is in the lower-cased text."""
    low, out = F.lower(text), None
    for name, words in classes:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w.lower())
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def parse_number(text: Column) -> Column:
    """Leading number of a text after commas and percent signs are taken out; else null."""
    return F.regexp_extract(F.regexp_replace(text, "[,，%]", ""), r"^[ ]*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def iso_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def half_up(x: Column) -> Column:
    """Round half toward positive infinity."""
    return F.floor(x + 0.5)
