"""Scalar functions of captions, subtitles, links and media files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media types by file extension.
MEDIA_TYPES = {"gif": "image/gif", "jpeg": "image/jpeg", "jpg": "image/jpeg", "mp3": "audio/mpeg", "mp4": "video/mp4", "pdf": "application/pdf", "png": "image/png", "webm": "video/webm", "webp": "image/webp"}
#: Units of a relative time, in seconds.
UNITS = {"d": 86400, "h": 3600, "m": 60}


def url_slug(url: Column, longest: int = 100, least: int = 50) -> Column:
    """Letters and digits of host and path, joined by dashes; a longer one ends before a dash unless little is left."""
    plain = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z]+://", ""), r"[?#].*$", "")
    slug = F.btrim(F.lower(F.regexp_replace(plain, "[^A-Za-z0-9]+", "-")), F.lit("-"))
    cut = F.left(slug, F.lit(longest))
    head = F.length(cut) - F.instr(F.reverse(cut), "-")
    return F.when(F.length(slug) <= longest, slug).when(head > least, F.left(cut, head)).otherwise(cut)


def speech_seconds(text: Column) -> Column:
    """Time to say a text: ideographs, Latin words and pauses, half a second at least."""
    ideographs, latin, pauses = (F.regexp_count(text, F.lit(p)) for p in (r"[\x{4e00}-\x{9fff}]", "[A-Za-z0-9]+", "[,.;:!?，。；：！？、]"))
    return F.greatest(ideographs / 4.5 + latin / 2.8 + pauses * 0.15, F.lit(0.5))


def truncate_at_word(text: Column, longest: int) -> Column:
    """The text, or its longest beginning within the limit that ends before white space, and an ellipsis."""
    head = F.regexp_extract(text, rf"(?s)^(.{{1,{longest}}})[ \t\n\r]", 1)
    return F.when(F.length(text) <= longest, text).otherwise(F.concat(F.when(head == "", F.left(text, F.lit(longest))).otherwise(head), F.lit("…")))


def media_type(name: Column) -> Column:
    types = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(types, F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))), F.lit("application/octet-stream"))


def since_seconds(text: Column) -> Column:
    """Length of a relative time such as 7h; null if it isn't one."""
    units = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return F.regexp_extract(text, r"^(\d+)[dhm]$", 1).try_cast("long") * F.try_element_at(units, F.right(text, F.lit(1)))


def since_time(text: Column, now: Column) -> Column:
    """The time that a relative one (7h) or a date means; null if it is neither."""
    ago = F.timestamp_seconds(F.unix_seconds(now) - since_seconds(text))
    return F.coalesce(ago, F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d\d-\d\d"), text)))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the code points of a text (its bytes, for ASCII)."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(points, F.lit(2166136261).cast("long"), lambda h, c: h.bitwiseXOR(c) * F.lit(16777619).cast("long") % F.lit(1 << 32))


#: Advances of a bold sans-serif face in thousandths of an em; any other character counts as a digit.
ADVANCES = {
    " ": 278, "!": 333, '"': 474, "#": 556, "$": 556, "%": 889, "&": 722, "'": 278, "(": 333, ")": 333, "*": 389, "+": 584, ",": 278, "-": 333, ".": 278, "/": 556, "0": 556, "1": 556, "2": 556, "3": 556, "4": 556, "5": 556, "6": 556, "7": 556,
    "8": 556, "9": 556, ":": 278, ";": 278, "<": 584, "=": 584, ">": 584, "?": 611, "@": 975, "A": 722, "B": 722, "C": 722, "D": 722, "E": 667, "F": 611, "G": 778, "H": 722, "I": 278, "J": 556, "K": 722, "L": 611, "M": 833, "N": 722, "O": 778,
    "P": 667, "Q": 778, "R": 722, "S": 667, "T": 611, "U": 722, "V": 667, "W": 944, "X": 667, "Y": 667, "Z": 611, "[": 333, "\\": 556, "]": 333, "^": 584, "_": 556, "`": 333, "a": 556, "b": 611, "c": 556, "d": 611, "e": 556, "f": 333,
    "g": 611, "h": 611, "i": 278, "j": 278, "k": 556, "l": 278, "m": 889, "n": 611, "o": 611, "p": 611, "q": 611, "r": 389, "s": 556, "t": 333, "u": 611, "v": 556, "w": 778, "x": 556, "y": 556, "z": 500, "{": 389, "|": 280, "}": 389, "~": 584,
}
ADVANCE = 556


def text_width(text: Column, advances: dict[str, int], default: int, size: float) -> Column:
    """Width of a text from its characters' advances in thousandths of the font size."""
    table = F.create_map(*[F.lit(x) for kv in advances.items() for x in kv])
    units = F.aggregate(F.split(text, ""), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.coalesce(F.try_element_at(table, c), F.lit(default))))
    return units * size / 1000


def subtitle_time(seconds: Column) -> Column:
    """h:mm:ss.cc, rounded to centiseconds."""
    c = F.floor(seconds * 100 + 0.5)
    return F.format_string("%d:%02d:%02d.%02d", F.floor(c / 360000), F.floor(c / 6000) % 60, F.floor(c / 100) % 60, c % 100)


def subtitle_seconds(text: Column) -> Column:
    part = lambda i: F.regexp_extract(text, r"(\d+):(\d\d):(\d\d)\.(\d\d)", i).try_cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 100


def percentage(done: Column, total: Column) -> Column:
    """Between 0 and 100; 0 of nothing."""
    return F.when(total > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * done / total))).otherwise(0.0)
