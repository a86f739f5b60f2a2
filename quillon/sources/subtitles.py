"""Subtitles: lines of timed text, read and written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.media import subtitle_seconds, subtitle_time


def subtitle_line(start: Column, end: Column, text: Column, style: str = "Default") -> Column:
    return F.concat(F.lit("Dialogue: 0,"), subtitle_time(start), F.lit(","), subtitle_time(end), F.lit(f",{style},,0,0,0,,"), F.regexp_replace(text, r"\r?\n", r"\\N"))


def parse_subtitles(lines: DataFrame, keys: list[str], line: str) -> DataFrame:
    """(keys, start, end, text, karaoke_cs) of the timed lines; tags leave the text, their karaoke centiseconds are summed."""
    part = F.split(F.regexp_replace(line, "^Dialogue: *", ""), ",", 10)
    raw = F.get(part, 9)
    karaoke = F.aggregate(F.regexp_extract_all(raw, F.lit(r"\\k[fo]?(\d+)"), 1), F.lit(0).cast("long"), lambda n, k: n + k.cast("long"))
    return lines.where(F.col(line).startswith("Dialogue:")).select(*keys, subtitle_seconds(F.get(part, 1)).alias("start"), subtitle_seconds(F.get(part, 2)).alias("end"), F.regexp_replace(raw, r"\{[^}]*\}", "").alias("text"), karaoke.alias("karaoke_cs"))


def escaped(text: Column) -> Column:
    """A text as subtitles hold it: backslashes and braces escaped, line ends as a tag."""
    for a, b in (("\\", "\\\\"), ("{", "\\{"), ("}", "\\}")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.regexp_replace(text, r"\r?\n", r"\\N")


@dataclass(frozen=True)
class Style:
    """How subtitles look and where they stand on a canvas of WIDE x HIGH."""

    font: str = "Helvetica Neue"
    size: int = 60
    spoken: str = "&H00FF8B4D"
    unspoken: str = "&H00F5F5F5"
    outline_color: str = "&H66000000"
    back_color: str = "&H66000000"
    outline: int = 3
    shadow: int = 1
    left: int = 110
    right: int = 250
    low: int = 570


WIDE, HIGH = 1080, 1920
STYLE_FIELDS = "Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
EVENT_FIELDS = "Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"


def header(style: Style) -> str:
    """What stands before a subtitle file's lines."""
    look = f"Default,{style.font},{style.size},{style.spoken},{style.unspoken},{style.outline_color},{style.back_color},-1,0,0,0,100,100,0,0,1,{style.outline},{style.shadow},2,{style.left},{style.right},{style.low},1"
    lines = ["[Script Info]", "ScriptType: v4.00+", f"PlayResX: {WIDE}", f"PlayResY: {HIGH}", "WrapStyle: 0", "ScaledBorderAndShadow: yes", "", "[V4+ Styles]", f"Format: {STYLE_FIELDS}", f"Style: {look}", "", "[Events]", f"Format: {EVENT_FIELDS}"]
    return "\n".join(lines) + "\n"


def subtitle_files(cues: DataFrame, key: str, style: Style | None = None) -> DataFrame:
    """(key, content): a whole subtitle file of each video's cues (key, start, end, text, words: array of (text, start, end)), in the order of their
    starts; a cue with words has their karaoke times. A file's cues are one video's."""
    text = F.when(F.size("words") > 0, karaoke_text(F.col("words"), F.col("start"))).otherwise(escaped(F.coalesce("text", F.lit(""))))
    line = F.concat(F.lit("Dialogue: 0,"), subtitle_time(F.greatest("start", F.lit(0.0))), F.lit(","), subtitle_time(F.greatest("end", F.lit(0.0))), F.lit(",Default,,0,0,0,,"), text)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("start", "end", line.alias("line")))), lambda x: x["line"])
    return cues.groupBy(key).agg(F.concat(F.lit(header(style or Style())), F.array_join(lines, "\n"), F.lit("\n")).alias("content"))


def subtitle_styles(lines: DataFrame, keys: list[str], line: str) -> DataFrame:
    """(keys, style: map of its fields) of the lines that set a style, by the fields that STYLE_FIELDS names."""
    names = F.array(*[F.lit(f.strip()) for f in STYLE_FIELDS.split(",")])
    values = F.transform(F.split(F.regexp_replace(line, "^Style: *", ""), ","), lambda v: F.btrim(v))
    return lines.where(F.col(line).startswith("Style:")).select(*keys, F.map_from_arrays(F.slice(names, F.lit(1), F.size(values)), values).alias("style"))


def karaoke_text(words: Column, start: Column) -> Column:
    """Words (text, start, end) with the offset from their line's start and the time they fill, in centiseconds to one decimal."""
    begins = F.floor(start * 100 + 0.5) / 100

    def centiseconds(x: Column) -> Column:
        tenths = F.greatest(F.floor(x * 1000 + 0.5), F.lit(0))
        return F.when(tenths % 10 == 0, (tenths / 10).cast("long").cast("string")).otherwise(F.format_string("%.1f", tenths / 10))

    tagged = F.transform(words, lambda w: F.concat(F.lit("{\\kt"), centiseconds(w["start"] - begins), F.lit("\\kf"), centiseconds(w["end"] - w["start"]), F.lit("}"), escaped(w["text"])))
    return F.array_join(tagged, " ")


def karaoke_words(raw: Column, start: Column) -> Column:
    """Array of (text, onset, fill) of a line's words: a tag sets the clock or goes on from the word before; a run without text takes
    its time too. Tags without a time leave the clock alone."""
    runs = F.regexp_extract_all(raw, F.lit(r"\{[^}]*\}(?:\\[\\{}Nh]|[^{\\]|\\[^\\{}Nh])*"), 0)
    plain = lambda t: F.replace(F.replace(F.replace(F.regexp_replace(F.replace(F.replace(t, F.lit("\\N"), F.lit("\n")), F.lit("\\h"), F.lit(" ")), r"\\([{}])", "$1"), F.lit("\\\\"), F.lit("\\")), F.lit("\r"), F.lit("")), F.lit("\x00"), F.lit(""))
    parts = F.transform(runs, lambda r: F.struct(
        F.regexp_extract(r, r"^\{[^}]*\\kt(-?[\d.]+)", 1).try_cast("double").alias("at"), F.regexp_extract(r, r"^\{[^}]*\\(?:kf|ko|K|k)(-?[\d.]+)", 1).try_cast("double").alias("fill"),
        F.btrim(plain(F.regexp_replace(r, r"^\{[^}]*\}", "")), F.lit(" \t\n\r")).alias("text"),
    ))
    word = "array<struct<text:string,onset:double,fill:double>>"
    begin = F.struct(F.lit(0.0).alias("clock"), F.array().cast(word).alias("words"))

    def step(s: Column, p: Column) -> Column:
        at = F.coalesce(p["at"] / 100, s["clock"])
        one = F.array(F.struct(p["text"].alias("text"), (start + at).alias("onset"), (p["fill"] / 100).alias("fill"))).cast(word)
        return F.struct(F.when(p["fill"].isNull(), at).otherwise(at + p["fill"] / 100).alias("clock"), F.when(p["fill"].isNotNull() & (p["text"] != ""), F.concat(s["words"], one)).otherwise(s["words"]).alias("words"))

    return F.aggregate(parts, begin, step, lambda s: s["words"])
