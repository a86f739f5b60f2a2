"""Subtitles from word timings: words into cues that fit a line, cues laid out on a video's time.

Cues follow one another within a video, so a video's words are one task's; the helpers below work on its lists.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.media import ADVANCE, ADVANCES
from quillon.operators.timeline import clip_frames

FPS = 30
#: Words and width of a cue, its size; times in seconds.
MOST_WORDS, WIDTH, SIZE = 6, 720, 60
SOFT_WIDTH = round(WIDTH * 0.85)
BEFORE_MARK = re.compile(r"\s+([,.;:!?])")
LEAST, HOLD, GAP, LEAD, CHAIN, FILL = 0.8, 0.5, 0.5, 2 / FPS, 2 / FPS, 0.6


class _Advances(dict):
    def __missing__(self, c: str) -> int:
        return ADVANCE


_ADVANCES = _Advances(ADVANCES)


def joined(words: list[str]) -> str:
    return BEFORE_MARK.sub(r"\1", " ".join(words))


def width(text: str) -> float:
    return sum(map(_ADVANCES.__getitem__, text)) / 1000 * SIZE


def fits(words: list[str]) -> bool:
    return len(words) <= MOST_WORDS and width(joined(words)) <= WIDTH


def group(words: list[str]) -> list[list[int]]:
    """Indices of the words of each cue: it ends with a sentence, where the next word would not fit, or where it would be wide and more
    words follow; a last cue of one word goes back to the one before, if that fits."""
    out: list[list[int]] = [[]]
    for i, w in enumerate(words):
        own = [words[j] for j in out[-1]]
        wide = width(joined([*own, w])) if len(own) < MOST_WORDS else float("inf")
        if own and (wide > WIDTH or (wide > SOFT_WIDTH and i + 1 < len(words))):
            out.append([])
        out[-1].append(i)
        if re.search(r"[.!?:;]$", w):
            out.append([])
    out = [g for g in out if g]
    if len(out) > 1 and len(out[-1]) == 1 and fits([words[j] for j in out[-2] + out[-1]]):
        out[-2:] = [out[-2] + out[-1]]
    return out


def shown_from(cue: dict) -> float:
    return max(cue["from"] - LEAD, 0.0)


def can_merge(a: dict, b: dict) -> bool:
    """Whether two cues of one scene fit a line together; one with words and one without stay apart."""
    if a["scene"] != b["scene"] or bool(a["words"]) != bool(b["words"]):
        return False
    return fits(a["words"] + b["words"]) if a["words"] else width(f"{a['text']} {b['text']}") <= WIDTH


def borrow(cues: list[dict]) -> list[dict]:
    """Cues too short to be read are merged with the next of their scene where both fit. A merged cue begins where its first did, so what
    could not merge before it still can't, and one pass comes to rest."""
    out: list[dict] = []
    for c in cues:
        if out and shown_from(c) - CHAIN - shown_from(out[-1]) < LEAST and can_merge(out[-1], c):
            words = out[-1]["words"] + c["words"]
            out[-1] = {**out[-1], "words": words, "text": joined(words) if words else f"{out[-1]['text']} {c['text']}", "to": c["to"], "clip_end": c["clip_end"]}
        else:
            out.append(c)
    return out


def lay_out(cues: list[dict]) -> list[tuple[float, float]]:
    """(start, end) of each cue: shown a little before and after its speech, joined to the next over short pauses, never beyond its clip
    or into the next, and gaps under FILL closed at last."""
    starts, out = [shown_from(c) for c in cues], []
    for i, c in enumerate(cues):
        start = max(starts[i], out[-1][1] + CHAIN) if out else starts[i]
        ceiling = starts[i + 1] - CHAIN if i + 1 < len(cues) else float("inf")
        end = c["to"] + HOLD
        if i + 1 < len(cues) and starts[i + 1] - end < GAP:
            end = ceiling
        end = max(min(max(min(end, c["clip_end"]), start + LEAST), ceiling), start + 1 / FPS)
        out.append((start, end))
    for i in range(len(out) - 1):
        if 0 < out[i + 1][0] - out[i][1] < FILL:
            out[i] = (out[i][0], out[i + 1][0] - CHAIN)
    return out


def video_cues(words: list[tuple]) -> list[tuple]:
    """(cue, scene, start, end, text) of one video's words (scene, segment, i, text, start, end, clip_end), which come in this order, in the order of their speech."""
    raw = []
    for (scene, _), rows in groupby(words, key=lambda w: w[:2]):
        own = list(rows)
        texts, clip_end = [w[3] for w in own], own[0][6]
        if own[0][2] < 0:  # a text without times of its words
            raw.append({"scene": scene, "words": [], "text": texts[0], "from": own[0][4], "to": own[0][5], "clip_end": clip_end})
            continue
        for g in group(texts):
            said = [texts[j] for j in g]
            raw.append({"scene": scene, "words": said, "text": joined(said), "from": own[g[0]][4], "to": own[g[-1]][5], "clip_end": clip_end})
    cues = borrow(sorted(raw, key=lambda c: c["from"]))
    return [(i, c["scene"], a, b, c["text"]) for i, (c, (a, b)) in enumerate(zip(cues, lay_out(cues), strict=True))]


def each_group(words: DataFrame, key: str, columns: list[str], one: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """(key, schema): the rows that ``one`` makes of each group's rows of these columns, sorted by them; many groups go to a task's function at once."""

    def run(batches):
        for b in batches:
            groups = b.column(1)
            inner = groups.flatten()
            rows = list(zip(*(inner.field(k).to_pylist() for k in range(len(columns))), strict=True))
            ends = np.cumsum([0, *pc.list_value_length(groups).to_pylist()]).tolist()
            made = [one(rows[i:j]) for i, j in pairwise(ends)]
            keys = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), [len(m) for m in made])))
            flat = [x for m in made for x in m]
            columns_ = [pa.array([x[k] for x in flat], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([keys, *columns_], [key, *names])

    fields = [x.strip().split() for x in schema.split(",")]
    names, kinds = [f[0] for f in fields], [{"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[f[1]] for f in fields]
    grouped = words.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"))
    return grouped.mapInArrow(run, f"{key} {words.schema[key].dataType.simpleString()}, {schema}")


def build(words: DataFrame, durations: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """(content, cue, scene, start, end, text): words (content, scene, segment, i, text, start, end; times within the scene) on the video's
    time, whose scenes (content, scene, duration) follow one another in whole frames. Words stay within their scene's speech.
    segments (content, scene, segment, text, start, end): those that have no words keep their text, as a cue without words; blank ones go."""
    if segments is not None:
        keys = ["content", "scene", "segment"]
        bare = segments.join(words.select(*keys).distinct(), keys, "left_anti").withColumn("text", F.btrim("text", F.lit(" \t\n\r\x0b\f"))).where("text <> ''")
        bare = bare.select(*keys, F.lit(-1).alias("i"), "text", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("start", "end")])
        words = words.select(*bare.columns).unionByName(bare)
    before = Window.partitionBy("content").orderBy("scene").rowsBetween(Window.unboundedPreceding, -1)
    clip = clip_frames(F.col("duration"), FPS)
    placed = durations.withColumn("_f", clip).select("content", "scene", "duration", "_f", (F.coalesce(F.sum("_f").over(before), F.lit(0)) / FPS).alias("offset"))
    inside = lambda x, low: F.least(F.greatest(x, low), F.col("offset") + F.col("duration"))
    w = words.join(placed, ["content", "scene"]).withColumn("start", inside(F.col("offset") + F.col("start"), F.col("offset")))
    w = w.withColumn("end", inside(F.col("offset") + F.col("end"), F.col("start"))).withColumn("clip_end", F.col("offset") + F.col("_f") / FPS)
    return each_group(w, "content", ["scene", "segment", "i", "text", "start", "end", "clip_end"], video_cues, "cue long, scene long, start double, end double, text string")


def phrases(words: DataFrame, least: int = 3, most: int = 7) -> DataFrame:
    """(scene, phrase, start, end, text): words (scene, i, text, start, end) into phrases that end with a sentence, at a comma from ``least``
    words on, or at ``most``; one that begins before the last kept one ends, or whose text came before, is left out."""

    def one(own: list[tuple]) -> list[tuple]:
        found, held, seen, kept = [], [], set(), []
        for r in own:
            held.append(r)
            if re.search("[.!?:;]$", r[1]) or len(held) >= most or (r[1].endswith(",") and len(held) >= least):
                found.append(held)
                held = []
        for g in found + [held] * bool(held):
            start, text = g[0][2], joined([w[1] for w in g])
            end = max(g[-1][3], start + 0.5)
            if (kept and round(start, 3) < kept[-1][2]) or text.lower().strip() in seen:
                continue
            seen.add(text.lower().strip())
            kept.append((len(kept), round(start, 3), round(end, 3), text))
        return kept

    return each_group(words, "scene", ["i", "text", "start", "end"], one, "phrase long, start double, end double, text string")
