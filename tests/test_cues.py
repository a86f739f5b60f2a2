"""Cues and phrases against plain loops over random words, and the files that they are written to."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from quillon.operators import cues
from quillon.sources import subtitles

FPS, LEAST, HOLD, GAP, LEAD, CHAIN, FILL = 30, 0.8, 0.5, 0.5, 2 / 30, 2 / 30, 0.6


def grouped(words):
    """Words into lines, one word at a time."""
    lines, held = [], []
    for i, w in enumerate(words):
        if held:
            wide = cues.width(cues.joined([x[0] for x in held] + [w[0]]))
            if len(held) >= 6 or wide > 720 or (wide > 612 and len(words) - (i + 1) >= 1):
                lines.append(held)
                held = []
        held.append(w)
        if re.search(r"[.!?:;]$", w[0]):
            lines.append(held)
            held = []
    lines += [held] if held else []
    if len(lines) > 1 and len(lines[-1]) == 1:
        both = lines[-2] + lines[-1]
        if len(both) <= 6 and cues.width(cues.joined([x[0] for x in both])) <= 720:
            lines[-2:] = [both]
    return lines


def merged(raw):
    """Neighbours merged one pair at a time, from the front again after each."""
    raw, changed = list(raw), True
    while changed:
        changed = False
        for i in range(len(raw) - 1):
            a, b = raw[i], raw[i + 1]
            if max(b["from"] - LEAD, 0) - CHAIN - max(a["from"] - LEAD, 0) >= LEAST or a["scene"] != b["scene"] or bool(a["words"]) != bool(b["words"]) or len(a["words"]) + len(b["words"]) > 6:
                continue
            words = a["words"] + b["words"]
            text = cues.joined(words) if words else f"{a['text']} {b['text']}"
            if cues.width(text) > 720:
                continue
            raw[i : i + 2] = [{**a, "words": words, "text": text, "to": b["to"], "clip_end": b["clip_end"]}]
            changed = True
            break
    return raw


def laid(raw):
    starts, out = [max(c["from"] - LEAD, 0) for c in raw], []
    for i, c in enumerate(raw):
        start = max(starts[i], out[-1][1] + CHAIN) if out else starts[i]
        end, more = c["to"] + HOLD, i + 1 < len(raw)
        if more and starts[i + 1] - end < GAP:
            end = starts[i + 1] - CHAIN
        end = min(end, c["clip_end"])
        ceiling = starts[i + 1] - CHAIN if more else float("inf")
        out.append([start, max(min(max(end, start + LEAST), ceiling), start + 1 / FPS)])
    for a, b in zip(out, out[1:], strict=False):
        if 0 < b[0] - a[1] < FILL:
            a[1] = b[0] - CHAIN
    return out


def test_cues_as_plain_loops_make_them(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgiklmW") for _ in range(rng.randint(1, 11))) + rng.choice(["", "", "", ",", ".", "?"])
    words, durations, bare, want = [], [], [], []
    for video in range(12):
        raw, offset = [], 0.0
        for scene in range(rng.randint(1, 4)):
            at, length = 0.0, rng.uniform(1, 14)
            for segment in range(rng.randint(1, 3)):
                if rng.random() < 0.3:  # a text without times of its words
                    text, a, b = rng.choice(["plain text here", "two words", "  "]), at, at + rng.uniform(0.1, 2)
                    bare.append((video, scene, segment, text, a if a else None, b))
                    if text.strip():
                        low = min(max(offset + a, offset), offset + length)
                        raw.append({"scene": scene, "words": [], "text": text, "from": low, "to": min(max(offset + b, low), offset + length), "scene_end": None})
                    at = b
                    continue
                own = []
                for i in range(rng.randint(1, 15)):
                    a = at + rng.choice([0.0, 0.05, 0.4, 2.0])
                    at = a + rng.uniform(0.05, 0.6)
                    text = word()
                    words.append((video, scene, segment, i, text, a, at))
                    low = min(max(offset + a, offset), offset + length)
                    own.append((text, low, min(max(offset + at, low), offset + length)))
                bare.append((video, scene, segment, "said by words", 0.0, 1.0))  # words go before the text
                raw += [{"scene": scene, "words": [x[0] for x in g], "text": cues.joined([x[0] for x in g]), "from": g[0][1], "to": g[-1][2]} for g in grouped(own)]
            import math

            frames = max(1, math.ceil((length + 0.5) * FPS - 1e-6))
            for c in raw:
                if c["scene"] == scene:
                    c["clip_end"] = offset + frames / FPS
            durations.append((video, scene, length))
            offset += frames / FPS
        raw = merged(sorted(raw, key=lambda c: c["from"]))
        want += [(video, i, c["scene"], round(a, 6), round(b, 6), c["text"]) for i, (c, (a, b)) in enumerate(zip(raw, laid(raw), strict=True))]
    got = cues.build(
        spark.createDataFrame(words, "content long, scene long, segment long, i long, text string, start double, end double"), spark.createDataFrame(durations, "content long, scene long, duration double"),
        spark.createDataFrame(bare, "content long, scene long, segment long, text string, start double, end double"),
    )
    assert sorted((r.content, r.cue, r.scene, round(r.start, 6), round(r.end, 6), r.text) for r in got.collect()) == sorted(want)


def test_phrases_as_a_plain_loop_makes_them(spark):
    rng = random.Random(9)
    words, want = [], []
    for scene in range(25):
        own, at = [], 0.0
        for i in range(rng.randint(1, 40)):
            at += rng.choice([0.0, 0.2, 0.5])
            own.append((scene, i, rng.choice("ab") + rng.choice(["", "", ",", "."]), at, at + rng.choice([0.1, 0.9])))
        words += own
        groups, held = [], []
        for w in own:
            held.append(w)
            if w[2][-1] in ".!?:;" or len(held) >= 7 or (w[2].endswith(",") and len(held) >= 3):
                groups.append(held)
                held = []
        groups += [held] if held else []
        kept, seen = [], set()
        for g in groups:
            start, end, text = round(g[0][3], 3), round(max(g[-1][4], g[0][3] + 0.5), 3), cues.joined([w[2] for w in g])
            if (kept and start < kept[-1][3]) or text.lower() in seen:
                continue
            seen.add(text.lower())
            kept.append((scene, len(kept), start, end, text))
        want += kept
    got = cues.phrases(spark.createDataFrame(words, "scene long, i long, text string, start double, end double"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_subtitle_files_are_read_back(spark):
    rows = [("v", 0.0, 1.5, "a {b}\nc", []), ("v", 2.0, 3.0, None, [("hi", 2.0, 2.5), ("you", 2.6, 3.0)]), ("w", 61.005, 3600.0, "late", None)]
    made = subtitles.subtitle_files(spark.createDataFrame(rows, "k string, start double, end double, text string, words array<struct<text: string, start: double, end: double>>"), "k")
    text = {r.k: r.content for r in made.collect()}
    assert text["v"].startswith("[Script Info]\nScriptType: v4.00+\nPlayResX: 1080\nPlayResY: 1920\n") and text["v"].endswith("Dialogue: 0,0:00:02.00,0:00:03.00,Default,,0,0,0,,{\\kt0\\kf50}hi {\\kt60\\kf40}you\n")
    assert "Dialogue: 0,0:00:00.00,0:00:01.50,Default,,0,0,0,,a \\{b\\}\\Nc\n" in text["v"] and "0,0:01:01.01,1:00:00.00," in text["w"]
    lines = made.select("k", F.explode(F.split("content", "\n")).alias("line"))
    styles = subtitles.subtitle_styles(lines, ["k"], "line").collect()
    assert {(r.k, r.style["Fontname"], r.style["Fontsize"], r.style["MarginV"]) for r in styles} == {("v", "Helvetica Neue", "60", "570"), ("w", "Helvetica Neue", "60", "570")}
    assert {(r.k, r.start, r.end) for r in subtitles.parse_subtitles(lines, ["k"], "line").collect()} == {("v", 0.0, 1.5), ("v", 2.0, 3.0), ("w", 61.01, 3600.0)}


def test_groups_of_words_go_to_a_task_together(spark):
    rows = [(k, i, f"w{i}", float(i), i + 0.5) for k in range(300) for i in reversed(range(k % 4))]
    words = spark.createDataFrame(rows, "scene int, i long, text string, start double, end double").coalesce(1)
    seen = cues.each_group(words, "scene", ["i", "text"], lambda own: [(len(own), 0.0, ",".join(t for _, t in own))] * (len(own) > 1), "n long, at double, text string")
    assert sorted((r.scene, r.n, r.text) for r in seen.collect()) == [(k, k % 4, ",".join(f"w{i}" for i in range(k % 4))) for k in range(300) if k % 4 > 1]
    for made in (cues.phrases(words), seen):
        assert "PerGroup" not in (plan := made._jdf.queryExecution().executedPlan().toString()) and "FlatMapGroups" not in plan and "MapInArrow" in plan
