"""Checks of video frames: how much of a region is bright, from summed-area tables over bands of a frame's rows.

A frame is cut into bands, so that none is held whole. In a band, a running sum over both directions answers any rectangle by its four corners;
a region less its exempt rectangles is cut into rectangles that don't overlap. Counts of a frame's bands add up.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rect = tuple[int, int, int, int]


@dataclass(frozen=True)
class Layout:
    """Margins that an app's controls cover, and what is let off in the top one; (x from, x to, y from, y to) each."""

    top: int = 220
    right: int = 200
    bottom: int = 770
    left: int = 60
    rail: tuple[int, int] = (640, 1775)
    lane: int = 1188
    exempt: tuple[Rect, ...] = field(default=((60, 880, 130, 200), (55, 125, 55, 125)))
    glow: int = 15


#: Brighter counts as bright, darker as black; shares that are too much and too little; every how many pixels one is looked at.
BRIGHT, BLACK, MOST, LEAST, STEP = 80, 5, 0.05, 0.01, 8
#: Bytes of bands of one shape that are looked at together.
TOGETHER = 4 << 20
TILES = "frame string, width int, height int, y int, data binary"


def tiles(frames: DataFrame, rows: int = 256) -> DataFrame:
    """``TILES`` of frames (frame, width, height, data: four bytes a pixel): bands of so many rows. Data of another length fails the job."""
    wide, high, size = F.col("width").cast("int"), F.col("height").cast("int"), F.octet_length("data")
    data = F.when(size == wide * high * 4, F.col("data")).otherwise(F.raise_error(F.concat(F.lit("a frame of "), wide.cast("string"), F.lit(" x "), high.cast("string"), F.lit(" has "), size.cast("string"), F.lit(" bytes"))).cast("binary"))
    bands = F.sequence(F.lit(0), F.greatest(high - 1, F.lit(0)), F.lit(rows))
    cut = frames.select(F.col("frame").cast("string").alias("frame"), wide.alias("width"), high.alias("height"), data.alias("data"), F.explode(bands).alias("y"))
    return cut.select("frame", "width", "height", "y", F.substring("data", F.col("y") * F.col("width") * 4 + 1, F.lit(rows) * F.col("width") * 4).alias("data"))


def disjoint(region: Rect, exempt: list[Rect]) -> list[Rect]:
    """Rectangles that don't overlap and cover the region but for the exempt ones."""
    x0, x1, y0, y1 = region
    if x0 >= x1 or y0 >= y1:
        return []
    inside = [(max(a, x0), min(b, x1), max(c, y0), min(d, y1)) for a, b, c, d in exempt]
    inside = [r for r in inside if r[0] < r[1] and r[2] < r[3]]
    ys = sorted({y0, y1, *(y for r in inside for y in r[2:])})
    out = []
    for top, low in zip(ys[:-1], ys[1:], strict=True):
        at = x0
        for a, b in sorted((r[0], r[1]) for r in inside if r[2] <= top and r[3] >= low):
            if a > at:
                out.append((at, a, top, low))
            at = max(at, b)
        if at < x1:
            out.append((at, x1, top, low))
    return out


def regions(width: int, height: int, at: Layout, step: int) -> dict[str, tuple[Rect, list[Rect], int]]:
    """Of each check: its region, what is let off, and the step between the pixels that are looked at."""
    glow = [(0, width, 0, at.glow), (0, width, height - at.glow, height), (0, at.glow, 0, height), (width - at.glow, width, 0, height)]
    return {
        "black": ((0, width, 0, height), [], 2 * step),
        "top": ((0, width, 0, at.top), [*at.exempt, *glow], step),
        "right": ((max(width - at.right, 0), width, *at.rail), [], step),
        "bottom": ((0, width, max(height - at.bottom, 0), at.lane), [], step),
        "content": ((at.left, width - at.right, at.top, height - at.bottom), [], step),
    }


def count_marked(marked: np.ndarray, y: int, region: Rect, exempt: list[Rect], step: int) -> tuple[np.ndarray, int]:
    """(marked, all) of a region's pixels at every ``step`` from its corner on, outside the exempt ones, in each of some bands [band, row, column]
    that begin at row y."""
    n, high, wide = marked.shape
    x0, x1, y0, y1 = region
    x1, y1 = min(x1, wide), min(y1, y + high)
    first = y0 + max(0, -(-(y - y0) // step)) * step  # the region's first row in this band
    if x0 >= x1 or first >= y1:
        return np.zeros(n, np.int64), 0
    part = marked[:, first - y : y1 - y : step, x0:x1:step]
    rows, columns = part.shape[1:]
    table = np.zeros((n, rows + 1, columns + 1), np.int64)
    table[:, 1:, 1:] = part.cumsum(1, dtype=np.int64).cumsum(2)
    on_grid = lambda v, origin, most: min(max(-(-(v - origin) // step), 0), most)
    found, total = np.zeros(n, np.int64), 0
    for a, b, c, d in disjoint((x0, x1, first, y1), exempt):
        i, j = on_grid(a, x0, columns), on_grid(b, x0, columns)
        k, m = on_grid(c, first, rows), on_grid(d, first, rows)
        found += table[:, m, j] - table[:, k, j] - table[:, m, i] + table[:, k, i]
        total += (j - i) * (m - k)
    return found, total


def luminance(data: np.ndarray) -> np.ndarray:
    """Brightness of pixels [.., 4] of 8-bit colours, 0 to 255."""
    c = data.astype(float)
    return 0.299 * c[..., 0] + 0.587 * c[..., 1] + 0.114 * c[..., 2]


def frame_counts(bands: DataFrame, at: Layout = Layout(), step: int = STEP) -> DataFrame:  # noqa: B008
    """(frame, check, found, total): black pixels of the whole frame, and bright ones of four regions."""

    def counted(b: pa.RecordBatch, w: int, height: int, y: int, size: int, rows: list[int]):
        """The checks of a batch's bands of one shape and place."""
        data = b.column(4).take(pa.array(rows)).cast(pa.large_binary())
        start = np.frombuffer(data.buffers()[1], np.int64)[data.offset]
        pixels = np.frombuffer(data.buffers()[2], np.uint8, len(rows) * size, start) if size else np.zeros(0, np.uint8)
        light = luminance(pixels.reshape(len(rows), -1, w, 4)) if w and size else np.zeros((len(rows), 0, 0))
        wanted = regions(w, height, at, step)
        got = [count_marked(light < BLACK if name == "black" else light > BRIGHT, y, *r) for name, r in wanted.items()]
        frame = b.column(0).take(pa.array(np.tile(rows, len(got))))
        check = pa.array(np.repeat(list(wanted), len(rows)), pa.string())
        total = pa.array(np.repeat([g[1] for g in got], len(rows)), pa.int64())
        return pa.RecordBatch.from_arrays([frame.cast(pa.string()), check, pa.array(np.concatenate([g[0] for g in got]), pa.int64()), total], ["frame", "check", "found", "total"])

    def run(batches):
        for b in batches:
            width, height, y = (b.column(k).to_pylist() for k in (1, 2, 3))
            sizes = pc.binary_length(b.column(4)).to_pylist()
            alike: dict[tuple, list[int]] = {}
            for i, shape in enumerate(zip(width, height, y, sizes, strict=True)):
                alike.setdefault(shape, []).append(i)
            for (*shape, size), rows in alike.items():
                most = max(1, TOGETHER // max(size, 1))
                for i in range(0, len(rows), most):
                    yield counted(b, *shape, size, rows[i : i + most])

    each = bands.mapInArrow(run, "frame string, check string, found long, total long")
    return each.groupBy("frame", "check").agg(F.sum("found").alias("found"), F.sum("total").alias("total"))


def frame_checks(bands: DataFrame, at: Layout = Layout(), step: int = STEP) -> DataFrame:  # noqa: B008
    """(frame, check, level, detail, found, total, ratio) of each of five checks: a frame isn't all black, three margins are clear, the middle isn't empty."""
    counts = frame_counts(bands, at, step)
    ratio: Column = F.when(F.col("total") > 0, F.col("found") / F.col("total")).otherwise(0.0)
    much, name = ratio > MOST, F.col("check")
    level = (
        F.when(name == "black", F.when(F.col("found") == F.col("total"), "fail").otherwise("pass"))
        .when(name == "content", F.when(ratio < LEAST, "warn").otherwise("pass"))
        .when(much, F.when(name == "top", "warn").otherwise("fail")).otherwise("pass")
    )
    kind = F.when(name == "black", "black").otherwise("bright")
    detail = F.concat(F.col("found").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" "), kind, F.lit(" pixels ("), F.format_number(ratio * 100, 1), F.lit("%)"))
    return counts.select("frame", "check", level.alias("level"), detail.alias("detail"), "found", "total", ratio.alias("ratio"))
