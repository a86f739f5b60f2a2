"""Sounds as blocks of samples: where a known sound begins in a recording, and tracks put together from parts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.timeline import clip_frames, offsets
from quillon.sources.audio import TOGETHER


def best_lag(x: np.ndarray, needle: np.ndarray, core: int, h_len: int, h_sum: int) -> tuple[int, int]:
    """(value, lag) of the first largest correlation of needle with x at lags 0 to core, both taken without their means.

    h_len, h_sum: samples and their sum of the whole recording; beyond its end it is silent. The value is the correlation times h_len times the needle's
    length, a whole number: a transform finds the lags that come into question, and those are compared exactly.
    """
    x, n = x.astype(np.int64), needle.astype(np.int64)
    m, n_sum = len(n), int(n.sum())
    size = 1 << max(len(x) + m - 1, 1).bit_length()
    spectrum = np.fft.rfft(x.astype(float), size) * np.conj(np.fft.rfft(n.astype(float), size))
    rough = np.fft.irfft(spectrum, size)[:core]
    lag = np.arange(core)
    k = np.minimum(m, len(x) - lag)  # samples that overlap
    heads = np.concatenate(([0], np.cumsum(n)))[k]
    upto = np.concatenate(([0], np.cumsum(x)))
    parts = upto[lag + k] - upto[lag]
    strength = float(np.sqrt((x.astype(float) ** 2).sum() * (n.astype(float) ** 2).sum()))
    value = rough - h_sum / h_len * heads - n_sum / m * parts + k * (h_sum / h_len) * (n_sum / m)
    near = np.flatnonzero(value >= value.max() - 1e-10 * (strength + np.abs(value).max()) - 1e-6)
    whole = strength < 1e11  # then the transform is off by far less than a half

    def exact(i: int) -> int:
        product = round(rough[i]) if whole else int(np.dot(x[i : i + k[i]], n[: k[i]]))
        return h_len * m * product - m * h_sum * int(heads[i]) - h_len * n_sum * int(parts[i]) + int(k[i]) * h_sum * n_sum

    return max(((exact(i), -i) for i in near.tolist()), key=lambda p: p)


def onsets(blocks: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle, path, sample, seconds): where each needle (needle, path, pcm) begins in the recording of its path, by the peak of their
    cross-correlation, the first of equals. blocks: of ``wav_blocks`` with an overlap of the longest needle less one sample at
    least. A needle longer than its recording, without samples or beyond the overlap fails the job."""
    good = blocks.where(F.col("error").isNull())
    whole = good.groupBy("path").agg(F.max("total").alias("h_len"), F.sum("core_sum").alias("h_sum"))
    known = needles.select("needle", "path", F.col("pcm").cast("array<short>").alias("n")).join(whole, "path")
    m = F.size("n")
    fault = F.when(m == 0, F.lit("a needle without samples")).when(m > F.col("h_len"), F.concat(F.lit("the needle is longer than the recording: "), "path"))
    known = known.withColumn("n", F.when(fault.isNotNull(), F.raise_error(fault).cast("array<short>")).otherwise(F.col("n")))
    tail = F.when((F.size("pcm") < F.least(F.col("core") + F.size("n") - 1, F.col("total") - F.col("at"))), F.raise_error(F.lit("blocks overlap too little for this needle")).cast("array<short>")).otherwise(F.col("pcm"))
    met = good.select("path", "sample_rate", "at", "core", "total", "pcm").join(known, "path").select("needle", "path", "sample_rate", "at", "core", "h_len", "h_sum", "n", tail.alias("pcm"))
    kind = met.schema["needle"].dataType.simpleString()

    def run(batches):
        for b in batches:
            get = {c: b[c].to_pylist() for c in ("at", "core", "h_len", "h_sum")}
            pcm, n = ((b[c].offsets.to_numpy(), b[c].values.to_numpy()) for c in ("pcm", "n"))
            cut = lambda x, i: x[1][x[0][i] : x[0][i + 1]]
            found = [best_lag(cut(pcm, i), cut(n, i), get["core"][i], get["h_len"][i], get["h_sum"][i]) for i in range(b.num_rows)]
            values = pa.array([str(v) for v, _ in found], pa.string()), pa.array([at - lag for at, (_, lag) in zip(get["at"], found, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([b["needle"], b["path"], b["sample_rate"], *values], ["needle", "path", "sample_rate", "value", "sample"])

    found = met.where("core > 0").mapInArrow(run, f"needle {kind}, path string, sample_rate int, value string, sample long")
    best = found.groupBy("needle", "path").agg(F.max_by(F.struct("sample", "sample_rate"), F.struct(F.col("value").cast("decimal(38,0)"), -F.col("sample"))).alias("b"))
    return best.select("needle", "path", "b.sample", (F.col("b.sample") / F.col("b.sample_rate")).alias("seconds"))


def clip_samples(seconds: Column, sample_rate: int, fps: int = 30) -> Column:
    """Samples of a part's clip, which is whole frames long."""
    return F.floor(clip_frames(seconds, fps) / fps * sample_rate + 0.5).cast("long")


def filled(size: np.ndarray, held: pa.Array) -> pa.Array:
    """Segments of so many samples with the pieces held (o: place, p: samples), silent between them."""
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    out = np.zeros(ends[-1], np.int16)
    pieces = held.flatten()
    rows = np.repeat(np.arange(len(held)), np.asarray(pc.fill_null(pc.list_value_length(held), 0)))
    if len(pieces):
        samples = pieces.field("p")
        start, low, values = ends[rows] + pieces.field("o").to_numpy(), samples.offsets.to_numpy(), samples.values.to_numpy()
        for at, i, j in zip(start.tolist(), low[:-1].tolist(), low[1:].tolist(), strict=True):
            out[at : at + j - i] = values[i:j]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out))


def track(parts: DataFrame, blocks: DataFrame, sample_rate: int, segment: int = 1 << 16, fps: int = 30) -> DataFrame:
    """(track, sample_rate, total, at, pcm): the parts (track, ordinal, path, seconds) one after another, each drawn out with silence to its clip's
    length, in segments of equal length but for the last. A part that is longer than its clip, has another sample rate or no readable sound fails the job."""
    timed = offsets(parts.withColumn("target", clip_samples(F.col("seconds"), sample_rate, fps)), "track", "ordinal", "target")
    sounds = blocks.groupBy("path").agg(F.max("error").alias("error"), F.max("sample_rate").alias("rate"), F.max("total").alias("samples"))
    checked = timed.join(sounds, "path", "left")
    fault = (
        F.when(F.col("samples").isNull(), F.concat(F.lit("no sound of "), "path", F.lit(": "), F.coalesce("error", F.lit("missing"))))
        .when(F.col("rate") != sample_rate, F.concat(F.lit("another sample rate: "), "path"))
        .when(F.col("samples") > F.col("target"), F.concat(F.lit("part "), "ordinal", F.lit(" of "), "samples", F.lit(" samples exceeds its clip of "), "target"))
    )
    checked = checked.withColumn("target", F.when(fault.isNotNull(), F.raise_error(fault).cast("long")).otherwise(F.col("target")))  # every segment waits for the track's total
    first, last = F.floor(F.col("from") / segment), F.floor((F.col("from") + F.size("pcm") - 1) / segment)
    placed = checked.select("track", "path", "start").join(blocks.where("core > 0").select("path", "at", F.slice("pcm", F.lit(1), F.col("core")).alias("pcm")), "path")
    placed = placed.select("track", (F.col("start") + F.col("at")).alias("from"), "pcm").withColumn("s", F.explode(F.sequence(first, last)))
    low, high = F.greatest(F.col("from"), F.col("s") * segment), F.least(F.col("from") + F.size("pcm"), (F.col("s") + 1) * segment)
    pieces = placed.select("track", "s", (low - F.col("s") * segment).alias("o"), F.slice("pcm", (low - F.col("from") + 1).cast("int"), (high - low).cast("int")).alias("p"))
    held = pieces.groupBy("track", "s").agg(F.collect_list(F.struct("o", "p")).alias("held"))  # a segment's samples at most
    totals = checked.groupBy("track").agg(F.sum("target").alias("total"))
    spans = totals.select("track", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / segment))).alias("s"))
    size = F.least(F.lit(segment).cast("long"), F.col("total") - F.col("s") * segment)

    def fill(batches):
        for b in batches:
            ends, i = np.cumsum(b.column(3).to_numpy(zero_copy_only=False)), 0
            while i < b.num_rows:  # some samples at a time, a segment at least
                j = max(i + 1, int(np.searchsorted(ends, TOGETHER + (ends[i - 1] if i else 0), "right")))
                part = b.slice(i, j - i)
                size = part.column(3).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), filled(size, part.column(4))], ["track", "total", "at", "pcm"])
                i = j

    kind = parts.schema["track"].dataType.simpleString()
    rows = spans.join(held, ["track", "s"], "left").select("track", "total", (F.col("s") * segment).alias("at"), size.alias("size"), "held")
    return rows.mapInArrow(fill, f"track {kind}, total long, at long, pcm array<short>").select("track", F.lit(sample_rate).alias("sample_rate"), "total", "at", "pcm")
