"""Sounds and frames: files read and refused, blocks of any size, onsets by direct correlation, tracks to the sample, pixels counted one by one."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import audio, frames
from quillon.sources.audio import find_samples, quantized, wav_blocks, wav_bytes, wav_files

FILES = "path string, content binary"


def wav(samples, rate=8000, channels=1, bits=16, kind=1, before=b"", claim=None) -> bytes:
    data = np.asarray(samples, "<i2").tobytes()
    fmt = struct.pack("<HHIIHH", kind, channels, rate, rate * 2, 2, bits)
    body = b"WAVE" + before + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", claim if claim is not None else len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_files_are_read_in_blocks_or_refused(spark, tmp_path):
    rng = np.random.default_rng(1)
    sound = rng.integers(-32768, 32768, 1000)
    odd_chunk = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    good = {"a": wav(sound), "odd": wav(sound, before=odd_chunk), "none": wav([])}
    bad = {
        "stereo": (wav(sound, channels=2), "expected mono, got 2 channels"), "bits": (wav(sound, bits=8), "unsupported bit depth 8"), "kind": (wav(sound, kind=3), "unsupported format 3"), "cut": (wav(sound, claim=2400), "truncated: 2000 of 2400 data bytes"),
        "half": (wav(sound, claim=1999), "odd number of data bytes"), "text": (b"x" * 60, "not a RIFF/WAVE file"), "short": (b"RIFF", "not a RIFF/WAVE file"), "no data": (wav(sound).replace(b"data", b"dat_"), "missing fmt or data chunk"), "null": (None, "no content"),
    }
    for name, data in good.items():
        (tmp_path / f"{name}.wav").write_bytes(data)
    rows = [(k, v) for k, (v, _) in bad.items()]
    assert {r.path: r.error for r in wav_blocks(spark.createDataFrame(rows, FILES)).collect()} == {k: e for k, (_, e) in bad.items()}
    for size, overlap in ((64, 0), (333, 50), (5000, 7)):
        got = wav_blocks(wav_files(spark, str(tmp_path)), size, overlap).collect()
        for name in ("a", "odd"):
            own = sorted((r for r in got if r.path.endswith(f"/{name}.wav")), key=lambda r: r.at)
            assert np.concatenate([r.pcm[: r.core] for r in own]).tolist() == sound.tolist()
            assert all(r.pcm == sound[r.at : r.at + size + overlap].tolist() and len(r.pcm) <= size + overlap and r.core_sum == sum(r.pcm[: r.core]) for r in own)
        assert [(r.total, r.core, r.pcm) for r in got if r.path.endswith("/none.wav")] == [(0, 0, [])]


def test_written_files_read_back(spark):
    made = spark.createDataFrame([([0.0, 1.0, -1.0, 2.0, -2.0, 0.5, 1e-5],)], "x array<double>").select(quantized(F.col("x")).alias("pcm"))
    row = made.select("pcm", wav_bytes(F.col("pcm"), F.lit(44100)).alias("content")).first()
    assert row.pcm == [0, 32767, -32767, 32767, -32768, 16384, 0]
    assert bytes(row.content) == wav(row.pcm, 44100) and find_samples(bytes(row.content)) == (44100, 44, 7)


def direct(h, n):
    """The first lag of the largest correlation without means, in fractions' numerators."""
    h, n = [int(x) for x in h], [int(x) for x in n]
    a, b = len(h), len(n)
    hs, ns = sum(h), sum(n)
    value = [sum((a * h[t + i] - hs) * (b * n[i] - ns) for i in range(min(b, a - t))) for t in range(a)]
    return value.index(max(value))


def test_onsets_are_those_of_direct_correlation(spark):
    rng = np.random.default_rng(2)
    loud = rng.integers(-3000, 3000, 400)
    beat = np.tile(rng.integers(-500, 500, 20), 20)  # the same again and again: the first counts
    hidden = np.concatenate([rng.integers(-50, 50, 150), loud[100:160], rng.integers(-50, 50, 90)])
    cases = {"loud": (loud, loud[120:180]), "beat": (beat, beat[40:80]), "hidden": (hidden, loud[100:160]), "silent": (np.zeros(100, int), np.array([1, 2, 3])), "flat needle": (loud[:80], np.array([7, 7, 7])), "whole": (loud, loud), "end": (loud, loud[390:]), "one": (loud[:30], np.array([5]))}
    rows = [(k, wav(h)) for k, (h, _) in cases.items()]
    needles = spark.createDataFrame([(k, k, [int(x) for x in n]) for k, (_, n) in cases.items()], "needle string, path string, pcm array<int>")
    want = {k: direct(h, n) for k, (h, n) in cases.items()}
    for size in (17, 128, 1 << 16):
        blocks = wav_blocks(spark.createDataFrame(rows, FILES), size, 399)
        got = {r.needle: (r["sample"], r.seconds) for r in audio.onsets(blocks, needles).collect()}
        assert got == {k: (t, t / 8000) for k, t in want.items()}
    with pytest.raises(Exception, match="overlap too little"):
        audio.onsets(wav_blocks(spark.createDataFrame(rows[:1], FILES), 17, 5), needles).collect()
    with pytest.raises(Exception, match="longer than the recording"):
        audio.onsets(wav_blocks(spark.createDataFrame([("p", wav([1, 2]))], FILES)), spark.createDataFrame([("n", "p", [1, 2, 3])], "needle string, path string, pcm array<int>")).collect()


def test_tracks_are_exact_to_the_sample(spark):
    rng = np.random.default_rng(3)
    sounds = {f"s{i}": rng.integers(-1000, 1000, n) for i, n in enumerate((700, 0, 5000, 33))}
    blocks = wav_blocks(spark.createDataFrame([(k, wav(v)) for k, v in sounds.items()], FILES), 256)
    parts = [("t", 2, "s2", 0.7), ("t", 0, "s0", 0.1), ("t", 1, "s1", 0.0), ("u", 0, "s3", 0.02), ("t", 3, "s0", 2.0)]
    schema = "track string, ordinal int, path string, seconds double"

    def frames_of(s):
        return max(1, int(np.ceil((s + 0.5) * 30 - 1e-6)))

    want = {}
    for t, _, p, s in sorted(parts):
        n = int(np.floor(frames_of(s) / 30 * 8000 + 0.5))
        want[t] = np.concatenate([want.get(t, np.zeros(0, int)), sounds[p], np.zeros(n - len(sounds[p]), int)])
    for segment in (100, 4096, 1 << 20):
        got: dict = {}
        for r in sorted(audio.track(spark.createDataFrame(parts, schema), blocks, 8000, segment).collect(), key=lambda r: (r.track, r.at)):
            assert r.at == len(got.get(r.track, [])) and r.total == len(want[r.track]) and len(r.pcm) == min(segment, r.total - r.at)
            got[r.track] = got.get(r.track, []) + r.pcm
        assert {k: v for k, v in got.items()} == {k: v.tolist() for k, v in want.items()}
    for wrong, match in ((("v", 0, "s2", 0.01), "exceeds its clip"), (("v", 0, "nowhere", 1.0), "no sound")):
        with pytest.raises(Exception, match=match):
            audio.track(spark.createDataFrame([wrong], schema), blocks, 8000).collect()
    with pytest.raises(Exception, match="another sample rate"):
        audio.track(spark.createDataFrame(parts[3:4], schema), blocks, 44100).collect()


def by_pixel(data, w, h, at, step):
    """The reference rule, pixel by pixel."""
    px = np.frombuffer(data, np.uint8).reshape(h, w, 4).tolist()
    light = lambda x, y: 0.299 * px[y][x][0] + 0.587 * px[y][x][1] + 0.114 * px[y][x][2]
    glow = [(0, w, 0, at.glow), (0, w, h - at.glow, h), (0, at.glow, 0, h), (w - at.glow, w, 0, h)]

    def count(x0, x1, y0, y1, exempt=()):
        found = total = 0
        for y in range(y0, min(y1, h), step):
            for x in range(x0, min(x1, w), step):
                if not any(a <= x < b and c <= y < d for a, b, c, d in exempt):
                    total += 1
                    found += light(x, y) > 80
        return found, total

    coarse = [light(x, y) < 5 for y in range(0, h, 2 * step) for x in range(0, w, 2 * step)]
    return {
        "black": (sum(coarse), len(coarse)), "top": count(0, w, 0, at.top, [*at.exempt, *glow]), "right": count(w - at.right, w, *at.rail), "bottom": count(0, w, h - at.bottom, at.lane), "content": count(at.left, w - at.right, at.top, h - at.bottom),
    }


def test_frames_are_counted_as_by_pixel(spark):
    rng = np.random.default_rng(4)
    at = frames.Layout(top=22, right=20, bottom=37, left=6, rail=(30, 80), lane=71, exempt=((6, 40, 13, 20), (5, 12, 5, 15), (35, 60, 10, 16)), glow=2)
    made = {
        "noise": rng.integers(0, 256, 70 * 100 * 4, dtype=np.uint8), "dim": rng.integers(0, 90, 70 * 100 * 4, dtype=np.uint8), "black": np.zeros(70 * 100 * 4, np.uint8), "white": np.full(70 * 100 * 4, 255, np.uint8),
    }
    df = spark.createDataFrame([(k, 70, 100, bytearray(v.tobytes())) for k, v in made.items()], "frame string, width int, height int, data binary")
    for step in (1, 3, 8):
        want = {(k, c): v for k, d in made.items() for c, v in by_pixel(d.tobytes(), 70, 100, at, step).items()}
        for rows in (1, 13, 256):
            got = {(r.frame, r.check): (r.found, r.total) for r in frames.frame_counts(frames.tiles(df, rows), at, step).collect()}
            assert got == want, (step, rows)
    level = {(r.frame, r.check): (r.level, r.detail) for r in frames.frame_checks(frames.tiles(df), at, 1).collect()}
    assert level["black", "black"][0] == "fail" and level["black", "content"][0] == "warn" and level["white", "top"][0] == "warn" and level["white", "right"][0] == level["white", "bottom"][0] == "fail" and level["white", "content"][0] == "pass"
    assert level["white", "right"][1] == "1000/1000 bright pixels (100.0%)"
    with pytest.raises(Exception, match="has 3 bytes"):
        frames.tiles(spark.createDataFrame([("x", 1, 1, bytearray(3))], df.schema)).collect()


def test_bands_of_one_shape_are_counted_together(spark, monkeypatch):
    calls, one = [], frames.count_marked
    monkeypatch.setattr(frames, "count_marked", lambda *x: calls.append(x[0].shape) or one(*x))
    at = frames.Layout(top=3, right=2, bottom=4, left=1, rail=(1, 6), lane=6, exempt=(), glow=0)
    rng = np.random.default_rng(3)
    marked = rng.random((50, 8, 6)) < 0.5
    for r in frames.regions(6, 8, at, 1).values():
        found, total = frames.count_marked(marked, 0, *r)
        want = [frames.count_marked(m[None], 0, *r) for m in marked]
        assert found.tolist() == [int(f[0]) for f, _ in want] and all(t == total for _, t in want)
    assert calls[0] == (50, 8, 6)


def test_segments_and_blocks_are_made_many_at_a_time(spark):
    import pyarrow as pa

    held = pa.array([[{"o": 5, "p": [1, 2]}, {"o": 0, "p": [3]}], None, [], [{"o": 1, "p": [-4, 5]}]], pa.list_(pa.struct([("o", pa.int64()), ("p", pa.list_(pa.int16()))])))
    want = [[3, 0, 0, 0, 0, 1, 2, 0], [0, 0], [], [0, -4, 5]]
    assert audio.filled(np.array([8, 2, 0, 3]), held).to_pylist() == want
    assert audio.filled(np.array([2, 0, 3]), held.slice(1)).to_pylist() == want[1:]
    rows = [(f"f{i}", bytearray(wav(range(i)))) for i in range(40)] + [("bad", bytearray(b"x")), ("none", None)]
    df = spark.createDataFrame(rows, FILES).coalesce(1)
    batches = wav_blocks(df, 7, 2).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in bs), "n long").collect()
    assert len(batches) == 1 and batches[0].n > 40
    back = {r.path: r for r in wav_blocks(df.where("path in ('bad', 'none')"), 7, 2).collect()}
    assert back["bad"].pcm is None and back["none"].error == "no content"
    made = spark.createDataFrame([(1, [1, -2]), (2, []), (3, None)], "id long, pcm array<short>").select("id", wav_bytes(F.col("pcm"), F.lit(8000)).alias("c"))
    assert {r.id: r.c and bytes(r.c) for r in made.collect()} == {1: wav([1, -2]), 2: wav([]), 3: None}


def test_onsets_of_many_blocks_at_once(spark):
    rows = [(f"s{i}", bytearray(wav([0] * i + [1, 5, -3] + [0] * (60 - i)))) for i in range(50)]
    blocks = wav_blocks(spark.createDataFrame(rows, FILES).coalesce(1), 20, 2)
    needles = spark.createDataFrame([(i, f"s{i}", [1, 5, -3]) for i in range(50)], "needle int, path string, pcm array<short>")
    assert sorted((r.needle, r.sample) for r in audio.onsets(blocks, needles).collect()) == [(i, i) for i in range(50)]
