"""WAV files as rows of samples: a long sound is many blocks, each with some of the samples after it where that is asked for."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes before the first chunk and of the shortest header; the one format, width and number of channels that are read.
FIRST_CHUNK, HEADER, PCM, BITS, CHANNELS = 12, 44, 1, 16, 1
#: Samples that go to Spark at once, a block at least.
TOGETHER = 1 << 20
BLOCKS = "path string, error string, sample_rate int, total long, at long, core int, core_sum long, pcm array<short>"


def wav_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the WAV files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(folder).select("path", "content")


def find_samples(data: bytes) -> tuple[int, int, int]:
    """(sample rate, first byte, samples) of a mono 16-bit PCM file; the last of several chunks of one kind counts. Anything else raises ValueError."""
    if len(data) < HEADER or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    found, at = {}, FIRST_CHUNK
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        found[name] = (at + 8, size)
        at += 8 + size + size % 2  # padded to even sizes
    if b"fmt " not in found or b"data" not in found:
        raise ValueError("missing fmt or data chunk")
    start, size = found[b"fmt "]
    if start + 16 > len(data):
        raise ValueError("truncated fmt chunk")
    kind, channels, rate = struct.unpack_from("<HHI", data, start)
    bits = struct.unpack_from("<H", data, start + 14)[0]
    if kind != PCM:
        raise ValueError(f"unsupported format {kind}")
    if bits != BITS:
        raise ValueError(f"unsupported bit depth {bits}")
    if channels != CHANNELS:
        raise ValueError(f"expected mono, got {channels} channels")
    start, size = found[b"data"]
    if size % 2:
        raise ValueError("odd number of data bytes")
    if start + size > len(data):
        raise ValueError(f"truncated: {len(data) - start} of {size} data bytes")
    return rate, start, size // 2


def wav_blocks(files: DataFrame, block: int = 1 << 16, overlap: int = 0) -> DataFrame:
    """``BLOCKS`` of files (path, content): samples ``at`` to at + core, and up to ``overlap`` samples after them, in ``pcm``; core_sum adds up
    the core's. A sound without samples is one empty block; a file that can't be read is one row with the error alone."""

    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    names = ["path", "error", "sample_rate", "total", "at", "core", "core_sum", "pcm"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True))[:-1], kinds, strict=True)]
        samples = [r[-1] for r in rows]
        ends = np.cumsum([0] + [0 if x is None else len(x) for x in samples], dtype=np.int32)
        values = np.concatenate([np.zeros(0, np.int16)] + [x for x in samples if x is not None])
        pcm = pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int16()), mask=pa.array([x is None for x in samples]))
        return pa.RecordBatch.from_arrays([*columns, pcm], names)

    def run(batches):
        for b in batches:
            held, size = [], 0
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = content.as_py()
                try:
                    if data is None:
                        raise ValueError("no content")
                    rate, start, n = find_samples(data)
                except ValueError as e:
                    held.append((path, str(e), None, None, None, None, None, None))
                    continue
                samples = np.frombuffer(data, "<i2", n, start)
                for at in range(0, max(n, 1), block):
                    core = min(block, n - at)
                    held.append((path, None, rate, n, at, core, int(samples[at : at + core].sum(dtype=np.int64)), samples[at : at + core + overlap]))
                    size += len(held[-1][-1])
                    if size >= TOGETHER:
                        yield batch(held)
                        held, size = [], 0
            if held:
                yield batch(held)

    return files.select("path", "content").mapInArrow(run, BLOCKS)


def _little(value: Column, size: int) -> Column:
    """Hexadecimal digits of a number's ``size`` lowest bytes, the lowest first."""
    return F.concat(*[F.lpad(F.hex(F.shiftright(value.cast("long"), 8 * i).bitwiseAND(F.lit(255).cast("long"))), 2, "0") for i in range(size)])


def wav_file(data: Column, sample_rate: Column) -> Column:
    """A mono 16-bit PCM file of samples' bytes."""
    size = F.octet_length(data)
    numbers = [(size + HEADER - 8, 4), (F.lit(16), 4), (F.lit(PCM), 2), (F.lit(CHANNELS), 2), (sample_rate, 4), (sample_rate * 2, 4), (F.lit(2), 2), (F.lit(BITS), 2), (size, 4)]
    hexed = [_little(v, n) for v, n in numbers]
    text = lambda s: F.lit(s.encode().hex())
    return F.concat(F.unhex(F.concat(text("RIFF"), hexed[0], text("WAVEfmt "), *hexed[1:8], text("data"), hexed[8])), data)


def _samples_bytes(pcm: pa.Array) -> pa.Array:
    """The bytes of lists of 16-bit numbers, the low byte first: what Arrow holds, with other bounds. Null samples are left out."""
    if pcm.null_count or pcm.flatten().null_count:
        return pa.array([None if x is None else np.asarray([v for v in x if v is not None], "<i2").tobytes() for x in pcm.to_pylist()], pa.binary())
    ends = pcm.offsets.to_numpy().astype(np.int64)
    data = pcm.flatten().to_numpy().astype("<i2", copy=False).tobytes()
    offsets = ((ends - ends[0]) * 2).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pcm), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def little_endian(pcm: Column) -> Column:
    @F.arrow_udf("binary")
    def run(x: pa.Array) -> pa.Array:
        return _samples_bytes(x)

    return run(pcm)


def wav_bytes(pcm: Column, sample_rate: Column) -> Column:
    """A mono 16-bit PCM file of an array of samples."""
    return wav_file(little_endian(pcm.cast("array<short>")), sample_rate)


def quantized(samples: Column) -> Column:
    """Samples of -1 to 1 as 16-bit numbers, halves rounded up, what is beyond cut off."""
    return F.transform(samples, lambda x: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.floor(x * 32767 + 0.5))).cast("short"))
