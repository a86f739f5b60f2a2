"""Vectorised words, hashes and windows over Arrow string columns (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: ASCII white space, as in words ``[^\x20\x09-\x0D]+``.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.default_rng(20240607)
_TABLES = _rng.integers(0, 2**64, (2, 1024), dtype=U64)
_BASES = _rng.integers(0, 2**63, 4, dtype=U64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


def inverse(base: int) -> np.uint64:
    return U64(pow(int(base), -1, 2**64))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.type not in (pa.string(), pa.large_string()):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document of each maximal run of True that stays in one document."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = off[:-1][off[:-1] < n]
    before[cuts] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def segment_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """64-bit hash of values[start:end] for ascending, disjoint segments; values < 1024."""
    n = len(values)
    if not len(start):
        return np.zeros(0, U64)
    first = np.zeros(n, np.int32)
    first[start] = start
    at = np.arange(n, dtype=np.int32)
    at -= np.maximum.accumulate(first, out=first)
    length = (end - start).astype(np.int32)
    gap = np.empty(len(start), np.int32)  # from an end to the next start
    gap[:-1] = start[1:] - end[:-1]
    gap[-1] = n - end[-1]
    scale = powers(_BASES[which], int(length.max()) + 1)
    if gap.any():
        # places past a segment's end count nothing
        most = int(length.max())
        limit = np.repeat(length, length + gap)
        lead = n - len(limit)
        at[lead:][at[lead:] >= limit] = most
        scale[most] = 0
    terms = _TABLES[which][values]
    terms *= scale[np.minimum(at, len(scale) - 1)] if start[0] else scale[at]
    return mix(np.add.reduceat(terms, start) + length.astype(U64) * _BASES[3])


def words(col: pa.Array, separators: np.ndarray = SPACES):
    """(bytes, offsets, start, end, doc) of the words of each text."""
    data, off = text_bytes(col)
    return (data, off, *runs(~separators[data], off))


def window_hashes(h: np.ndarray, length: int, which: int) -> np.ndarray:
    """Hash of h[i:i+length] for every i with a whole window (positions; document bounds are the caller's)."""
    n = len(h)
    if n < length:
        return np.zeros(0, U64)
    base = _BASES[2 + which % 2]
    up, down = powers(base, n), powers(inverse(base), n)
    total = np.zeros(n + 1, U64)
    np.cumsum(h * up, out=total[1:])
    return mix((total[length:] - total[:-length]) * down[: n - length + 1])


def doc_bounds(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """First word of each document, and the number of words at the end."""
    return np.searchsorted(doc, np.arange(n_docs + 1))
