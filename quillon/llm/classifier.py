"""Quality as a generalised additive model with pairwise interactions.

Each feature, and each chosen pair of features, has a lookup table over its bins, learned by
cyclic gradient boosting: round after round, a shallow tree on one feature's (or pair's) bins
fits what the others leave. A score is the sum of the looked-up values, through the logistic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import by_bytes, map_arrow
from quillon.llm.hashing import doc_bounds, runs, segment_hashes, text_bytes, words
from quillon.llm.labelled import remainder, sample

FEATURES = (
    "log_words", "word_length", "longest_word", "upper", "digit", "punctuation", "symbols", "exclaim", "non_ascii", "blank",
    "distinct_words", "same_as_before", "distinct_pairs", "commonest", "log_lines", "dup_lines", "line_length", "stops", "lone_marks", "marked_words",
)
_BYTE = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "punctuation": bytes(c for c in range(33, 127) if not chr(c).isalnum()),
    "symbols": b"#*$%&|<>", "exclaim": b"!", "non_ascii": bytes(range(128, 256)), "blank": b" \t\n\x0b\x0c\r", "stops": b".",
}
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document, and the count of the commonest."""
    order = np.lexsort((h, doc))
    d, v = doc[order], h[order]
    at = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (d[1:] != d[:-1])))) if len(d) else np.zeros(0, np.int64)
    most = np.zeros(n)
    np.maximum.at(most, d[at], np.diff(np.append(at, len(d))))
    return np.bincount(d[at], minlength=n), most


def features(col: pa.Array) -> np.ndarray:
    """[texts, FEATURES]; null and empty texts give zeros."""
    n = len(col)
    data, off, start, end, doc = words(col)
    size, count = np.diff(off), np.bincount(doc, minlength=n)
    one, many = np.maximum(size, 1), np.maximum(count, 1)
    at = np.repeat(np.arange(n), size)
    out: dict[str, np.ndarray] = {"log_words": np.log1p(count)}
    for name, chars in _BYTE.items():
        lut = np.zeros(256, bool)
        lut[list(chars)] = True
        out[name] = np.bincount(at[lut[data]], minlength=n) / one
    length = end - start
    out["word_length"] = np.bincount(doc, weights=length, minlength=n) / many
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    out["longest_word"] = np.log1p(longest)
    h = segment_hashes(data, start, end, 0)
    distinct, most = _distinct(doc, h, n)
    out["distinct_words"], out["commonest"] = distinct / many, most / many
    near = doc[1:] == doc[:-1]
    out["same_as_before"] = np.bincount(doc[1:][near & (h[1:] == h[:-1])], minlength=n) / many
    pairs = np.bincount(doc[1:][near], minlength=n)
    out["distinct_pairs"] = _distinct(doc[1:][near], (h[1:] * np.uint64(3) + h[:-1])[near], n)[0] / np.maximum(pairs, 1)
    ls, le, ld = runs(data != 10, off)
    lines = np.bincount(ld, minlength=n)
    out["log_lines"], out["line_length"] = np.log1p(lines), np.log1p(size / np.maximum(lines, 1))
    out["dup_lines"] = 1 - _distinct(ld, segment_hashes(data, ls, le, 0), n)[0] / np.maximum(lines, 1)
    if len(start):
        letters = np.add.reduceat(np.concatenate((_LETTER[data], [False])).astype(np.int32), np.stack([start, end], 1).ravel())[::2]
        out["lone_marks"] = np.bincount(doc[letters == 0], minlength=n) / many
        out["marked_words"] = np.bincount(doc[(letters > 0) & ~_LETTER[data[end - 1]]], minlength=n) / many
    else:
        out["lone_marks"] = out["marked_words"] = np.zeros(n)
    return np.stack([out[f] for f in FEATURES], 1).astype(float)


@dataclass
class AdditiveModel:
    bias: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], "right") for i, c in enumerate(self.cuts)], 1) if len(x) else np.zeros((0, len(self.cuts)), np.int64)

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.bias)
        for i, t in enumerate(self.tables):
            z += t[b[:, i]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-z))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, smooth: float) -> np.ndarray:
    """Leaf value of each bin, of a tree that splits the bins' range ``depth`` times over."""
    value = g.sum() / (h.sum() + smooth)
    out = np.full(len(g), value)
    if depth and len(g) > 1:
        cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = cg**2 / (ch + smooth) + (g.sum() - cg) ** 2 / (h.sum() - ch + smooth)
        k = int(np.argmax(gain)) + 1
        if gain[k - 1] > g.sum() ** 2 / (h.sum() + smooth) + 1e-9:
            out[:k], out[k:] = _tree(g[:k], h[:k], depth - 1, smooth), _tree(g[k:], h[k:], depth - 1, smooth)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[np.ndarray, float]:
    """Values of a tree of one cut on each of two features, and its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts_g = [cg, cg[:, -1:] - cg, cg[-1:] - cg, cg[-1, -1] - cg[:, -1:] - cg[-1:] + cg]
    parts_h = [ch, ch[:, -1:] - ch, ch[-1:] - ch, ch[-1, -1] - ch[:, -1:] - ch[-1:] + ch]
    gain = sum(a**2 / (b + smooth) for a, b in zip(parts_g, parts_h, strict=True))[:-1, :-1]
    if not gain.size:
        return np.zeros_like(g), 0.0
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [a[i, j] / (b[i, j] + smooth) for a, b in zip([np.broadcast_to(p, cg.shape) for p in parts_g], [np.broadcast_to(p, cg.shape) for p in parts_h], strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return out, float(gain.max())


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, pair_rounds: int = 20, n_pairs: int = 10, bins: int = 48, rate: float = 0.15, smooth: float = 2.0) -> AdditiveModel:
    """Deterministic for given rows in a given order."""
    mean = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for i in range(x.shape[1])]
    m = AdditiveModel(float(np.log(mean / (1 - mean))), cuts, [np.zeros(len(c) + 1) for c in cuts], [], [])
    if len(y) == 0 or y.min() == y.max():
        return m
    b = m.bins(x)
    z = np.full(len(y), m.bias)

    def slope():
        p = 1 / (1 + np.exp(-z))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for i, t in enumerate(m.tables):
            g, h = slope()
            step = rate * np.clip(_tree(np.bincount(b[:, i], g, len(t)), np.bincount(b[:, i], h, len(t)), 2, smooth), -4, 4)
            t += step
            z += step[b[:, i]]
    g, h = slope()

    def table(i, j, w):
        shape = len(m.tables[i]), len(m.tables[j])
        return np.bincount(b[:, i] * shape[1] + b[:, j], w, shape[0] * shape[1]).reshape(shape)

    gains = [(_quadrants(table(i, j, g), table(i, j, h), smooth)[1], -i, -j) for i in range(len(cuts)) for j in range(i)]
    m.pairs = [(-i, -j) for _, i, j in sorted(gains, reverse=True)[:n_pairs]]
    m.pair_tables = [np.zeros((len(m.tables[i]), len(m.tables[j]))) for i, j in m.pairs]
    for _ in range(pair_rounds):
        for (i, j), t in zip(m.pairs, m.pair_tables, strict=True):
            g, h = slope()
            step = rate * np.clip(_quadrants(table(i, j, g), table(i, j, h), smooth)[0], -4, 4)
            t += step
            z += step[b[:, i], b[:, j]]
    return m


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", sample_rows: int = 12_000, threshold: float = 0.3, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """(id, held_out, score, predicted) of every whole text.

    Learned from at most sample_rows labelled rows whose crc32(id as text) mod ``modulus`` is not
    ``held_out``; only the text's features are inputs. Null and empty texts score as a text of zeros
    in every feature. With no labels, or one class of them, every score is one constant. Repeated
    rows each give a row; other columns are ignored; an empty table gives an empty one.
    """
    k = len(FEATURES)
    vector = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def measure(batches):
        for b in by_bytes(batches, 0):
            x = features(b.column(0))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(x.ravel()))], ["label", "x"])

    rows = sample(docs, labels, label, remainder(id_col, modulus) != held_out, sample_rows, id_col, text_col).mapInArrow(measure, vector).collect()
    rows = sorted((r.x, r.label) for r in rows)
    model = fit(np.array([r[0] for r in rows]).reshape(-1, k), np.array([r[1] for r in rows], float))
    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType())])

    def score(batches):
        for b in by_bytes(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.predict(features(b.column(1))))], schema.names)

    out = map_arrow(docs.select(id_col, text_col), score, schema)
    return out.select(id_col, (remainder(id_col, modulus) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
