"""Log-bilinear language model with noise-contrastive estimation, over counts of the whole corpus.

Every word's count comes from all training documents. The model's words are the commonest ones, the end of a text, and for
all others one word for each of some shapes (by their last letters). Words are dealt into classes by frequency, and a word's
probability is that of its class times its own within the class: both are a softmax of <target vector, sum of
position-scaled context vectors> + bias, so a probability is normalised exactly by two small products. A word outside has its
shape's probability times its share of it by smoothed counts. So all probabilities sum to one, and the untrained model is a
smoothed unigram.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.blocks import ASK, answer, bucket_count, bucket_of, meet, pack_blocks, sealed, split_by_bucket, unpack
from quillon.llm.common import materialize
from quillon.llm.hashing import SPACES, U64, mix, runs, segment_hashes, text_bytes

#: The end of a text, as a word's hash.
END = U64(0x5AD0_0E4D_0000_0000)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters, digits and all bytes beyond ASCII.
WORDY = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
SMOOTH = 0.1
CONTEXT, WIDTH, CLASS_WORDS, SHAPES = 4, 16, 128, 64
#: Rows of a sum of parameters that meet in one task.
FAN_IN = 16


def tokens(docs: pa.Table, id_col: str, text_col: str, modulus: int, held_out: int):
    """(hash, document) of each token, ends included, and which documents are held out. A hash's low bits are the word's shape."""
    data, off = text_bytes(docs[text_col])
    data = LOWER[data]
    start, end, doc = runs(~SPACES[data], off)
    n = docs.num_rows
    h = segment_hashes(data, start, end, 0)
    if len(start):
        # the last two letters, before a mark at the end
        last = end - 1 - ((end - start > 2) & ~WORDY[data[end - 1]])
        pair = data[last].astype(U64) * U64(257) + np.where(last > start, data[np.maximum(last - 1, 0)], 0).astype(U64)
        h = h & ~U64(SHAPES - 1) | mix(pair + U64(1)) % U64(SHAPES)
    h = np.concatenate([h, np.full(n, END)])
    d = np.concatenate([doc, np.arange(n)])
    order = np.argsort(d, kind="stable")
    ids = pc.fill_null(pc.cast(docs[id_col], pa.string()), "").to_pylist()
    held = np.fromiter((zlib.crc32(i.encode()) % modulus == held_out for i in ids), bool, n)
    return h[order], d[order], held


def seal_tokens(t: pa.Table, id_col: str, text_col: str, modulus: int, held_out: int) -> bytes:
    """A block's documents as their words: ids, what is held out and the number of words; the distinct hashes, ascending; each word's place among them."""
    h, d, held = tokens(t, id_col, text_col, modulus, held_out)
    u, inv = np.unique(h, return_inverse=True)
    parts = [pa.table([t[id_col], pa.array(held), pa.array(np.bincount(d, minlength=t.num_rows))], names=["id", "held", "n"]), pa.table([pa.array(u)], names=["u"]), pa.table([pa.array(inv.astype(np.uint16 if len(u) < 2**16 else np.uint32))], names=["inv"])]
    return b"".join(len(x).to_bytes(8, "little") + x for x in map(sealed, parts))


class Words(NamedTuple):
    """What was sealed: documents (id, held, n), distinct hashes, each word's place among them, and its document."""

    docs: pa.Table
    u: np.ndarray
    inv: np.ndarray
    d: np.ndarray

    @classmethod
    def unseal(cls, data) -> Words:
        raw, parts = (data.as_py() if hasattr(data, "as_py") else data), []
        while raw:
            n = int.from_bytes(raw[:8], "little")
            parts.append(unpack(raw[8 : 8 + n]))
            raw = raw[8 + n :]
        docs, u, inv = parts
        return cls(docs, u["u"].to_numpy(), inv["inv"].to_numpy(), np.repeat(np.arange(docs.num_rows), docs["n"].to_numpy()))

    @property
    def held(self) -> np.ndarray:
        return self.docs["held"].to_numpy()


def _sums_by_row(i: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of i, and the sum of g's rows for each."""
    order = np.argsort(i, kind="stable")
    rows = i.take(order)
    first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    # numpy goes over the groups once for each column: two of them as one complex number halve that, and add up just the same
    return rows.take(first), np.add.reduceat(g.take(order, axis=0).view(np.complex64), first, axis=0).view(np.float32)


def _with_bias(vectors: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Vectors with their bias as one more column: their product with a vector that ends in 1 has it added."""
    return np.concatenate([vectors, bias[:, None]], axis=1)


def _side_by_side(position: np.ndarray) -> np.ndarray:
    """[CONTEXT * WIDTH, WIDTH]: the product with context vectors laid side by side is their sum, each scaled by its position."""
    return (position[:, :, None] * np.eye(WIDTH, dtype=np.float32)).reshape(-1, WIDTH)


class Model:
    """Parameters of fixed size. hashes (ascending) and words: place of each named word; shapes: place of each shape's word;
    mass: smoothed count of each place, 0 where a class has no more words. Places of one class are neighbours."""

    NAMES = ("context", "word", "word_bias", "cls", "cls_bias", "position")

    def __init__(self, hashes: np.ndarray, words: np.ndarray, shapes: np.ndarray, mass: np.ndarray, parts: list[np.ndarray] | None = None):
        self.hashes, self.words, self.shapes, self.mass = hashes, words, shapes, mass
        self.classes = len(mass) // CLASS_WORDS
        by_class = mass.reshape(self.classes, CLASS_WORDS)
        self.prior = by_class.sum(1) / mass.sum()
        self.share = by_class / by_class.sum(1, keepdims=True)
        if parts is None:
            rng = np.random.default_rng(1)
            with np.errstate(divide="ignore"):
                bias = np.maximum(np.log(self.share.ravel()), -1e4)
            parts = [rng.normal(0, 0.1, (len(mass), WIDTH)), rng.normal(0, 0.1, (len(mass), WIDTH)), bias, rng.normal(0, 0.1, (self.classes, WIDTH)), np.log(self.prior), np.ones((CONTEXT, WIDTH))]
        self.parts = [x.astype(np.float32) for x in parts]

    def state(self) -> tuple:
        return self.hashes, self.words, self.shapes, self.mass, self.parts

    def place_of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each token, whether it is a named word)."""
        if not len(self.hashes):
            return self.shapes[(h & U64(SHAPES - 1)).astype(np.int64)], np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        named = self.hashes[at] == h
        return np.where(named, self.words[at], self.shapes[(h & U64(SHAPES - 1)).astype(np.int64)]), named

    def contexts(self, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """[tokens, CONTEXT] places before each token; before a text stands its end."""
        end = self.place_of(np.array([END]))[0][0]
        out = np.full((len(c), CONTEXT), end)
        for i in range(CONTEXT):
            same = d[i + 1 :] == d[: len(d) - i - 1]
            out[i + 1 :, i][same] = c[: len(c) - i - 1][same]
        return out

    def train(self, c: np.ndarray, ctx: np.ndarray, seed: int, noise: int = 64, batch: int = 512, rate: float = 0.1, passes: int = 1) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Changes of the parameters after passes of noise-contrastive estimation over the tokens, and which context and word rows changed.

        A step takes tokens of one class, and holds their words against noise of the words' shares in it and the class against noise of
        the class prior. Steps are scaled by the squares of past gradients (of rows that a step touches alone).
        """
        rng = np.random.default_rng(seed)
        context, word, word_bias, cls, cls_bias, position = (x.copy() for x in self.parts)
        words, kinds = _with_bias(word, word_bias), _with_bias(cls, cls_bias)
        past_context, past_words, past_kinds, past_position = (np.full(x.shape, 1e-6, np.float32) for x in (context, words, kinds, position))
        rates = np.full(WIDTH + 1, rate, np.float32)
        rates[WIDTH] *= 0.3
        log_prior = np.log(noise * self.prior).astype(np.float32)
        with np.errstate(divide="ignore"):
            log_share = np.maximum(np.log(noise * self.share), -1e4).astype(np.float32)
        # as Generator.choice draws, without its checks of the shares at each step
        prior_ends, share_ends = np.cumsum(self.prior), np.cumsum(self.share, axis=1)
        prior_ends, share_ends = prior_ends / prior_ends[-1], share_ends / share_ends[:, -1:]
        ahead = np.ones((batch, WIDTH + 1), np.float32)  # a step's sums of context vectors, and 1 for the bias

        def step(x: np.ndarray, past: np.ndarray, g: np.ndarray, rate) -> None:
            """Moves x up the gradient, in place."""
            past += g * g
            g *= rate
            g /= np.sqrt(past)
            x += g

        def drawn(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Distinct places of the noise, and how often each was drawn."""
            n = np.bincount(ends.searchsorted(rng.random(noise), "right"))
            at = np.flatnonzero(n)
            return at, n[at]

        def descend(i: np.ndarray, k: int) -> None:
            """One step on tokens of class k: their words against noise of the class, and the class against noise of all."""
            i = i.take(inner.take(i).argsort(kind="stable"))
            x, targets = before.take(i, axis=0), inner.take(i)
            m = np.float32(1 / len(i))
            seen = context.take(x, axis=0)  # [tokens, CONTEXT, WIDTH]
            to_sum = _side_by_side(position)
            h = ahead[: len(i)]
            np.matmul(seen.reshape(len(i), -1), to_sum, out=h[:, :WIDTH])
            own, own_past = words[k * CLASS_WORDS : (k + 1) * CLASS_WORDS], past_words[k * CLASS_WORDS : (k + 1) * CLASS_WORDS]
            # noise of the class, noise of all, and the class itself: one product; what is drawn twice counts twice
            (some, n_some), (others, n_others) = drawn(share_ends[k]), drawn(prior_ends)
            q = np.concatenate([own.take(some, axis=0), kinds.take(others, axis=0), kinds[k : k + 1]])
            q[:, WIDTH] -= np.concatenate([log_share[k].take(some), log_prior.take(others), log_prior[k : k + 1]])
            np.negative(q, out=q)
            down = h @ q.T
            np.clip(down, -30, 30, out=down)
            np.exp(down, out=down)
            down += 1
            np.divide(np.concatenate([n_some, n_others, [1]]).astype(np.float32) * m, down, out=down)
            down[:, -1] -= m
            qt = own.take(targets, axis=0)
            up = np.einsum("ij,ij->i", h, qt)
            up -= log_share[k].take(targets)
            up = m / (1 + np.exp(np.clip(up, -30, 30, out=up)))
            # gradients
            dh = down @ q[:, :WIDTH]
            dh += up[:, None] * qt[:, :WIDTH]
            g = down.T @ h
            g_words, g_kinds = np.zeros_like(own), np.zeros_like(kinds)
            first = np.flatnonzero(np.concatenate(([True], targets[1:] != targets[:-1])))
            g_words[targets.take(first)] = np.add.reduceat(up[:, None] * h, first, axis=0)
            g_words[some] -= g[: len(some)]
            g_kinds[others] -= g[len(some) : -1]
            g_kinds[k] -= g[-1]
            step(own, own_past, g_words, rates)
            step(kinds, past_kinds, g_kinds, rates)
            rows, g = _sums_by_row(x.ravel(), (dh @ to_sum.T).reshape(-1, WIDTH))
            step(position, past_position, np.einsum("ik,ijk->jk", dh, seen), rate)
            moved, past = context.take(rows, axis=0), past_context.take(rows, axis=0)
            step(moved, past, g, rate)
            context[rows], past_context[rows] = moved, past

        # places as small numbers sort by radix
        before = ctx.astype(np.int16 if len(self.mass) < 2**15 else np.int32)
        inner = (c % CLASS_WORDS).astype(np.int16)
        for _ in range(passes):
            own = (c // CLASS_WORDS).astype(np.int16 if self.classes < 2**15 else np.int32)
            some = rng.permutation(len(c))
            shuffled = some[np.argsort(own[some], kind="stable")]
            ends = np.searchsorted(own[shuffled], np.arange(self.classes + 1))
            steps = [(k, shuffled[lo : min(lo + batch, ends[k + 1])]) for k in range(self.classes) for lo in range(ends[k], ends[k + 1], batch)]
            for s in rng.permutation(len(steps)):
                k, i = steps[s]
                descend(i, k)
        parts = [context, words[:, :WIDTH], words[:, WIDTH], kinds[:, :WIDTH], kinds[:, WIDTH], position]
        return [x - y for x, y in zip(parts, self.parts, strict=True)], (past_context > 1e-6).any(1), (past_words[:, :WIDTH] > 1e-6).any(1)

    def log_probs(self, c: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        """Natural log probability of each token's place, normalised over all classes and over its class by batched products."""
        context, word, word_bias, cls, cls_bias, position = self.parts
        words, kinds, to_sum = _with_bias(word, word_bias), _with_bias(cls, cls_bias), _side_by_side(position)
        out = np.zeros(len(c))
        ahead = np.ones((512, WIDTH + 1), np.float32)
        ctx, own = ctx.astype(np.int32), (c // CLASS_WORDS).astype(np.int16 if self.classes < 2**15 else np.int32)
        order = np.argsort(own, kind="stable")
        own = own[order]
        edges = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True]))) if len(c) else np.zeros(1, np.int64)
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            k = int(own[lo])
            q = np.concatenate([words[k * CLASS_WORDS : (k + 1) * CLASS_WORDS], kinds]).T
            for at in range(lo, hi, len(ahead)):  # products that stay in a core's cache
                i = order[at : min(at + len(ahead), hi)]
                h = ahead[: len(i)]
                np.matmul(context.take(ctx.take(i, axis=0), axis=0).reshape(len(i), -1), to_sum, out=h[:, :WIDTH])
                s = h @ q
                halves = s[:, :CLASS_WORDS], s[:, CLASS_WORDS:]
                if s.max() > 80:  # beyond what single precision exponentiates
                    for x in halves:
                        x -= x.max(1, keepdims=True)
                total = s[np.arange(len(i)), c.take(i) % CLASS_WORDS] + s[:, CLASS_WORDS + k]
                np.exp(s, out=s)
                for x in halves:
                    total -= np.log(x @ np.ones(x.shape[1], np.float32))
                out[i] = total
        return out


def named_model(words: list[tuple[int, int]], shape_n: np.ndarray, shape_v: np.ndarray) -> Model:
    """The untrained model of named words (hash, count), with the counts and numbers of all words of each shape."""
    h = np.array([x for x, _ in words], U64)
    n = np.array([x for _, x in words], float)
    shape = (h & U64(SHAPES - 1)).astype(np.int64)
    rest_n = shape_n - np.bincount(shape, n, SHAPES)
    rest_v = shape_v - np.bincount(shape, minlength=SHAPES)
    mass = np.concatenate([n, rest_n + SMOOTH * rest_v]) + SMOOTH
    order = np.argsort(-mass, kind="stable")
    place = np.empty(len(mass), np.int64)
    place[order] = np.arange(len(mass))
    full = np.zeros(-(-len(mass) // CLASS_WORDS) * CLASS_WORDS)
    full[: len(mass)] = mass[order]
    by_hash = np.argsort(h)
    return Model(h[by_hash], place[: len(h)][by_hash], place[len(h) :], full)


def added(sums: DataFrame, tasks: int) -> DataFrame:
    """One row (total) that adds up those of ``tasks`` tasks (part, total), FAN_IN of them in a task at a time."""

    def add(t):
        total = None
        for x in t["total"]:
            one = np.frombuffer(x.as_buffer(), "<f4")
            total = one.astype("<f4") if total is None else total + one
        return pa.table([t["part"].slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["part", "total"])

    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        sums = sums.select(F.floor(F.col("part") / FAN_IN).cast("int").alias("part"), "total").groupBy("part").applyInArrow(add, "part int, total binary")
    return sums


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 10, held_out: int = 0, most_words: int = 16_000, least_count: int = 10, rounds: int = 4, passes: int = 1) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Counts, totals and the model come from all documents whose crc32(id as text) mod ``modulus`` is not ``held_out``. The
    model names the ``most_words`` commonest words (of equally common ones those of least hash) that stand ``least_count`` times at least; the others have
    their shape's probability times their share of it. In each round, tasks train from the same parameters, each on its own share
    of the documents' blocks; a vector's changes are averaged over the blocks that have its word. The rounds of a pass share all
    blocks out among them. Words are lower-cased for A-Z alone and told apart by 58 bits of a hash, whose other bits are their shape. Null and empty
    texts have one token, the end; a very long text is a block of its own. Repeated rows are documents of their own; with no training document N and V
    are 0. Other columns are ignored, whatever their names; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    named_docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # texts are hashed once: what is stored, trained on and scored are places of words
    blocks = pack_blocks(named_docs, "text", seal=lambda t: seal_tokens(t, "id", "text", modulus, held_out))
    buckets = bucket_count(blocks, 0.4)

    def ask(batches):
        for b in batches:
            for name, data in zip(b["block"].to_pylist(), b["data"], strict=True):
                w = Words.unseal(data)
                n = np.bincount(w.inv, ~w.held[w.d], len(w.u)).astype(np.uint32)
                yield split_by_bucket(name, w.u, w.u, buckets, n)

    def reply(keys: list[bytes], counts: list[bytes]) -> list[bytes]:
        sizes = [len(k) // 8 for k in keys]
        u, inv = np.unique(np.frombuffer(b"".join(keys), U64), return_inverse=True)
        total = np.bincount(inv, np.frombuffer(b"".join(counts), np.uint32), len(u)).astype(np.int64)
        ends = np.cumsum(sizes)
        out = total[inv].astype("<u4" if total.max(initial=0) < 2**32 else "<u8")
        out = [out[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)]
        shape = (u & U64(SHAPES - 1)).astype(np.int64)
        top = np.flatnonzero((total >= least_count) | (u == END))
        top = top[np.lexsort((u[top], -total[top], u[top] != END))][:most_words]
        head = np.concatenate([np.bincount(shape, total, SHAPES), np.bincount(shape, total > 0, SHAPES)]).astype(np.int64).tobytes()
        out[0] = np.int64(len(head) + 16 * len(top)).tobytes() + head + u[top].tobytes() + total[top].tobytes() + out[0]
        return [out[0], *(np.int64(0).tobytes() + x for x in out[1:])]

    counted = materialize(answer(blocks.select("block", "data").mapInArrow(ask, ASK), reply), "counts")

    def heads(batches):
        """Each bucket's totals by shape, and its commonest words."""
        for b in batches:
            for x in b.column(0).to_pylist():
                n = int.from_bytes(x[:8], "little")
                if n:
                    v = np.frombuffer(x[8 : 8 + n], np.int64)
                    k = (len(v) - 2 * SHAPES) // 2
                    w = v[2 * SHAPES :]
                    yield pa.RecordBatch.from_arrays([pa.array([*range(SHAPES), *[None] * k], pa.int64()), pa.array([*[None] * SHAPES, *w[:k]], pa.int64()), pa.array([*v[:SHAPES], *w[k:]], pa.int64()), pa.array([*v[SHAPES : 2 * SHAPES], *[0] * k], pa.int64())], ["shape", "h", "n", "v"])

    head = materialize(counted.select("answer").mapInArrow(heads, "shape long, h long, n long, v long"), "heads")
    shape_n, shape_v = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in head.where("shape IS NOT NULL").groupBy("shape").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        shape_n[r["shape"]], shape_v[r["shape"]] = r.n, r.v
    n_all, v_all = int(shape_n.sum()), int(shape_v.sum())
    named = head.where("h IS NOT NULL")
    # the commonest words by steps of their counts; of the first step that doesn't fit as a whole, those that come first
    level = F.when(F.col("h") == int(END.view(np.int64)), 1 << 20).otherwise(F.floor(F.log2(F.greatest("n", F.lit(1))) * 64))
    held, words = 0, []
    for r in sorted(named.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):
        if held + r["count"] > most_words:
            words = named.where(level == r.level).orderBy(F.desc("n"), "h").limit(most_words - held).select("h", "n").collect()
            break
        held, lowest = held + r["count"], r.level
    if held:
        words += named.where(level >= lowest).select("h", "n").collect()
    model = named_model(sorted((r.h & (2**64 - 1), int(r.n)) for r in words), shape_n, shape_v)
    shapes = [x.shape for x in model.parts]
    ends = np.cumsum([0, *(int(np.prod(x)) for x in shapes)])

    tasks = blocks.rdd.getNumPartitions() if n_all else 0
    for turn in range(rounds * passes if n_all else 0):
        shared = spark.sparkContext.broadcast(model.state())  # of fixed size

        def train(batches, shared=shared, turn=turn):
            m, total, seen = Model(*shared.value), None, None
            for b in batches:
                for name, data in zip(b["block"].to_pylist(), b["data"], strict=True):
                    w = Words.unseal(data)
                    place, _ = m.place_of(w.u)
                    c = place[w.inv]
                    use = ~w.held[w.d]
                    if use.any():
                        parts, ctx_rows, word_rows = m.train(c[use], m.contexts(c, w.d)[use], name % 2**31 + turn)
                        one = np.ones(1, bool)
                        counts = [ctx_rows, word_rows, word_rows, one, one, one]
                        total = parts if total is None else [x + y for x, y in zip(total, parts, strict=True)]
                        seen = [x.astype(np.float32) for x in counts] if seen is None else [x + y for x, y in zip(seen, counts, strict=True)]
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([np.concatenate([x.ravel() for x in [*total, *seen]]).astype("<f4").tobytes()], pa.binary())], ["part", "total"])

        # every task has blocks for every round; sums of fixed size for each task, some of which meet in a task at a time
        mine = blocks.where(F.pmod(F.col("block") + F.shiftright("block", 32), F.lit(rounds)) == turn % rounds).select("block", "data")
        for r in added(mine.mapInArrow(train, "part int, total binary"), tasks).collect():
            flat = np.frombuffer(bytes(r.total), "<f4")
            counts = np.split(flat[ends[-1] :], np.cumsum([shapes[0][0], shapes[1][0], shapes[1][0], 1, 1]))
            for k, (lo, hi, shape, n) in enumerate(zip(ends[:-1], ends[1:], shapes, counts, strict=True)):
                model.parts[k] = (model.parts[k] + flat[lo:hi].reshape(shape) / np.maximum(n, 1).reshape([-1] + [1] * (len(shape) - 1))).astype(np.float32)

    final = spark.sparkContext.broadcast(model.state())
    schema = T.StructType([docs.schema[id_col], T.StructField("held_out", T.BooleanType()), *(T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def score(name, w, got):
        m = Model(*final.value)
        sizes = np.bincount(bucket_of(w.u, buckets))
        sizes = sizes[sizes > 0]
        raw = [x[8 + int.from_bytes(x[:8], "little") :] for x in got]
        count = np.concatenate([np.frombuffer(x, f"<u{len(x) // n}") for x, n in zip(raw, sizes, strict=True)]).astype(float) if len(w.u) else np.zeros(0)
        n = w.docs.num_rows
        place, known = m.place_of(w.u)
        base = np.log10((count + SMOOTH) / (n_all + SMOOTH * (v_all + 1)))
        rest = np.zeros(len(w.u))
        rest[~known] = np.log10((count[~known] + SMOOTH) / m.mass[place[~known]])
        c = place[w.inv]
        p = m.log_probs(c, m.contexts(c, w.d)) / np.log(10) + rest[w.inv]

        def per(x):
            return np.bincount(w.d, x, n)

        cols = [w.docs["id"], w.docs["held"], w.docs["n"], pa.array(per((count > 0)[w.inv]).astype(np.int64)), pa.array(np.full(n, n_all)), pa.array(per(base[w.inv])), pa.array(per(p))]
        return pa.table(cols, names=schema.names)

    return meet(blocks, counted, score, schema, Words.unseal)
