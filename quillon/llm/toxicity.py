"""Toxicity by an approximate lexicon: Levenshtein automata over a trie, weighed by context.

The lexicon holds words and stems that labelled training documents tie to toxicity. The words of
a text run through the intersection of the trie with the Levenshtein automaton of one edit (for
words of some length), so misspelled terms are caught; then the words around each find decide
whether it stands in a quotation or report, or is used against someone.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import by_bytes, map_arrow, materialize
from quillon.llm.hashing import doc_bounds, segment_hashes, words
from quillon.llm.labelled import remainder, sample

EDGE = ".,;:!?\"'()[]{}<>*_~`#%&$|/\\-“”‘’«»…¿¡"
QUOTES = "\"“”«»"
#: Words that report or discuss speech.
REPORTING = frozenset("said says say called calls quoted quote quotes wrote word term insult slur sagte sagt nannte wort dit dire appelle mot dijo dice palabra".split())
#: Words that address someone.
ADDRESS = frozenset("you your youre are u he she they du dich bist ihr sie tu vous toi es usted eres".split())
WINDOW = 6
QUOTED, REPORTED, ADDRESSED, MISSPELLED = 0.15, 0.5, 1.2, 0.6
#: Insults known beforehand; each is dropped where labelled clean rows use it.
SEED_LEXICON = ("idiot", "moron", "stupid", "scum", "trash", "loser", "clown", "pathetic", "worthless", "disgusting", "imbecile", "bastard", "cretin", "vermin", "dimwit", "lowlife")
SEED_WEIGHT = 2.0
#: Letters of a term at least, and of a word that is looked for with an edit; letters of stems.
LEAST, FUZZY_LEAST = 4, 4
STEMS = range(4, 8)
CACHE = 150_000
KEPT = 50_000


class Trie:
    """Terms as nested dicts; '' marks an end with (weight, is_stem)."""

    def __init__(self, terms: dict[str, tuple[float, bool]], known: frozenset[str]):
        self.root: dict = {}
        self.known = known
        for t, w in terms.items():
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = w

    def find(self, word: str) -> tuple[float, bool]:
        """(weight, misspelled) of the best term that the word is, begins with (stems), or is one edit from."""
        best, node = 0.0, self.root
        for c in word:
            node = node.get(c)
            if node is None:
                break
            if "" in node and node[""][1]:
                best = max(best, node[""][0])
        else:
            if "" in node:
                best = max(best, node[""][0])
        if best or len(word) < FUZZY_LEAST or word in self.known:
            return best, False
        # states of the automaton of one edit, walked along the trie: (node, letters read, edits left)
        todo, n = [(self.root, 0, 1)], len(word)
        while todo:
            node, i, left = todo.pop()
            while True:
                if i == n and "" in node and not node[""][1]:
                    best = max(best, node[""][0])
                if left:
                    if i < n:
                        todo.append((node, i + 1, 0))
                    for c, child in node.items():
                        if c:
                            todo.append((child, i, 0))
                            if i < n and c != word[i]:
                                todo.append((child, i + 1, 0))
                if i == n or (node := node.get(word[i])) is None:
                    break
                i += 1
        return best, True


def _words(text: str | None) -> list[str]:
    """Distinct lower-case words of LEAST letters and more, without marks at their edges."""
    return sorted({w for x in (text or "").lower().split() if len(w := x.strip(EDGE)) >= LEAST})


def learn(rows: DataFrame, chance: float = 1e-5, purity: float = 0.01, times: int = 3) -> tuple[dict[str, tuple[float, bool]], frozenset[str]]:
    """(terms with weight and whether they are stems, clean words close to a term) from rows (_text, _label).

    A candidate (a word, or its first few letters) is in so many toxic rows that chance would rarely put it in those alone, and in next to no
    clean ones. The lexicon is a greedy cover: the candidate that most toxic rows still lack goes first,
    until every row has ``times`` terms or no candidate adds enough rows. Rows are read and counted in tasks; the driver gets
    the candidates that passed and the numbers of the toxic rows that hold them, no texts.
    """
    spark = rows.sparkSession

    def cut(batches):
        for b in by_bytes(batches, 0):
            own = [_words(t) for t in b.column(0).to_pylist()]
            begun = [sorted({w[:k] for w in ws for k in STEMS if len(w) > k}) for ws in own]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.string())), pa.array(begun, pa.list_(pa.string())), b.column(1).cast(pa.int32())], ["words", "stems", "label"])

    own = materialize(rows.select("_text", "_label").mapInArrow(cut, "words array<string>, stems array<string>, label int").withColumn("row", F.monotonically_increasing_id()), "words")
    n = {bool(r.label): r["n"] for r in own.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = n.get(True, 0), n.get(False, 0)
    share = toxic / max(1, toxic + clean)
    least = max(4, math.ceil(math.log(chance) / math.log(min(max(share, 1e-3), 0.9))))
    flat = own.select("row", "label", F.explode("words").alias("t"), F.lit(False).alias("stem")).union(own.select("row", "label", F.explode("stems"), F.lit(True)))
    counted = flat.groupBy("t", "stem").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    passed = materialize(counted.where((F.col("toxic") >= least) & (F.col("clean") <= purity * F.col("toxic"))), "passed")
    held = flat.where("label = 1").join(passed, ["t", "stem"]).groupBy("t", "stem").agg(F.collect_list("row").alias("rows"), F.first("clean").alias("clean")).collect()
    where = {(r.t, r.stem): (r.rows, r.clean) for r in held}
    have: Counter = Counter()
    terms: dict[str, tuple[float, bool]] = {}
    queue = [(-len(v), c[1], -len(c[0]), c[0]) for c, (v, _) in where.items()]
    heapq.heapify(queue)
    while queue:  # lazily: a stale gain is put back
        gain, stem, short, t = heapq.heappop(queue)
        in_rows, in_clean = where[t, stem]
        now = sum(have[i] < times for i in in_rows)
        if now < least:
            continue
        if now < -gain:
            heapq.heappush(queue, (-now, stem, short, t))
            continue
        if t not in terms and not (not stem and any(t[:k] in terms and terms[t[:k]][1] for k in STEMS)):
            odds = (len(in_rows) + 0.5) / (toxic + 1) / ((in_clean + 0.5) / (clean + 1))
            terms[t] = (min(3.0, math.log(odds)), stem)
            have.update(in_rows)
    # Stems match exactly, since a prefix one edit away is that of too many clean words; so that an edit among
    # a stem's letters is caught too, the whole words of toxic rows that begin with it are terms, with its weight.
    stems = {t: w for t, (w, stem) in terms.items() if stem}
    words_of = lambda label: own.where(F.col("label") == label).select(F.explode("words").alias("w")).distinct()
    if stems:
        starts = [F.left("w", F.lit(k)).isin([t for t in stems if len(t) == k]) for k in STEMS if any(len(t) == k for t in stems)]
        for r in words_of(1).where(reduce(lambda a, b: a | b, starts)).collect():  # words of one lexicon
            if r.w not in terms:
                terms[r.w] = (max(stems[r.w[:k]] for k in STEMS if r.w[:k] in stems), False)
    text = F.lower(F.coalesce("_text", F.lit("")))
    used = rows.where("_label = 0").agg(*[F.count_if(text.contains(t)).alias(t) for t in SEED_LEXICON]).first()
    for t in SEED_LEXICON:
        if t not in terms and used[t] <= purity * clean:
            terms[t] = (SEED_WEIGHT, False)
    shared = spark.sparkContext.broadcast(terms)  # bounded by the sample

    def near(batches):
        trie = Trie(shared.value, frozenset())
        for b in batches:
            yield b.filter(pa.array([bool(trie.find(w)[0]) for w in b.column(0).to_pylist()], pa.bool_()))

    return terms, frozenset(r.w for r in words_of(0).mapInArrow(near, "w string").collect())  # clean words an edit away from a term


def _context(around: list[str], at: int) -> float:
    own = around[at]
    before, after = around[:at], around[at + 1 :]
    opened = sum(w.count(q) for w in before for q in QUOTES) + (own[:1] in QUOTES)
    closed = sum(w.count(q) for w in after for q in QUOTES) + (own[-1:] in QUOTES or own[-2:-1] in QUOTES)
    near = {w.lower().strip(EDGE) for w in before + after}
    factor = QUOTED if opened % 2 and closed else 1.0
    if near & REPORTING:
        factor *= REPORTED
    if near & ADDRESS:
        factor *= ADDRESSED
    return factor


def score_texts(col: pa.Array, trie: Trie, memory: dict) -> np.ndarray:
    """1 - exp(-sum of finds' weights in context) of each text."""
    data, _, start, end, doc = words(col)
    total = np.zeros(len(col))
    if not len(start):
        return total
    _, first, inv = np.unique(segment_hashes(data, start, end, 0), return_index=True, return_inverse=True)
    weight, raw = np.zeros(len(first)), data.tobytes()
    if len(memory) > CACHE:
        memory.clear()
    for u, i in enumerate(first.tolist()):
        w = raw[start[i] : end[i]]
        got = memory.get(w)
        if got is None:
            plain = w.decode("utf-8", "replace").lower().strip(EDGE)
            got, fuzzy = trie.find(plain) if plain else (0.0, False)
            got = memory[w] = got * (MISSPELLED if fuzzy else 1.0)
        weight[u] = got
    bounds = doc_bounds(doc, len(col))
    for i in np.flatnonzero(weight[inv]).tolist():
        d = doc[i]
        lo, hi = max(bounds[d], i - WINDOW), min(bounds[d + 1], i + WINDOW + 1)
        around = [raw[start[j] : end[j]].decode("utf-8", "replace") for j in range(lo, hi)]
        total[d] += weight[inv[i]] * _context(around, i - lo)
    return 1 - np.exp(-total)


_MEMORY: dict = {}


def _thin() -> None:
    """Between tasks a worker keeps the words that it met first, by far the commonest among them."""
    memory = _MEMORY.get("memory", {})
    _MEMORY["memory"] = dict(islice(memory.items(), KEPT))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", sample_rows: int = 8000, threshold: float = 0.7, modulus: int = 3, held_out: int = 1, with_hash: bool = False) -> DataFrame:
    """(id, held_out, score, predicted) of every whole text; with_hash: also text_hash, xxhash64 of the text.

    The lexicon is learned from at most sample_rows labelled rows whose crc32(id as text) mod
    ``modulus`` is not ``held_out``; only texts are inputs of a score. Terms have LEAST letters and more, and a word of
    FUZZY_LEAST letters and more matches a whole term with one edit; what has two edits isn't caught. Null, empty and wordless texts
    score 0; very long ones are batches of their own. With no labels the lexicon is the seed alone. Repeated rows each give a row;
    other columns are ignored, whatever their names; an empty table gives an empty one.
    """
    terms, known = learn(materialize(sample(docs, labels, label, remainder(id_col, modulus) != held_out, sample_rows, id_col, text_col, positive=0.25), "sampled"))
    name = hash((tuple(sorted(terms.items())), known))
    shared = docs.sparkSession.sparkContext.broadcast((terms, known))  # bounded by the sample
    more = ["text_hash"] if with_hash else []
    schema = T.StructType([docs.schema[id_col], *(T.StructField(c, T.LongType()) for c in more), T.StructField("score", T.DoubleType())])

    def score(batches):
        if _MEMORY.get("name") != name:
            _MEMORY.update(name=name, trie=Trie(*shared.value), memory={})
        for part in by_bytes(batches, 1, 4 << 20):
            yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(score_texts(part.column(1), _MEMORY["trie"], _MEMORY["memory"]))], schema.names)

    out = map_arrow(docs.select(id_col, text_col, *[F.xxhash64(text_col).alias(c) for c in more]), score, schema, _thin)
    return out.select(id_col, (remainder(id_col, modulus) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *more)
