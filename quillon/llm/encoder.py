"""Token ids of whole Arrow columns with the ``tokenizers`` library, each distinct pre-token encoded once.

A byte-pair model works on one pre-token at a time, so a text's ids are its pre-tokens'
ids one after another. Texts made of ordinary Latin characters are cut into pre-tokens
with numpy; a batch's distinct ones go through the library, and their ids are gathered
back. All other texts (other scripts, control characters, special tokens' strings) go through
the library whole. For counts, every text is cut into pre-tokens, those others by the library.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa

from quillon.llm.hashing import U64, segment_hashes

LIMIT = 0x250
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Contractions after an apostrophe, longest first.
TAILS = ("re", "ve", "ll", "s", "t", "m", "d")
CACHE = 500_000
#: Text that goes through an encoder at once.
ENCODE_BYTES = 1 << 20


def _classes() -> np.ndarray:
    kind = np.full(LIMIT, 255, np.uint8)
    for c in range(LIMIT):
        cat = unicodedata.category(chr(c))
        kind[c] = {"L": LETTER, "N": NUMBER}.get(cat[0], OTHER if cat[0] in "PS" else 255)
    kind[[0x20, 0x09, 0x0A, 0x0D]] = SPACE
    kind[0x130] = 255  # its lower case is two characters
    return kind


_KIND = _classes()
_LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < LIMIT else c for c in range(LIMIT)], np.uint16)
#: Letters whose lower case lies outside the table.
_KIND[[c for c in range(LIMIT) if len(chr(c).lower()) != 1 or ord(chr(c).lower()) >= LIMIT]] = 255


def _second(p: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Length and three characters of each pre-token, which show that two of one hash differ."""
    return (end - begin).astype(U64) << U64(32) | p[begin].astype(U64) | p[end - 1].astype(U64) << U64(10) | p[(begin + end) // 2].astype(U64) << U64(20)


class Encoder:
    """spaces: pre-tokens carry a leading space and white space is kept (byte-level BPE);
    else white space is dropped, letters are lower-cased and digits stand alone (BPE with word ends)."""

    def __init__(self, path: str, spaces: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.spaces = spaces
        self.to_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        #: Ids that begin (with a space) or end (at a word's end) a pre-token.
        self.edges = np.zeros(self.lib.get_vocab_size() + 1, bool)
        for t, i in self.lib.get_vocab().items():
            self.edges[i] = t.startswith("\u0120") if spaces else t.endswith("</w>")
        self._forget()

    def _forget(self):
        self.keys = np.zeros(0, U64)
        self.second = np.zeros(0, U64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _distinct(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of pre-tokens; most go through the library as one text that it cuts up again."""
        if self.spaces:
            joint = np.fromiter((len(t) > 1 and t[0] == " " and t[1:].isalpha() for t in pieces), bool, len(pieces))
        else:
            joint = np.ones(len(pieces), bool)
        size = np.zeros(len(pieces), np.int64)
        flat = self.lib.encode_batch_fast([("" if self.spaces else " ").join(t for t, j in zip(pieces, joint, strict=True) if j)], add_special_tokens=False)[0].ids
        flat = np.array(flat, np.uint32)
        edge = np.flatnonzero(self.edges[flat])
        n = np.diff(np.append(edge, len(flat))) if self.spaces else np.diff(edge, prepend=-1)
        if len(n) != int(joint.sum()):
            joint[:] = False
        else:
            size[joint] = n
        rest = np.flatnonzero(~joint)
        one = self._library([pieces[i] for i in rest])
        size[rest] = [len(x) for x in one]
        ids = np.empty(int(size.sum()), np.uint32)
        mask = np.repeat(joint, size)
        if joint.any():
            ids[mask] = flat
        ids[~mask] = np.fromiter((x for y in one for x in y), np.uint32, int((~mask).sum()))
        return ids, size

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which texts numpy can cut, and their code points."""
        ok, points = np.ones(len(texts), bool), []
        for i, t in enumerate(texts):
            p = np.frombuffer(t.encode("utf-32-le"), np.uint32)
            if any(s in t for s in self.special) or (len(p) and (int(p.max()) >= LIMIT or (_KIND[p] == 255).any())):
                ok[i] = False
            else:
                points.append(p.astype(np.uint16))
        return ok, points

    def _cut(self, p: np.ndarray, off: np.ndarray):
        """Starts and ends of the pre-tokens in code points p; off: text bounds."""
        n = len(p)
        kind = _KIND[p]
        prev = np.full(n, 254, np.uint8)
        prev[1:] = kind[:-1]
        edge = off[:-1][off[:-1] < n]
        prev[edge] = 254
        new = kind != prev
        if not self.spaces:
            new |= kind == NUMBER
        tail_start, tail_end = self._contractions(p, kind, prev, off)
        if not self.spaces:
            new[tail_start] = True
            new[tail_start + 1] = False
            new[tail_end[tail_end < n]] = True
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], n)
            keep = kind[begin] != SPACE
            return begin[keep], end[keep]
        # a last blank before a non-space joins what follows; other white space runs stand alone, less their last character
        nxt = np.full(n, 254, np.uint8)
        nxt[:-1] = kind[1:]
        nxt[edge[edge > 0] - 1] = 254
        last = (kind == SPACE) & (nxt != SPACE) & (nxt != 254)
        joins = last & (p == 32)
        new |= last
        follow = np.flatnonzero(joins) + 1
        new[follow] = False
        new[tail_start] = True
        new[tail_start + 1] = False
        new[tail_end[tail_end < n]] = True
        begin = np.flatnonzero(new)
        return begin, np.append(begin[1:], n)

    def _contractions(self, p, kind, prev, off):
        n = len(p)
        at = np.flatnonzero(p == 39)
        at = at[prev[at] != OTHER]
        if self.spaces and len(at):
            before = np.where(at > 0, p[at - 1], 0)
            before[np.isin(at, off)] = 0
            at = at[before != 32]
        if not len(at):
            return at, at
        stop = off[np.searchsorted(off, at, "right")]
        fold = _LOWER if not self.spaces else np.arange(LIMIT, dtype=np.uint16)
        end = np.zeros(len(at), np.int64)
        for tail in TAILS:
            k = len(tail)
            fits = (end == 0) & (at + k < stop)
            for j, c in enumerate(tail, 1):
                fits &= fold[p[np.minimum(at + j, n - 1)]] == ord(c)
            end[fits] = at[fits] + 1 + k
        return at[end > 0], end[end > 0]

    def _known(self, p, begin, end):
        """For each pre-token, its place in the table of known ones; None if two share a hash."""
        h = segment_hashes(p, begin, end, 0)
        g = _second(p, begin, end)
        u, first, inv = np.unique(h, return_index=True, return_inverse=True)
        if (g[first][inv] != g).any():
            return None
        where = np.searchsorted(self.keys, u)
        have = np.zeros(len(u), bool)
        inside = where < len(self.keys)
        have[inside] = self.keys[where[inside]] == u[inside]
        if (self.second[where[have]] != g[first[have]]).any():
            return None
        fresh = np.flatnonzero(~have)
        if len(fresh):
            s, e = begin[first[fresh]], end[first[fresh]]
            if len(self.keys) and len(self.keys) + len(fresh) > CACHE:
                self._forget()
                return self._known(p, begin, end)
            whole = p.tobytes().decode("utf-16-le")
            ids, size = self._distinct([whole[i:j] for i, j in zip(s.tolist(), e.tolist(), strict=True)])
            at = np.cumsum(size) - size + len(self.ids)
            keys = np.concatenate([self.keys, u[fresh]])
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.second = np.concatenate([self.second, g[first[fresh]]])[order]
            self.at = np.concatenate([self.at, at])[order]
            self.size = np.concatenate([self.size, size])[order]
            self.ids = np.concatenate([self.ids, ids])
            where = np.searchsorted(self.keys, u)
        return where[inv]

    def _pieces(self, texts: list[str]):
        """(which texts are plain, text of each piece, place of each piece), or None for the whole list."""
        ok, points = self._plain(texts)
        if self.spaces:
            p = np.concatenate(points) if points else np.zeros(0, np.uint16)
        else:
            p = _LOWER[np.concatenate(points)] if points else np.zeros(0, np.uint16)
        off = np.concatenate(([0], np.cumsum([len(x) for x in points]))).astype(np.int64)
        if not len(p):
            z = np.zeros(0, np.int64)
            return ok, z, z
        begin, end = self._cut(p, off)
        if not len(begin):
            z = np.zeros(0, np.int64)
            return ok, z, z
        place = self._known(p, begin, end)
        if place is None:
            return None
        return ok, np.searchsorted(off, begin, "right") - 1, place

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a column of texts; null counts as empty."""
        texts = [t or "" for t in col.to_pylist()]
        got = self._pieces(texts)
        if got is None:
            ids = self._library(texts)
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter((x for y in ids for x in y), np.uint32, int(size.sum())), np.concatenate(([0], np.cumsum(size)))
        ok, doc, place = got
        n = self.size[place]
        total = np.zeros(len(texts), np.int64)
        plain = np.flatnonzero(ok)
        total[plain] = np.bincount(doc, weights=n, minlength=len(plain)).astype(np.int64)[: len(plain)]
        rest = np.flatnonzero(~ok)
        whole = self._library([texts[i] for i in rest])
        total[rest] = [len(x) for x in whole]
        off = np.concatenate(([0], np.cumsum(total)))
        out = np.empty(int(off[-1]), np.uint32)
        ends = np.cumsum(n)
        src = np.repeat(self.at[place] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        if not len(rest):
            out[:] = self.ids[src]
        else:
            mask = np.repeat(ok, total)
            out[mask] = self.ids[src]
            for i, x in zip(rest, whole, strict=True):
                out[off[i] : off[i + 1]] = x
        return out, off

    def pieces(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """(text of each pre-token, its place among the distinct ones, the distinct ones, special tokens of each text).

        Texts that numpy can't cut go through the library's own normaliser and pre-tokeniser, after their special strings are
        taken out, as the library does.
        """
        texts = [t or "" for t in col.to_pylist()]
        ok, points = self._plain(texts)
        flat = np.concatenate(points) if points else np.zeros(0, np.uint16)
        p = flat if self.spaces else _LOWER[flat]
        off = np.concatenate(([0], np.cumsum([len(x) for x in points]))).astype(np.int64)
        begin, end = self._cut(p, off) if len(p) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        doc = np.flatnonzero(ok)[np.searchsorted(off, begin, "right") - 1] if len(begin) else begin
        whole = p.tobytes().decode("utf-16-le")
        h = segment_hashes(p, begin, end, 0)
        g = _second(p, begin, end)
        _, first, place = np.unique(h, return_index=True, return_inverse=True)
        if (g[first][place] != g).any():  # two pre-tokens share a hash: by their strings
            names: dict[str, int] = {}
            place = np.array([names.setdefault(whole[i:j], len(names)) for i, j in zip(begin.tolist(), end.tolist(), strict=True)], np.int64)
            distinct = list(names)
        else:
            distinct = [whole[i:j] for i, j in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
        special = np.zeros(len(texts), np.int64)
        rest = np.flatnonzero(~ok)
        if len(rest):
            names = {t: i for i, t in enumerate(distinct)}
            docs, places = [], []
            for d in rest.tolist():
                parts = self.split_special.split(texts[d]) if self.split_special else [texts[d]]
                special[d] = len(parts) - 1
                for part in parts:
                    t = self.lib.normalizer.normalize_str(part) if self.lib.normalizer else part
                    for _, (i, j) in self.lib.pre_tokenizer.pre_tokenize_str(t):
                        docs.append(d)
                        places.append(names.setdefault(t[i:j], len(names)))
            distinct = list(names)
            doc, place = np.concatenate([doc, np.array(docs, np.int64)]), np.concatenate([place, np.array(places, np.int64)])
        return doc, place, distinct, special

    def lengths(self, pieces: list[str]) -> np.ndarray:
        """Number of ids of each pre-token; no ids are kept."""
        plain = np.fromiter((p.isalnum() and p.isascii() or self._plain([p])[0][0] for p in pieces), bool, len(pieces))
        out = np.zeros(len(pieces), np.int64)
        if plain.any():
            out[plain] = self._distinct([p for p, x in zip(pieces, plain.tolist(), strict=True) if x])[1]
        for i in np.flatnonzero(~plain).tolist():  # past the normaliser, which has seen it
            out[i] = sum(len(self.lib.model.tokenize(b)) for b, _ in self.to_bytes.pre_tokenize_str(pieces[i]))
        return out


def encoder(path: str, spaces: bool) -> Encoder:
    """The Python worker's encoder of this file, loaded once."""
    held = sys.modules[__name__].__dict__.setdefault("_HELD", {})
    if (path, spaces) not in held:
        held.clear()
        held[path, spaces] = Encoder(path, spaces)
    return held[path, spaces]


def forget() -> None:
    """Drop the worker's table of known pre-tokens; the library stays loaded."""
    for e in sys.modules[__name__].__dict__.get("_HELD", {}).values():
        e._forget()
