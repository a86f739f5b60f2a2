"""Vector bin packing of token pieces under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import by_bytes, give_back, map_arrow
from quillon.llm.encoder import ENCODE_BYTES, encoder, forget


def dot_product_pack(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> np.ndarray:
    """Bin of each item. A bin takes, again and again, the fitting item whose demand has the largest
    dot product with what the bin has left (tokens, one segment, loss tokens, each as a share of its limit).

    Items with equal demand are one class with a count, so a step costs the number of distinct demands.
    """
    order = np.lexsort((loss, tokens))[::-1]
    t, lo = tokens[order], loss[order]
    first = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (lo[1:] != lo[:-1]))))[: len(t)]
    need = np.stack([t[first], np.ones(len(first), np.int64), lo[first]], 1)
    if len(need) and (need > np.array(limits)).any():
        raise ValueError("an item exceeds the limits of an empty bin")
    left = np.diff(np.append(first, len(t)))
    used = np.zeros(len(first), np.int64)
    share = need / np.array(limits, float)
    out = np.empty(len(t), np.int64)
    b, todo = -1, len(t)
    while todo:
        b += 1
        room = np.array(limits)
        while True:
            fits = (need <= room).all(1) & (left > 0)
            if not fits.any():
                break
            k = int(np.argmax(np.where(fits, share @ (room / limits), -1.0)))
            n = 1  # as many of this class as stay the best choice are rarely more than one
            out[order[first[k] + used[k]]] = b
            used[k] += n
            left[k] -= n
            todo -= n
            room = room - need[k]
    return out


def cut(off: np.ndarray, cum: np.ndarray, limits: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start in all ids, length) of pieces, each the longest that keeps the limits on tokens and on loss tokens.

    off: bounds of the documents; cum[i]: loss-bearing ids before i. A piece's first id bears none, since nothing precedes it.
    """
    doc, s, out = np.flatnonzero(np.diff(off) > 0), off[:-1][np.diff(off) > 0], []
    while len(doc):
        e = np.searchsorted(cum, cum[s + 1] + limits[2], "right") - 1
        e = np.minimum(np.minimum(e, s + limits[0]), off[doc + 1])
        out.append((doc, s, e - s))
        more = e < off[doc + 1]
        doc, s = doc[more], e[more]
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z
    return tuple(np.concatenate([x[i] for x in out]) for i in range(3))


def plan(off: np.ndarray, cum: np.ndarray, limits: tuple[int, int, int]):
    """(document, start, length, loss tokens, sequence, offset in it) of each piece, and the number of sequences."""
    most, most_segments, most_loss = limits
    doc, start, length = cut(off, cum, limits)
    loss = cum[start + length] - cum[start + 1] if len(start) else length
    whole = length == most
    count = int(whole.sum())
    placed = [(doc[whole], start[whole], length[whole], np.arange(count), np.zeros(count, np.int64))]
    doc, start, length, loss = doc[~whole], start[~whole], length[~whole], loss[~whole]
    bins = dot_product_pack(length, loss, limits)
    n_bins = int(bins.max()) + 1 if len(bins) else 0
    order = np.lexsort((-length, bins))
    doc, start, length, loss, bins = doc[order], start[order], length[order], loss[order], bins[order]
    tokens, segments = np.bincount(bins, length, n_bins).astype(np.int64), np.bincount(bins, minlength=n_bins)
    borne = np.bincount(bins, loss, n_bins).astype(np.int64)
    first = np.searchsorted(bins, np.arange(n_bins + 1))

    # bins that are not full: the pieces of the emptiest, cut freely, fill the others until the two meet
    loose = np.flatnonzero(tokens < most)
    loose = loose[np.argsort(-tokens[loose], kind="stable")].tolist()
    stay, extra, held, i = np.ones(n_bins, bool), [], [], 0
    while i < len(loose):
        b = loose[i]
        gap, room, free = most - int(tokens[b]), most_loss - int(borne[b]), most_segments - int(segments[b])
        while gap > 0 and free > 0:
            if not held:
                if len(loose) == i + 1:
                    break
                j = loose.pop()
                stay[j] = False
                held = [(int(doc[k]), int(start[k]), int(length[k])) for k in range(first[j], first[j + 1])]
            d, g, n = held[-1]
            by_loss = int(np.searchsorted(cum, cum[g + 1] + room, "right")) - 1 - g
            take = min(gap, n, by_loss)
            if take < min(gap, n, 32):  # no room for loss: not worth a segment
                break
            held.pop()
            extra.append((d, g, take, b, most - gap))
            if take < n:
                held.append((d, g + take, n - take))
            gap, room, free = gap - take, room - int(cum[g + take] - cum[g + 1]), free - 1
        i += 1
    if not held and stay.any() and loose and tokens[b := loose[-1]] < most and stay[b] and not any(x[3] == b for x in extra):
        stay[b] = False  # one last bin that is not full
        held = [(int(doc[k]), int(start[k]), int(length[k])) for k in range(first[b], first[b + 1])]

    new = np.cumsum(stay) - 1 + count
    keep = stay[bins]
    at = np.cumsum(length) - length
    at = at - at[first[:-1]][bins] if len(bins) else at
    placed.append((doc[keep], start[keep], length[keep], new[bins[keep]], at[keep]))
    count += int(stay.sum())
    extra = [(d, g, n, int(new[b]), o) for d, g, n, b, o in extra]

    # the rest goes into sequences of a power of two tokens, which need no padding
    while held:
        fits, room = 0, most_loss
        for d, g, n in held[::-1][:most_segments]:
            by_loss = int(np.searchsorted(cum, cum[g + 1] + room, "right")) - 1 - g
            fits += (take := min(n, by_loss, most - fits))
            room -= int(cum[g + take] - cum[g + 1])
            if take < n:
                break
        size, used = 1 << (fits.bit_length() - 1), 0
        while used < size:
            d, g, n = held.pop()
            take = min(size - used, n)
            extra.append((d, g, take, count, used))
            used += take
            if take < n:
                held.append((d, g + take, n - take))
        count += 1
    if extra:
        placed.append(tuple(np.array(x, np.int64) for x in zip(*extra, strict=True)))
    doc, start, length, seq, at = (np.concatenate([np.asarray(p[i], np.int64) for p in placed]) for i in range(5))
    return doc, start, length, (cum[start + length] - cum[start + 1]).astype(np.int64) if len(start) else length, seq, at, count


def pack_documents(docs: DataFrame, tokenizer: str, spaces: bool, end_id: int, id_col: str = "doc_id", text_col: str = "text", parts_col: str | None = None, max_tokens: int = 2048, max_segments: int = 512, max_loss: int | None = None, group_tokens: int = 2_000_000, with_ids: bool = True) -> DataFrame:
    """Pieces of documents placed in sequences of at most max_tokens tokens, max_segments pieces and max_loss loss-bearing
    tokens; a row for each piece.

    Returns (id, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset, ids unless with_ids is False). A
    document is its ids, then end_id. Which of them bear loss: with parts_col (array of struct<text, loss>), those of its
    parts with loss (end_id as the last part), each part encoded alone; else all. A piece's first id bears none, since
    nothing precedes it in its segment; so for whole texts the default max_loss (max_tokens) follows from the limit on tokens.

    A document is cut where a piece would pass the limits; pieces of max_tokens are sequences of their own, the others
    are packed within groups of about group_tokens by the dot-product rule. Sequences that would stay part empty take the
    pieces of the emptiest, cut freely within all three limits; what remains at the end of a group is cut into powers of two,
    which need no padding. sequence_id is unique over all input. A null or empty text, or a null or empty array of parts, is its
    end_id alone. Repeated rows are documents of their own; other columns are ignored; an empty table gives an empty one.
    """
    max_loss = max_tokens if max_loss is None else max_loss
    if min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("limits are positive")
    fields = [docs.schema[id_col], *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset")), *([T.StructField("ids", T.BinaryType())] if with_ids else [])]
    schema = T.StructType([f for i, f in enumerate(fields) if i == 0 or f.name != id_col])
    limits = (max_tokens, max_segments, max_loss)

    def encoded(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(ids, bounds of documents, whether each id bears loss or None for all), end ids among them."""
        enc = encoder(tokenizer, spaces)
        if parts_col is None:
            ids, off = enc.encode(part.column(1))
            return np.insert(ids, off[1:], end_id), off + np.arange(len(off)), None
        lists = part.column(1).combine_chunks() if isinstance(part.column(1), pa.ChunkedArray) else part.column(1)
        flat = lists.flatten()
        n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
        ends = np.concatenate(([0], np.cumsum(n)))
        ids, each = enc.encode(pc.struct_field(flat, "text"))
        marked = np.asarray(pc.fill_null(pc.struct_field(flat, "loss"), False), bool)
        bears = np.repeat(marked, np.diff(each))
        off = each[ends]
        last = np.where(n > 0, marked[np.maximum(ends[1:], 1) - 1] if len(marked) else False, False)
        return np.insert(ids, off[1:], end_id), off + np.arange(len(off)), np.insert(bears, off[1:], last)

    def groups(batches):
        held, size = [], 0
        length = _parts_bytes if parts_col is not None else None
        for part in by_bytes(batches, 1, ENCODE_BYTES, length):
            held.append((part.column(0), *encoded(part)))
            size += len(held[-1][1])
            if size >= group_tokens:
                yield held
                give_back()
                held, size = [], 0
        if held:
            yield held

    def place(batches):
        base = TaskContext.get().partitionId() << 34
        for held in groups(batches):
            keys = pa.concat_arrays([h[0] for h in held])
            shift = np.cumsum([0] + [len(h[1]) for h in held])
            off = np.concatenate([h[2][:-1] + s for h, s in zip(held, shift[:-1], strict=True)] + [shift[-1:]])
            kind = np.int32 if shift[-1] < 2**31 - 1 else np.int64
            cum = np.arange(shift[-1] + 1, dtype=kind) if held[0][3] is None else np.concatenate(([0], np.concatenate([h[3] for h in held]))).cumsum(dtype=kind)
            ids = np.concatenate([h[1] for h in held])
            held.clear()
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            doc, start, length, loss, seq, at, count = plan(off, cum, limits)
            data = [raw[4 * i : 4 * (i + n)] for i, n in zip(start.tolist(), length.tolist(), strict=True)]
            crc = np.fromiter((zlib.crc32(x) for x in data), np.int64, len(data))
            cols = [keys.take(pa.array(doc)), start - off[doc], length, crc, np.diff(off)[doc], loss, seq + base, at] + [pa.array([bytes(x) for x in data] if with_ids else [], pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=schema.names)
            base += count

    return map_arrow(docs.select(id_col, text_col if parts_col is None else parts_col), place, schema, forget)


def _parts_bytes(col: pa.Array) -> np.ndarray:
    """Bytes of all texts of each row's parts."""
    each = np.concatenate(([0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(pc.struct_field(col.flatten(), "text")), 0), np.int64))))
    ends = np.concatenate(([0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(col), 0), np.int64))))
    return np.diff(each[ends])


def conversation_parts(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", bears: str = "assistant") -> DataFrame:
    """(conversation, parts) for pack_documents: a conversation's turns in order, those of one role bearing loss. A conversation is
    one training example and so one row; turns of equal number stand in the order of role and text; a null role bears none."""
    turn = F.struct(turn_col, F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    sorted_turns = F.array_sort(F.collect_list(turn))
    part = lambda t: F.struct(t["text"].alias("text"), F.coalesce(t["role"] == bears, F.lit(False)).alias("loss"))
    return turns.groupBy(conv_col).agg(sorted_turns.alias("parts")).select(conv_col, F.transform("parts", part).alias("parts"))
