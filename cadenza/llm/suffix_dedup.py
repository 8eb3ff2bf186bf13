"""Removal of byte strings that an earlier document also holds, by sorted suffixes.

Every window of `span` bytes holds at least one anchor: a place whose hashed neighbourhood is the least of some window,
so equal windows hold equal anchors at equal places. What the windows around one anchor can share is decided by its
context, the bytes up to a window's length to either side. Documents are dealt into groups of equal bytes by ranges of
doc_id; an earlier group therefore holds smaller ids. Then

1. each group sends its distinct (anchor, context) hashes to a bucket of the anchor;
2. the bucket tells a group which of its contexts an earlier group has whole, and which share only the anchor;
3. of the latter, the first group sends the text, and a bucket sorts the windows as suffixes: equal windows of an
   earlier group mark the bytes;
4. each group resolves its own documents in the same way, applies both, and cuts.

Whole contexts count as equal if 88 bits of hash are; suffixes are sorted where texts begin to differ. The sort is
deep-shallow: a multikey quicksort to a shallow depth, with eight bytes for a key and all groups refined at once, then
blind tries, built one leaf path a round, for groups that still agree. Anchors with many contexts (the edges of a passage
that a large share of documents hold) send their windows one by one, dealt by their own bytes; a group in which an anchor
has many announces it in one row. Both ways mark the same bytes, since both compare all windows around the anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.llm.common import lean, mix, on_disk, utf8_lists
from cadenza.llm.subword import spread
from cadenza.llm.words import blocks, factors

SPAN, ANCHOR = 50, 24
SIDE = SPAN - ANCHOR
#: A context row: SIDE bytes, the anchor, SIDE bytes, how many of either side are inside the document, whether only one
#: window is left of it, a spare byte.
ROW = SPAN + SIDE + 4
SHALLOW = 16
#: Bytes of text in a group, anchors and contexts in a bucket, contexts whose windows are sorted at once.
GROUP, BUCKET, CHUNK = 4e6, 300_000, 10_000
#: Groups, whatever the corpus (their bounds are broadcast, 8 bytes each; beyond that, groups grow), groups in a range of
#: doc_id that one task cuts up (more if there would be over MOST_RANGES), bytes of text in a shuffle partition of groups.
MOST_GROUPS, RANGE, MOST_RANGES, PARTITION = 1_000_000, 16, 2_000, 16e6
#: What a null doc_id is coded as.
NULL_ID = -(2**63)
#: An anchor with more contexts than this sends its distinct windows one by one; one with more than the second in one group
#: is announced by the group in one row, whose context is MARK.
WIDE, NARROW = 2_000, 128
MARK = np.uint64(2**40 - 1)
LAST = np.uint64(2**64 - 1)


def changes(x: np.ndarray) -> np.ndarray:
    """True where a value differs from the one before it, and at the start."""
    out = np.ones(len(x), bool)
    out[1:] = x[1:] != x[:-1]
    return out


# ---- sorting -------------------------------------------------------------------------------------------------------


def _refine(slot: np.ndarray, active: np.ndarray, key: np.ndarray, done: int | None = None) -> np.ndarray:
    """Split the groups of active suffixes by key; returns those that still share a group, without key `done`."""
    order = np.lexsort((key, slot[active])) if slot[active[0]] != slot[active[-1]] or (slot[active] != slot[active[0]]).any() else np.argsort(key, kind="stable")
    a, k = active[order], key[order]
    s = slot[a]
    parent = changes(s)
    child = parent | changes(k)
    i = np.arange(len(a))
    begin = np.maximum.accumulate(np.where(child, i, 0))
    slot[a] = s + begin - np.maximum.accumulate(np.where(parent, i, 0))
    many = ~child | np.append(~child[1:], False)
    return a[many if done is None else many & (k != done)]


def deep_shallow(text: np.ndarray, starts: np.ndarray, depth: int, shallow: int = SHALLOW) -> np.ndarray:
    """The place of each suffix text[start:start+depth] in sorted order; equal ones share the first place of their run.

    text must go on for depth+8 bytes after the last start.
    """
    n = len(starts)
    slot = np.zeros(n, np.int64)
    if n < 2:
        return slot
    words = np.ndarray((len(text) - 7,), ">u8", np.ascontiguousarray(text), 0, (1,))
    active, at = np.arange(n), 0
    while at < min(shallow, depth) and len(active):  # multikey quicksort
        key = words[starts[active] + at].astype(np.uint64)
        if depth - at < 8:
            key >>= np.uint64(8 * (8 - depth + at))
        active = _refine(slot, active, key)
        at += 8
    lanes = -(-max(0, depth - at) // 8)
    spare = np.uint64(8 * (lanes * 8 - (depth - at)))
    equal = 1 << 20
    while len(active) and lanes:  # blind tries: one leaf of each group's trie, and where the others leave its path
        active = active[np.argsort(slot[active], kind="stable")]
        s = slot[active]
        leaf = np.maximum.accumulate(np.where(changes(s), np.arange(len(active)), 0))
        lcp = np.full(len(active), depth)
        byte = np.zeros(len(active), np.int64)
        less = np.zeros(len(active), bool)
        left = np.arange(len(active))
        for lane in range(lanes):
            x = words[starts[active[left]] + at + 8 * lane].astype(np.uint64)
            y = words[starts[active[leaf[left]]] + at + 8 * lane].astype(np.uint64)
            if lane == lanes - 1:
                x, y = x >> spare << spare, y >> spare << spare
            differs = x != y
            if differs.any():
                z, x, y = (x ^ y)[differs], x[differs], y[differs]
                first = 7 - (np.frexp((z >> np.uint64(1)).astype(np.float64) * 2 + 1)[1] - 1) // 8
                first = np.clip(first, 0, 7)
                # the float may round up to the next byte: step on where that byte is equal
                first += ((z >> ((7 - first) * 8).astype(np.uint64)) & np.uint64(255)) == 0
                who = left[differs]
                lcp[who] = at + 8 * lane + first
                byte[who] = (x >> ((7 - first) * 8).astype(np.uint64)) & np.uint64(255)
                less[who] = x < y
                left = left[~differs]
            if not len(left):
                break
        key = np.where(lcp == depth, equal, np.where(less, lcp * 256 + byte, 2 * equal + (depth - lcp) * 256 + byte))
        active = _refine(slot, active, key, equal)
    return slot


# ---- anchors and contexts ------------------------------------------------------------------------------------------


def _slide(a: np.ndarray, w: int, f: Callable) -> np.ndarray:
    m, s = a, 1
    while s * 2 <= w:
        m, s = f(m[:-s], m[s:]), s * 2
    n = len(a) - w + 1
    return f(m[:n], m[w - s : w - s + n]) if s < w else m


def anchors(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of every text, ascending, and their hashes."""
    places, hashes = [], []
    w = SIDE + 1
    for i, j in blocks(offsets, 1 << 18):
        lo, hi = int(offsets[i]), int(offsets[j])
        n = hi - lo
        if n < SPAN:
            continue
        v = np.ndarray((n + 8,), "<u8", raw[lo:hi] + b"\0" * 32, 0, (1,))
        m = n - ANCHOR + 1
        h = v[:m] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += v[8 : 8 + m]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        h += v[16 : 16 + m]
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(30)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h[h == LAST] = LAST - np.uint64(1)
        ends = (offsets[i + 1 : j + 1] - lo).astype(np.int64)
        begins = (offsets[i:j] - lo).astype(np.int64)
        bad = spread(np.maximum(begins, ends - ANCHOR + 1), ends - np.maximum(begins, ends - ANCHOR + 1))
        h[bad[bad < m]] = LAST
        least = _slide(h, w, np.minimum)  # one for each window
        out = spread(np.maximum(begins, ends - SPAN + 1), ends - np.maximum(begins, ends - SPAN + 1))
        least[out[out < len(least)]] = 0
        pad = np.zeros(SIDE, np.uint64)
        at = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), w, np.maximum)[:m] == h)
        places.append(at + lo)
        hashes.append(h[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(hashes)


def context_rows(padded: np.ndarray, places: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Context rows of anchors; padded is the text after 32 and before 64 zero bytes."""
    rows = np.zeros((len(places), ROW), np.uint8)
    rows[:, : SPAN + SIDE] = padded[(places + (32 - SIDE))[:, None] + np.arange(SPAN + SIDE)]
    few = np.flatnonzero((left < SIDE) | (right < SIDE))
    if len(few):
        cols = np.arange(SPAN + SIDE)
        rows[few, : SPAN + SIDE] *= (cols >= SIDE - left[few][:, None]) & (cols < SPAN + right[few][:, None])
    rows[:, SPAN + SIDE] = left
    rows[:, SPAN + SIDE + 1] = right
    return rows


def row_hashes(rows: np.ndarray) -> np.ndarray:
    lanes = np.ascontiguousarray(rows).view("<u8")
    h = np.zeros(len(rows), np.uint64)
    for k, f in enumerate(factors(lanes.shape[1])):
        h = mix(h + lanes[:, k] * f) if k % 5 == 4 else h + lanes[:, k] * f
    return mix(h)


class Group:
    """The texts of one group with their anchors; order gives the rank of each text's doc_id."""

    def __init__(self, texts: pa.ChunkedArray):
        self.raw, self.offsets = utf8_lists(texts)
        self.padded = np.frombuffer(b"\0" * 32 + self.raw + b"\0" * 64, np.uint8)
        self.at, h = anchors(self.raw, self.offsets)
        self.doc = np.searchsorted(self.offsets, self.at, side="right") - 1
        self.left = np.minimum(self.at - self.offsets[self.doc], SIDE)
        self.right = np.minimum(self.offsets[self.doc + 1] - self.at - ANCHOR, SIDE)
        self.anchor = h >> np.uint64(16)
        self.context = np.empty(len(h), np.uint64)
        for i in range(0, len(h), 50_000):
            s = slice(i, i + 50_000)
            self.context[s] = np.minimum(row_hashes(context_rows(self.padded, self.at[s], self.left[s], self.right[s])) >> np.uint64(24), MARK - np.uint64(1))

    def rows(self, which: np.ndarray) -> np.ndarray:
        return context_rows(self.padded, self.at[which], self.left[which], self.right[which])


def pack(anchor: np.ndarray, context: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Six bytes of anchor, five of context, then bytes of more; a row each."""
    n = len(anchor)
    a = np.ascontiguousarray(anchor, "<u8").view(np.uint8).reshape(n, 8)[:, :6]
    c = np.ascontiguousarray(context, "<u8").view(np.uint8).reshape(n, 8)[:, :5]
    return np.concatenate([a, c, *[(m if m.ndim > 1 else m[:, None]).astype(np.uint8) for m in more]], 1)


def unpack(blobs: list[bytes], more: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What pack() made: anchor, context, the further bytes, and the number of the blob that each row came from."""
    flat = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 11 + more)
    out = np.zeros((2, len(flat), 8), np.uint8)
    out[0, :, :6], out[1, :, :5] = flat[:, :6], flat[:, 6:11]
    of = np.repeat(np.arange(len(blobs)), [len(b) // (11 + more) for b in blobs])
    return out[0].reshape(-1).view("<u8"), out[1].reshape(-1).view("<u8"), flat[:, 11:], of


def bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def window_spans(rows: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each context row the first and the last window that a row of a smaller owner also has (first > last: none).

    Windows of a row begin at bytes SIDE-left to right of it. All windows are sorted as suffixes of the rows' text.
    """
    n = len(rows)
    first, last = np.full(n, SIDE + 1), np.full(n, -1)
    left, right = rows[:, SPAN + SIDE].astype(np.int64), rows[:, SPAN + SIDE + 1].astype(np.int64)
    count = np.maximum(left + right - SIDE + 1, 0)
    of = np.repeat(np.arange(n), count)
    starts = spread(np.arange(n) * ROW + SIDE - left, count)
    if not len(starts):
        return first, last
    slot = deep_shallow(np.append(rows.reshape(-1), np.zeros(SPAN + 16, np.uint8)), starts, SPAN)
    least = np.full(len(starts), np.iinfo(np.int64).max)
    np.minimum.at(least, slot, owner[of])
    dup = np.flatnonzero(least[slot] < owner[of])
    o = starts[dup] - of[dup] * ROW
    np.minimum.at(first, of[dup], o)
    np.maximum.at(last, of[dup], o)
    return first, last


def chunks(anchor: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of about `size` rows, sorted by anchor, that keep an anchor's rows together."""
    if not len(anchor):
        return
    begins = np.flatnonzero(changes(anchor))
    i = 0
    while i < len(anchor):
        k = np.searchsorted(begins, i + size)
        j = int(begins[k]) if k < len(begins) else len(anchor)
        j = j if j > i else len(anchor)
        yield i, j
        i = j


# ---- the steps -----------------------------------------------------------------------------------------------------


def _emit(bucket: np.ndarray, rows: np.ndarray, key: str, g: int | None = None, extra: int | None = None) -> pa.Table:
    """One blob for each bucket; rows are in the order of their buckets."""
    cut = np.flatnonzero(changes(bucket))
    ends = np.append(cut[1:], len(bucket))[: len(cut)]
    cols = {key: pa.array(bucket[cut], pa.int64())}
    if g is not None:
        cols["g"] = pa.array(np.full(len(cut), g), pa.int64())
    if extra is not None:
        cols["kind"] = pa.array(np.full(len(cut), extra), pa.int32())
    cols["rows"] = pa.array([rows[a:b].tobytes() for a, b in zip(cut.tolist(), ends.tolist(), strict=True)], pa.binary())
    return pa.table(cols)


def _announce(buckets: int, narrow: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        group = Group(t.column("text"))
        order = np.lexsort((group.context, group.anchor))
        a, c = group.anchor[order], group.context[order]
        new = changes(a) | changes(c)
        a, c = a[new], c[new]
        head = changes(a)
        if len(a):
            size = np.bincount(np.cumsum(head) - 1)[np.cumsum(head) - 1]
            c[size > narrow] = MARK
            keep = (size <= narrow) | head
            a, c = a[keep], c[keep]
        return _emit(bucket_of(a, buckets), pack(a, c), "bucket", t.column("g")[0].as_py())

    return run


#: Kinds of answers to a group: an earlier group has the context; send the context; send its windows; a span of the
#: context is shared; a window is shared.
WHOLE, SEND, SEND_WINDOWS, PART, WINDOW = 0, 1, 2, 3, 4


def _answer(wide: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        a, c, _, of = unpack(t.column("rows").to_pylist())
        g = t.column("g").to_numpy()[of]
        order = np.lexsort((g, c, a))
        a, c, g = a[order], c[order], g[order]
        n = len(a)
        new_a = changes(a)
        new_c = new_a | changes(c)
        run_a = np.cumsum(new_a) - 1
        begins = np.flatnonzero(new_a)
        contexts = np.add.reduceat(new_c.astype(np.int64), begins)[run_a]
        several = (np.maximum.reduceat(g, begins) != np.minimum.reduceat(g, begins))[run_a]
        kind = np.full(n, -1)
        kind[~new_c] = WHOLE
        kind[new_c & several & (contexts > 1)] = SEND
        many = np.logical_or.reduceat(c == MARK, begins)[run_a] | (contexts > wide)
        kind[new_c & several & many] = SEND_WINDOWS
        kind[(c == MARK) & several] = SEND_WINDOWS
        kind[(c == MARK) & ~several] = -1
        out = []
        for k in (WHOLE, SEND, SEND_WINDOWS):
            which = np.flatnonzero(kind == k)
            which = which[np.argsort(g[which], kind="stable")]
            none = np.zeros((len(which), 2), np.uint8)
            out.append(_emit(g[which], pack(a[which], c[which], none), "g", None, k))
        return pa.concat_tables(out)

    return run


def _find(group: Group, a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every occurrence in the group of the given (anchor, context) keys: occurrence, key number. Keys may repeat."""
    if not len(a) or not len(group.anchor):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hit = np.flatnonzero(np.isin(group.anchor, a))
    own = np.stack([group.anchor[hit], group.context[hit]], 1)
    every = np.concatenate([own, np.stack([a, c], 1)])
    number = _numbers(every)
    mine, keys = number[: len(hit)], number[len(hit) :]
    order = np.argsort(keys, kind="stable")
    lo, hi = np.searchsorted(keys[order], mine), np.searchsorted(keys[order], mine, side="right")
    return np.repeat(hit, hi - lo), order[spread(lo, hi - lo)]


def _numbers(pairs: np.ndarray) -> np.ndarray:
    """Equal rows of two columns get equal numbers."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    p = pairs[order]
    new = np.append(True, (p[1:] != p[:-1]).any(1))
    out = np.empty(len(pairs), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def windows_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every window of the context rows as a row with only its own bytes left: rows, their hashes, and where they came from."""
    lo, hi = SIDE - rows[:, -4].astype(np.int64), rows[:, -3].astype(np.int64)
    count = np.maximum(hi - lo + 1, 0)
    o, of = spread(lo, count), np.repeat(np.arange(len(rows)), count)
    out = rows[of]
    cols = np.arange(SPAN + SIDE)
    out[:, : SPAN + SIDE] *= (cols >= o[:, None]) & (cols < o[:, None] + SPAN)
    out[:, -4], out[:, -3], out[:, -2] = SIDE - o, o, 1
    return out, row_hashes(out) >> np.uint64(24), of


def _send(buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"bucket": pa.array([], pa.int64()), "g": pa.array([], pa.int64()), "rows": pa.array([], pa.binary())})
        if not left.num_rows or not right.num_rows:
            return empty
        g = left.column("g")[0].as_py()
        group = Group(left.column("text"))
        kinds = right.column("kind").to_numpy()
        a, c, _, of = unpack(right.column("rows").to_pylist(), 2)
        out = []
        for kind in (SEND, SEND_WINDOWS):
            mine = np.flatnonzero(kinds[of] == kind)
            hit, key = _find(group, a[mine], c[mine])
            first = np.unique(key, return_index=True)[1]
            hit = hit[first]
            marked = a[mine][c[mine] == MARK]
            if len(marked):  # every context of these
                every = np.flatnonzero(np.isin(group.anchor, marked))
                order = np.lexsort((group.context[every], group.anchor[every]))
                every = every[order]
                hit = np.append(hit, every[changes(group.anchor[every]) | changes(group.context[every])])
            if not len(hit):
                continue
            rows, anchor, context = group.rows(hit), group.anchor[hit], group.context[hit]
            if kind == SEND:
                to = bucket_of(anchor, buckets)
            else:  # its distinct windows, dealt by their own bytes
                parts = []
                for i in range(0, len(rows), 2000):
                    w, h, of = windows_of(rows[i : i + 2000])
                    once = np.unique(h, return_index=True)[1]
                    parts.append((w[once], anchor[i : i + 2000][of[once]], h[once]))
                rows, anchor, context = (np.concatenate(x) for x in zip(*parts, strict=True))
                once = np.unique(context, return_index=True)[1]
                rows, anchor, context = rows[once], anchor[once], context[once]
                to = (context % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((anchor, to))
            out.append(_emit(to[order], pack(anchor[order], context[order], rows[order]), "bucket", g))
        return pa.concat_tables(out) if out else empty

    return run


def _compare(t: pa.Table) -> pa.Table:
    a, c, rows, of = unpack(t.column("rows").to_pylist(), ROW)
    g = t.column("g").to_numpy()[of]
    order = np.argsort(a, kind="stable")
    a, c, g, rows = a[order], c[order], g[order], rows[order]
    first, last = np.full(len(a), SIDE + 1), np.full(len(a), -1)
    for i, j in chunks(a):
        first[i:j], last[i:j] = window_spans(np.ascontiguousarray(rows[i:j]), g[i:j])
    alone = rows[:, -2] == 1
    out = []
    for kind in (PART, WINDOW):
        which = np.flatnonzero((first <= last) & (alone == (kind == WINDOW)))
        which = which[np.argsort(g[which], kind="stable")]
        out.append(_emit(g[which], pack(a[which], c[which], first[which], last[which]), "g", None, kind))
    return pa.concat_tables(out)


def cuts(group: Group, rank: np.ndarray, a: np.ndarray, c: np.ndarray, kinds: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """True for each byte of the group to remove. rank: of each text's doc_id; the rest: what earlier groups have."""
    n = len(group.at)
    first, last = np.full(n, SIDE + 1), np.full(n, -1)
    lo, hi = SIDE - group.left, group.right
    # earlier groups
    mine = np.flatnonzero((kinds == WHOLE) | (kinds == PART))
    hit, key = _find(group, a[mine], c[mine])
    whole = kinds[mine][key] == WHOLE
    np.minimum.at(first, hit, np.where(whole, lo[hit], spans[mine][key, 0]))
    np.maximum.at(last, hit, np.where(whole, hi[hit], spans[mine][key, 1]))
    wide = np.flatnonzero(kinds == WINDOW)
    if len(wide):  # windows were answered for by their own hashes
        occ = np.flatnonzero(np.isin(group.anchor, a[wide]))
        for i in range(0, len(occ), 2000):
            _, h, of = windows_of(group.rows(occ[i : i + 2000]))
            which = np.flatnonzero(np.isin(h, c[wide]))
            if not len(which):
                continue
            pairs = np.stack([np.append(group.anchor[occ[i + of[which]]], a[wide]), np.append(h[which], c[wide])], 1)
            number = _numbers(pairs)
            shared = which[np.isin(number[: len(which)], number[len(which) :])]
            at = occ[i + of[shared]]
            o = shared - np.searchsorted(of, of[shared]) + lo[at]
            np.minimum.at(first, at, o)
            np.maximum.at(last, at, o)
    # this group's own texts
    if n:
        order = np.lexsort((rank[group.doc], group.context, group.anchor))
        sa, sc, sr = group.anchor[order], group.context[order], rank[group.doc[order]]
        new_a = changes(sa)
        new_c = new_a | changes(sc)
        begin_c = np.flatnonzero(new_c)
        run_c = np.cumsum(new_c) - 1
        later = sr > sr[begin_c][run_c]
        own = order[later]
        first[own], last[own] = np.minimum(first[own], lo[own]), np.maximum(last[own], hi[own])
        begin_a = np.flatnonzero(new_a)
        run_a = np.cumsum(new_a) - 1
        mixed = (np.add.reduceat(new_c.astype(np.int64), begin_a) > 1) & (np.maximum.reduceat(sr, begin_a) != np.minimum.reduceat(sr, begin_a))
        heads = np.flatnonzero(new_c & mixed[run_a])
        f, l = np.full(len(heads), SIDE + 1), np.full(len(heads), -1)
        for i, j in chunks(sa[heads]):
            f[i:j], l[i:j] = window_spans(group.rows(order[heads[i:j]]), sr[heads[i:j]])
        # a head's span holds for the occurrences of its context in the same text
        to = np.full(len(begin_c), -1)
        to[run_c[heads]] = np.arange(len(heads))
        occ = np.flatnonzero(~later & (to[run_c] >= 0))
        k, own = to[run_c[occ]], order[occ]
        first[own], last[own] = np.minimum(first[own], f[k]), np.maximum(last[own], l[k])
    cover = np.zeros(len(group.raw) + 1, np.int32)
    dup = np.flatnonzero(first <= last)
    np.add.at(cover, group.at[dup] - SIDE + first[dup], 1)
    np.add.at(cover, group.at[dup] - SIDE + last[dup] + SPAN, -1)
    return np.cumsum(cover[:-1]) > 0


def _finish(make: Callable[[pa.Table, list[bytes], np.ndarray, Group, np.ndarray], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        group = Group(left.column("text"))
        a, c, spans, of = unpack(right.column("rows").to_pylist(), 2)
        kinds = right.column("kind").to_numpy()[of] if right.num_rows else np.zeros(0, np.int32)
        rank = np.unique(left.column("id").to_numpy(), return_inverse=True)[1]
        cut = cuts(group, rank, a, c, kinds, spans.astype(np.int64))
        total = np.append(0, np.cumsum(cut))
        removed = (total[group.offsets[1:]] - total[group.offsets[:-1]]).astype(np.int64)
        data = np.frombuffer(group.raw, np.uint8)
        kept = [data[i:j][~cut[i:j]].tobytes() for i, j in zip(group.offsets[:-1].tolist(), group.offsets[1:].tolist(), strict=True)]
        return make(left, kept, removed, group, cut)

    return run


def _bounds(docs: DataFrame, group_bytes: float) -> tuple[np.ndarray, int]:
    """The first ids of all groups but the first, ascending, and the bytes of all texts.

    Ids are sorted range by range, as narrow rows, and a group ends where its bytes are full; an id's rows stay together.
    """
    ids = on_disk(docs.groupBy("id").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")))
    total = ids.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    group_bytes = max(group_bytes, total / MOST_GROUPS)
    groups = -(-total // group_bytes)
    if groups <= 1:
        ids.unpersist()
        return np.zeros(0, np.int64), total
    ranges = int(min(MOST_RANGES, -(-groups // RANGE)))
    edges = sorted(set(ids.select(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or [])) if ranges > 1 else []
    of = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("id"))) if edges else F.lit(0)
    part = F.floor((F.sum("n").over(Window.partitionBy("r").orderBy("id")) - F.col("n")) / F.lit(float(group_bytes)))
    firsts = ids.withColumn("r", of).withColumn("part", part).groupBy("r", "part").agg(F.min("id").alias("first"))
    bounds = np.sort(np.array([x["first"] for x in firsts.select("first").collect()], np.int64))[1:]
    ids.unpersist()
    return bounds, total


def _solve(docs: DataFrame, cols: list[str], make: Callable, schema: str, group_bytes: float, wide: int, narrow: int) -> DataFrame:
    """docs has id (never null), text and cols; make builds the result of one group."""
    bounds, total = _bounds(docs, group_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(bounds)  # MOST_GROUPS ids at most

    @F.arrow_udf("bigint")
    def group_of(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(shared.value, ids.to_numpy(zero_copy_only=False), side="right"), pa.int64())

    buckets = max(1, int(-(-total * 0.075 // BUCKET)))
    # partitions follow the bytes, whatever the session's shuffle partitions
    parts = max(1, int(-(-total // PARTITION)))
    dealt = docs.select((group_of("id") if len(bounds) else F.lit(0).cast("bigint")).alias("g"), "id", "text", *cols).repartition(parts, "g")
    said = dealt.groupBy("g").applyInArrow(lean(_announce(buckets, narrow)), "bucket bigint, g bigint, rows binary")
    heard = said.repartition(parts, "bucket").groupBy("bucket").applyInArrow(lean(_answer(wide)), "g bigint, kind int, rows binary")
    ask, have = heard.where(F.col("kind") != WHOLE), heard.where(F.col("kind") == WHOLE)
    sent = dealt.groupBy("g").cogroup(ask.repartition(parts, "g").groupBy("g")).applyInArrow(lean(_send(4 * buckets)), "bucket bigint, g bigint, rows binary")
    found = sent.repartition(2 * parts, "bucket").groupBy("bucket").applyInArrow(lean(_compare), "g bigint, kind int, rows binary")
    return dealt.groupBy("g").cogroup(have.unionByName(found).repartition(parts, "g").groupBy("g")).applyInArrow(lean(_finish(make)), schema)


def _with_id(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).alias("id"), "text", *more)


def digests(docs: DataFrame, group_bytes: float = GROUP, wide: int = WIDE, narrow: int = NARROW) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a 50-byte string over it also starts in a document of a smaller doc_id, judged on the input. Rows with
    the same doc_id are no smaller than each other, so neither cuts the other; a null doc_id counts as smaller than all.
    Null texts are empty. An empty table gives no rows. Other columns are ignored.
    """

    def make(left: pa.Table, kept: list[bytes], removed: np.ndarray, group: Group, cut: np.ndarray) -> pa.Table:
        edge = cut & ~np.append(False, cut[:-1])
        at = group.offsets[:-1][np.diff(group.offsets) > 0]
        edge[at] = cut[at]
        runs = np.append(0, np.cumsum(edge))
        n_spans = (runs[group.offsets[1:]] - runs[group.offsets[:-1]]).astype(np.int64)
        return pa.table({"doc_id": left.column("doc_id"), "n_bytes": pa.array(np.diff(group.offsets)), "n_removed": pa.array(removed), "n_spans": pa.array(n_spans), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())})

    return _solve(_with_id(docs, "doc_id"), ["doc_id"], make, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", group_bytes, wide, narrow)


def dedup(docs: DataFrame, group_bytes: float = GROUP, wide: int = WIDE, narrow: int = NARROW) -> DataFrame:
    """docs with the repeated bytes cut from text (and n_chars, if there, counted again), every row and column kept.

    Where a cut splits a character, its remaining bytes go too, so that the text stays valid UTF-8. A null text stays null.
    """
    names = docs.columns
    inner = {c: f"c{i}" for i, c in enumerate(names)}  # names of our own, whatever the columns are called

    def make(left: pa.Table, kept: list[bytes], removed: np.ndarray, group: Group, cut: np.ndarray) -> pa.Table:
        texts = [None if null else k.decode("utf-8", "ignore") for k, null in zip(kept, left.column("text").is_null().to_pylist(), strict=True)]
        cols = {inner[c]: left.column(inner[c]) for c in names if c != "text"}
        cols[inner["text"]] = pa.array(texts, pa.string())
        if "n_chars" in inner:
            old = left.column(inner["n_chars"])
            cols[inner["n_chars"]] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(old.type)
        return pa.table({n: cols[n] for n in inner.values()})

    other = [F.col(c).alias(inner[c]) for c in docs.columns if c != "text"]
    own = docs.select(F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).alias("id"), "text", *other)
    schema = ", ".join(f"{inner[f.name]} {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = _solve(own, [n for c, n in inner.items() if c != "text"], make, schema, group_bytes, wide, narrow)
    return out.select(*[F.col(inner[c]).alias(c) for c in docs.columns])
