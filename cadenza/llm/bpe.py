"""Byte-level BPE by merge replay over the distinct words of a chunk of the corpus.

Training applies its merges, in rank order, to every word of the corpus at once; encoding can replay that. A chunk of
documents (an Arrow batch) is split into pattern matches, the distinct ones are laid end to end as byte symbols, and an
inverted index maps each mergeable pair to the positions where it stands. Ranks are taken in ascending order; all
positions of a rank merge together and only their two neighbours get new pairs in the index. Documents then look their
words up. Chunks are independent, so there is no shuffle and memory is bounded by the batch; each Python worker keeps a
bounded cache of pieces it has already encoded.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from cadenza.llm.common import held, pieces

NONE = np.int32(2**31 - 1)
#: A space between two whitespace characters joins its neighbours in one match; other spaces start a match of their own.
LOOSE_SPACE = re.compile(r" (?<=\s )\s")
CACHE = 300_000


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class MergeReplay:
    """Encoder for one rank table. encode_words() is the replay; encode() splits texts and looks words up."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.tokens[r] = b
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        keys, to = [], []
        for b, r in ranks.items():
            for i in range(1, len(b)):
                x, y = ranks.get(b[:i]), ranks.get(b[i:])
                if x is not None and y is not None:
                    keys.append(x << 32 | y)
                    to.append(r)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.append(np.array(keys, np.int64)[order], np.int64(2**62))
        self.to = np.append(np.array(to, np.int32)[order], NONE)
        self.pieces: dict[str, bytes] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merged token; NONE where it has none or right is a word's end (-1)."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where((right >= 0) & (self.keys[at] == key), self.to[at], NONE)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        if not n:
            return [b""] * len(words)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lens)
        tok = np.append(self.byte_ids[raw], np.int32(-1))  # place n is the end of every word
        nxt = np.arange(1, n + 2)
        nxt[ends[lens > 0] - 1] = n
        prv = np.arange(-1, n)
        prv[(ends - lens)[lens > 0]] = n
        prv, nxt = np.append(prv, n)[: n + 1], nxt[: n + 1]
        pair = np.append(self.pair_ranks(tok[:-1], tok[nxt[:-1]]), NONE)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def put(places: np.ndarray, ranks: np.ndarray) -> None:
            keep = ranks != NONE
            places, ranks = places[keep], ranks[keep]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, part in zip(ranks[np.r_[0, cut]].tolist() if len(ranks) else (), np.split(places, cut), strict=False):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        put(np.arange(n), pair[:n])
        early: list[np.ndarray] = []
        while heap:
            r = heapq.heappop(heap)
            found = index.pop(r)
            at = found[0] if len(found) == 1 else distinct(np.concatenate(found))
            at = at[pair[at] == r]
            if not len(at):
                continue
            right = nxt[at]
            tied = np.append(False, right[:-1] == at[1:])
            if tied.any():  # runs such as aaa: the leftmost pair first, then every second one
                i = np.arange(len(at))
                first = np.maximum.accumulate(np.where(tied, 0, i))
                at = at[(i - first) % 2 == 0]
                right = nxt[at]
            after = nxt[right]
            tok[at] = r
            nxt[at] = after
            prv[after] = at
            pair[right] = NONE
            tok[n] = -1
            before = prv[at]
            touched = np.concatenate([before[before != n], at])
            if len(touched) > 1:
                touched = distinct(touched)
            new = self.pair_ranks(tok[touched], tok[nxt[touched]])
            pair[touched] = new
            if new.min() < r:
                early.append(touched[new < r])
            put(touched, new)
        alive = np.zeros(n, bool)  # a place is alive if its word's chain reaches it; right halves of merges are not
        starts = (ends - lens)[lens > 0]
        alive[starts] = True
        linked = nxt[:n]
        chain = starts
        while len(chain):
            chain = linked[chain]
            chain = chain[chain != n]
            alive[chain] = True
        ids = tok[:n][alive].astype("<u4")
        counts = np.cumsum(np.append(0, alive))[np.append(0, ends)] * 4
        flat = ids.tobytes()
        out = [flat[i:j] for i, j in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True)]
        if early:  # a merge made a pair of lower rank: its word is merged again one pair at a time
            for w in np.unique(np.searchsorted(ends, np.concatenate(early), side="right")).tolist():
                out[w] = np.array(self.one_by_one(words[w]), "<u4").tobytes()
        return out

    def one_by_one(self, word: bytes) -> list[int]:
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            r, i = min((self.ranks.get(parts[i] + parts[i + 1], NONE), i) for i in range(len(parts) - 1))
            if r == NONE:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Packed ids of each text (null: none).

        A text is cut before each single space, which never changes its matches; the few texts where a space stands
        between whitespace are matched as a whole. Cuts are numbered by Arrow, so each distinct one is encoded once.
        """
        if len(self.pieces) > CACHE:
            self.pieces = {}
        col = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        whole: dict[int, list[str]] = {}
        for i in pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(col, r"\s \s|[^\x00-\x7F] [^\x00-\x7F]"), False)).to_pylist():
            t = col[i].as_py()
            if LOOSE_SPACE.search(t):
                whole[i] = self.pattern.findall(t)
        if whole:
            loose = np.zeros(len(col), bool)
            loose[list(whole)] = True
            plain_col = pc.if_else(pa.array(loose), "", pc.fill_null(col, ""))
        else:
            plain_col = pc.fill_null(col, "")
        cuts = pc.split_pattern(plain_col, " ")
        bounds = cuts.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        flat = cuts.flatten()
        is_head = np.zeros(len(flat), bool)
        is_head[bounds[:-1]] = True
        heads = [self.pattern.findall(x) for x in flat.filter(pa.array(is_head)).to_pylist()]
        coded = flat.filter(pa.array(~is_head)).dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        pieces = coded.dictionary.to_pylist()
        cut = {p: self.pattern.findall(" " + p) for p in pieces if p not in self.pieces}
        fresh: set[str] = set()
        for group in (cut.values(), heads, whole.values()):
            for x in group:
                fresh.update(x)
        listed = list(fresh)
        words = dict(zip(listed, self.encode_words([w.encode() for w in listed]), strict=True))
        for p, x in cut.items():
            self.pieces[p] = words[x[0]] if len(x) == 1 else b"".join([words[w] for w in x])
        packed = list(map(self.pieces.__getitem__, pieces))
        lens = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        ids = np.frombuffer(b"".join(packed), "<u4")
        at = coded.indices.to_numpy()
        each = lens[at]
        stop = np.cumsum(each)
        all_ids = ids[np.arange(stop[-1] if len(stop) else 0) + np.repeat((np.cumsum(lens) - lens)[at] - (stop - each), each)]
        ends = np.append(0, stop)[bounds[1:] - np.arange(1, len(bounds))].tolist()
        out, start = [], 0
        for i, (head, end) in enumerate(zip(heads, ends, strict=True)):
            out.append(b"".join([words[w] for w in whole[i]]) if i in whole else b"".join([words[w] for w in head]) + all_ids[start:end].tobytes())
            start = end
        return out

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def encoder(data: bytes, pattern: str) -> MergeReplay:
    """One encoder per worker process and rank file."""
    return held(("bpe", hashlib.sha256(data).digest(), pattern), lambda: MergeReplay(read_ranks(data), pattern))


def _mapped(df: DataFrame, ranks_path: str, pattern: str, col: str, fields: list[tuple[str, str, pa.DataType]], make) -> DataFrame:
    with open(ranks_path, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, under a megabyte whatever the corpus

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        enc = encoder(data.value, pattern)
        gc.disable()  # hundreds of thousands of short lists a batch, none of them cyclic
        try:
            vals = make(enc, b.column(at))
        finally:
            gc.enable()
        yield pa.RecordBatch.from_arrays([b.column(i) for i in range(b.num_columns) if i != at] + [pa.array(v, t) for v, (_, _, t) in zip(vals, fields, strict=True)], names)

    new = {n.lower() for n, _, _ in fields} - {col.lower()}
    df = df.select(*[f"`{c.replace('`', '``')}`" for c in df.columns if c.lower() not in new])
    at = df.columns.index(col)
    kept = [f for f in df.schema.fields if f.name != col]
    names = [f.name for f in kept] + [n for n, _, _ in fields]
    schema = StructType([*kept, *[StructField(n, _parse_datatype_string(t)) for n, t, _ in fields]])
    return df.mapInArrow(pieces(run, holds=True), schema)


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with text_col replaced by its ids (array<int>; null and empty texts: an empty array).

    A column that df has by the name of ids_col is replaced too; all others pass through.
    """
    return _mapped(df, ranks_path, pattern, text_col, [(ids_col, "array<int>", pa.list_(pa.int32()))], lambda e, ts: [[np.frombuffer(x, "<i4") for x in e.encode(ts)]])


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "bytes") -> DataFrame:
    """df with ids_col replaced by the bytes its ids stand for (null: empty); a column named bytes_col is replaced too."""
    return _mapped(df, ranks_path, pattern, ids_col, [(bytes_col, "binary", pa.binary())], lambda e, xs: [[b"".join(map(e.tokens.__getitem__, x or ())) for x in xs.to_pylist()]])


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256. The second is of the ids decoded again.

    Every row of docs gives one row, repeated and null ids too; a null text counts as empty; other columns are ignored.
    """

    def make(e: MergeReplay, texts: pa.Array):
        packed = e.encode(texts)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return [len(p) // 4 for p in packed], [sha(p) for p in packed], [sha(e.decode(p)) for p in packed]

    narrow = docs.select(F.col("doc_id"), F.col("text"))
    return _mapped(narrow, ranks_path, pattern, "text", [("n_tokens", "bigint", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())], make)


def tokens(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """docs with text replaced by ids, n_tokens and decoded_sha256 (of the ids decoded again).

    Columns of docs by these three names are replaced too; all others pass through.
    """

    def make(e: MergeReplay, texts: pa.Array):
        packed = e.encode(texts)
        return [np.frombuffer(p, "<i4") for p in packed], [len(p) // 4 for p in packed], [hashlib.sha256(e.decode(p)).hexdigest() for p in packed]

    fields = [("ids", "array<int>", pa.list_(pa.int32())), ("n_tokens", "bigint", pa.int64()), ("decoded_sha256", "string", pa.string())]
    return _mapped(docs, ranks_path, pattern, "text", fields, make)
