"""Benchmark decontamination by pigeonhole edit matching.

A test item of length L may differ from a passage by up to e edits. Cut into e+1 pieces, at least one piece stands in the
passage unchanged; one automaton over all pieces finds those in a single pass over each text. Around each hit Myers' bit
vectors give the least edit distance of the item to any passage near by.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from cadenza.llm.common import held, pieces

#: Edits allowed, as a share of the item's length, rounded down.
ERROR_RATE = 0.10
#: Items held at once by the automaton; more are taken block by block, each block a pass over the documents.
BLOCK = 20_000
#: Length of the short runs by which a place is screened before the bit vectors run.
Q = 5


def normal(text: str) -> str:
    return " ".join(text.lower().split())


@dataclass
class Item:
    item_id: int
    text: str
    budget: int
    masks: dict[str, int]
    runs: list[str]


def myers(item: Item, text: str, limit: int) -> tuple[int, int]:
    """Least edit distance of the item to any substring of text, and that substring's end; limit+1 if none is within."""
    m = len(item.text)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, where = full, 0, m, limit + 1, -1
    get = item.masks.get
    for i, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, where = score, i + 1
            if not best:
                break
    return best, where


class Matcher:
    """Pieces of a block of items, ready for texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float = ERROR_RATE):
        self.items: list[Item] = []
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, raw in items:
            t = normal(raw or "")
            if not t:
                continue
            e = int(len(t) * error_rate + 1e-9)
            masks: dict[str, int] = defaultdict(int)
            for i, c in enumerate(t):
                masks[c] |= 1 << i
            self.items.append(Item(item_id, t, e, dict(masks), [t[k : k + Q] for k in range(0, len(t) - Q + 1, Q)]))
            cut = [len(t) * k // (e + 1) for k in range(e + 2)]
            for a, b in zip(cut, cut[1:], strict=False):
                places[t[a:b]].append((len(self.items) - 1, a))
        self.automaton = ahocorasick.Automaton()
        for p, where in places.items():
            self.automaton.add_word(p, (len(p), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def find(self, text: str | None, any_one: bool = False) -> list[tuple[int, int]]:
        """(item_id, distance) of each item that stands in the text within its budget; any_one: of one at most."""
        if self.empty or not text:
            return []
        t = normal(text)
        near: dict[int, list[int]] = defaultdict(list)
        for end, (size, where) in self.automaton.iter(t):
            for i, at in where:
                near[i].append(end + 1 - size - at)  # where the item would begin
        out = []
        for i, starts in near.items():
            item = self.items[i]
            m, e = len(item.text), item.budget
            best = e + 1
            if e == 0:
                best = 0  # its one piece is the whole item
            else:
                starts.sort()
                done = -1
                for s in starts:
                    if s + e <= done:
                        continue
                    lo, hi = max(0, s - e), min(len(t), s + m + e)
                    done = s + e
                    if hi - lo < m - e or not self.likely(item, t[lo:hi]):
                        continue
                    best = min(best, myers(item, t[max(0, s - 2 * e) : min(len(t), s + m + 2 * e)], e)[0])
                    if not best:
                        break
            if best <= e:
                out.append((item.item_id, best))
                if any_one:
                    break
        return out

    @staticmethod
    def likely(item: Item, window: str) -> bool:
        """Whether the window may hold a passage within the budget: an edit breaks one of the item's disjoint runs at most."""
        missing = 0
        for run in item.runs:
            if run not in window:
                missing += 1
                if missing > item.budget:
                    return False
        return True


def matcher(key: str, items: list[tuple[int, str]], error_rate: float) -> Matcher:
    return held(("decontam", key), lambda: Matcher(items, error_rate))


def _blocks(items: DataFrame, block: int) -> Iterator[list[tuple[int, str]]]:
    rows: list[tuple[int, str]] = []
    for r in items.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        rows.append((r[0], r[1]))
        if len(rows) == block:
            yield rows
            rows = []
    if rows:
        yield rows


def hits(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, distance) for each item that a document holds within its edit budget.

    The budget of an item of L characters is floor(error_rate * L) edits, whatever L is; an item shorter than 1/error_rate
    must stand in the text as it is. Texts and items are compared in lower case with white space made single spaces. Null
    and empty texts and items match nothing; repeated rows give repeated hits, once for each row of docs. Other columns
    are ignored. The items are a stated query set: they are read in blocks of `block` rows, each broadcast and matched
    against all documents.
    """
    narrow = docs.select("doc_id", "text")
    kinds = docs.schema["doc_id"].dataType, items.schema["item_id"].dataType
    schema = StructType([StructField("doc_id", kinds[0]), StructField("item_id", kinds[1]), StructField("distance", LongType())])
    out = None
    for rows in _blocks(items, block):
        shared, key = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

        def run(b: pa.RecordBatch, shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            m = matcher(key, shared.value, error_rate)
            got = [(k, i, e) for k, t in enumerate(b.column(1).to_pylist()) for i, e in m.find(t)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([g[0] for g in got], pa.int64())), pa.array([g[1] for g in got], to_arrow_type(kinds[1])), pa.array([g[2] for g in got], pa.int64())], ["doc_id", "item_id", "distance"])

        part = narrow.mapInArrow(pieces(run, holds=True), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, block: int = BLOCK) -> DataFrame:
    """The documents that hold no item (as in hits), with their own columns."""
    names = docs.columns
    out = docs
    for rows in _blocks(items, block):
        shared, key = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

        def run(b: pa.RecordBatch, shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            m = matcher(key, shared.value, error_rate)
            ok = np.array([not m.find(t, True) for t in b.column(names.index("text")).to_pylist()], bool)
            yield b.filter(pa.array(ok))

        out = out.mapInArrow(pieces(run, holds=True), docs.schema)
    return out


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each contaminated doc_id: item_id and distance of its nearest item, n_items that it holds."""
    return hits(docs, items).groupBy("doc_id").agg(F.min_by("item_id", F.struct("distance", "item_id")).alias("item_id"), F.min("distance").alias("distance"), F.count_distinct("item_id").alias("n_items"))
