"""Near duplicates by the Jaccard similarity of word shingles, as an exact T-occurrence search.

Two sets link when 7 * |A and B| >= 3 * (|A| + |B|), that is at a similarity of 0.75. Every step before the search only
drops what cannot link:

1. documents with equal sets form a class, by a 128-bit print of the set; one of each goes on;
2. if two sets link, the parts of them that come first in hash order share several shingles (the prefix filter in its
   extended form); a class with too few shared shingles in its first part drops out;
3. the classes left order their shingles by frequency, rare ones first: those that link share one in the first quarter.
   Classes that share such a shingle fall into one block; a block is a component of that graph, so no link leaves it;
4. in a block, each class asks the inverted index for the classes that hold T of its shingles: DivideSkip merges its
   short lists through a heap, skipping what can no longer reach T, and probes the long ones for what is left. A class
   does not ask for those that links found before have already joined with it.

A class has a number of its own from the written table of classes, so null and repeated ids are classes like others.
Between steps, hashes travel as packed rows, combined before each shuffle. A block of many classes is searched in
parts: each part as a query set against each other, so no task holds more than two parts. Only links that join two
components of what a task has seen leave it.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import components, drop_out, free_shuffles, lean, mix, on_disk, pieces, unused, utf8_lists, write_out
from cadenza.llm.subword import spread, sums
from cadenza.llm.suffix_dedup import bucket_of, changes, pack, unpack
from cadenza.llm.words import LOWER, blocks, shingles, word_hashes

WORDS = 5
#: Share of a set, in hash order, that the second step compares; packed rows in a bucket; shingles in a group of classes.
PART, BUCKET, GROUP = 0.4, 600_000, 500_000
#: Classes of a block that are searched as one part.
BLOCK = 1500
#: A shingle that more classes of one batch have counts for them at once and travels once.
COMMON = 32


def least_overlap(n: np.ndarray) -> np.ndarray:
    return -(-3 * n // 4)


def first_part(n: np.ndarray) -> np.ndarray:
    return np.minimum(n, np.maximum(n - least_overlap(n) + 1, np.ceil(PART * n).astype(np.int64)))


def needed(n: np.ndarray) -> np.ndarray:
    """How many shingles of its first part a set of n must share with the first part of any set that it links with."""
    slack = lambda m: first_part(m) - m + least_overlap(m)
    return np.maximum(1, np.minimum(slack(n), slack(least_overlap(n))) - 1)


class Sets:
    """The distinct shingle hashes of each text, ascending, end to end."""

    def __init__(self, texts: pa.Array):
        raw, offsets = utf8_lists(texts)
        raw = raw.translate(LOWER)
        hs, ds = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, j in blocks(offsets):
            words, per = word_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            h, d, _ = shingles(words, per, WORDS, True)
            order = np.lexsort((h, d))
            h, d = h[order], d[order]
            new = changes(h) | changes(d)
            hs.append(h[new]), ds.append(d[new] + i)
        self.hashes, doc = np.concatenate(hs), np.concatenate(ds)
        n = len(offsets) - 1
        self.doc = doc
        self.size = np.bincount(doc, minlength=n) if n else np.zeros(0, np.int64)
        self.offsets = np.append(0, np.cumsum(self.size))

    def prints(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each set; a set's size is part of them."""
        a = mix(sums(mix(self.hashes), self.offsets) + self.size.astype(np.uint64))
        b = mix(sums(mix(self.hashes ^ np.uint64(0x9E3779B97F4A7C15)), self.offsets) ^ a)
        return a.view(np.int64), b.view(np.int64)

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """The first part of each set: hashes and the number of their text."""
        m = first_part(self.size)
        m[self.size < 3] = 0  # sets of one or two only link with equal ones
        at = spread(self.offsets[:-1], m)
        return self.hashes[at], np.repeat(np.arange(len(m)), m)


def _table(**cols: pa.Array) -> pa.Table:
    return pa.table(cols)


def _blobs(key: np.ndarray, name: str, rows: np.ndarray, **same: int) -> pa.Table:
    """One row for each run of key, with its rows of bytes in one."""
    cut = np.flatnonzero(changes(key))
    ends = np.append(cut[1:], len(key))[: len(cut)]
    cols = {name: pa.array(key[cut], pa.int64())} | {k: pa.array(np.full(len(cut), v), pa.int64()) for k, v in same.items()}
    return pa.table(cols | {"rows": pa.array([rows[a:b].tobytes() for a, b in zip(cut.tolist(), ends.tolist(), strict=True)], pa.binary())})


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, need, the print (p, q) of the set, and two hashes of the text (t1, t2) of each row of docs."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        s = Sets(b.column(1))
        p, q = s.prints()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s.size, pa.int64()), pa.array(needed(s.size), pa.int64()), pa.array(p), pa.array(q), b.column(2), b.column(3)], ["doc_id", "n_shingles", "need", "p", "q", "t1", "t2"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles bigint, need bigint, p bigint, q bigint, t1 bigint, t2 int"
    return docs.select("doc_id", "text", *text_key("text")).mapInArrow(pieces(run), schema)


def text_key(text: str) -> list[F.Column]:
    """96 bits that stand for a text where texts are joined."""
    return [F.xxhash64(text).alias("t1"), F.hash(text).alias("t2")]


def _shared(docs: DataFrame, buckets: int) -> DataFrame:
    """(p40, shared): how many shingles of the first part of class p another class has in its own first part."""

    def announce(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        s = Sets(b.column(0))
        p, _ = s.prints()
        h, d = s.parts()
        a, c = h >> np.uint64(16), p.view(np.uint64)[d] >> np.uint64(24)
        order = np.lexsort((c, a))
        a, c = a[order], c[order]
        new = changes(a) | changes(c)
        a, c = a[new], c[new]
        # a very common shingle is shared whatever others say: its classes count it here, and it travels once, for others'
        # sake. A class with copies in several batches may count it more than once, which only keeps the class longer
        run = np.cumsum(changes(a)) - 1
        common = np.bincount(run)[run] > COMMON if len(a) else np.zeros(0, bool)
        here, sent = c[common], ~common | changes(a)
        marked = (common & changes(a))[sent]
        yield from _blobs(bucket_of(a[sent], buckets), "bucket", pack(a[sent], c[sent], marked)).to_batches()
        if len(here):
            yield from counted(here, -1).to_batches()

    def counted(c: np.ndarray, sign: int = 1) -> pa.Table:
        """(class, how often) in packed rows, dealt by class; those that are counted on the way have negative buckets."""
        key, n = np.unique(c, return_counts=True)
        rows = np.zeros((len(key), 9), np.uint8)
        rows[:, :5] = np.ascontiguousarray(key).view(np.uint8).reshape(-1, 8)[:, :5]
        rows[:, 5:] = np.ascontiguousarray(n, "<u4").view(np.uint8).reshape(-1, 4)
        to = (key * np.uint64(buckets) >> np.uint64(40)).astype(np.int64)
        return _blobs(to if sign > 0 else -1 - to, "bucket", rows)

    def count(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        if bucket < 0:
            return pa.table({"bucket": pa.array([-1 - bucket] * t.num_rows, pa.int64()), "rows": t.column("rows").combine_chunks()})
        a, c, more, _ = unpack(t.column("rows").to_pylist(), 1)
        order = np.lexsort((c, a))
        a, c, marked = a[order], c[order], more[order, 0] > 0
        head = changes(a)
        run = np.cumsum(head) - 1
        known = np.bincount(run, marked)[run] > 0  # common in some batch
        new = (head | changes(c)) & ~marked
        several = known | (np.bincount(run, new)[run] > 1)
        return counted(c[new & several])

    def add(t: pa.Table) -> pa.Table:
        flat = np.frombuffer(b"".join(t.column("rows").to_pylist()), np.uint8).reshape(-1, 9)
        wide = np.zeros((len(flat), 8), np.uint8)
        wide[:, :5] = flat[:, :5]
        key = wide.reshape(-1).view("<u8")
        n = np.ascontiguousarray(flat[:, 5:]).reshape(-1).view("<u4").astype(np.int64)
        order = np.argsort(key)
        key, n = key[order], n[order]
        head = np.flatnonzero(changes(key))
        return _table(p40=pa.array(key[head].astype(np.int64)), shared=pa.array(np.add.reduceat(n, head) if len(head) else n))

    said = docs.select("text").mapInArrow(pieces(announce), "bucket bigint, rows binary")
    heard = said.groupBy("bucket").applyInArrow(lean(count), "bucket bigint, rows binary")
    return heard.groupBy("bucket").applyInArrow(lean(add), "p40 bigint, shared bigint")


def _sets_of(texts: DataFrame) -> DataFrame:
    """(cls, sets): the packed hashes of each text; texts has cls, text and p, and a text of another set goes."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        s = Sets(b.column(1))
        p, _ = s.prints()
        ok = np.flatnonzero(p == b.column(2).to_numpy())
        blobs = [s.hashes[s.offsets[i] : s.offsets[i + 1]].tobytes() for i in ok.tolist()]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok)), pa.array(blobs, pa.binary())], ["cls", "sets"])

    return texts.select("cls", "text", "p").mapInArrow(pieces(run), "cls bigint, sets binary")


def _load(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class numbers, ascending; their hashes end to end; offsets."""
    ids = t.column("cls").to_numpy()
    order = np.argsort(ids, kind="stable")
    order = order[changes(ids[order])]
    blobs = t.column("sets")
    some = [blobs[int(i)].as_py() for i in order]
    hashes = np.frombuffer(b"".join(some), np.uint64)
    return ids[order], hashes, np.append(0, np.cumsum([len(b) // 8 for b in some])).astype(np.int64)


def _rare_prefixes(sets: DataFrame, buckets: int) -> DataFrame:
    """(h, cls): of each class the shingles, rare ones first, that any link must share one of, if others have them."""

    def announce(t: pa.Table) -> pa.Table:
        _, hashes, _ = _load(t)
        h, n = np.unique(hashes, return_counts=True)
        rows = np.concatenate([h.view(np.uint8).reshape(-1, 8), np.ascontiguousarray(n, "<u4").view(np.uint8).reshape(-1, 4)], 1)
        return _blobs(bucket_of(h >> np.uint64(16), buckets), "bucket", rows, g=t.column("g")[0].as_py())

    def read(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 12)
        h = np.ascontiguousarray(flat[:, :8]).reshape(-1).view("<u8")
        n = np.ascontiguousarray(flat[:, 8:]).reshape(-1).view("<u4").astype(np.int64)
        return h, n, np.repeat(np.arange(len(blobs)), [len(b) // 12 for b in blobs])

    def answer(t: pa.Table) -> pa.Table:
        h, n, of = read(t.column("rows").to_pylist())
        g = t.column("g").to_numpy()[of]
        order = np.argsort(h, kind="stable")
        h, n, g = h[order], n[order], g[order]
        run = np.cumsum(changes(h)) - 1
        df = np.bincount(run, n).astype(np.int64)[run]
        which = np.flatnonzero(df > 1)
        which = which[np.argsort(g[which], kind="stable")]
        rows = np.concatenate([np.ascontiguousarray(h[which]).view(np.uint8).reshape(-1, 8), np.ascontiguousarray(df[which], "<u4").view(np.uint8).reshape(-1, 4)], 1)
        return _blobs(g[which], "g", rows)

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table(h=pa.array([], pa.int64()), cls=pa.array([], pa.int64()))
        ids, hashes, offsets = _load(left)
        known, df, _ = read(right.column("rows").to_pylist())
        order = np.argsort(known)
        known, df = known[order], df[order]
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        freq = np.where(known[at] == hashes, df[at], 1)
        size = np.diff(offsets)
        doc = np.repeat(np.arange(len(ids)), size)
        order = np.lexsort((hashes, freq, doc))
        place = np.arange(len(hashes)) - np.repeat(offsets[:-1], size)
        chosen = order[(place < (size - least_overlap(size) + 1)[doc]) & (freq[order] > 1)]
        return _table(h=pa.array(hashes[chosen].view(np.int64)), cls=pa.array(ids[doc[chosen]]))

    said = sets.groupBy("g").applyInArrow(lean(announce), "bucket bigint, g bigint, rows binary")
    heard = said.groupBy("bucket").applyInArrow(lean(answer), "g bigint, rows binary")
    return sets.groupBy("g").cogroup(heard.groupBy("g")).applyInArrow(lean(choose), "h bigint, cls bigint")


def merge_skip(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """(document, in how many lists) of those in at least `least` of the ascending lists, ascending, by a heap of their heads.

    Where the least document of the heap is in too few lists, least-1 heads go, and their lists skip by binary search to
    the head that is then the least: nothing before it can be in `least` lists.
    """
    # a head is one number: its document, then its list
    shift = len(lists).bit_length()
    mask = (1 << shift) - 1
    heap = [x[0] << shift | k for k, x in enumerate(lists) if x]
    heapq.heapify(heap)
    place = [0] * len(lists)
    out: list[tuple[int, int]] = []
    pop, push = heapq.heappop, heapq.heappush
    while len(heap) >= least:
        doc = heap[0] >> shift
        limit = doc + 1 << shift
        seen = []
        while heap and heap[0] < limit:
            seen.append(pop(heap) & mask)
        if len(seen) >= least:
            out.append((doc, len(seen)))
            for k in seen:
                at = place[k] = place[k] + 1
                if at < len(lists[k]):
                    push(heap, lists[k][at] << shift | k)
            continue
        for _ in range(least - 1 - len(seen)):
            seen.append(pop(heap) & mask)
        to = heap[0] >> shift
        for k in seen:
            x = lists[k]
            at = place[k] = bisect_left(x, to, place[k])
            if at < len(x):
                push(heap, x[at] << shift | k)
    return out


class Index:
    """Inverted lists over the sets of a block, and the DivideSkip search in them."""

    #: Cost of merging against probing that sets how many lists count as long.
    MU = 0.003

    def __init__(self, hashes: np.ndarray, offsets: np.ndarray):
        self.tokens, inverse = np.unique(hashes, return_inverse=True)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        order = np.argsort(inverse, kind="stable")
        self.lists = doc[order]
        self.bounds = np.append(0, np.cumsum(np.bincount(inverse, minlength=len(self.tokens))))
        self.size = np.diff(offsets)

    def search(self, query: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
        """Documents of the index that link with the set `query`; among: only of those where it is true."""
        at = np.minimum(np.searchsorted(self.tokens, query), max(len(self.tokens) - 1, 0))
        found = at[self.tokens[at] == query] if len(self.tokens) else at[:0]
        n = len(query)
        least = int(least_overlap(np.array(n)))
        if len(found) < least or not n:
            return np.zeros(0, np.int64)
        fit = (4 * self.size >= 3 * n) & (3 * self.size <= 4 * n)
        fit = fit if among is None else fit & among
        length = self.bounds[found + 1] - self.bounds[found]
        found, length = (x[np.argsort(length, kind="stable")] for x in (found, length))
        docs = self.lists[spread(self.bounds[found], length)]
        ok = fit[docs]
        ends = np.cumsum(length)
        left = np.append(0, np.cumsum(ok))[np.append(0, ends)]  # the lists without documents that cannot link
        docs, length = docs[ok], np.diff(left)
        most = int(length.max())
        if not most:
            return np.zeros(0, np.int64)
        long = min(least - 1, int(least / (self.MU * np.log2(max(2, most)) + 1)))
        order = np.argsort(length, kind="stable")
        cut = [docs[left[k] : left[k + 1]] for k in order.tolist()]
        merged = merge_skip([x.tolist() for x in cut[: len(cut) - long]], least - long)
        if not merged:
            return np.zeros(0, np.int64)
        some, overlap = (np.array(x, np.int64) for x in zip(*merged, strict=True))
        for k, one in enumerate(cut[len(cut) - long :]):  # binary probes, only of the documents that can still reach it
            can = overlap + (long - k) >= least
            some, overlap = some[can], overlap[can]
            if not len(some):
                break
            p = np.minimum(np.searchsorted(one, some), max(len(one) - 1, 0))
            overlap = overlap + (one[p] == some if len(one) else 0)
        return some[7 * overlap >= 3 * (n + self.size[some])]


def spanning(ids: np.ndarray, hashes: np.ndarray, offsets: np.ndarray) -> tuple[list[int], list[int]]:
    """Links between the documents that join components; one link for each join.

    A pair is looked for once, when the first of it asks, and not if links already join it. Whoever asks next is outside
    the component that has the most documents left to ask; when all that are left are of one component, none needs to.
    """
    index = Index(hashes, offsets)
    of = np.arange(len(ids))  # the component of each document
    left = np.ones(len(ids), bool)  # those that have not asked
    a, b = [], []
    while True:
        at = np.flatnonzero(left)
        sizes = np.bincount(of[at], minlength=len(ids))
        largest = int(sizes.argmax()) if len(at) else 0
        others = at[of[at] != largest]
        if not len(others):
            return a, b
        q = int(others[0])
        left[q] = False
        for d in index.search(hashes[offsets[q] : offsets[q + 1]], left & (of != of[q])).tolist():
            if of[q] != of[d]:
                of[of == of[d]] = of[q]
                a.append(int(ids[q])), b.append(int(ids[d]))


def _search_block(key: tuple, t: pa.Table) -> pa.Table:
    a, b = spanning(*_load(t))
    return _table(a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()))


def in_parts(of_block: DataFrame, block: int = BLOCK) -> DataFrame:
    """of_block (cls, block) without blocks of one, with the number of parts of the block and the part of the class."""
    sizes = of_block.groupBy("block").agg(F.count("*").alias("m")).where("m > 1")
    return of_block.join(sizes, "block").select("cls", "block", F.ceil(F.col("m") / block).cast("int").alias("parts")).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))


def links(sets: DataFrame) -> DataFrame:
    """(a, b): enough links between the classes of sets (cls, block, parts, part, sets) to join all that link."""
    # part i meets part j in task (i, j), i <= j
    tasks = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, F.col("part")).cast("int").alias("i"), F.greatest(k, F.col("part")).cast("int").alias("j")))
    )
    dealt = sets.select("block", "cls", "sets", F.explode(tasks).alias("t")).select("block", "t.i", "t.j", "cls", "sets")
    return dealt.groupBy("block", "i", "j").applyInArrow(lean(_search_block), "a bigint, b bigint")


def _classes(docs: DataFrame, block: int) -> DataFrame:
    """classes(), with the text's key (t1, t2)."""
    docs = docs.select("doc_id", "text")
    own = on_disk(prints(docs))
    rows = own.count()
    reps = own.where("n_shingles > 0").groupBy("p", "q").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("need").alias("need"), F.min(F.struct("t1", "t2")).alias("t"))
    reps = write_out(reps.select(F.monotonically_increasing_id().alias("cls"), "p", "q", "rep", "n", "need", "t.t1", "t.t2"), "classes", 64 * rows)
    total = reps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, int(-(-total * PART // BUCKET)))
    # p40 may stand for two classes; both then go on, which is safe
    shared = _shared(docs, buckets)
    alive = reps.where("n > 2").withColumn("p40", F.shiftrightunsigned("p", 24)).join(shared, "p40").where("shared >= need").select("cls", "p", "n", "t1", "t2")
    alive = write_out(alive, "alive", 48 * rows)
    del shared
    free_shuffles(docs.sparkSession)
    left, shingles_left = alive.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # one text of each class left: copies are combined before the shuffle, and classes grow with the corpus, so neither side
    # is broadcast
    texts = docs.select("text", *text_key("text")).groupBy("t1", "t2").agg(F.first("text").alias("text"))
    sets = _sets_of(texts.join(alive.select("cls", "p", "t1", "t2").hint("merge"), ["t1", "t2"]))
    groups = max(1, int(-(-shingles_left // GROUP)))
    sets = write_out(sets.withColumn("g", F.pmod(F.xxhash64("cls"), F.lit(groups))), "sets", 8 * shingles_left)
    del texts
    free_shuffles(docs.sparkSession)
    prefixes = write_out(_rare_prefixes(sets, groups), "prefixes", 4 * shingles_left)
    first = prefixes.groupBy("h").agg(F.min("cls").alias("m"), F.count("*").alias("c")).where("c > 1").select("h", "m")
    stars = prefixes.join(first, "h").where("cls <> m").select(F.col("cls").alias("a"), F.col("m").alias("b")).distinct()
    of_block = components(stars, edges_about=prefixes.count()).toDF("cls", "block")
    linked = components(links(sets.join(in_parts(of_block, block), "cls")), edges_about=2 * left).toDF("cls", "component")
    for done in (alive, sets, prefixes, of_block):
        drop_out(done)
    free_shuffles(docs.sparkSession)
    # a component is named by the smallest doc_id among its classes
    named = linked.join(reps.select("cls", "rep"), "cls")
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    to = reps.select("cls", "p", "q", "rep").join(linked.join(least, "component").select("cls", "least", F.lit(True).alias("found")), "cls", "left")
    to = to.select("p", "q", F.when(F.col("found"), F.col("least")).otherwise(F.col("rep")).alias("component_id"))
    out = own.join(to, ["p", "q"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "t1", "t2")


def classes(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id.

    Texts are lower-cased in A-Z; null texts and those without a word have no shingle and link with nothing, themselves
    included, so their component is their own id. Rows count by themselves: those that repeat a doc_id may have unlike
    texts and be in different components, and a row without doc_id links like any other. A null doc_id is never a
    component's id: such a row gets the id of its component if another row of the component has one, else null. An empty
    table gives no rows. Other columns are ignored.
    """
    return _classes(docs, block).select("doc_id", "n_shingles", "component_id")


def keep_first(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows whose doc_id is that of their component, with their own columns.

    A row without doc_id stays if no row of its component has one. Rows that repeat the doc_id of their component stand for
    one document and stay together.
    """
    c = _classes(docs, block)
    gone = c.where("component_id is not null and not doc_id <=> component_id").select("doc_id", "t1", "t2").distinct()
    a, b, d = (unused(docs, n) for n in ("t1", "t2", "of"))
    gone = gone.toDF(d, a, b)
    same_text = (F.xxhash64(docs["text"]) == gone[a]) & (F.hash(docs["text"]) == gone[b])
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[d]) & same_text, "left_anti")
