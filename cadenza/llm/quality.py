"""Quality by co-training two views of a document.

The text view sees the content alone: an averaged subword embedding of the words as they stand, and layout counts of the
text. The page view sees the page's metadata alone: language, source and recorded length, in a logistic regression. Both
start from the labelled sample. In each round both views score all unlabelled documents; those of which a view is sure, by
its calibrated odds, go to the other view as labelled, drawn evenly over languages and sources. Views are calibrated on
labelled documents that neither saw, and the score of every document combines their calibrated log-odds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from cadenza.llm.common import free_shuffles, mix, on_disk, pieces, unused, utf8_lists
from cadenza.llm.subword import SAMPLE_BYTES, Subword, choose, fetch, learnable, logistic, platt, sigmoid, split_words, spread, sums, text_rows
from cadenza.llm.words import blocks

#: At most this many labelled texts of each class are learned from, and this many pseudo-labelled ones of each class and
#: each of STRATA strata of language and source.
MOST, POOL, STRATA = 1000, 60, 16
#: Rounds of exchange, and the calibrated log-odds from which a view is sure of a document.
ROUNDS, SURE = 2, 2.0
#: Documents below this score are rejected: only those that both views together hold to be poor.
THRESHOLD = 0.1
HASHED = 64

# Classes of bytes for the layout counts: capital, digit, symbol, other punctuation, white space, line end, beyond ASCII.
CLASSES = np.full(256, 7)
for _chars, _class in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0), (b"0123456789", 1), (b"#*$%&|<>@^~\\{}[]_=+/", 2), (b".,;:!?'\"()-`", 3), (b" \t\r\x0b\x0c", 4), (b"\n", 5), (bytes(range(128, 256)), 6)):
    CLASSES[list(_chars)] = _class


def layout_features(texts: pa.Array, at: np.ndarray, words: np.ndarray) -> np.ndarray:
    """One row of numbers for each text: one, log length, log lines, shares of seven byte classes, words that repeat at once.

    at and words: the number of each word of the texts in order, and where each text's words begin and end.
    """
    raw, offsets = utf8_lists(texts)
    n = len(offsets) - 1
    data = np.frombuffer(raw, np.uint8)
    shares = np.zeros((n, 7))
    for i, j in blocks(offsets):
        c = CLASSES[data[offsets[i] : offsets[j]]]
        for k in range(7):
            shares[i:j, k] = sums((c == k).astype(np.int64), offsets[i : j + 1] - offsets[i])
    size = np.diff(offsets)
    out = np.ones((n, 11))
    out[:, 1] = (np.log1p(size) - 7) / 2
    out[:, 2] = np.log1p(shares[:, 5])
    out[:, 3:10] = np.sqrt(shares / np.maximum(size, 1)[:, None]) * 4
    again = np.append(False, at[1:] == at[:-1]) if len(at) else np.zeros(0, bool)
    again[words[:-1][np.diff(words) > 0]] = False
    out[:, 10] = np.sqrt(sums(again.astype(np.int64), words) / np.maximum(np.diff(words), 1)) * 4
    return out


def page_features(pages: pa.Table | pa.RecordBatch) -> np.ndarray:
    """One row of numbers for each page, from its metadata: one, log n_chars, hashed lang and source. The text is not read."""
    n = pages.num_rows
    out = np.zeros((n, 3 + 2 * HASHED))
    out[:, 0] = 1
    chars = pages.column("n_chars").to_pylist()
    out[:, 1] = [0 if c is None else (np.log1p(max(c, 0)) - 7) / 2 for c in chars]
    out[:, 2] = [c is None for c in chars]
    for k, col in enumerate(("lang", "source")):
        names = pages.column(col).to_pylist()
        seen = {x: int(mix(np.array([sum((b + 1) * 257**i for i, b in enumerate((x or "").encode()[:64])) % 2**64], np.uint64))[0] % HASHED) for x in set(names)}
        out[np.arange(n), 3 + k * HASHED + np.array([seen[x] for x in names], np.int64) if n else []] = 0.5
    return out


def combined(joint: tuple[float, ...], odds: np.ndarray) -> np.ndarray:
    """The chance of good quality, from calibrated log-odds; far ones count as certain, not more."""
    return sigmoid(joint[0] + np.clip(odds, -8, 8) @ np.array(joint[1:]))


#: What both views read.
READS = ["text", "lang", "source", "n_chars"]


@dataclass
class Quality:
    """A fitted pair of views. The text view has two parts, words and layout; fits calibrates those and the page view."""

    words: Subword
    layout: np.ndarray
    page: np.ndarray
    fits: list[tuple[float, float]]
    joint: tuple[float, ...]

    def odds(self, pages: pa.Table | pa.RecordBatch) -> np.ndarray:
        """Calibrated log-odds of each page: words, layout, page view."""
        text = pages.column("text")
        text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
        words, at, offsets = split_words(text, False)
        z = self.words.bags(words, at, offsets)
        raw = (z[:, 1] - z[:, 0], layout_features(text, at, offsets) @ self.layout, page_features(pages) @ self.page)
        return np.stack([a * x + b for (a, b), x in zip(self.fits, raw, strict=True)], 1)

    def score(self, pages: pa.Table | pa.RecordBatch) -> np.ndarray:
        return combined(self.joint, self.odds(pages))

    def labels(self, pages: pa.RecordBatch, sure: float = SURE) -> tuple[np.ndarray, np.ndarray]:
        """What the text view and the page view say of each page: 1 good, 0 poor, -1 not sure."""
        o = np.clip(self.odds(pages), -8, 8)
        # the parts of the text view in the proportions of the joint fit
        w = np.maximum(np.array(self.joint[1:3]), 0)
        text = o[:, :2] @ (w / w.sum() if w.sum() else np.array([0.5, 0.5])) * (2 if w.sum() else 1)
        return tuple(np.where(x > sure, 1, np.where(x < -sure, 0, -1)) for x in (text, o[:, 2]))


def train(known: pa.Table, y: np.ndarray, to_text: tuple[pa.Table, np.ndarray] | None = None, to_page: tuple[pa.Table, np.ndarray] | None = None, seed: int = 7) -> Quality:
    """known: labelled pages, y: 1 good, 0 poor. Every fifth is kept for the calibration.

    to_text, to_page: pages that the other view labelled.
    """
    part = np.arange(len(y)) % 5
    base, held = np.flatnonzero(part != 4), np.flatnonzero(part == 4)
    held = held if len(held) else base
    pages = known if to_text is None else pa.concat_tables([known, to_text[0]])
    rows = base if to_text is None else np.append(base, len(y) + np.arange(len(to_text[1])))
    labels = y if to_text is None else np.append(y, to_text[1])
    text = pages.column("text").combine_chunks()
    words, at, offsets = split_words(text, False)
    n = np.diff(offsets)
    model = Subword(2, 2, 4, 1 << 16, 8, False, seed)
    model.start()
    model.fit(words, at[spread(offsets[rows], n[rows])], np.append(0, np.cumsum(n[rows])), labels[rows], epochs=3, rate=2.0)
    x = layout_features(text, at, offsets)
    layout = logistic(x[rows], labels[rows])
    p, py = page_features(known), y
    page = logistic(p[base], y[base]) if to_page is None else logistic(np.concatenate([p[base], page_features(to_page[0])]), np.append(py[base], to_page[1]))
    z = model.bags(words, at, offsets)[held]
    raw = np.stack([z[:, 1] - z[:, 0], x[held] @ layout, p[held] @ page], 1)
    fits = [platt(raw[:, k], y[held]) for k in range(3)]
    odds = np.clip(np.stack([a * raw[:, k] + b for k, (a, b) in enumerate(fits)], 1), -8, 8)
    joint = logistic(np.concatenate([np.ones((len(held), 1)), odds], 1), y[held], 0.1)
    return Quality(model.fold(), layout, page, fits, tuple(joint.tolist()))


def _pages(docs: DataFrame) -> DataFrame:
    """doc_id and what the views read; a column that docs lacks is null."""
    col = lambda c, t: (F.col(c).cast(t) if c in docs.columns else F.lit(None).cast(t)).alias(c)
    return docs.select("doc_id", col("text", "string"), col("lang", "string"), col("source", "string"), col("n_chars", "bigint"))


def _exchange(docs: DataFrame, labels: DataFrame, model: Quality, pool: int, sample_bytes: int) -> list[tuple[pa.Table, np.ndarray] | None]:
    """For the text view and for the page view: unlabelled pages of which the other view is sure, and their labels.

    All unlabelled documents are scored, in one pass that leaves narrow rows; the sample is drawn from those.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one table of buckets, whatever the corpus

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        text, page = shared.value.labels(b)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), b.column("n"), b.column("s"), pa.array(text, pa.int32()), pa.array(page, pa.int32())], ["doc_id", "h", "n", "s", "by_text", "by_page"])

    rows = docs.where(F.octet_length("text") > 0).select("*", F.xxhash64("doc_id", "text").alias("h"), F.octet_length("text").cast("bigint").alias("n"), F.pmod(F.xxhash64("lang", "source"), F.lit(STRATA)).cast("int").alias("s"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h bigint, n bigint, s int, by_text int, by_page int"
    said = rows.mapInArrow(pieces(run), schema).where("by_text >= 0 or by_page >= 0")
    said = on_disk(said.join(labels.select("doc_id").distinct(), "doc_id", "left_anti"))
    out = []
    for by in ("by_page", "by_text"):
        keys = said.where(F.col(by) >= 0).select((F.col("s") * 2 + F.col(by)).alias("y"), "h", "n")
        t = fetch(docs, choose(keys, pool, sample_bytes=sample_bytes), IntegerType(), tuple(READS[1:]))
        out.append((t, t.column("y").to_numpy().astype(np.int64) % 2) if t.num_rows else None)
    said.unpersist()
    return out


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST, pool: int = POOL, rounds: int = ROUNDS, sample_bytes: int = SAMPLE_BYTES // 4) -> Quality:
    """Learn from `most` labelled texts of each class, none held out, and from what the views tell each other of all others.

    Conflicting labels of a doc_id count as poor; labels other than 0 and 1 are left out. Each sample has at most
    `sample_bytes` of text. Without labels of both classes every document scores 0.88.
    """
    docs = _pages(docs)
    good = labels.where(learnable() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    t = fetch(docs, choose(text_rows(docs).join(good, "doc_id"), most, sample_bytes=sample_bytes), IntegerType(), tuple(READS[1:]))
    y = t.column("y").to_numpy().astype(np.int64) if t.num_rows else np.zeros(0, np.int64)
    if not (y == 1).any() or not (y == 0).any():
        return Quality(Subword(2, table=np.zeros((1 << 16, 2), np.float32), bias=np.zeros(2, np.float32)), np.zeros(11), np.zeros(3 + 2 * HASHED), [(0.0, 0.0)] * 3, (2.0, 0.0, 0.0, 0.0))
    model = train(t, y)
    for _ in range(rounds):
        free_shuffles(docs.sparkSession)
        to_text, to_page = _exchange(docs, labels, model, pool, sample_bytes)
        if to_text is None and to_page is None:
            break
        model = train(t, y, to_text, to_page)
        del to_text, to_page
    del t
    free_shuffles(docs.sparkSession)
    return model


def scored(docs: DataFrame, model: Quality, to: str = "quality_score") -> DataFrame:
    """docs with a further column, which replaces one of that name; all others pass through. Null texts score as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one table of buckets, whatever the corpus
    docs = docs.drop(to)
    lacking = [c for c in READS if c not in docs.columns]

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = {c: pa.nulls(b.num_rows, pa.int64() if c == "n_chars" else pa.string()) if c in lacking else b.column(b.schema.names.index(c)) for c in READS}
        s = shared.value.score(pa.table(own))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, to])

    return docs.mapInArrow(pieces(run), StructType([*docs.schema.fields, StructField(to, DoubleType())]))


def keep(docs: DataFrame, model: Quality, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model does not reject, with their own columns."""
    own = unused(docs, "quality_score")
    return scored(docs, model, own).where(F.col(own) >= threshold).drop(own)


def verdicts(docs: DataFrame, model: Quality, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, score, kept. Repeated rows give repeated rows; other columns are only read as features."""
    s = scored(_pages(docs), model, "score")
    return s.select("doc_id", "score", (F.col("score") >= threshold).alias("kept"))
