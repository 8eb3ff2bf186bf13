"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A text is scored as bags of subwords, each averaged and put through the softmax: the whole text as one bag, and every run
of a few consecutive words, because a long text may hold two toxic words among thousands, which one average drowns. The
average of the whole text and that of its most toxic run are weighted and calibrated on labelled texts kept back from
training. Training starts on short toxic texts as single bags, then takes the runs that the model itself finds most toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from cadenza.llm.common import pieces
from cadenza.llm.subword import SAMPLE_BYTES, Subword, choose, fetch, learnable, logistic, platt, sigmoid, split_words, spread, sums, text_rows

RUN = 2
#: At most this many labelled texts of each class are learned from.
MOST = 3000
THRESHOLD = 0.3


def best_runs(word_scores: np.ndarray, at: np.ndarray, offsets: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """For each text the largest mean over runs of consecutive words (0 if it has none), and where that run starts."""
    n = np.diff(offsets)
    total = np.append(0.0, np.cumsum(word_scores[at].astype(np.float64)))
    size = np.minimum(n, run)
    count = np.where(n > 0, n - size + 1, 0)
    begin = spread(offsets[:-1], count)
    length = np.repeat(size, count)
    means = (total[begin + length] - total[begin]) / np.maximum(length, 1)
    best, where = np.zeros(len(n)), offsets[:-1].copy()
    full = np.flatnonzero(count)
    if len(full):
        starts = (np.cumsum(count) - count)[full]
        best[full] = np.maximum.reduceat(means, starts)
        hit = np.flatnonzero(means >= np.repeat(best[full], count[full]))
        owner = np.repeat(full, count[full])[hit]
        first = np.unique(owner, return_index=True)[1]
        where[owner[first]] = begin[hit[first]]
    return best, where


def misspelt(word: str, rng: np.random.Generator) -> str:
    """The word with one character changed, doubled or left out."""
    i = int(rng.integers(len(word)))
    return word[:i] + ("", word[i] * 2, "0123456789*@$!xzqvk"[int(rng.integers(19))])[int(rng.integers(3))] + word[i + 1 :]


@dataclass
class Toxicity:
    """A fitted model: score() gives the calibrated probability of each text."""

    words: Subword
    weights: tuple[float, float, float]  # of one, the most toxic run, the whole text

    def score(self, texts: pa.Array) -> np.ndarray:
        words, at, offsets = split_words(texts, True)
        z = self.words.logits_of_words(words)
        return sigmoid(views(z[:, 1] - z[:, 0], at, offsets) @ np.array(self.weights))


def views(word_scores: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text one, the average of its most toxic run, and the average of the whole text."""
    best, _ = best_runs(word_scores, at, offsets)
    whole = sums(word_scores[at].astype(np.float64), offsets) / np.maximum(np.diff(offsets), 1)
    return np.stack([np.ones(len(best)), best, whole], 1)


def train(texts: pa.Array, labels: np.ndarray, prior: float | None = None, seed: int = 7) -> Toxicity:
    """Fit on texts; every fifth is kept for the calibration. prior: share of toxic labels among all, if texts is balanced."""
    words, at, offsets = split_words(texts, True)
    n = np.diff(offsets)
    model = Subword(2, 3, 6, 1 << 17, 8, True, seed)
    model.start()
    rng = np.random.default_rng(seed)
    part = np.arange(len(labels)) % 5
    learn = part != 4
    if labels[learn].min(initial=1) == labels[learn].max(initial=0) or not n.sum():
        return Toxicity(model.fold(), (float(np.log(max(labels.mean() if len(labels) else 0.01, 1e-3))), 1.0, 0.0))
    pos = np.flatnonzero(learn & (labels == 1) & (n > 0))
    neg = np.flatnonzero(learn & (labels == 0) & (n > 0))

    def runs_of(docs: np.ndarray) -> np.ndarray:
        return offsets[docs] + (rng.random(len(docs)) * np.maximum(n[docs] - RUN + 1, 1)).astype(np.int64)

    short = pos[n[pos] <= max(12, np.quantile(n[pos], 0.1))]
    bags, ends, ys = [offsets[short]], [offsets[short] + n[short]], [np.ones(len(short), np.int64)]
    for round_ in range(5):
        for _ in range(6):
            b = runs_of(neg)
            bags.append(b), ends.append(np.minimum(b + RUN, offsets[neg] + n[neg])), ys.append(np.zeros(len(neg), np.int64))
        if round_:  # variants of the words that count as toxic by now, and as many of other words
            strong = [w for w, x in zip(words, (z[:, 1] - z[:, 0]).tolist(), strict=True) if x > 6 and len(w) > 4]
            other = [words[i] for i in at[offsets[neg] + (rng.random(len(neg)) * n[neg]).astype(np.int64)].tolist() if len(words[i]) > 4]
            pairs = [(misspelt(w, rng), 1) for w in strong for _ in range(2)] + [(misspelt(w, rng), 0) for w in other]
            model.fit([w for w, _ in pairs], np.arange(len(pairs)), np.arange(len(pairs) + 1), np.array([k for _, k in pairs], np.int64), epochs=1, rate=2.0)
        begin, end, y = np.concatenate(bags), np.concatenate(ends), np.concatenate(ys)
        size = end - begin
        model.fit(words, at[spread(begin, size)], np.append(0, np.cumsum(size)), y, epochs=3, rate=3.0)
        z = model.logits_of_words(words)
        _, where = best_runs(z[:, 1] - z[:, 0], at, offsets)
        bags, ends, ys = [], [], []
        for docs, label in ((pos, 1), (neg, 0)):
            bags.append(where[docs]), ends.append(np.minimum(where[docs] + RUN, offsets[docs] + n[docs])), ys.append(np.full(len(docs), label))
    held = part == 4
    x, y, w = views(z[:, 1] - z[:, 0], at, offsets)[held], labels[held], None
    if prior is not None and 0 < y.mean() < 1:
        w = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    joint = logistic(x, y, 1.0, w)
    slope, offset = platt(x @ joint, y, w)
    return Toxicity(model.fold(), tuple((slope * joint + np.array([offset, 0, 0])).tolist()))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST, sample_bytes: int = SAMPLE_BYTES) -> Toxicity:
    """Learn from at most `most` labelled texts of each class, none of them held out, and at most `sample_bytes` of text.

    Conflicting labels of a doc_id count as toxic, labels other than 0 and 1 are left out. Texts that repeat with their
    doc_id count once. Only doc_id and text of docs are read.
    """
    known = labels.where(learnable() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    t = fetch(docs, choose(text_rows(docs).join(known, "doc_id"), most, sample_bytes=sample_bytes), IntegerType())
    if not t.num_rows:
        return Toxicity(Subword(2, table=np.zeros((1 << 16, 2), np.float32), bias=np.zeros(2, np.float32)), (-3.0, 1.0, 0.0))
    return train(t.column("text").combine_chunks(), t.column("y").to_numpy().astype(np.int64), counts.get(1, 0) / max(1, sum(counts.values())))


def score(docs: DataFrame, model: Toxicity, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted. Empty and null texts score as a text without toxic words.

    A null doc_id is not held out. Rows that repeat give rows that repeat. Other columns of docs are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one table of buckets, whatever the corpus

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        s = shared.value.score(b.column(2))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    narrow = docs.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "text")
    return narrow.mapInArrow(pieces(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
