"""Language identification: averaged hashed subword embeddings, a linear softmax, and calibrated rejection.

The softmax is calibrated by one temperature, chosen on texts that the training did not see, and a prediction below the
confidence that keeps nearly all of those is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cadenza.llm.common import pieces
from cadenza.llm.subword import SAMPLE_BYTES, SAMPLE_ROWS, Subword, choose, fetch, learnable, softmax, split_words

#: At most this many texts of each language are learned from.
MOST = 800
UNKNOWN = "und"


@dataclass
class Languages:
    names: list[str]
    words: Subword
    temperature: float
    least: float

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated score and whether the score suffices. Without a letter: und, 0, no."""
        lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        p = softmax(self.words.logits(texts) / self.temperature)
        best = p.argmax(1)
        score = np.where(lettered, p[np.arange(len(p)), best], 0.0)
        return [self.names[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), lettered.tolist(), strict=True)], score, lettered & (score >= self.least)


def train(texts: pa.Array, labels: list[str], seed: int = 7) -> Languages:
    """Fit on texts; every fifth is kept for the temperature and the least confidence."""
    names = sorted(set(labels))
    number = {x: i for i, x in enumerate(names)}
    y = np.array([number[x] for x in labels], np.int64)
    words, at, offsets = split_words(texts, True)
    part = np.arange(len(y)) % 5
    model = Subword(len(names), 2, 4, 1 << 15, 12, True, seed)
    model.start()
    begin, n = offsets[:-1], np.diff(offsets)
    rows = np.flatnonzero(part != 4)
    take = lambda r, m: np.concatenate([at[begin[i] : begin[i] + k] for i, k in zip(r, m, strict=True)] or [at[:0]])
    whole = (take(rows, n[rows]), np.append(0, np.cumsum(n[rows])), y[rows])
    # short runs as well, so that texts of a few words are known
    rng = np.random.default_rng(seed)
    few = np.minimum(n[rows], rng.integers(2, 9, len(rows)))
    start = begin[rows] + (rng.random(len(rows)) * (n[rows] - few + 1)).astype(np.int64)
    runs = np.concatenate([at[i : i + k] for i, k in zip(start, few, strict=True)] or [at[:0]])
    model.fit(words, np.concatenate([whole[0], runs]), np.append(whole[1], whole[1][-1] + np.cumsum(few)), np.append(whole[2], y[rows]), epochs=4, rate=1.0, batch=32)
    folded = model.fold()
    held = np.flatnonzero(part == 4)
    held = held if len(held) else np.arange(len(y))
    z = folded.logits(texts.take(pa.array(held)))
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / temperature).max(1)
    return Languages(names, folded, temperature, float(min(0.5, np.quantile(p, 0.005))))


def fit(docs: DataFrame, most: int = MOST, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Languages:
    """Learn from documents that are not held out and whose lang is given: every language, whatever their number.

    At most `most` texts of each, and so many of all that neither `sample_rows` nor `sample_bytes` is passed; each language
    has one text drawn before any has its second. Texts that repeat with their doc_id and language count once.
    """
    known = docs.where(learnable() & F.col("lang").isNotNull())
    keys = known.where(F.octet_length("text") > 0).select(F.col("lang").alias("y"), F.xxhash64("doc_id", "text").alias("h"), F.octet_length("text").alias("n"))
    t = fetch(known, choose(keys, most, sample_rows, sample_bytes), StringType())
    if not t.num_rows:
        return Languages([], Subword(1), 1.0, 1.0)
    return train(t.column("text").combine_chunks(), t.column("y").to_pylist())


def identify(docs: DataFrame, model: Languages) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score, accepted. Null texts and those without a letter: und, 0.

    A null doc_id is not held out. Other columns of docs, lang among them, are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one table of buckets, whatever the corpus

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lang, s, ok = shared.value.predict(b.column(2))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(s, pa.float64()), pa.array(ok)], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    narrow = docs.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "text")
    return narrow.mapInArrow(pieces(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, accepted boolean")
