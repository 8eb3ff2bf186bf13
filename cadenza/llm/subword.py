"""Averaged hashed subword embeddings under a linear softmax, trained jointly by stochastic gradient descent in numpy.

A word is the mean of the vectors of its character n-grams and of itself, all hashed to a fixed table; a bag of words is
the mean of its words. Embeddings and softmax are trained together on the driver, on a bounded sample. For scoring both
are folded into one small table, a row of logits for each bucket, so a text costs one lookup for each n-gram of each
distinct word in its batch, and misspelt or unseen words are scored by the n-grams that they share with known ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType
from pyspark.sql.window import Window

from cadenza.llm.common import mix
from cadenza.llm.words import blocks, factors


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of each run, end to end."""
    stop = np.cumsum(lens)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(starts - (stop - lens), lens)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row sums of the runs between offsets; empty runs give zero."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full])
    return out


def ngrams(words: list[str], shortest: int, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of each word's n-grams, marked at both ends, and of the word itself; and n+1 offsets."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    chars = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    starts = np.cumsum(lens) - lens
    of = np.repeat(np.arange(len(words)), lens)
    place = np.arange(len(chars)) - starts[of]
    left = lens[of] - place
    whole = np.add.reduceat(chars * factors(int(lens.max()))[place], starts)
    hashes, owner = [mix(whole)], [np.arange(len(words))]
    f = factors(longest + 2)
    for n in range(shortest, longest + 1):
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64) * f[longest]
        for j in range(n):
            h += chars[at + j] * f[j]
        hashes.append(mix(h))
        owner.append(of[at])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    ids = (np.concatenate(hashes)[order] % np.uint64(buckets)).astype(np.int64)
    return ids, np.append(0, np.cumsum(np.bincount(owner, minlength=len(words))))


#: So many words are hashed at a time.
PIECE = 4000


def all_ngrams(words: list[str], shortest: int, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """ngrams() of many words, in pieces: the hashes take some twenty times what is kept."""
    ids, lens = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for i in range(0, len(words), PIECE):
        some, offsets = ngrams(words[i : i + PIECE], shortest, longest, buckets)
        ids.append(some.astype(np.int32))
        lens.append(np.diff(offsets))
    return np.concatenate(ids), np.append(0, np.cumsum(np.concatenate(lens)))


def split_words(texts: pa.Array, lower: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of the texts, the number of each word in order, and n+1 offsets. Null texts have none."""
    col = pc.fill_null(texts, "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    cut = pc.utf8_split_whitespace(pc.utf8_lower(col) if lower else col)
    bounds = cut.offsets.to_numpy().astype(np.int64)
    flat = cut.flatten()
    bounds -= bounds[0] if len(bounds) else 0
    if not len(bounds):
        bounds = np.zeros(1, np.int64)
    empty = pc.equal(flat, "").to_numpy(zero_copy_only=False)  # before leading and after trailing white space
    if empty.any():
        bounds -= np.append(0, np.cumsum(empty))[bounds]
        flat = flat.filter(pa.array(~empty))
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds


@dataclass
class Subword:
    """The model. `table` is None while it is trained and the folded logits afterwards."""

    classes: int
    shortest: int = 3
    longest: int = 5
    buckets: int = 1 << 16
    width: int = 12
    lower: bool = True
    seed: int = 7
    table: np.ndarray | None = None
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    embed: np.ndarray | None = None
    out: np.ndarray | None = None

    def start(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.embed = np.zeros((self.buckets, self.width), np.float32)  # n-grams never seen in training stay neutral
        self.out = rng.normal(0, 1, (self.width, self.classes)).astype(np.float32)
        self.bias = np.zeros(self.classes, np.float32)
        self.table = None

    def fit(self, words: list[str], at: np.ndarray, offsets: np.ndarray, labels: np.ndarray, epochs: int = 5, rate: float = 0.5, batch: int = 64) -> None:
        """Train on bags: bag i has words[at[offsets[i]:offsets[i+1]]] and class labels[i]. Goes on from where it is."""
        if self.embed is None:
            self.start()
        grams, g_off = all_ngrams(words, self.shortest, self.longest, self.buckets)
        g_len = np.diff(g_off)
        lens = np.diff(offsets)
        rng = np.random.default_rng(self.seed + 1)
        use = np.flatnonzero(lens)
        steps = max(1, epochs * -(-len(use) // batch))
        step = 0
        for _ in range(epochs):
            rng.shuffle(use)
            for i in range(0, len(use), batch):
                some = use[i : i + batch]
                n = lens[some]
                uniq, inv = np.unique(at[spread(offsets[some], n)], return_inverse=True)
                ids = grams[spread(g_off[uniq], g_len[uniq])]
                cuts = np.append(0, np.cumsum(g_len[uniq]))
                word = sums(self.embed[ids], cuts) / g_len[uniq][:, None].astype(np.float32)
                bag = sums(word[inv], np.append(0, np.cumsum(n))) / n[:, None].astype(np.float32)
                z = bag @ self.out + self.bias
                z -= z.max(1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(some)), labels[some]] -= 1
                lr = np.float32(rate * (1 - step / steps))
                step += 1
                g_bag = p @ self.out.T / n[:, None].astype(np.float32)
                self.out -= lr * bag.T @ p / len(some)
                self.bias -= lr * p.mean(0)
                g_word = np.zeros_like(word)
                np.add.at(g_word, inv, np.repeat(g_bag, n, 0))
                g_word *= lr / g_len[uniq][:, None].astype(np.float32)
                np.add.at(self.embed, ids, -np.repeat(g_word, g_len[uniq], 0))

    def fold(self) -> Subword:
        """The model for scoring: a table of logits, or the embeddings where there are more classes than dimensions."""
        own = (self.classes, self.shortest, self.longest, self.buckets, self.width, self.lower, self.seed)
        if self.classes > self.width:
            return Subword(*own, None, self.bias.copy(), self.embed, self.out)
        return Subword(*own, (self.embed @ self.out).astype(np.float32), self.bias.copy())

    def _of_words(self, words: list[str], table: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), table.shape[1]), np.float32)
        for i in range(0, len(words), PIECE):
            ids, off = ngrams(words[i : i + PIECE], self.shortest, self.longest, self.buckets)
            out[i : i + PIECE] = sums(table[ids], off) / np.diff(off)[:, None]
        return out

    def logits_of_words(self, words: list[str]) -> np.ndarray:
        if self.table is not None:
            return self._of_words(words, self.table)
        return self._of_words(words, self.embed @ self.out) if self.classes <= self.width else self._of_words(words, self.embed) @ self.out

    def bags(self, words: list[str], at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Logits of each text as one bag, the average of its words; of a text without words, the bias."""
        unfolded = self.table is None
        rows = self._of_words(words, self.embed if unfolded else self.table)
        mean = np.zeros((len(offsets) - 1, rows.shape[1]))
        for i, j in blocks(offsets, 1 << 17):  # a row of numbers for each word of a text takes many times the text
            mean[i:j] = sums(rows[at[offsets[i] : offsets[j]]].astype(np.float64), offsets[i : j + 1] - offsets[i])
        mean /= np.maximum(np.diff(offsets), 1)[:, None]
        return (mean @ self.out if unfolded else mean) + self.bias

    def logits(self, texts: pa.Array) -> np.ndarray:
        return self.bags(*split_words(texts, self.lower))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def platt(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset of a calibrated sigmoid, by Newton steps on smoothed targets."""
    pos, neg = int(labels.sum()), int((1 - labels).sum())
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.ones(len(scores)) if weights is None else weights
    m, s = scores.mean(), scores.std() or 1.0
    x = (scores - m) / s
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * x + b)
        g = w * (p - target)
        h = w * p * (1 - p) + 1e-9
        grad = np.array([(g * x).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum()]])
        d = np.linalg.solve(hess, grad)
        d *= min(1, 2 / (np.abs(d).max() + 1e-12))
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-7:
            break
    return float(a / s), float(b - a * m / s)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, weights: np.ndarray | None = None) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's method."""
    w, k = np.zeros(x.shape[1]), np.ones(len(y)) if weights is None else weights
    for _ in range(25):
        p = sigmoid(x @ w)
        d = np.linalg.solve((x * (k * p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (k * (y - p)) - ridge * w)
        w += d
        if np.abs(d).max() < 1e-6:
            break
    return w


def learnable() -> F.Column:
    """Rows whose labels may be learned: the checksum of doc_id as text is not 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(False))


#: Bounds of a training sample: its rows, whatever the number of classes, and the bytes of its texts.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 32_000_000


def text_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n) of each row with a text that is not empty: a hash of doc_id and text, and the text's bytes."""
    return docs.where(F.octet_length("text") > 0).select("doc_id", F.xxhash64("doc_id", "text").alias("h"), F.octet_length("text").cast("bigint").alias("n"))


def choose(keys: DataFrame, most: int, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> list[tuple]:
    """A bounded sample (y, h) of keys (y, h, n), by hash: at most `most` of each y, each y's first before any's second.

    It ends at `sample_rows`; a text that no longer fits into `sample_bytes` is left out. Equal keys count once. The counts
    of y come first, and a threshold on the hash leaves about twice what is wanted, so what the window ranks is bounded
    however many rows there are.
    """
    keys = keys.select("y", "h", "n").distinct()
    counted = keys.join(keys.groupBy("y").agg(F.count("*").alias("all")), "y")
    few = counted.where((F.col("h") / float(2**63) + 1) / 2 * F.col("all") < 2 * most + 200)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("y").orderBy("h"))).where(F.col("rank") <= most)
    out, left = [], sample_bytes
    for r in ranked.orderBy("rank", "h", "y").limit(sample_rows).collect():
        if r.n <= left:
            out.append((r.y, r.h))
            left -= r.n
    return out


def fetch(docs: DataFrame, chosen: list[tuple], kind: DataType, cols: tuple[str, ...] = ()) -> pa.Table:
    """The chosen texts, whole, on the driver: doc_id, text, cols, y, h, in the order of doc_id. Rows that repeat come once."""
    keys = docs.sparkSession.createDataFrame(pa.table({"y": pa.array([y for y, _ in chosen], to_arrow_type(kind)), "h": pa.array([h for _, h in chosen], pa.int64())}))
    own = docs.where(F.octet_length("text") > 0).select("doc_id", "text", *cols, F.xxhash64("doc_id", "text").alias("h"))
    found = own.join(F.broadcast(keys), "h").groupBy("y", "h").agg(*[F.min(c).alias(c) for c in ("doc_id", "text", *cols)])  # SAMPLE_ROWS keys at most
    t = found.select("doc_id", "text", *cols, "y", "h").toArrow()
    return t.sort_by([("doc_id", "ascending"), ("h", "ascending"), ("y", "ascending")])
