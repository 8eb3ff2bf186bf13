"""Words of byte texts, found and hashed with numpy for a whole batch at once.

A word is a maximal run of bytes other than space and \\x09-\\x0D. Its hash is multilinear over 64-bit words (a fixed odd
multiplier for each place), then mixed; a shingle's hash is the same over its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from cadenza.llm.common import mix

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of text that numpy works on at once: the temporary arrays take some forty times this.
BLOCK = 1 << 20

_factors = np.zeros(0, np.uint64)


def factors(n: int) -> np.ndarray:
    global _factors
    if len(_factors) < n:
        _factors = mix(np.arange(1, max(n, 4096) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _factors[:n]


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about `size` bytes each; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, j
        i = j


def word_hashes(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of every text, and n+1 offsets into them."""
    text = np.frombuffer(raw, np.uint8)
    if not len(text):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[text]
    begins = inside.copy()
    edge = np.zeros(len(text) + 1, bool)
    edge[offsets] = True
    begins[1:] &= SPACE[text[:-1]] | edge[1:-1]
    starts = np.flatnonzero(begins)
    per_doc = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), per_doc
    place = np.arange(len(text))
    place -= np.repeat(np.append(0, starts), np.diff(np.append(np.append(0, starts), len(text))))
    values = (text.astype(np.uint64) + np.uint64(1)) * factors(int(place.max()) + 1)[place]
    values[~inside] = 0
    return mix(np.add.reduceat(values, starts)), per_doc


def shingles(words: np.ndarray, offsets: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k-word runs, the number of the text of each, and the place of its first word among all words.

    short: a text of fewer than k words, but some, has its whole sequence as its one run.
    """
    n = len(words)
    counts = np.diff(offsets)
    doc = np.repeat(np.arange(len(counts)), counts)
    f = factors(k + 16)
    if n >= k:
        h = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            h += words[j : n - k + 1 + j] * f[j]
        at = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
        h = mix(h[at])
    else:
        h, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    d = doc[at]
    if short and len(few := np.flatnonzero((counts > 0) & (counts < k))):
        hs = np.zeros(len(few), np.uint64)
        for j in range(k - 1):
            has = counts[few] > j
            hs[has] += words[offsets[few][has] + j] * f[j]
        hs = mix(hs + f[k : k + k][counts[few]])
        h, d, at = np.concatenate([h, hs]), np.concatenate([d, few]), np.concatenate([at, offsets[few]])
        order = np.argsort(d, kind="stable")
        h, d, at = h[order], d[order], at[order]
    return h, d, at
