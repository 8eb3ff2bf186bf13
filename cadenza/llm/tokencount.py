"""Token counts under a unigram vocabulary, without making the tokens.

One Aho-Corasick automaton over the vocabulary gives every piece that ends at every character; dynamic programming carries
the best score and its number of pieces, and nothing to trace back with. Pieces never cross the start of a word (a space
mark after another character), so a text is the sum of its words and each distinct word is counted once.

Rules of the tokenizer, as they bear on counts: a space is the mark U+2581 and every text but the empty one begins with
one; of equal scores at a place the piece that begins first wins; a character that is no piece of its own scores ten less
than the lowest piece and falls back to one token for each of its UTF-8 bytes.

The vocabulary file's pieces and scores are read as the log probabilities of a unigram model; the exact tokenizer for that
is the Unigram model of the tokenizers library over each word, with byte fallback, whose counts these are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cadenza.llm.common import held, pieces

from cadenza.llm.subword import sums

MARK = "▁"
PENALTY = 10.0
CACHE = 500_000


def read_pieces(model: bytes) -> dict[str, float]:
    """Ordinary pieces and their scores."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_proto=model)
    return {m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}


class Counter:
    def __init__(self, pieces: dict[str, float]):
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece spans the start of a word; words cannot be counted alone")
        self.automaton = ahocorasick.Automaton()
        for p, s in pieces.items():
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min(pieces.values()) - PENALTY
        self.spare = next(c for c in map(chr, range(1, 128)) if c not in self.single)  # an unknown character of one byte
        self.cache: dict[str, int] = {}

    def words(self, words: list[str]) -> list[int]:
        """Number of tokens of each word (its marks included)."""
        text = "\0".join([w.replace("\0", self.spare) for w in words]) + "\0"
        odd = set(text) - self.single
        places = [m.start() for m in re.finditer("[" + re.escape("".join(sorted(odd))) + "]", text)]
        best: list[float] = [0.0] * (len(text) + 1)
        count = [0] * (len(text) + 1)
        out: list[int] = []
        low = self.unknown
        reached = 0  # places after this one have no score yet
        at, n = 0, len(places)
        places.append(len(text) + 1)
        upcoming = places[0]
        for end, (size, score) in self.automaton.iter(text):
            while upcoming < end:
                c = text[upcoming]
                if c == "\0":
                    out.append(count[upcoming])
                    best[upcoming + 1], count[upcoming + 1] = 0.0, 0
                elif reached <= upcoming or best[upcoming] + low > best[upcoming + 1]:
                    best[upcoming + 1], count[upcoming + 1] = best[upcoming] + low, count[upcoming] + len(c.encode("utf-8", "surrogatepass"))
                reached = upcoming + 1
                at += 1
                upcoming = places[at]
            b = best[end + 1 - size] + score
            if reached <= end or b > best[end + 1]:
                best[end + 1], count[end + 1] = b, count[end + 1 - size] + 1
                reached = end + 1
        while at < n:
            c = text[upcoming]
            if c == "\0":
                out.append(count[upcoming])
                best[upcoming + 1], count[upcoming + 1] = 0.0, 0
            elif reached <= upcoming or best[upcoming] + low > best[upcoming + 1]:
                best[upcoming + 1], count[upcoming + 1] = best[upcoming] + low, count[upcoming] + len(c.encode("utf-8", "surrogatepass"))
            reached = upcoming + 1
            at += 1
            upcoming = places[at]
        return out

    def known(self, words: list[str]) -> list[int]:
        fresh = [w for w in words if w not in self.cache]
        if fresh:
            fresh = list(dict.fromkeys(fresh))
            if len(self.cache) > CACHE:
                self.cache = {}
                fresh = list(dict.fromkeys(words))
            for i in range(0, len(fresh), 20_000):
                self.cache.update(zip(fresh[i : i + 20_000], self.words(fresh[i : i + 20_000]), strict=True))
        return list(map(self.cache.__getitem__, words))

    def texts(self, col: pa.Array) -> np.ndarray:
        """Number of tokens of each text; null and empty texts have none."""
        col = pc.fill_null(col, "")
        loose = pc.or_(pc.or_(pc.match_substring(col, "  "), pc.match_substring(col, MARK)), pc.starts_with(col, " "))
        total = np.zeros(len(col), np.int64)
        for i in pc.indices_nonzero(loose).to_pylist():
            total[i] = sum(self.known(re.findall(f"{MARK}+[^{MARK}]*", MARK + col[i].as_py().replace(" ", MARK))))
        plain = pc.and_(pc.invert(loose), pc.not_equal(col, ""))
        rows = pc.indices_nonzero(plain).to_numpy().astype(np.int64)
        cut = pc.split_pattern(col.filter(plain), " ")
        if not len(rows):
            return total
        bounds = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        counts = np.array(self.known([MARK + w for w in coded.dictionary.to_pylist()]), np.int64)
        total[rows] = sums(counts[coded.indices.to_numpy(zero_copy_only=False)], bounds - bounds[0])
        return total


def counter(model: bytes) -> Counter:
    return held(("tokens", hashlib.sha256(model).digest()), lambda: Counter(read_pieces(model)))


def token_counts(docs: DataFrame, model_path: str, to: str = "n_tokens") -> DataFrame:
    """Per row of docs: doc_id and its number of tokens. Repeated rows give repeated rows; other columns are ignored."""
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, half a megabyte whatever the corpus

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counter(shared.value).texts(b.column(1)), pa.int64())], ["doc_id", to])

    return docs.select("doc_id", "text").mapInArrow(pieces(run, holds=True), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {to} bigint")
