"""Restoring disguised words: Viterbi decoding under a byte language model of the corpus.

A disguised word is a lattice: each written character offers the letters it may
stand for, runs of a letter may be shorter, separators may vanish.  The decoder
picks the path that the language model and the channel find likeliest together.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.frames import ROWS_AT_ONCE, pick

# Hashed trigrams of bytes, then all bigrams of bytes, in one table of counts.
TRIGRAMS = 1 << 18
BIGRAMS = 1 << 16
_MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)

# What a written sign may stand for.
_STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "§": "s",
}
_MASKS = "*#%?"
_SEPARATORS = ".-_,'~^`·•/\\"
_ANY_LETTER = "abcdefghijklmnopqrstuvwxyz"
# Channel costs in nats; a sign that looks like a letter is hardly ever there for nothing.
_SUBSTITUTED, _DROPPED, _MASKED, _SHORTENED, _NEEDLESS = 0.5, 0.7, 2.0, 0.4, 8.0
BEAM = 60

_EDGES = " \t\r\n\"'.,;:?!*#$%&()[]{}<>|~`-_/\\"
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_LETTER = re.compile(r"[^\W\d_]")


def _folded(texts: list[str]) -> np.ndarray:
    """Lower-case bytes of the texts; all that is no letter is a blank."""
    raw = np.frombuffer((" " + " ".join(texts) + " ").lower().encode("utf-8", "surrogatepass"), np.uint8)
    letters = (raw >= 97) & (raw <= 122) | (raw >= 128)
    return np.where(letters, raw, np.uint8(32))


def _trigram(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    mixed = a.astype(np.uint64) * _MIX[0] + b.astype(np.uint64) * _MIX[1] + c.astype(np.uint64) * _MIX[2]
    return ((mixed ^ (mixed >> np.uint64(15))) % TRIGRAMS).astype(np.int64)


def language_counts(docs: DataFrame) -> np.ndarray:
    """Counts of byte trigrams (hashed) and bigrams over all whole texts.

    Each task counts its texts and hands on its non-empty cells, which are summed
    after a shuffle; the table has at most ``TRIGRAMS + BIGRAMS`` cells at any size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TRIGRAMS + BIGRAMS, np.int64)
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
                texts = [t for t in batch.slice(begin, ROWS_AT_ONCE).column(0).to_pylist() if t]
                seen = _folded(texts)
                total[:TRIGRAMS] += np.bincount(_trigram(seen[:-2], seen[1:-1], seen[2:]), minlength=TRIGRAMS)
                pairs = (seen[:-1].astype(np.int64) << 8) | seen[1:]
                total[TRIGRAMS:] += np.bincount(pairs, minlength=BIGRAMS)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    cells = pick(docs, "text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    table = np.zeros(TRIGRAMS + BIGRAMS, np.int64)
    for batch in cells.toArrow().to_batches():
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return table


@dataclass
class LanguageModel:
    """Interpolated trigram model of bytes over the counted table."""

    counts: np.ndarray

    def __post_init__(self) -> None:
        self.pairs = self.counts[TRIGRAMS:].reshape(256, 256)
        self.singles = self.pairs.sum(axis=1)
        self.memo: dict[tuple[int, int, int], float] = {}

    def cost(self, a: int, b: int, c: int) -> float:
        """Nats of byte c after a and b."""
        key = (a, b, c)
        found = self.memo.get(key)
        if found is None:
            one = (self.singles[c] + 1) / (self.singles.sum() + 256)
            two = (self.pairs[b, c] + 20 * one) / (self.singles[b] + 20)
            cell = int(_trigram(*(np.array([x]) for x in key))[0])
            seen = min(self.counts[cell], self.pairs[a, b])
            found = self.memo[key] = -math.log((seen + 20 * two) / (self.pairs[a, b] + 20))
        return found


class Restorer:
    """Decodes disguised words; plain words pass through."""

    def __init__(self, counts: np.ndarray) -> None:
        self.model = LanguageModel(counts)

    def _choices(self, sign: str, run: int) -> list[tuple[bytes, float]]:
        if _LETTER.match(sign):
            letter = sign.encode()
            if run == 1:
                return [(letter, 0.0)]
            if run == 2:
                return [(letter * 2, 0.0), (letter, 2.5)]
            return [(letter, _SHORTENED), (letter * 2, _SHORTENED)]
        if sign in _STANDS_FOR:
            choices = [(c.encode(), _SUBSTITUTED) for c in _STANDS_FOR[sign]]
            if run > 1:
                choices += [(c.encode() * 2, _SUBSTITUTED * 2) for c in _STANDS_FOR[sign]]
            return choices + [(b"", _NEEDLESS * run)]
        if sign in _MASKS:
            return [(c.encode() * run, _MASKED * run) for c in _ANY_LETTER] + [(b"", _NEEDLESS * run)]
        return [(b"", _DROPPED)]

    def decode(self, written: str) -> str:
        """The likeliest word behind a lower-case written form."""
        cost = self.model.cost
        beam: dict[tuple[int, int], tuple[float, bytes]] = {(32, 32): (0.0, b"")}
        for sign, group in groupby(written):
            choices = self._choices(sign, sum(1 for _ in group))
            grown: dict[tuple[int, int], tuple[float, bytes]] = {}
            for (a, b), (so_far, word) in beam.items():
                for letters, price in choices:
                    total, x, y = so_far + price, a, b
                    for c in letters:
                        total += cost(x, y, c)
                        x, y = y, c
                    if (x, y) not in grown or total < grown[x, y][0]:
                        grown[x, y] = (total, word + letters)
            beam = dict(sorted(grown.items(), key=lambda kv: (kv[1][0], kv[1][1]))[:BEAM])
        ended = ((total + cost(a, b, 32), word) for (a, b), (total, word) in beam.items())
        return min(ended)[1].decode("utf-8", "replace")

    def word(self, token: str) -> str:
        """A lower-case token restored: edges trimmed, disguises decoded."""
        bare = token.strip(_EDGES)
        if not _LETTER.search(bare):
            return ""
        # a currency sign in front may be a letter ("$cum"), one behind is decoration
        begin = token.find(bare)
        if begin and token[begin - 1] in "$€":
            bare = token[begin - 1] + bare
        return bare if bare.isalpha() and not _TRIPLE.search(bare) else self.decode(bare)


def joined_tokens(text: str) -> list[str]:
    """White-space tokens, lower-case, with spelled-out runs of single letters added as one token."""
    tokens = text.lower().split()
    if not tokens:
        return tokens
    added, run = [], ""
    for token in [*tokens, ""]:
        if len(token) == 1:
            run += token
            continue
        if len(run) > 3:
            # a one-letter word before or after may have joined the run
            added += [run, run[1:], run[:-1]]
        run = ""
    return tokens + added
