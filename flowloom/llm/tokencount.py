"""Token counts at every prefix of a text, for a byte-fallback BPE piece model.

No piece of the vocabulary holds a space or a line break after its first
character, so the encoding of a text is that of its segments, one after the
other.  Within a segment a dynamic program walks the prefixes: the encoding of a
prefix ends in the one piece that neither merges with, nor is broken up by, the
last piece of the shorter prefix before it.  That gives the exact count at every
prefix.  Segments are memoised, and counts at segment ends are running sums, so
questions about truncation and budgets look numbers up and encode nothing again.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.frames import map_texts, pick

MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
SPACE = "▁"
# Segments longer than this are rarely met twice and are not memoised.
MEMO_CHARS = 48
# Entries of a worker's memo; it starts afresh when full.
MEMO_ENTRIES = 600_000


class Prefixes(NamedTuple):
    """Counts at segment ends: ``ends`` in code points, ``counts`` of all tokens up to there."""

    ends: list[int]
    counts: list[int]
    segments: list[str]


class PieceCounter:
    """Exact prefix counts of one piece model."""

    def __init__(self, model: bytes) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        # type 1 are ordinary pieces; bytes and control pieces never match text
        pieces = [p for p in proto.pieces if p.type == 1]
        self.score = {p.piece: p.score for p in pieces}
        self.number = {p.piece: k for k, p in enumerate(pieces, 1)}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.score):
            raise ValueError("pieces of this model cross words or lines")
        # lists the pieces that end at each place of a segment, longest first
        self.ending = ahocorasick.Automaton()
        for piece, k in self.number.items():
            self.ending.add_word(piece, (k, piece, len(piece)))
        self.ending.make_automaton()
        self.fitting: dict[int, bool] = {}
        self.memo: dict[str, int] = {"": 0}

    def merge(self, text: str) -> list[str]:
        """Plain BPE of a short string: best score first, leftmost on ties."""
        symbols = list(text)
        score = self.score
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def fits(self, before: str, piece: str) -> bool:
        """Whether the piece stays whole, and apart, when it follows the other one."""
        if len(self.fitting) > MEMO_ENTRIES:
            self.fitting.clear()
        return self.merge(before + piece) == ([before, piece] if before else [piece])

    def prefix_counts(self, segment: str) -> list[int]:
        """Tokens of every prefix of a segment, from the empty one to the whole.

        A character outside the vocabulary falls back to its bytes and takes part
        in no merge, so what follows it is encoded as at a beginning.
        """
        fitting = self.fitting
        numbers, pieces, counts = [0], [""], [0]
        done = 0
        for place, (k, piece, size) in self.ending.iter(segment):
            if place < done:
                continue
            while done < place:
                self._fall_back(segment[done], numbers, pieces, counts)
                done += 1
            begin = place + 1 - size
            key = (numbers[begin] << 20) | k
            fit = fitting.get(key)
            if fit is None:
                fit = fitting[key] = self.fits(pieces[begin], piece)
            if fit:
                numbers.append(k)
                pieces.append(piece)
                counts.append(counts[begin] + 1)
                done += 1
        for char in segment[done:]:
            self._fall_back(char, numbers, pieces, counts)
        return counts

    def _fall_back(self, char: str, numbers: list[int], pieces: list[str], counts: list[int]) -> None:
        if char in self.number:
            raise AssertionError(f"no piece ends with {char!r} here")
        numbers.append(0)
        pieces.append("")
        counts.append(counts[-1] + len(char.encode("utf-8", "surrogatepass")))

    def total(self, segment: str) -> int:
        found = self.memo.get(segment)
        if found is None:
            found = self.prefix_counts(segment)[-1]
            if len(segment) <= MEMO_CHARS:
                if len(self.memo) >= MEMO_ENTRIES:
                    self.memo.clear()
                    self.memo[""] = 0
                self.memo[segment] = found
        return found

    @staticmethod
    def segments(text: str) -> list[str]:
        """The text after its leading mark, cut before each run of spaces and around each line break.

        Some of the segments may be empty.
        """
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        if SPACE + SPACE in marked:
            return [s for line in re.split("(\n)", marked) for s in re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", line)]
        return marked.replace(SPACE, " " + SPACE).replace("\n", " \n ").split(" ")

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        known = self.memo.get
        return sum([n if (n := known(s)) is not None else self.total(s) for s in self.segments(text)])

    def prefixes(self, text: str) -> Prefixes:
        cut = self.segments(text)
        counts = [self.total(s) for s in cut]
        # the leading mark is no character of the text
        ends = [e - 1 for e in accumulate(map(len, cut))]
        return Prefixes(ends, list(accumulate(counts)), cut)

    def at(self, prefixes: Prefixes, chars: int) -> int:
        """Tokens of the text's first ``chars`` code points."""
        if chars <= 0 or not prefixes.ends:
            return 0
        k = bisect_right(prefixes.ends, chars)
        before = prefixes.counts[k - 1] if k else 0
        begin = prefixes.ends[k - 1] if k else -1
        if k == len(prefixes.ends) or begin == chars:
            return before
        return before + self.prefix_counts(prefixes.segments[k])[chars - begin]

    def within(self, prefixes: Prefixes, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens."""
        k = bisect_right(prefixes.counts, budget)
        before = prefixes.counts[k - 1] if k else 0
        begin = prefixes.ends[k - 1] if k else -1
        if k == len(prefixes.ends):
            return max(begin, 0)
        inside = self.prefix_counts(prefixes.segments[k])
        more = max(i for i, n in enumerate(inside) if before + n <= budget)
        return max(begin + more, 0)


_loaded: dict[int, PieceCounter] = {}


def _counter(model: bytes) -> PieceCounter:
    """One counter per worker process, so that its memo outlives a task."""
    key = hash(model)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = PieceCounter(model)
    return _loaded[key]


def model_bytes(path: str | None = None) -> bytes:
    """The vocabulary file, read on the driver and sent to the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    with open(path, "rb") as file:
        return file.read()


def token_counts(docs: DataFrame, limit: int = TOKEN_LIMIT, path: str | None = None) -> DataFrame:
    """Per document: UTF-8 bytes, tokens, whether they exceed ``limit``, and the longest fitting prefix.

    Takes ``doc_id`` and ``text``; other columns are left out.  A null text
    counts as empty: no bytes, no tokens.  Repeated rows and null ids are counted
    like any other row.  ``fit_chars`` is the number of code points of the longest
    prefix of at most ``limit`` tokens.  A map over rows: no shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(path))

    def prepare():
        counter = _counter(model.value)

        def work(texts):
            n_bytes, n_tokens, fit = [], [], []
            for text in texts:
                tokens = counter.count(text)
                n_bytes.append(len(text.encode()))
                n_tokens.append(tokens)
                fit.append(len(text) if tokens <= limit else counter.within(counter.prefixes(text), limit))
            return n_bytes, n_tokens, [n > limit for n in n_tokens], fit

        return work

    added = "n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
    return map_texts(pick(docs, "doc_id", "text"), "text", added, prepare)


def prefix_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The stored table: per document the segment ends and the token counts up to them.

    Columns ``doc_id``, ``ends`` and ``counts`` (arrays, empty for an empty or
    null text).  ``tokens_at`` and ``cut_at`` answer from it.
    """
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(path))

    def prepare():
        counter = _counter(model.value)

        def work(texts):
            tables = [counter.prefixes(t) for t in texts]
            return [t.ends for t in tables], [t.counts for t in tables]

        return work

    return map_texts(pick(docs, "doc_id", "text"), "text", "ends array<int>, counts array<int>", prepare)


def cut_at(table: DataFrame, budget: int) -> DataFrame:
    """From a stored table: the last segment end within ``budget`` tokens and the count there.

    Counts grow along a text, so this is a filter of two arrays; nothing is encoded.
    """
    held = F.size(F.filter("counts", lambda n: n <= F.lit(budget)))
    end = F.when(held > 0, F.element_at("ends", F.greatest(held, F.lit(1)))).otherwise(F.lit(0))
    count = F.when(held > 0, F.element_at("counts", F.greatest(held, F.lit(1)))).otherwise(F.lit(0))
    return table.select("doc_id", F.greatest(end, F.lit(0)).alias("cut_chars"), count.alias("cut_tokens"))
