"""Packing documents into token sequences by bin completion.

Documents are tokenised and cut into pieces of at most one sequence.  An instance
of the packing problem is the histogram of piece lengths, which has at most
``capacity`` entries at any corpus size; the solver turns it into patterns (the
lengths in one sequence) with how often each is used.  Pieces of a length are
numbered, and their number says which place of which pattern is theirs.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from flowloom.llm.frames import ROWS_AT_ONCE, pick
from flowloom.session import checkpoint

MODEL = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
# Chunks of text whose ids a worker remembers; it starts afresh when full.
MEMO_ENTRIES = 600_000
# ASCII signs that are neither letters, digits nor blanks.
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MEMO_CHARS = 48
# Nodes the branch and bound may visit, and completions it tries at each.
NODES = 20_000
WIDTH = 6

_UINT32 = "I"


# --- tokens ----------------------------------------------------------------


# Byte-level alphabets write a byte as its Latin-1 character, or, where that does not
# print, as the next free character from 256 on.
_SILENT = [*range(33), *range(127, 161), 173]
_BYTE_LETTERS = {b: 256 + k for k, b in enumerate(_SILENT)}


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _ends_word(core: str) -> bool:
    """Whether the last character, in lower case, still ends in a letter or digit."""
    last = core[-1].lower()[-1]
    return last.isalpha() or last in "0123456789"


class ChunkEncoder:
    """Ids of whole texts from memoised chunks between blanks.

    The tokenizer drops white space and lets no token cross it, so the ids of a
    text are those of its chunks in order.
    """

    def __init__(self, model: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.model = self.tokenizer.model
        # two generations: what is met again while the older one is forgotten moves to the newer
        self.memo: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.memo) > MEMO_ENTRIES:
            self.older, self.memo = self.memo, {"": b""}
        known = self.memo
        chunks = [self._folded(t).replace("\n", " ").split(" ") for t in texts]
        coded = [list(map(known.get, cut)) for cut in chunks]
        missing = {c for cut, ids in zip(chunks, coded) if None in ids for c, i in zip(cut, ids) if i is None}
        fresh = self._look_up(missing)
        for cut, ids in zip(chunks, coded):
            if None in ids:
                ids[:] = [i if i is not None else fresh[c] for c, i in zip(cut, ids)]
        known.update((c, ids) for c, ids in fresh.items() if len(c) <= MEMO_CHARS)
        return [b"".join(ids) for ids in coded]

    def _look_up(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of chunks not at hand.

        Signs at the end of a chunk, after a letter or digit, are words of their own
        to the tokenizer, so the chunk's ids are those of both parts.
        """
        memo, older = self.memo, self.older
        fresh: dict[str, bytes] = {}
        closed: list[tuple[str, str]] = []
        asked: set[str] = set()
        for c in missing:
            if (ids := older.get(c)) is not None:
                fresh[c] = ids
                continue
            core = c.rstrip(_SIGNS)
            if not core or core == c or "<|" in c or not _ends_word(core):
                asked.add(c)
                continue
            closed.append((c, core))
            for part in (core, c[len(core) :]):
                if (ids := memo.get(part) or older.get(part)) is not None:
                    fresh[part] = ids
                else:
                    asked.add(part)
        whole = []
        for c in asked:
            if c.isalpha() and (c.isascii() or _is_latin(c)) and c == c.lower():
                fresh[c] = self._letters(c)
            else:
                whole.append(c)
        for c, e in zip(whole, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)):
            fresh[c] = array("I", e.ids).tobytes()
        for c, core in closed:
            fresh[c] = fresh[core] + fresh[c[len(core) :]]
        return fresh

    def _letters(self, word: str) -> bytes:
        """Ids of a lower-case Latin-1 word, which normalising and pre-splitting leave whole.

        The model itself is asked, with the word's bytes written as its alphabet has them.
        """
        coded = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(coded)]).tobytes()

    @staticmethod
    def _folded(text: str) -> str:
        """Lower case where that is plainly what the tokenizer does: Latin-1 without special tokens."""
        return text.lower() if "<|" not in text and _is_latin(text) else text


_loaded: dict[int, ChunkEncoder] = {}


def _encoder(model: str) -> ChunkEncoder:
    """One encoder per worker process, so that its memo outlives a task."""
    key = hash(model)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ChunkEncoder(model)
    return _loaded[key]


def model_text(path: str | None = None) -> str:
    """The tokenizer file, read on the driver and sent to the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    with open(path, encoding="utf-8") as file:
        return file.read()


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """The pieces of every document: ``doc_id, piece, start, length, ids_crc32, part``.

    A document is its ids and the end id; only longer ones than ``capacity`` are cut.
    """
    model = docs.sparkSession.sparkContext.broadcast(model_text(path))
    slim = pick(docs, "doc_id", "text")
    rest = StructType.fromDDL("piece int, start long, length long, ids_crc32 long")
    schema = StructType([slim.schema["doc_id"], *rest.fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        encoder = _encoder(model.value)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(begin, ROWS_AT_ONCE)
                coded = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                source, piece, start, length, crc = [], [], [], [], []
                for row, ids in enumerate(coded):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        source.append(row)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                names = part.column(0).take(pa.array(source, pa.int64()))
                columns = [names.cast(arrow.field(0).type)]
                columns += [pa.array(v, arrow.field(k).type) for k, v in enumerate((piece, start, length, crc), 1)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return slim.mapInArrow(cut, schema).withColumn("part", F.spark_partition_id())


# --- the solver ------------------------------------------------------------


@dataclass
class Packing:
    """Patterns (lengths, largest first) and how many sequences follow each."""

    patterns: list[tuple[tuple[int, ...], int]] = field(default_factory=list)

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.patterns)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: by volume, and by items too large to share with one another."""
    lengths = np.arange(capacity + 1)
    best = -(-int((counts * lengths).sum()) // capacity)
    many = np.concatenate([[0], np.cumsum(counts)])
    volume = np.concatenate([[0], np.cumsum(counts * lengths)])
    for small in range(0, capacity // 2 + 1):
        # items above capacity - small stand alone among those of at least ``small``
        alone = many[capacity + 1] - many[capacity - small + 1]
        large = many[capacity - small + 1] - many[capacity // 2 + 1]
        large_volume = volume[capacity - small + 1] - volume[capacity // 2 + 1]
        middle = volume[capacity // 2 + 1] - volume[small]
        room = large * capacity - large_volume
        best = max(best, int(alone + large + max(0, -(-(middle - room) // capacity))))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> Packing:
    """Best-fit decreasing over the histogram: equal sequences are filled alike, all at once."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    room = np.zeros(capacity + 1, dtype=np.int64)
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            fitting = np.flatnonzero(room[length:])
            if not len(fitting):
                fill = min(capacity // length, left)
                times = left // fill
                space = capacity - fill * length
                open_bins.setdefault(space, []).append(((length,) * fill, times))
                room[space] += times
                left -= times * fill
                continue
            space = int(fitting[0]) + length
            pattern, times = open_bins[space].pop()
            fill = min(space // length, left)
            used = min(times, left // fill)
            if used < times:
                open_bins[space].append((pattern, times - used))
            room[space] -= used
            after = space - fill * length
            open_bins.setdefault(after, []).append((pattern + (length,) * fill, used))
            room[after] += used
            left -= used * fill
    return Packing([b for same in open_bins.values() for b in same])


class BinCompletion:
    """Branch and bound that completes the sequence of the largest piece left.

    Completions are tried fullest first, of equally full ones those of fewer,
    larger pieces, which dominate: what fits beside small pieces fits beside larger
    ones they could stand in for.  A branch ends when its waste exceeds what a
    better packing than the incumbent may waste.
    """

    def __init__(self, counts: np.ndarray, capacity: int) -> None:
        self.capacity = capacity
        self.counts = counts.astype(np.int64).copy()
        self.volume = int((self.counts * np.arange(capacity + 1)).sum())
        self.bound = lower_bound(self.counts, capacity)
        self.incumbent = best_fit(self.counts, capacity)
        self.nodes = 0

    def solve(self, nodes: int = NODES) -> Packing:
        if self.incumbent.sequences <= self.bound:
            return self.incumbent
        chosen: list[tuple[tuple[int, ...], int]] = []
        # each level: the completions still to try there
        levels: list[list[tuple[int, ...]]] = []
        waste = used = 0
        while self.nodes < nodes and self.incumbent.sequences > self.bound:
            if len(levels) == len(chosen):
                if not self.counts.any():
                    if used < self.incumbent.sequences:
                        self.incumbent = Packing(list(chosen))
                    levels.append([])
                else:
                    self.nodes += 1
                    levels.append(self.completions()[::-1])
            if levels[-1]:
                pattern = levels[-1].pop()
                times = self._times(pattern)
                allowed = (self.incumbent.sequences - 1) * self.capacity - self.volume
                more = (self.capacity - sum(pattern)) * times
                last = times * sum(pattern) == int((self.counts * np.arange(self.capacity + 1)).sum())
                if waste + more > allowed + (self.capacity if last else 0):
                    continue
                self._take(pattern, times, -1)
                chosen.append((pattern, times))
                waste, used = waste + more, used + times
                continue
            levels.pop()
            if not chosen:
                break
            pattern, times = chosen.pop()
            self._take(pattern, times, 1)
            waste, used = waste - (self.capacity - sum(pattern)) * times, used - times
        return self.incumbent

    def _times(self, pattern: tuple[int, ...]) -> int:
        """How often the pattern can be used with the pieces left."""
        lengths, each = np.unique(pattern, return_counts=True)
        return int((self.counts[lengths] // each).min())

    def _take(self, pattern: tuple[int, ...], times: int, sign: int) -> None:
        lengths, each = np.unique(pattern, return_counts=True)
        self.counts[lengths] += sign * times * each

    def completions(self) -> list[tuple[int, ...]]:
        """Fillings around the largest piece left, best first."""
        counts = self.counts
        largest = int(np.flatnonzero(counts)[-1])
        counts[largest] -= 1
        room = self.capacity - largest
        places = np.where(counts[: room + 1] > 0, np.arange(room + 1), 0)
        floor = np.maximum.accumulate(places)  # the largest length left that is at most this
        found: set[tuple[int, ...]] = set()
        if floor[room]:
            found.add((int(floor[room]),))
            pair = self._pair(floor, room)
            if pair:
                found.add(pair)
            head: tuple[int, ...] = ()
            rest = room
            # the largest that fits, again and again, each time ended by the best pair
            while rest > 0 and floor[rest]:
                firsts = np.unique(floor[max(rest - 64, 0) : rest + 1])[::-1][:WIDTH]
                for first in firsts[firsts > 0]:
                    first = int(first)
                    start = (*head, first)
                    pair = self._pair(floor, rest - first)
                    for tail in ((), (int(floor[rest - first]),) if floor[rest - first] else (), pair):
                        if self._enough((*start, *tail)):
                            found.add((*start, *tail))
                first = int(floor[rest])
                while first and not self._enough((*head, first)):
                    first = int(floor[first - 1])
                if not first:
                    break
                head = (*head, first)
                rest -= first
                found.add(head)
        counts[largest] += 1
        whole = {tuple(sorted((largest, *f), reverse=True)) for f in found} or {(largest,)}
        return sorted(whole, key=lambda p: (self.capacity - sum(p), len(p), [-x for x in p]))[:WIDTH]

    def _enough(self, filling: tuple[int, ...]) -> bool:
        return all(self.counts[x] >= filling.count(x) for x in set(filling))

    def _pair(self, floor: np.ndarray, room: int) -> tuple[int, ...]:
        """The fullest two pieces for the room, of equally full pairs that with the largest piece."""
        if room < 2:
            return ()
        first = np.flatnonzero(self.counts[:room] > 0)
        first = first[first > 0]
        if not len(first):
            return ()
        second = floor[np.minimum(room - first, first)]
        valid = (second > 0) & ((second != first) | (self.counts[first] > 1))
        if not valid.any():
            return ()
        total = np.where(valid, first + second, 0)
        k = len(total) - 1 - int(np.argmax(total[::-1]))
        return int(first[k]), int(second[k])


# --- assignment ------------------------------------------------------------


def place_ranges(packing: Packing) -> list[tuple[int, int, int, int, int, int]]:
    """For the pieces of each length, by number: ``length, low, high, each, first_sequence, offset``."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for pattern, times in packing.patterns:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            each = pattern.count(length)
            low = used.get(length, 0)
            used[length] = low + times * each
            rows.append((length, low, used[length], each, first, offset))
            offset += each * length
        first += times
    return rows


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Per piece: where it lies in which sequence.

    Takes ``doc_id`` and ``text``; other columns are left out.  A null or empty text
    is the end id alone.  Output: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset``.  Equal rows and null ids are documents like any other; an empty table
    gives no rows.  Only the histogram of lengths (at most ``capacity`` numbers) goes
    to the driver and only the ranges of its patterns are broadcast.  Numbers within
    a length are counted per input partition, so a length that very many pieces share
    is not gathered in one task.
    """
    spark = docs.sparkSession
    small = checkpoint(pieces(docs, capacity, path))
    per_part = small.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    packing = BinCompletion(counts, capacity).solve()
    ranges = spark.createDataFrame(
        place_ranges(packing), "length long, low long, high long, each long, first_sequence long, at long"
    )
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = per_part.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    inner = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    numbered = (
        small.withColumn("k", F.row_number().over(inner) - 1)
        .join(begins, ["length", "part"])
        .withColumn("k", F.col("k") + F.col("begin"))
    )
    inside = F.col("k") - F.col("low")
    return (
        numbered.join(F.broadcast(ranges), "length")
        .where((F.col("k") >= F.col("low")) & (F.col("k") < F.col("high")))
        .select(
            "doc_id",
            "piece",
            "start",
            "length",
            "ids_crc32",
            (F.col("first_sequence") + F.floor(inside / F.col("each"))).cast("long").alias("sequence_id"),
            (F.col("at") + F.pmod(inside, F.col("each")) * F.col("length")).cast("long").alias("offset"),
        )
    )
