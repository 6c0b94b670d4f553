"""Ranked search for benchmark items by scanning the documents, without an index of them.

The terms of all items form one Aho-Corasick automaton that is broadcast.  Each term is
guarded by a blank at either side, and every character that belongs to no term is a
blank in the scanned text, so an output of the automaton is an occurrence of the whole
term.  A text is scanned once and gives the frequencies of all terms of all items;
an output is a term, and a list maps it to the items that hold it.  A first scan gives
the statistics of the corpus, a second one the scores.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegralType, LongType, StructField, StructType

from flowloom.llm.frames import pick

TOP = 50
# Texts of items whose terms are in the tasks at once; more are searched block after block.
BLOCK_BYTES = 2 << 20
# Cells of the dense table of documents and items that a task adds scores up in.
CELLS = 1 << 21
# Candidates that a task keeps beside its best before it drops the worse ones.
PENDING = 1 << 18
# Parts that the candidates of one item are dealt to before the last ranking.
LANES = 64

# Digits, lower-case letters and all of non-ASCII belong to terms, upper case is folded onto lower.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def folded(text: str) -> bytes:
    """The text in UTF-8, A-Z lower-cased, every character outside terms a blank."""
    return text.encode().translate(_FOLD)


class TermScanner:
    """All terms of some items as one boundary-guarded automaton, and which items hold each."""

    def __init__(self, items: Sequence[Iterable[bytes]]) -> None:
        import ahocorasick

        holders: dict[bytes, list[int]] = defaultdict(list)
        for k, terms in enumerate(items):
            for term in set(terms):
                holders[term].append(k)
        self.n_items = len(items)
        self.n_terms = len(holders)
        # the items of term t are held[begins[t]:begins[t + 1]]
        self.begins = np.concatenate([[0], np.cumsum([len(h) for h in holders.values()], dtype="int64")]).astype("int64")
        self.held = np.array([k for h in holders.values() for k in h], dtype="int64")
        self.automaton = ahocorasick.Automaton()
        for place, term in enumerate(holders):
            self.automaton.add_word(f" {term.decode()} ", place)
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[int, Counter]:
        """Terms of the text with repeats, and how often each of the items' terms occurs."""
        plain = folded(text)
        size = len(plain.split())
        if not size or not self.n_terms:
            return size, Counter()
        return size, Counter(map(itemgetter(1), self.automaton.iter(f" {plain.decode()} ")))

    def spread(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For places of terms: the place in ``terms`` and the item, of every item that holds them."""
        sizes = self.begins[terms + 1] - self.begins[terms]
        which = np.repeat(np.arange(len(terms)), sizes)
        within = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return which, self.held[self.begins[terms][which] + within]


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))), in doubles."""
    return np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype("int64")


def _add_up(cells: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of whole numbers per cell; halves of 24 bits keep the doubles of bincount exact."""
    low = np.bincount(cells, values & 0xFFFFFF, size).astype("int64")
    return (np.bincount(cells, values >> 24, size).astype("int64") << 24) + low


class Best:
    """The highest-scoring documents of every item, ties by ascending id (null last)."""

    def __init__(self, n_items: int, top: int) -> None:
        self.top = top
        self.least = np.ones(n_items, dtype="int64")
        self.parts: list[np.ndarray] = []
        self.size = 0
        self.rows = np.zeros((4, 0), dtype="int64")

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, absent: np.ndarray) -> None:
        """Candidates; ``absent`` is 1 where the id is null."""
        good = score >= self.least[item]
        self.parts.append(np.stack([item[good], score[good], doc[good], absent[good]]))
        self.size += int(good.sum())
        if self.size > PENDING + self.top * len(self.least):
            self.settle()

    def settle(self) -> np.ndarray:
        """The best so far as rows item, score, doc, absent; the worse ones are let go."""
        rows = np.concatenate([self.rows, *self.parts], axis=1)
        item, score, doc, absent = rows
        order = np.lexsort((doc, absent, -score, item))
        begins = np.searchsorted(item[order], np.arange(len(self.least)))
        place = np.arange(len(order)) - begins[item[order]]
        self.rows = rows[:, order[place < self.top]]
        last = order[place == self.top - 1]
        self.least[item[last]] = score[last]
        self.parts, self.size = [], self.rows.shape[1]
        return self.rows


_loaded: dict[str, TermScanner] = {}


def _scanner(name: str, items: Sequence[Iterable[bytes]]) -> TermScanner:
    """One automaton per worker process and block."""
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = TermScanner(items)
    return _loaded[name]


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Items in pieces of bounded size, dealt by id: the ids, and the terms of each."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).head()[0]
    count = max(1, -(-size // block_bytes))
    for k in range(count):
        terms: dict[object, set[bytes]] = defaultdict(set)
        for item, text in items.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k).collect():
            terms[item].update(folded(text or "").split())
        yield list(terms), [sorted(t) for t in terms.values()]


def _statistics(docs: DataFrame, name: str, shared, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and documents per term of the block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(name, shared.value)
        held = np.zeros(scanner.n_terms + 2, dtype="int64")
        for batch in batches:
            for text in batch.column(0).to_pylist():
                size, found = scanner.scan(text or "")
                held[-2] += size > 0
                held[-1] += size
                held[np.fromiter(found, dtype="int64", count=len(found))] += 1
        place = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(held[place])], ["place", "n"])

    counted = docs.select("text").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    held = np.zeros(n_terms + 2, dtype="int64")
    for place, n in counted.collect():  # one row per term of the block at most
        held[place] = n
    return int(held[-2]), int(held[-1]), held[:-2]


def _best_of_block(docs: DataFrame, name: str, shared, ids: list, item_type, n_terms: int, top: int) -> DataFrame:
    """Per task the best documents of every item of the block: ``item_id``, ``doc_id``, ``score``."""
    n_docs, n_all, df = _statistics(docs, name, shared, n_terms)
    weights = docs.sparkSession.sparkContext.broadcast(term_weights(df, n_docs))
    schema = StructType([StructField("item_id", item_type), docs.schema["doc_id"], StructField("score", LongType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        scanner, weight = _scanner(name, shared.value), weights.value
        best = Best(scanner.n_items, top)
        at_once = max(1, CELLS // max(scanner.n_items, 1))
        for batch in batches:
            for begin in range(0, batch.num_rows, at_once):
                part = batch.slice(begin, at_once)
                doc = part.column(0).cast(pa.int64())
                absent = np.asarray(doc.is_null()).astype("int64")
                doc = doc.fill_null(0).to_numpy()
                terms, times, sizes, lengths = [], [], [], []
                for text in part.column(1).to_pylist():
                    size, found = scanner.scan(text or "")
                    terms.extend(found.keys())
                    times.extend(found.values())
                    sizes.append(len(found))
                    # in Python's whole numbers: the product may pass 64 bits
                    lengths.append(50 + 50 * size * n_docs // n_all if size else 50)
                row = np.repeat(np.arange(part.num_rows), sizes)
                term, tf = np.array(terms, dtype="int64"), np.array(times, dtype="int64")
                value = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * np.array(lengths, dtype="int64")[row]))
                which, item = scanner.spread(term)
                cells = _add_up(row[which] * scanner.n_items + item, value[which], part.num_rows * scanner.n_items)
                hit = np.flatnonzero(cells)
                row, item = np.divmod(hit, max(scanner.n_items, 1))
                best.add(item, cells[hit], doc[row], absent[row])
        item, points, doc, absent = best.settle()
        names = pa.array(ids, type=arrow.field(0).type).take(pa.array(item))
        whose = pa.array(doc, mask=absent.astype(bool)).cast(arrow.field(1).type)
        yield pa.RecordBatch.from_arrays([names, whose, pa.array(points)], schema=arrow)

    return docs.mapInArrow(score, schema)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``top`` highest-scoring documents of each item: ``item_id``, ``rank``, ``doc_id``, ``score``.

    ``docs`` has ``doc_id`` (a whole number) and ``text``, ``items`` has ``item_id`` and ``text``; other
    columns are left out.  Null and empty texts have no terms: such documents are found by nothing and count in no statistic,
    such items find nothing.  Rows of one ``item_id`` (null is an id as well) are one item with the terms of all.
    Repeated documents are ranked like any other; equal scores rank by ascending ``doc_id``, null last.
    An empty table on either side gives no rows.

    Two scans of the documents per block of items; what leaves a task is ``top`` rows per item at most.  Those of one
    item are ranked in lanes first, so that no task gets the candidates of all tasks.  What is broadcast is bounded by ``block_bytes``, unless
    one item alone is larger.
    """
    docs, items = pick(docs, "doc_id", "text"), pick(items, "item_id", "text")
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise ValueError("doc_id must be a whole number")
    found = None
    for ids, terms in _blocks(items, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(terms)
        n_terms = len({t for held in terms for t in held})
        part = _best_of_block(docs, uuid.uuid4().hex, shared, ids, items.schema["item_id"].dataType, n_terms, top)
        found = part if found is None else found.unionByName(part)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    lane = F.pmod(F.xxhash64("doc_id", "score"), F.lit(LANES))
    for keys in (["item_id", lane], ["item_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return found.select("item_id", "rank", "doc_id", "score")
