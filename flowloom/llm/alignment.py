"""Links between the tokens of two vocabularies, counted with inverted bitmaps.

Tokens of the byte-level and of the piece vocabulary are laid over the same bytes.
Places where both end cut them into groups; two tokens whose bytes overlap are linked.

Documents are numbered in blocks.  A task inverts each block: for every pair of ids it
writes bitmaps of the block's documents, compressed to sorted numbers where they are
thin.  There is one bitmap per bit of the number of links (a multiplicity plane), and
the documents that hold a pair are the bits of its planes, merged by OR and counted.
Blocks hold different documents, so the counts of a pair add up over them.  The counts
then travel with the postings back to the blocks, where the planes give every document
its sums.  No document meets another and none is tokenized twice.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from flowloom.llm.frames import pick, stored

BYTE_MODEL = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"
SPACE = "▁"
# A block ends after so many documents, or with the document that brings it over so many links.
BLOCK_DOCS = 4096
BLOCK_LINKS = 2_000_000
# Documents whose unknown words are encoded together.
ROWS_AT_ONCE = 256
# Size (characters and links) at which a worker forgets its words.
MEMO_SIZE = 12_000_000
# Pairs whose counts are sent to every task (some 20 MB); more of them are joined by a shuffle.
BROADCAST_PAIRS = 500_000

POSTING = "block long, pair long, plane int, dense boolean, n_docs int, docs binary"
COUNTED = "local int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"

# A blank between two characters that are no white space begins a token of either vocabulary.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary.

    Printable Latin-1 stands for itself, the other bytes follow each other from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Words(NamedTuple):
    """The pairs of the known words, word after word, and where those of each begin."""

    begins: np.ndarray
    pairs: np.ndarray


class Aligner:
    """Both vocabularies, and what is known of the words met so far.

    Where the vocabularies allow it, a text is cut before single blanks and the words
    between are aligned once each; a word is a whole text where they do not.
    """

    def __init__(self, byte_model: str, piece_model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_model)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=piece_model)
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            known = all(c in alphabet for c in token)
            self.a_bytes[k] = bytes(alphabet[c] for c in token) if known else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [self._piece_bytes(p) for p in pieces]
        self.a_sizes, self.b_sizes = ([len(x) for x in side] for side in (self.a_bytes, self.b_bytes))
        self.names = [str(k) for k in range(max(len(self.a_bytes), len(self.b_bytes)))]
        how = json.loads(byte_model)
        before = how.get("pre_tokenizer") or {}
        self.by_words = (
            how.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        )
        self.forget()

    @staticmethod
    def _piece_bytes(piece: str) -> bytes:
        byte = _BYTE_PIECE.fullmatch(piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE, " ").encode()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.unfit: set[int] = set()
        self.groups: list[str] = []
        self.counts = [array("q") for _ in range(4)]
        self.begins = array("q", [0])
        self.pairs = array("q")
        self.size = 0

    def words_of(self, text: str) -> list[str]:
        """Pieces of the text between which both vocabularies always have a boundary, without the blank ahead of each."""
        return _CUT.split(text) if self.by_words else [text]

    def learn(self, words: list[str]) -> None:
        """Align words that are not known yet."""
        # nothing here forms cycles, and the collector would look at every known word again and again
        gc.disable()
        try:
            encoded = self.a.encode_batch([" " + w for w in words], add_special_tokens=False)
            for word, a, b in zip(words, encoded, self.b.encode(words, num_threads=1)):
                self._enter(word, a.ids, b)
        finally:
            gc.enable()

    def _enter(self, word: str, a: list[int], b: list[int]) -> None:
        number = self.number[word] = len(self.groups)
        whole = b" " + word.encode()
        fits = b"".join([self.a_bytes[k] for k in a]) == whole == b"".join([self.b_bytes[k] for k in b])
        if not fits:
            self.unfit.add(number)
            a = b = []
        groups, links = align(a, b, self.a_sizes, self.b_sizes)
        name = self.names
        self.groups.append(
            ";".join([",".join([name[k] for k in x]) + "|" + ",".join([name[k] for k in y]) for x, y in groups])
        )
        n_a, n_b, n_groups, n_links = self.counts
        n_a.append(len(a))
        n_b.append(len(b))
        n_groups.append(len(groups))
        n_links.append(len(links))
        self.pairs.extend(links)
        self.begins.append(len(self.pairs))
        self.size += len(word) + len(links) + 16

    def numbers_of(self, texts: list[str]) -> list[list[int] | None]:
        """Per text the numbers of its words in order; None where the text has no tokens that fit."""
        cut = [self.words_of(t) if t else [] for t in texts]
        fresh = dict.fromkeys(w for words in cut for w in words if w not in self.number)
        self.learn(list(fresh))
        known, unfit = self.number, self.unfit
        out: list[list[int] | None] = []
        for text, words in zip(texts, cut):
            numbers = [known[w] for w in words]
            if unfit and not unfit.isdisjoint(numbers):
                # a word that does not fit by itself: the text as a whole decides
                if text not in known:
                    self.learn([text])
                numbers = [known[text]]
            out.append(numbers if numbers and numbers[0] not in unfit else None)
        return out

    def table(self) -> Words:
        return Words(np.array(self.begins, dtype="int64"), np.array(self.pairs, dtype="int64"))

    def totals(self, texts: list[list[int] | None]) -> np.ndarray:
        """Per text (numbers of words) the tokens of either side, groups and links: one row each."""
        numbers = np.array([k for t in texts for k in t or ()], dtype="int64")
        ends = np.cumsum([len(t or ()) for t in texts], dtype="int64")
        out = np.empty((len(texts), len(self.counts)), dtype="int64")
        for column, held in enumerate(self.counts):
            running = np.concatenate([[0], np.cumsum(np.frombuffer(held, dtype="int64")[numbers] if len(held) else [])])
            out[:, column] = np.diff(running[ends], prepend=0)
        return out


def align(
    a: list[int], b: list[int], a_sizes: list[int], b_sizes: list[int]
) -> tuple[list[tuple[list[int], list[int]]], list[int]]:
    """Groups and links (pairs of ids) of two token sequences over the same bytes; sizes are by id.

    Between two neighbouring boundaries lies exactly one token of either side; that is one link.
    """
    if len(a) == 1 or len(b) == 1:
        return [(a, b)], [(x << 32) | y for x in a for y in b]
    groups, links = [], []
    i = j = first_i = first_j = ahead = 0
    while i < len(a) and j < len(b):
        # how much further the token of b reaches than that of a
        if i == first_i and j == first_j:
            ahead = b_sizes[b[j]] - a_sizes[a[i]]
        links.append((a[i] << 32) | b[j])
        if ahead > 0:
            i += 1
            ahead -= a_sizes[a[i]]
        elif ahead < 0:
            j += 1
            ahead += b_sizes[b[j]]
        else:
            i, j = i + 1, j + 1
            groups.append((a[first_i:i], b[first_j:j]))
            first_i, first_j = i, j
    return groups, links


def _expand(begins: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges ``begins[p]:begins[p + 1]``: which of ``places`` each element belongs to, and its position."""
    sizes = begins[places + 1] - begins[places]
    which = np.repeat(np.arange(len(places)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes - begins[places], sizes)


def invert(words: Words, numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per (pair, document) of a block, sorted, the number of links; documents count from 0."""
    doc = np.repeat(np.arange(len(numbers)), [len(n) for n in numbers])
    every = np.concatenate([*numbers, np.zeros(0, dtype="int32")])
    n_words = len(words.begins)
    held, times = np.unique(doc * n_words + every, return_counts=True)
    doc, word = np.divmod(held, n_words)
    which, place = _expand(words.begins, word)
    codes, pair = np.unique(words.pairs[place], return_inverse=True)
    key = pair * max(len(numbers), 1) + doc[which]
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[which][order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    pair, doc = np.divmod(key[first], max(len(numbers), 1))
    return codes[pair], doc, np.add.reduceat(times, first) if len(first) else times


def planes_of(pair: np.ndarray, doc: np.ndarray, times: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, list[bytes], list[bool]]]:
    """Bitmaps of a block by multiplicity plane: the plane, its pairs, their bitmaps, and which of them are dense.

    Plane k holds the documents whose number of links has bit k.  A thin bitmap is the sorted document numbers
    in 16 bits each, a dense one has a bit per document of the block (``width``).
    """
    for plane in range(int(times.max(initial=0)).bit_length()):
        held = np.flatnonzero((times >> plane) & 1)
        here, docs = pair[held], doc[held]
        first = np.flatnonzero(np.diff(here, prepend=-1))
        ends = np.append(first[1:], len(here))
        thin = docs.astype("<u2").tobytes()
        bitmaps = [thin[2 * x : 2 * y] for x, y in zip(first.tolist(), ends.tolist())]
        dense = (ends - first) * 16 > width
        for k in np.flatnonzero(dense).tolist():
            bits = np.zeros(width, dtype="uint8")
            bits[docs[first[k] : ends[k]]] = 1
            bitmaps[k] = np.packbits(bits).tobytes()
        yield plane, here[first], bitmaps, dense.tolist()


def posting_rows(block: int, pair: np.ndarray, doc: np.ndarray, times: np.ndarray, width: int) -> list[list]:
    """Columns of ``POSTING``.  A pair's lowest plane carries the popcount of all its planes merged by OR."""
    codes, n_docs = np.unique(pair, return_counts=True)
    counted = np.zeros(len(codes), dtype=bool)
    columns: list[list] = [[] for _ in range(5)]
    for plane, held, bitmaps, dense in planes_of(pair, doc, times, width):
        place = np.searchsorted(codes, held)
        fresh = ~counted[place]
        counted[place] = True
        for column, values in zip(columns, (held.tolist(), [plane] * len(held), dense, np.where(fresh, n_docs[place], 0).tolist(), bitmaps)):
            column.extend(values)
    return [[block] * len(columns[0]), *columns]


def add_planes(docs: pa.Array, dense: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """Per document of a block the sum of the values (rows) over the bitmaps (rows) that hold it."""
    sums = np.zeros((width, values.shape[1]), dtype="int64")
    thin = docs.filter(pa.array(~dense))
    sizes = np.array([len(x) // 2 for x in thin.to_pylist()], dtype="int64") if len(thin) else np.zeros(0, dtype="int64")
    places = np.frombuffer(b"".join(thin.to_pylist()), dtype="<u2").astype("int64")
    np.add.at(sums, places, np.repeat(values[~dense], sizes, axis=0))
    bitmaps, weights = docs.filter(pa.array(dense)).to_pylist(), values[dense]
    for begin in range(0, len(bitmaps), 512):
        part = bitmaps[begin : begin + 512]
        bits = np.unpackbits(np.frombuffer(b"".join(part), dtype="uint8").reshape(len(part), -1), axis=1)[:, :width]
        sums += bits.T.astype("int64") @ weights[begin : begin + 512]
    return sums


_loaded: dict[tuple, Aligner] = {}


def _aligner(byte_model: str, piece_model: bytes) -> Aligner:
    """One aligner per worker process, so that the words it knows outlive a task."""
    key = (hash(byte_model), hash(piece_model))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Aligner(byte_model, piece_model)
    return _loaded[key]


def _file(path: str | None, name: str) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, "rb") as file:
        return file.read()


def inverted(
    docs: DataFrame,
    byte_path: str | None = None,
    piece_path: str | None = None,
    block_docs: int = BLOCK_DOCS,
    block_links: int = BLOCK_LINKS,
) -> DataFrame:
    """The blocks of ``docs``, written to the shared folder: rows of postings and rows of documents.

    A posting (``local`` is null) has ``POSTING``, ``pair`` being the byte-level id times 2^32 plus the piece id.
    A document has its ``block``, its number in it (``local``), ``doc_id``, and what ``COUNTED`` names.
    """
    if not 0 < block_docs <= 1 << 16:
        raise ValueError("a block has 1 to 65536 documents")
    docs = pick(docs, "doc_id", "text")
    models = docs.sparkSession.sparkContext.broadcast((_file(byte_path, BYTE_MODEL).decode(), _file(piece_path, PIECE_MODEL)))
    fields = [*StructType.fromDDL(POSTING).fields, docs.schema["doc_id"], *StructType.fromDDL(COUNTED).fields]
    schema = StructType(fields)
    n_posting = len(StructType.fromDDL(POSTING).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        arrow = to_arrow_schema(schema)
        aligner = _aligner(*models.value)
        # numbers of blocks are unique: the table is written once, by one attempt of each task
        block = TaskContext.get().partitionId() << 32
        held: list[np.ndarray] = []
        rows: list[list] = [[] for _ in range(7)]
        links = 0

        def rows_of(columns: dict[int, object], size: int) -> pa.RecordBatch:
            arrays = [
                pa.array(columns[k], type=f.type) if k in columns else pa.nulls(size, type=f.type) for k, f in enumerate(arrow)
            ]
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, links, held, rows
            if held:
                pair, doc, times = invert(aligner.table(), held)
                postings = posting_rows(block, pair, doc, times, len(held))
                yield rows_of(dict(enumerate(postings)), len(postings[0]))
                own = {0: [block] * len(held), n_posting: rows[0], n_posting + 1: list(range(len(held)))}
                yield rows_of(own | {n_posting + 1 + k: rows[k] for k in range(1, 6)}, len(held))
            block, links, held, rows = block + 1, 0, [], [[] for _ in range(7)]

        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(begin, ROWS_AT_ONCE)
                if aligner.size > MEMO_SIZE:
                    yield from flush()
                    aligner.forget()
                found = aligner.numbers_of([t or "" for t in part.column(1).to_pylist()])
                totals = aligner.totals(found).tolist()
                for doc_id, numbers, counts in zip(part.column(0).to_pylist(), found, totals):
                    digest = ""
                    if numbers is not None:
                        digest = hashlib.sha256(";".join([aligner.groups[k] for k in numbers]).encode()).hexdigest()
                    for column, value in zip(rows, (doc_id, *counts, digest)):
                        column.append(value)
                    held.append(np.array(numbers or [], dtype="int32"))
                    links += counts[3]
                    if len(held) >= block_docs or links >= block_links:
                        yield from flush()
        yield from flush()

    return stored(docs.mapInArrow(run, schema), "pair-bitmaps")


def pair_counts(postings: DataFrame) -> DataFrame:
    """Per pair of ids: the documents that hold it linked (``count``), and whether that is the most for its byte-level id (``best``).

    A pair that all documents hold has one row per block, thinned by partial sums before the shuffle.
    """
    counts = postings.where("n_docs > 0").groupBy("pair").agg(F.sum("n_docs").alias("count"))
    counts = counts.withColumn("a", F.call_function("shiftright", F.col("pair"), F.lit(32)))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    return counts.join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def align_documents(
    docs: DataFrame,
    byte_path: str | None = None,
    piece_path: str | None = None,
    block_docs: int = BLOCK_DOCS,
    block_links: int = BLOCK_LINKS,
    broadcast_pairs: int = BROADCAST_PAIRS,
) -> DataFrame:
    """Per document the tokens of both vocabularies, their groups and links, and how common the links are.

    Takes ``doc_id`` and ``text``; other columns are left out.  The byte-level vocabulary encodes a blank and the text,
    the piece vocabulary the text; neither adds special tokens.  Output: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``,
    ``n_links``, ``n_best`` (links whose pair is the most common of its byte-level id, ties included),
    ``count_sum`` (documents that hold the pair, summed over links) and ``groups_sha256``.
    Null and empty texts, and texts whose joined tokens differ from blank and text, have no tokens: zeros and ``''``.
    Repeated rows and null ids are documents of their own; an empty table gives no rows.

    Tokenizing and inverting is a map.  What moves afterwards are postings, by block; a block's
    are bounded by ``block_docs`` documents and about ``block_links`` links.  Counts of pairs are
    broadcast if there are at most ``broadcast_pairs`` of them, else joined by a shuffle.
    """
    table = inverted(docs, byte_path, piece_path, block_docs, block_links)
    postings = table.where("local is null")
    counts = stored(pair_counts(postings), "pair-counts")
    small = counts.count() <= broadcast_pairs
    scored = postings.join(F.broadcast(counts) if small else counts, "pair").select(
        "block", F.lit(None).cast("int").alias("local"), "plane", "dense", "docs", "count", "best"
    )
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    own = table.where("local is not null").select("block", "local", *names)
    out = StructType([table.schema[n] for n in names[:5]] + StructType.fromDDL("n_best long, count_sum long").fields + [table.schema[names[5]]])

    def sum_up(group: pa.Table) -> pa.Table:
        mine = group.filter(pc.is_valid(group["local"])).sort_by("local")
        rest = group.filter(pc.is_null(group["local"])).combine_chunks()
        sums = np.zeros((mine.num_rows, 2), dtype="int64")
        if rest.num_rows:
            one = 1 << rest["plane"].to_numpy().astype("int64")
            best, count = rest["best"].to_numpy(zero_copy_only=False).astype("int64"), rest["count"].to_numpy()
            values = np.stack([one * best, one * count], axis=1)
            sums = add_planes(rest["docs"].combine_chunks(), rest["dense"].to_numpy(zero_copy_only=False).astype(bool), values, mine.num_rows)
        arrow = to_arrow_schema(out)
        columns = [*[mine[n] for n in names[:5]], pa.array(sums[:, 0]), pa.array(sums[:, 1]), mine[names[5]]]
        return pa.table([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    both = own.unionByName(scored, allowMissingColumns=True)
    return both.groupBy("block").applyInArrow(sum_up, out)
