"""Joining documents by the Jaccard similarity of their word n-grams, with an LSH forest.

Each different text gets MinHash values arranged as several trees; a tree's label
is a sequence of them.  Texts whose labels agree in a prefix are candidates.  The
matched prefix is shortened from the full depth until pairs at the threshold are
met in some tree with the target recall.  Candidates are gathered into candidate
components by ids alone; only then are n-gram sets shuffled, once per text, and
all pairs of a component verified exactly, in blocks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowloom.llm.components import components
from flowloom.llm.frames import map_texts, pick, stored
from flowloom.llm.keyfilter import filter_table, maybe_held

# Texts of a component compared at once; larger components are compared block by block.
BLOCK = 256
# Words whose hash a worker remembers; it starts afresh when full.
MEMO_ENTRIES = 500_000


@dataclass(frozen=True)
class Join:
    """What counts as similar, and the forest that finds it."""

    words: int = 5
    over: int = 4  # the threshold over / under
    under: int = 5
    trees: int = 16
    deepest: int = 8
    recall: float = 0.9995

    def depth(self) -> int:
        """The prefix length: shortened until pairs at the threshold are met with the target recall."""
        similarity = self.over / self.under
        depth = self.deepest
        while depth > 1 and 1 - (1 - similarity**depth) ** self.trees < self.recall:
            depth -= 1
        return depth


class Shingler:
    """64-bit hashes of word n-grams and their MinHash labels."""

    def __init__(self, join: Join) -> None:
        self.join = join
        self.memo: dict[str, int] = {}
        rng = np.random.Generator(np.random.PCG64(20_240_229))
        odd = rng.integers(0, 1 << 63, size=(2, join.trees * join.depth()), dtype=np.uint64)
        self.factors, self.shifts = (odd[0] << np.uint64(1)) | np.uint64(1), odd[1]
        more = rng.integers(0, 1 << 63, size=(2, max(join.words, join.depth())), dtype=np.uint64)
        self.places, self.levels = (more << np.uint64(1)) | np.uint64(1)

    def _word(self, word: str) -> int:
        found = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(self.memo) >= MEMO_ENTRIES:
            self.memo.clear()
        if len(word) <= 40:
            self.memo[word] = found
        return found

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def shingles(self, text: str) -> np.ndarray:
        """Distinct n-gram hashes of the lower-case words, sorted.

        A text of fewer words is one n-gram; one without words is the empty n-gram.
        """
        words = text.lower().split()
        known = self.memo.get
        hashes = np.array([h if (h := known(w)) is not None else self._word(w) for w in words], np.uint64)
        size = self.join.words
        if len(hashes) < size:
            total = (hashes * self.places[: len(hashes)]).sum(dtype=np.uint64) + np.uint64(len(hashes))
            return self._mix(np.array([total], np.uint64))
        n = len(hashes) - size + 1
        total = hashes[:n] * self.places[0]
        for k in range(1, size):
            total = total + hashes[k : n + k] * self.places[k]
        return np.unique(self._mix(total + np.uint64(size)))

    def labels(self, shingles: np.ndarray) -> np.ndarray:
        """One label per tree: the prefix of its MinHash values, hashed."""
        depth = self.join.depth()
        least = np.full(len(self.factors), np.iinfo(np.uint64).max, np.uint64)
        for begin in range(0, len(shingles), 512):
            part = shingles[begin : begin + 512]
            values = part[None, :] * self.factors[:, None] + self.shifts[:, None]
            least = np.minimum(least, values.min(axis=1))
        prefix = least.reshape(self.join.trees, depth)
        return self._mix((self._mix(prefix) * self.levels[:depth]).sum(axis=1, dtype=np.uint64)).view(np.int64)


_loaded: dict[Join, Shingler] = {}


def _shingler(join: Join) -> Shingler:
    """One per worker process, so that its memo outlives a task."""
    if join not in _loaded:
        _loaded[join] = Shingler(join)
    return _loaded[join]


def _text_id() -> F.Column:
    """A text's 64-bit id; a null text is the empty one."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def candidate_components(texts: DataFrame, join: Join) -> DataFrame:
    """Texts that share a label in some tree, by component: ``id, root``.

    Buckets of equal labels are linked as stars to their least text, so a bucket of
    n texts gives n rows, whatever n is.
    """

    def prepare():
        shingler = _shingler(join)
        return lambda batch: [[shingler.labels(shingler.shingles(t)) for t in batch]]

    signed = map_texts(texts.select(_text_id().alias("id"), "text"), "text", "labels array<long>", prepare)
    labelled = signed.groupBy("id").agg(F.first("labels").alias("labels"))
    leaves = stored(labelled.select("id", F.posexplode("labels").alias("tree", "label")), "leaves")
    heads = leaves.groupBy("tree", "label").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = leaves.join(heads, ["tree", "label"]).where("id != head").select(F.col("id").alias("a"), F.col("head").alias("b"))
    return components(stored(edges.distinct(), "candidate-edges"))


def compare(ids: np.ndarray, block: np.ndarray, offsets: np.ndarray, values: np.ndarray, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """Links of each text to the others, and the least text of its linked group.

    With two blocks only pairs across them count, as each block is compared within
    itself elsewhere.  Shared n-grams are counted through postings.
    """
    m = len(ids)
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(m), sizes)
    _, code = np.unique(values, return_inverse=True)
    posted = owner[np.argsort(code, kind="stable")]
    counts = np.bincount(code)
    starts = np.concatenate([[0], np.cumsum(counts)])
    links = np.zeros(m, np.int64)
    leader = np.arange(m)

    def find(k: int) -> int:
        while leader[k] != k:
            leader[k] = leader[leader[k]]
            k = leader[k]
        return k

    across = len(set(block.tolist())) > 1
    for i in range(m):
        mine = code[offsets[i] : offsets[i + 1]]
        lengths = counts[mine]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(starts[mine] - (ends - lengths), lengths)
        shared = np.bincount(posted[at], minlength=m)
        similar = join.under * shared >= join.over * (sizes[i] + sizes - shared)
        similar[: i + 1] = False
        if across:
            similar &= block != block[i]
        found = np.flatnonzero(similar)
        links[i] += len(found)
        links[found] += 1
        for j in found:
            x, y = find(i), find(int(j))
            if x != y:
                low, high = (x, y) if ids[x] < ids[y] else (y, x)
                leader[high] = low
    return links, np.array([ids[find(k)] for k in range(m)], np.int64)


def verified_links(texts: DataFrame, candidates: DataFrame, join: Join, block: int = BLOCK) -> DataFrame:
    """Per text of a candidate component and block pair: ``id, links, least``.

    N-grams are built for these texts only: a key filter keeps the others out of
    the join.  A component of more than ``block`` texts becomes pairs of blocks.
    """
    sizes = candidates.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    placed = candidates.join(sizes, "root").select("id", "root", blocks.alias("blocks"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    keyed = texts.select(_text_id().alias("id"), "text")
    wanted = keyed.where(maybe_held(F.col("id"), filter_table(candidates, "id"))).dropDuplicates(["id"]).join(candidates.select("id"), "id")

    def prepare():
        shingler = _shingler(join)
        return lambda batch: [[shingler.shingles(t).view(np.int64) for t in batch]]

    sets = map_texts(wanted, "text", "shingles array<long>", prepare)
    # each block meets itself and every other block of its component
    rest = F.sequence(F.lit(0), F.col("blocks") - 1)
    met = sets.join(placed, "id").withColumn("with", F.explode(rest))
    met = met.withColumns({"one": F.least("block", "with"), "two": F.greatest("block", "with")})
    out = StructType.fromDDL("id long, links long, least long")

    def verify(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids = group.column("id").to_numpy()
        listed = group.column("shingles").combine_chunks()
        listed = listed.chunk(0) if isinstance(listed, pa.ChunkedArray) else listed
        offsets = listed.offsets.to_numpy()
        values = listed.values.to_numpy(zero_copy_only=False)
        links, least = compare(ids, group.column("block").to_numpy(), offsets, values, join)
        return pa.table({"id": ids, "links": links, "least": least})

    return met.select("root", "one", "two", "block", "id", "shingles").groupBy("root", "one", "two").applyInArrow(verify, out)


def near_classes(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """Per document: ``doc_id``, its class, its links and copies, and the text id.

    Takes ``doc_id`` and ``text``; other columns are left out.  ``class_id`` is the
    least doc_id among all documents connected by links or equal texts (null where
    all their ids are null); ``n_links`` is the number of other different texts that
    are similar to the document's text; ``n_copies`` counts documents of the very same
    text.  Null and empty texts are copies of each other; texts of fewer words than an
    n-gram are similar only if their words are equal.  Repeated rows are copies.  An
    empty table gives no rows.
    """
    slim = pick(docs, "doc_id", "text")
    candidates = stored(candidate_components(slim, join), "candidate-components")
    checked = stored(verified_links(slim, candidates, join), "checked")
    links = checked.groupBy("id").agg(F.sum("links").alias("links"))
    edges = stored(checked.where("id != least").select(F.col("id").alias("a"), F.col("least").alias("b")), "links")
    classes = components(edges).select("id", "root")
    rows = slim.select("doc_id", _text_id().alias("id"))
    texts = rows.groupBy("id").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_copies"))
    texts = stored(
        texts.join(classes, "id", "left").join(links, "id", "left").withColumn("root", F.coalesce("root", "id")), "texts"
    )
    named = texts.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("n_copies").alias("n_class"))
    told = texts.join(named, "root").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("n_links"), "n_copies", "n_class", "root")
    return rows.join(told, "id").select("doc_id", "class_id", "n_links", "n_copies", "n_class", F.col("id").alias("text_id"), "root")


def duplicates(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """Document rows that belong to a class of several: ``rk`` (id and text), and whether it is the one to keep.

    The one kept is the least by (doc_id, rk), null ids last.
    """
    classes = near_classes(docs, join).where("n_class > 1")
    rows = stored(classes.select("root", "doc_id", F.xxhash64("doc_id", "text_id").alias("rk")).distinct(), "class-rows")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "rk")
    first = rows.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.rk").alias("rk"), F.lit(True).alias("keep"))
    return rows.select("rk").distinct().join(first, "rk", "left").select("rk", F.coalesce("keep", F.lit(False)).alias("keep"))


def one_of_each(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """The documents with all their columns, one of each class.

    Documents alone in their class take part in no join.  Rows that repeat id and text
    are one document, of which one row stays.
    """
    found = stored(duplicates(docs, join), "duplicates")
    columns = docs.columns
    place = {n: columns.index(n) for n in ("doc_id", "text")}
    bare = docs.toDF(*[f"_{i}" for i in range(len(columns))])
    text_id = F.xxhash64(F.coalesce(F.col(f"_{place['text']}"), F.lit("")))
    keyed = bare.withColumn("rk", F.xxhash64(F.col(f"_{place['doc_id']}"), text_id))
    held = maybe_held(F.col("rk"), filter_table(found, "rk"))
    alone = keyed.where(~held)
    judged = keyed.where(held).join(found, "rk", "left").where(F.coalesce("keep", F.lit(True)))
    kept = alone.unionByName(judged.drop("keep").dropDuplicates(["rk"]))
    return kept.drop("rk").toDF(*columns)
