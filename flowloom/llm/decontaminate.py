"""Benchmark passages in documents, by Wu-Manber search over words.

Words are the alphabet.  All patterns of one length form a searcher: a shift
table over blocks of two words says how far the window may jump when the block
at its end cannot end a pattern there; blocks that can end one select a bucket of
patterns by the hash of that suffix, and patterns of the bucket are compared with
the text directly.  Almost every position of clean text is jumped over.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.frames import map_texts, pick
from flowloom.session import checkpoint

WINDOW = 10
# Texts of benchmark items that are sent to every task at once; more are searched block after block.
BLOCK_BYTES = 8 << 20

# Bytes of words (digits, lower-case letters, all of non-ASCII), upper case folded onto lower.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text whose A-Z are lower-cased, as UTF-8."""
    return text.encode().translate(_FOLD).split()


class WordSearcher:
    """Wu-Manber over patterns of one length."""

    def __init__(self, length: int, patterns: Iterable[tuple[bytes, ...]]) -> None:
        self.length = length
        self.block = min(2, length)
        self.furthest = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[bytes, ...]]] = defaultdict(list)
        for pattern in patterns:
            for end in range(self.block, length + 1):
                block = pattern[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.furthest), length - end)
            self.buckets[pattern[length - self.block :]].append(pattern)

    def find(self, words: Sequence[bytes]) -> list[tuple[int, tuple[bytes, ...]]]:
        """All occurrences: where each begins and which pattern it is."""
        found = []
        shift, furthest, block, length = self.shift.get, self.furthest, self.block, self.length
        end, last = length, len(words)
        while end <= last:
            suffix = (words[end - 2], words[end - 1]) if block == 2 else (words[end - 1],)
            jump = shift(suffix, furthest)
            if jump:
                end += jump
                continue
            begin = end - length
            here = tuple(words[begin:end])
            found += [(begin, pattern) for pattern in self.buckets[suffix] if pattern == here]
            end += 1
        return found


class WindowIndex:
    """Searchers for the windows of benchmark items, by window length."""

    def __init__(self, items: Iterable[tuple[object, str]], window: int) -> None:
        self.items: dict[tuple[bytes, ...], set] = defaultdict(set)
        for item, text in items:
            words = words_of(text or "")
            size = min(window, len(words))
            for begin in range(len(words) - size + 1 if size else 0):
                self.items[tuple(words[begin : begin + size])].add(item)
        by_length: dict[int, list[tuple[bytes, ...]]] = defaultdict(list)
        for pattern in self.items:
            by_length[len(pattern)].append(pattern)
        self.searchers = [WordSearcher(n, patterns) for n, patterns in sorted(by_length.items())]

    def search(self, words: Sequence[bytes]) -> tuple[list[list[int]], set]:
        """Hit words as disjoint runs [begin, end), and the items whose windows occur."""
        runs, items = [], set()
        for searcher in self.searchers:
            for begin, pattern in searcher.find(words):
                runs.append([begin, begin + searcher.length])
                items |= self.items[pattern]
        return join_runs(runs), items


def join_runs(runs: Iterable[Sequence[int]]) -> list[list[int]]:
    joined: list[list[int]] = []
    for begin, end in sorted(map(tuple, runs)):
        if joined and begin <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([begin, end])
    return joined


def _blocks(benchmark: DataFrame, block_bytes: int):
    """The benchmark in pieces of bounded size, dealt by item."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).head()[0]
    count = max(1, -(-size // block_bytes))
    for k in range(count):
        mine = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        yield k == count - 1, [(r[0], r[1]) for r in mine.collect()]


def find_passages(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Per document: its words, the hit runs of words, and the items whose windows occur in it.

    ``docs`` has ``doc_id`` and ``text``, ``benchmark`` has ``item_id`` and ``text``;
    of other columns of ``docs`` those named in ``carry`` come through, with the text.
    Output: ``doc_id``, ``n_words``, ``runs`` (disjoint
    [begin, end) word positions) and ``items`` (distinct ids as strings, sorted).
    Null and empty texts have no words and no hits; items without words match
    nothing; equal windows of several items count for each of them; repeated rows
    and null ids are searched like any other.  An empty benchmark hits nothing.

    A map over documents without a shuffle.  A benchmark above ``block_bytes`` is
    searched in blocks of about that size, each over all documents, so what a task
    holds is bounded; the carried result is written to the shared folder in between.
    """
    found = pick(docs, "doc_id", *carry, "text")
    found = found.withColumns(
        {"runs": F.expr("cast(array() as array<array<int>>)"), "items": F.expr("cast(array() as array<string>)")}
    )
    for last, items in _blocks(pick(benchmark, "item_id", "text"), block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def prepare(shared=shared):
            index = WindowIndex(shared.value, window)

            def work(texts):
                n_words, runs, names = [], [], []
                for text in texts:
                    words = words_of(text)
                    hit, ids = index.search(words)
                    n_words.append(len(words))
                    runs.append(hit)
                    names.append(sorted({str(i) for i in ids if i is not None}))
                return n_words, runs, names

            return work

        before = found.select("doc_id", *carry, F.col("runs").alias("before"), F.col("items").alias("known"), "text")
        added = "n_words long, now array<array<int>>, fresh array<string>"
        found = map_texts(before, "text", added, prepare, keep_text=bool(carry) or not last)
        # runs of several blocks may overlap; hit_words() counts them once
        found = found.withColumns(
            {
                "runs": F.concat("before", "now"),
                "items": F.array_sort(F.array_union("known", "fresh")),
            }
        ).drop("before", "known", "now", "fresh")
        if not last:
            found = checkpoint(found.drop("n_words"))
    return found


def hit_words(runs) -> object:
    """Column: the number of words inside any of the runs."""
    struct = "struct<covered:bigint,upto:int>"
    return F.aggregate(
        F.array_sort(runs),
        F.expr(f"cast(named_struct('covered', 0L, 'upto', 0) as {struct})"),
        lambda s, r: F.struct(
            (s["covered"] + F.greatest(r[1] - F.greatest(r[0], s["upto"]), F.lit(0))).alias("covered"),
            F.greatest(s["upto"], r[1]).alias("upto"),
        ),
        lambda s: s["covered"],
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The digest of ``find_passages`` per document: counts, the items' hash, and the verdict."""
    found = find_passages(docs, benchmark, window, block_bytes)
    n_hit = hit_words(F.col("runs"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )
