"""Removing lines that repeat earlier ones, by an exact set-similarity join.

A line is the set of its words.  Words are ordered by rarity over the corpus; two
sets of Jaccard similarity t or more share one of their first (rarest) words, so
only those prefixes are joined.  Length, position and a parity bitmap rule out most
partners inside the join, and the rest are verified on the word sets themselves.

Everything is DataFrame functions.  What grows with the data is shuffled by keys:
equal lines meet once, with a map-side minimum, before any join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.frames import pick, stored
from flowloom.llm.keyfilter import bits_for, maybe_in_words, word_table

# Words are counted in this many hashed cells; a cell's class orders its words.
CELLS = 1 << 17
# Words of a set flip one of 128 bits each, kept in two numbers.  They rule out
# partners and never tell sets apart.
_HALF = 6
# Of a set's rarest words, so many are asked for their heads.
HEAD_WORDS = 4
# Prefixes are shuffled in so many shares, by word, one after the other: a share at a time lies on disk.
SHARES = 2
_KEY_BITS = 56


@dataclass(frozen=True)
class Similarity:
    """A Jaccard threshold as a fraction, so that all bounds are whole numbers."""

    over: int = 4
    under: int = 5

    def _ceil(self, n: Column, over: int, under: int) -> Column:
        return F.floor((n * over + (under - 1)) / under).cast("int")

    def prefix(self, n: Column) -> Column:
        """Words of a set of n that must be looked at."""
        return n - self._ceil(n, self.over, self.under) + 1

    def overlap(self, n: Column, m: Column) -> Column:
        """Shared words that sets of n and m need."""
        return self._ceil(n + m, self.over, self.over + self.under)

    def lengths_fit(self, n: Column, m: Column) -> Column:
        return (n * self.under >= m * self.over) & (m * self.under >= n * self.over)


def _cell(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(CELLS - 1)).cast("int")


def _lines(docs: DataFrame) -> DataFrame:
    """The lines of documents that have words: ``doc_id, rk, pos, line``.

    Words stand between blanks.  Rows that repeat both id and text share a key.
    """
    return _split(_keyed(docs))


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with their key, hashed in a step of its own: beside the explode the whole text would be hashed once per line."""
    return docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rk"))


def _split(keyed: DataFrame) -> DataFrame:
    lines = keyed.select("doc_id", "rk", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(F.trim("line") != "")


def rarity_classes(docs: DataFrame) -> DataFrame:
    """One row: for every cell its class, the logarithm of the words counted in it."""
    seen = (
        docs.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(" "))).alias("w"))
        .groupBy(_cell(F.col("w")).alias("cell"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    cells = docs.sparkSession.range(0, CELLS, 1, 1).select(F.col("id").cast("int").alias("cell"))
    level = F.least(F.floor(F.log2(F.coalesce("n", F.lit(0)) + 1) * 2), F.lit(120)).cast("tinyint")
    return (
        cells.join(seen, "cell", "left")
        .agg(F.sort_array(F.collect_list(F.struct("cell", level.alias("level")))).alias("levels"))
        .select(F.transform("levels", lambda x: x["level"]).alias("levels"))
    )


def line_sets(docs: DataFrame, classes: DataFrame, similarity: Similarity) -> DataFrame:
    """Every line as ``id, set_hash, word_xor, even, odd, n, doc_id, rk, pos, prefix``: its set, and the rarest words of it, rarest first.

    Equal sets agree in two hashes of 64 bits made in different ways: one of the sorted
    keys, and the exclusive or of the whole word hashes.  Ids are short, and what they
    are is settled when the lines are written.
    """
    keyed = word_keys(_lines(docs), classes)
    n = F.size("keys")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    place = lambda k: k.bitwiseAND(F.lit((1 << _HALF) - 1)).cast("int")
    half = lambda k: F.shiftright(k, _HALF).bitwiseAND(one)
    flipped = lambda s, bit, k: s.bitwiseXOR(F.call_function("shiftleft", bit, place(k)))
    return keyed.select(
        F.monotonically_increasing_id().alias("id"),
        F.xxhash64("keys").alias("set_hash"),
        "word_xor",
        # over all words, and over those of the odd half alone
        F.aggregate("keys", zero, lambda s, k: flipped(s, one, k)).alias("all"),
        F.aggregate("keys", zero, lambda s, k: flipped(s, half(k), k)).alias("odd"),
        n.alias("n"),
        "doc_id",
        "rk",
        "pos",
        F.transform(
            F.slice("keys", F.lit(1), similarity.prefix(n)), lambda k: k.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
        ).alias("prefix"),
    ).select("id", "set_hash", "word_xor", F.col("all").bitwiseXOR(F.col("odd")).alias("even"), "odd", "n", "doc_id", "rk", "pos", "prefix")


def word_keys(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """The words of a line as distinct numbers, rarest first, in place of the line, and ``word_xor`` of their whole hashes."""
    mask = F.lit((1 << _KEY_BITS) - 1)
    ranked = lines.withColumn("levels", classes.scalar())
    hashes = F.array_remove(F.array_distinct(F.transform(F.split("line", " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    cell = lambda h: h.bitwiseAND(F.lit(CELLS - 1)).cast("int")
    # every cell has a level: said so, keys are known not to be null and are sorted as plain numbers
    level = lambda h: F.coalesce(F.get("levels", cell(h)).cast("long"), F.lit(0).cast("long"))
    keys = F.transform("hashes", lambda h: F.shiftleft(level(h), _KEY_BITS).bitwiseOR(h.bitwiseAND(mask)))
    xor = F.aggregate("hashes", F.lit(0).cast("long"), lambda s, h: s.bitwiseXOR(h))
    keyed = ranked.withColumn("hashes", hashes).withColumn("keys", F.sort_array(keys)).withColumn("word_xor", xor)
    return keyed.drop("line", "levels", "hashes")


def _least_size(similarity: Similarity) -> int:
    """Sets below this size are similar to equal ones only."""
    return similarity.under - 1 if similarity.under == similarity.over + 1 else 1


def distinct_sets(lines: DataFrame) -> DataFrame:
    """The sets of the lines: ``id, set_hash, word_xor, first, times, n, even, odd, prefix``.

    Most sets are held by one line, which is not moved: hashes are counted first, and
    only lines whose hash is among the repeated ones are grouped.
    """
    often = lines.groupBy("set_hash", "word_xor").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    held = _filter(stored(often.select("set_hash"), "repeated-hashes"), "set_hash", "set_hash")
    place = F.struct("doc_id", "rk", "pos")
    kept = ["n", "even", "odd", "prefix"]
    single = lines.where(~held).select("id", "set_hash", "word_xor", place.alias("first"), F.lit(1).cast("long").alias("times"), *kept)
    several = lines.where(held).groupBy("set_hash", "word_xor").agg(
        F.min("id").alias("id"),
        F.min(place).alias("first"),
        F.count(F.lit(1)).alias("times"),
        *[F.first(c).alias(c) for c in kept],
    )
    return single.unionByName(stored(several, "repeated-sets"))


def _filter(keys: DataFrame, key: str | Column, column: str | Column) -> Column:
    """Whether ``column`` may be among the (long, evenly spread) keys of a stored table: a key filter sized by their number."""
    bits = bits_for(keys.count())
    key = F.col(key) if isinstance(key, str) else key
    table = stored(word_table(keys.select(key.alias("key")), "key", bits), "filter")
    return maybe_in_words(F.col(column) if isinstance(column, str) else column, table, bits)


def head_candidates(sets: DataFrame, similarity: Similarity) -> DataFrame:
    """At most one pair for each set, with an earlier one of which it shares a rare word: ``later, other, same``.

    Each of a set's rarest words has one head, the earliest set that holds it there.
    Groups of near copies, however large, thus meet in as many pairs as members.
    """
    all_near = sets.where(F.col("n") >= _least_size(similarity)).select(
        "id", "n", "even", "odd", "first", F.explode(F.slice("prefix", F.lit(1), F.lit(HEAD_WORDS))).alias("word")
    )
    n, m = F.col("n"), F.col("head.n")
    apart = _apart(F.col, lambda c: F.col(f"head.{c}"))
    fits = similarity.lengths_fit(n, m) & (apart <= n + m - similarity.overlap(n, m) * 2)

    def share(k: int) -> DataFrame:
        near = all_near.where(_share("word", k))
        heads = near.groupBy("word").agg(F.min(F.struct("first", "id", "n", "even", "odd")).alias("head"))
        met = near.join(heads, "word").where((F.col("head.first") < F.col("first")) & fits)
        return met.select("id", apart.alias("apart"), F.col("head.id").alias("other"))

    best = _in_shares(share, "met-heads").groupBy("id").agg(F.min(F.struct("apart", "other")).alias("best"))
    return best.select(F.col("id").alias("later"), "best.other", F.lit(False).alias("same"))


def _share(word: str, k: int) -> Column:
    return F.pmod(F.col(word), F.lit(SHARES)) == k


def _in_shares(share: Callable[[int], DataFrame], name: str) -> DataFrame:
    """The rows of all shares of the words, each found and written before the next is begun."""
    return reduce(DataFrame.union, [stored(share(k), name) for k in range(SHARES)])


def _apart(x, y) -> Column:
    """Words in which two sets differ at least, by their parities; ``x`` and ``y`` give the columns of each."""
    even, odd = (F.bit_count(x(c).bitwiseXOR(y(c))) for c in ("even", "odd"))
    return even + odd


def similar_candidates(sets: DataFrame, similarity: Similarity) -> DataFrame:
    """Pairs of different sets that the filters leave: ``later, other, apart, same``, each once.

    Only ``open`` sets look for earlier ones.

    ``later`` first occurs in the document of the greater id; where that is the
    ``same`` document both directions are given and the order is settled afterwards.
    ``apart`` bounds the number of words in which the sets differ from below.

    The first common word of similar sets leaves both enough words for the overlap that
    they need; partners met at later words only are no candidates.
    """
    all_entries = sets.where(F.col("n") >= _least_size(similarity)).select("id", "open", "n", F.col("first.doc_id").alias("doc"), "even", "odd", F.posexplode("prefix").alias("at", "word"))
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    need = similarity.overlap(x("n"), y("n"))
    rest = F.least(x("n") - x("at"), y("n") - y("at"))
    apart = _apart(x, y)
    fits = similarity.lengths_fit(x("n"), y("n")) & (rest >= need) & (apart <= x("n") + y("n") - need * 2)
    same = x("doc").eqNullSafe(y("doc"))
    follows = F.coalesce(x("doc") > y("doc"), x("doc").isNotNull())  # null ids come first
    # x is open; written alike over both sides, so that neither is filtered below and they share one shuffle
    asks = x("open").cast("int") * 2 + y("open").cast("int") >= 2

    def share(k: int) -> DataFrame:
        entries = all_entries.where(_share("word", k))
        one, two = entries.alias("x"), entries.alias("y")
        pairs = one.join(two, (x("word") == y("word")) & asks & (x("id") != y("id")) & (same | follows) & fits)
        return pairs.select(x("id").alias("later"), y("id").alias("other"), apart.alias("apart"), same.alias("same")).distinct()

    return _in_shares(share, "met").distinct()


def line_texts(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """One line of every set in the pairs, its first: ``id, first, line``.

    Key filters of sets, documents and lines keep the others from being shuffled.
    """
    asked = stored(pairs.select(F.explode(F.array("later", "other")).alias("id")).distinct(), "asked")
    wanted = stored(sets.where(_filter(asked, F.xxhash64("id"), F.xxhash64("id"))).select("id", "first").join(asked, "id").select("id", "first", "first.rk", "first.pos"), "asked-lines")
    rows = _keyed(docs).where(_filter(wanted, "rk", "rk"))
    key = F.xxhash64("rk", "pos")
    lines = _split(rows).where(_filter(wanted, key, key)).select("rk", "pos", "line")
    # rows that repeat id and text give the same lines again
    return lines.join(wanted, ["rk", "pos"]).select("id", "first", "line").dropDuplicates(["id"])


def _words(line: str) -> Column:
    return F.array_distinct(F.array_remove(F.split(line, " "), ""))


def verified(pairs: DataFrame, texts: DataFrame, similarity: Similarity) -> DataFrame:
    """Sets that have an earlier similar one among the pairs, compared word by word: ``later``."""
    one = texts.select(F.col("id").alias("later"), F.col("first").alias("mine"), F.col("line").alias("la"))
    two = texts.select(F.col("id").alias("other"), F.col("first").alias("theirs"), F.col("line").alias("lb"))
    both = pairs.join(one, "later").join(two, "other").where("not same or theirs < mine").select("later", _words("la").alias("wa"), _words("lb").alias("wb"))
    enough = F.size(F.array_intersect("wa", "wb")) >= similarity.overlap(F.size("wa"), F.size("wb"))
    return both.where(enough).select("later").distinct()


def later_lines(docs: DataFrame, similarity: Similarity = Similarity()) -> DataFrame:
    """Lines to remove, by document row: ``rk, later`` (their positions).

    A set with an earlier similar one goes wherever it occurs; of any other set all
    but the first occurrence go.  So one similar earlier set is enough.  The heads of rare
    words are tried first, which settles the members of groups without pairing them
    all; sets left open go through the full prefix join, where again the likeliest
    partner is verified first and the others only if it fails.
    """
    classes = stored(rarity_classes(docs), "word-classes")
    lines = stored(line_sets(docs, classes, similarity), "lines")
    sets = distinct_sets(lines)
    tried = stored(head_candidates(sets, similarity), "head-candidates")
    gone = stored(verified(tried, stored(line_texts(tried, sets, docs), "line-texts"), similarity), "gone")
    pairs = stored(similar_candidates(_marked(sets, gone, "settled").withColumn("open", ~F.col("settled")), similarity), "candidates")
    texts = stored(line_texts(pairs, sets, docs), "line-texts")
    nearest = pairs.groupBy("later").agg(F.min(F.struct("apart", "other", "same")).alias("best"))
    more = verified(nearest.select("later", "best.other", "best.same"), texts, similarity)
    gone = stored(gone.union(more), "gone")
    open_still = pairs.join(gone, "later", "left_anti")
    gone = stored(gone.union(verified(open_still, texts, similarity)).distinct(), "gone")
    again = stored(
        _marked(sets.select("id", "set_hash", "word_xor", "first", "times"), gone, "whole").where("times > 1 or whole"), "again"
    ).select("set_hash", "word_xor", "first", "whole")
    held = _filter(again, "set_hash", "set_hash")
    repeated = lines.where(held).join(again, ["set_hash", "word_xor"]).where(F.col("whole") | (F.struct("doc_id", "rk", "pos") > F.col("first")))
    return repeated.groupBy("rk").agg(F.collect_set("pos").alias("later"))


def _marked(sets: DataFrame, found: DataFrame, mark: str) -> DataFrame:
    """The sets with a column that tells those found; sets that a key filter rules out take part in no join."""
    maybe = _filter(found, F.xxhash64("later"), F.xxhash64("id"))
    known = found.select(F.col("later").alias("id"), F.lit(True).alias("_found"))
    joined = sets.where(maybe).join(known, "id", "left").withColumn(mark, F.coalesce("_found", F.lit(False))).drop("_found")
    return sets.where(~maybe).withColumn(mark, F.lit(False)).unionByName(stored(joined, mark))


def cut_lines(docs: DataFrame, similarity: Similarity = Similarity()) -> DataFrame:
    """All rows and columns of the documents, and of each ``cut`` (its new text), ``n_lines`` and ``n_removed``.

    The columns of ``docs`` come first, named ``_0, _1, ...`` by place.  Documents that
    lose no line take part in no join: a key filter keeps them out.
    """
    columns = docs.columns
    bare = docs.toDF(*[f"_{i}" for i in range(len(columns))])
    doc_id, text = (F.col(f"_{columns.index(n)}") for n in ("doc_id", "text"))
    later = stored(later_lines(pick(docs, "doc_id", "text"), similarity), "later-lines")
    keyed = bare.withColumn("rk", F.xxhash64(doc_id, text))
    touched = _filter(later, "rk", "rk")
    lines = F.split(text, "\n")
    n_lines = F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "later")
    cut = (
        keyed.where(touched)
        .join(later, "rk", "left")
        .withColumn("lines", lines)
        .select(
            *bare.columns,
            F.when(F.col("later").isNull(), text)
            .otherwise(F.array_join(F.transform(kept, lambda k: F.get("lines", k)), "\n"))
            .alias("cut"),
            n_lines,
            F.coalesce(F.size("later"), F.lit(0)).cast("long").alias("n_removed"),
        )
    )
    whole = keyed.where(~touched).select(*bare.columns, text.alias("cut"), n_lines, F.lit(0).cast("long").alias("n_removed"))
    return whole.unionByName(cut)


def drop_later_lines(docs: DataFrame, similarity: Similarity = Similarity()) -> DataFrame:
    """Documents without the lines that are similar to an earlier one.

    Takes ``doc_id`` and ``text``; other columns are left out.  Earlier means by
    (doc_id, text hash, line), null ids first; a line goes if any earlier line, kept
    or not, is equal as a set of words or similar to the threshold.  Lines without
    words always stay.  Rows that repeat both id and text are treated alike.
    Output: ``doc_id, text, n_lines, n_removed``; null texts stay null and have no
    lines; a text whose lines all go is empty.  An empty table gives no rows.
    """
    cut = cut_lines(pick(docs, "doc_id", "text"), similarity)
    return cut.select(F.col("_0").alias("doc_id"), F.col("cut").alias("text"), "n_lines", "n_removed")
