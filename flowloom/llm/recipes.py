"""Exact duplicates by content-defined chunk recipes, in SQL functions alone.

A text without its white space is cut into chunks at places that its own bytes
decide, so equal texts are cut alike wherever they lie.  A chunk is known by a
128-bit identifier and a text by its recipe, the ordered list of the identifiers
of its chunks.  Recipes are a few bytes a chunk and all that is grouped and joined;
no document moves as a whole.  Identifiers are verified: the bytes of every chunk
of a repeated recipe are brought together once, each different chunk once per task,
and if two chunks share an identifier, all are numbered anew with another salt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.frames import pick, stored
from flowloom.llm.keyfilter import bits_for, filter_table, maybe_held

# The characters that are deleted before texts are compared.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
# Bytes of a chunk, at least (but for a text's last) and at most.
LEAST, MOST = 512, 4096
# A chunk ends after so many bytes of the class, which holds about two in five of all byte values.
RUN = 6
CUT_CLASS = r"[\x00-\x0F\x20-\x2F\x44-\x4B\x61-\x67\x72-\x76\x80-\x8F\xA0-\xAF\xC0-\xC3]"
# Salts tried before two chunks that share an identifier under each of them are reported.
SALTS = 8

Identify = Callable[[Column, int], Column]


def identifier(chunk: Column, salt: int) -> Column:
    """128 bits of a chunk: two 64-bit hashes that start from different values."""
    return F.struct(F.xxhash64(F.lit(2 * salt), chunk).alias("a"), F.xxhash64(F.lit(2 * salt + 1), chunk).alias("b"))


def without_blanks(text: Column) -> Column:
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def chunks_of(bare: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The chunks of a text, in order and without gaps, as strings of one character per byte."""
    as_bytes = F.decode(bare.cast("binary"), "ISO-8859-1")
    pattern = f"(?s).{{{least},{most - RUN}}}?{CUT_CLASS * RUN}|.{{1,{most}}}"
    return F.regexp_extract_all(as_bytes, F.lit(pattern), F.lit(0))


def _cut(docs: DataFrame, least: int, most: int) -> DataFrame:
    """``doc_id``, ``n_chars`` of the original text, the text without blanks and its chunks."""
    text = F.coalesce("text", F.lit(""))
    bare = pick(docs, "doc_id", "text").select(
        "doc_id", F.char_length(text).cast("long").alias("n_chars"), without_blanks(text).alias("bare")
    )
    return bare.withColumn("chunks", chunks_of(F.col("bare"), least, most))


def _digest(recipe: str) -> Column:
    return F.xxhash64(recipe)


def _repeated(recipes: DataFrame) -> DataFrame:
    """Recipes that several rows have."""
    return recipes.groupBy("recipe").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and size(recipe) > 0")


def shared_identifiers(chunks: DataFrame) -> DataFrame:
    """Identifiers (``id``) that different chunks (``chunk``) have.

    Equal chunks are dropped within tasks before anything moves, so a chunk that a third of all rows hold
    moves once per task, and its group is counted, never gathered.
    """
    different = chunks.groupBy("id", "chunk").agg(F.count(F.lit(1)).alias("times"))
    return different.groupBy("id").agg(F.count(F.lit(1)).alias("chunks")).where("chunks > 1")


def recipes(
    docs: DataFrame, least: int = LEAST, most: int = MOST, identify: Identify = identifier, salts: int = SALTS
) -> DataFrame:
    """Per row of ``doc_id`` and ``text``: row number, id, code points, hash of the bare text, verified recipe.

    Written to the shared folder, without texts.  Where two rows have one recipe, each identifier in it stands
    for one chunk only, so rows of one recipe have one text.  A null text counts as empty; its recipe is empty.
    """
    cut = _cut(docs, least, most)
    for salt in range(salts):
        recipe = F.transform("chunks", lambda c: identify(c, salt))  # noqa: B023 - used at once
        made = cut.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars",
            F.sha2(F.col("bare").cast("binary"), 256).alias("text_sha256"), recipe.alias("recipe"),
        )
        made = stored(made, "recipes")
        # what moves for verification are chunks of recipes that several rows have; the filter may let others pass
        repeated = stored(_repeated(made).select(_digest("recipe").alias("digest")), "repeated-recipes")
        bits = bits_for(repeated.count())
        asked = cut.withColumn("recipe", recipe).where(maybe_held(_digest("recipe"), filter_table(repeated, "digest", bits), bits))
        chunks = asked.select(F.explode("chunks").alias("chunk")).select(identify(F.col("chunk"), salt).alias("id"), "chunk")
        if shared_identifiers(chunks).isEmpty():
            return made
    raise ValueError(f"different chunks share an identifier under each of {salts} salts")


def exact_groups(docs: DataFrame, least: int = LEAST, most: int = MOST, identify: Identify = identifier) -> DataFrame:
    """One row per row of ``docs``: which row of its group of equal texts stays.

    Takes ``doc_id`` and ``text``; other columns are left out.  Texts are equal when they are after all of
    ``[\\x20\\x09-\\x0D]`` is deleted; a null text counts as empty, so null, empty and blank texts are one
    group.  The row with the most code points in its original text stays, of those the one with the smallest
    ``doc_id`` (null last), of repeated rows the first.  Output: ``doc_id``, ``keep_id`` (id of the row that
    stays), ``group_size``, ``kept``, ``text_sha256`` (of the text without blanks).  An empty table gives none.

    Rows are grouped and joined by their recipes; partial aggregation thins the copies of one text before
    they meet, and a recipe that very many rows have is split by AQE in the join.
    """
    rows = recipes(docs, least, most, identify)
    first = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    groups = rows.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first"))
    return rows.join(groups, "recipe").select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The digests of the rows that stay, one per different text."""
    return exact_groups(docs).where("kept").drop("kept")
