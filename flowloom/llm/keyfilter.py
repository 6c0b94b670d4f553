"""A filter of row keys that lets rows skip a join: bitmaps of bounded size, natively built and tested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of a filter whose keys were not counted (1 MB).  When keys fill it, it spares fewer rows the join; results never change.
BITS = 1 << 23
# For counted keys: bits for each of them, and in all at most (4 MB, which is what is broadcast).
BITS_PER_KEY = 16
MOST_BITS = 1 << 25
_BITMAP = 32768


def bits_for(keys: int) -> int:
    """Bits of the filter of so many keys, a power of two."""
    bits = 1 << 16
    while bits < min(BITS_PER_KEY * keys, MOST_BITS):
        bits *= 2
    return bits


def filter_table(keys: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """One row: the bitmaps that hold the (long) keys, ``bits`` (a power of two) in all."""
    h = F.pmod(key, F.lit(bits))
    return (
        keys.groupBy(F.floor(h / _BITMAP).cast("int").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.pmod(h, F.lit(_BITMAP))).alias("bitmap"))
        .agg(F.map_from_entries(F.collect_list(F.struct("bucket", "bitmap"))).alias("held"))
    )


def maybe_held(key: Column, table: DataFrame, bits: int = BITS) -> Column:
    """Whether the filter may hold a key; false only for keys that it was not given."""
    h = F.pmod(key, F.lit(bits))
    place = F.pmod(h, F.lit(_BITMAP)).cast("int")
    bitmap = F.try_element_at(table.scalar(), F.floor(h / _BITMAP).cast("int"))
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, F.pmod(place, F.lit(8)).cast("int")).bitwiseAND(F.lit(1))
    return F.coalesce(bit == 1, F.lit(False))


def word_table(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """One row: the same filter as numbers of 32 bits, which are tested without copying a bitmap for every row."""
    word = lambda i: F.conv(F.hex(F.substring("bitmap", i * 4 + 1, F.lit(4))), 16, 10).cast("long")
    h = F.pmod(key, F.lit(bits))
    held = (
        keys.groupBy(F.floor(h / _BITMAP).cast("int").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.pmod(h, F.lit(_BITMAP))).alias("bitmap"))
        .select("bucket", F.transform(F.sequence(F.lit(0), F.lit(_BITMAP // 32 - 1)), word).alias("words"))
    )
    buckets = keys.sparkSession.range(0, bits // _BITMAP, 1, 1).select(F.col("id").cast("int").alias("bucket"))
    rows = buckets.join(held, "bucket", "left").agg(F.sort_array(F.collect_list(F.struct("bucket", "words"))).alias("rows"))
    return rows.select(F.transform("rows", lambda r: r["words"]).alias("held"))


def maybe_in_words(key: Column, table: DataFrame, bits: int) -> Column:
    """Whether a ``word_table`` may hold a key; false only for keys that it was not given."""
    h = F.pmod(key, F.lit(bits))
    words = F.get(table.scalar(), F.shiftright(h, _BITMAP.bit_length() - 1).cast("int"))
    word = F.get(words, F.shiftright(h, 5).bitwiseAND(F.lit(_BITMAP // 32 - 1)).cast("int"))
    # the bytes of a bitmap are read as one number, the first as its highest
    place = h.bitwiseAND(F.lit(31)).bitwiseXOR(F.lit(24)).cast("int")
    return F.coalesce(F.call_function("shiftright", word, place).bitwiseAND(F.lit(1)) == 1, F.lit(False))
