import random

import pytest
from pyspark.sql import functions as F

from flowloom.llm import keyfilter as K


@pytest.mark.parametrize("bits", [1 << 15, 1 << 18])
def test_no_key_is_missed(spark, bits):
    keys = [0, 1, 63, 64, -1, -64, 2**62 + 5, -(2**63), 12345]
    table = K.filter_table(spark.createDataFrame([(k,) for k in keys], "k long"), "k", bits)
    asked = spark.createDataFrame([(k, True) for k in keys] + [(k, False) for k in (7, 65, 2**40)] + [(None, False)], "k long, given boolean")
    found = asked.select("k", "given", K.maybe_held(F.col("k"), table, bits).alias("held")).collect()
    assert all(r.held for r in found if r.given)
    places = {k % bits for k in keys}
    assert all(r.held == (r.k is not None and r.k % bits in places) for r in found if not r.given)


def test_no_keys_hold_nothing(spark):
    table = K.filter_table(spark.createDataFrame([], "k long"), "k", 1 << 16)
    assert [r.held for r in spark.range(3).select(K.maybe_held(F.col("id"), table, 1 << 16).alias("held")).collect()] == [False] * 3


def test_size_follows_the_keys():
    assert K.bits_for(0) == 1 << 16 and K.bits_for(10**5) == 1 << 21 and K.bits_for(10**12) == K.MOST_BITS


def test_a_filter_in_words_holds_what_the_bitmaps_hold(spark):
    for size in (0, 3, 20_000):
        rng = random.Random(size)
        keys = [rng.randrange(-(2**63), 2**63) for _ in range(size)]
        bits = K.bits_for(size)
        given = spark.createDataFrame([(k,) for k in keys], "k long")
        asked = spark.createDataFrame([(k,) for k in keys + [rng.randrange(-(2**63), 2**63) for _ in range(20_000)]], "k long")
        found = asked.select(
            K.maybe_in_words(F.col("k"), K.word_table(given, "k", bits), bits).alias("words"),
            K.maybe_held(F.col("k"), K.filter_table(given, "k", bits), bits).alias("bitmaps"),
        )
        assert found.where("words <> bitmaps or words is null").count() == 0
        assert given.where(~K.maybe_in_words(F.col("k"), K.word_table(given, "k", bits), bits)).count() == 0
