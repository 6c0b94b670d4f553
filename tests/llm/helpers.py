"""Small inputs for the operator tests, with the awkward cases in one place."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

CLASHING = "doc_id long, text string, TEXT string, rk string, score int, id long, n_tokens string, _rest int, keep boolean"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))


def awkward(spark: SparkSession, texts: list | None = None) -> DataFrame:
    """Null ids and texts, blanks, a long text, ties, repeated rows, and columns with clashing names."""
    rows = [
        (1, None),
        (None, "of no id at all"),
        (None, None),
        (2, ""),
        (3, " \n\t "),
        (4, LONG),
        (5, "a plain text of seven words here"),
        (5, "a plain text of seven words here"),
        (6, "a plain text of seven words here"),
        (5, "the same id but another text"),
    ]
    rows += list(enumerate(texts or [], 100))
    return spark.createDataFrame([(i, t, "other", None, None, 7, None, None, None) for i, t in rows], CLASHING)


def documents(spark: SparkSession, texts) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "doc_id long, text string")


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> list[str]:
    return [f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(words)]
