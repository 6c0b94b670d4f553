"""Turning rows: wide snapshots to series, datasets to several copies, QA documents to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions import text as T
from flowloom.functions.scalars import strip


def metrics_unpivot(
    snapshots: DataFrame, features: Sequence[str], keys: Sequence[str] = ("ts_ns", "pid")
) -> DataFrame:
    """RSH-01: one wide snapshot per (time, pid) to one row per feature."""
    present = [f for f in features if f in snapshots.columns]
    typed = snapshots.select(*keys, *[F.col(f).cast("double").alias(f) for f in present])
    return typed.unpivot(list(keys), present, "feature", "value")


def series_pivot(series: DataFrame, names: Sequence[str], keys: Sequence[str] = ("pid", "ts_ns")) -> DataFrame:
    """RSH-02: long series back to one column per name, in one aggregation."""
    return series.groupBy(*keys).agg(
        *[F.max(F.when(F.col("feature") == n, F.col("value"))).alias(n) for n in names]
    )


def replicate_n(df: DataFrame, n: int) -> DataFrame:
    """SET-02: the dataset n times over (at least once), without a join or a long union."""
    if n <= 1:
        return df
    copies = F.explode(F.sequence(F.lit(1), F.lit(n)))
    return df.withColumn("_copy", copies).drop("_copy")


def repartition(df: DataFrame, partitions: int) -> DataFrame:
    """SET-03: spread rows evenly over a number of partitions."""
    return df.repartition(max(1, partitions))


def _questions(documents: DataFrame) -> DataFrame:
    paragraphs = documents.select(
        F.col("data.title").alias("title"), F.explode("data.paragraphs").alias("p")
    )
    return paragraphs.select("title", F.col("p.context").alias("context"), F.explode("p.qas").alias("qa")).select(
        strip(F.col("title")).alias("title"),
        strip(F.col("context")).alias("context"),
        strip(F.col("qa.question")).alias("question"),
        F.col("qa.answers").alias("answers"),
    )


def flatten_qa_train(documents: DataFrame, template: T.ChatTemplate = T.ChatTemplate()) -> DataFrame:
    """RSH-03: one (prompt, completion) row per answer; unanswered questions give none."""
    rows = _questions(documents).withColumn("answer", F.explode("answers.text"))
    return rows.select(
        T.chat_prompt(F.col("title"), F.col("context"), F.col("question"), template).alias("prompt"),
        T.completion(T.answer_or_default(F.col("answer")), template).alias("completion"),
    )


def flatten_qa_eval(documents: DataFrame, template: T.ChatTemplate = T.ChatTemplate()) -> DataFrame:
    """RSH-04, AGG-09: one row per question with all its answer texts, unstripped."""
    return _questions(documents).select(
        T.chat_prompt(F.col("title"), F.col("context"), F.col("question"), template).alias("prompt"),
        F.transform("answers", lambda a: a["text"]).alias("answers"),
    )
