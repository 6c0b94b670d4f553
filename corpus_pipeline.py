"""The corpus pipeline: five stages over the documents, each on all that the one before kept.

A stage takes ``(spark, docs, sf_dir)``; all but the last return documents with the
columns they came with.  Between stages the documents are written as Parquet in the
shared folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import decontaminate, linededup, neardup, packing, toxicity
from flowloom.llm.frames import stored

_REST = "_rest"


def _bundled(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and one struct of all other columns, whatever their names."""
    columns = docs.columns
    key, text = columns.index("doc_id"), columns.index("text")
    bare = docs.toDF(*[f"_{i}" for i in range(len(columns))])
    others = [F.col(f"_{i}") for i in range(len(columns)) if i not in (key, text)]
    rest = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
    return bare.select(F.col(f"_{key}").alias("doc_id"), F.col(f"_{text}").alias("text"), rest.alias(_REST))


def _unbundled(kept: DataFrame, like: DataFrame) -> DataFrame:
    """The documents in the columns, and the order of columns, they had before."""
    columns = like.columns
    own = {columns.index("doc_id"): F.col("doc_id"), columns.index("text"): F.col("text")}
    return kept.select(*[own.get(i, F.col(f"{_REST}._{i}")).alias(f"_{i}") for i in range(len(columns))]).toDF(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go; null and empty texts stay."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(_bundled(docs), model, carry=(_REST,))
    return _unbundled(scored.where(F.col("predicted") == 0), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later similar lines go; a document that is left without words by that goes too.

    ``n_chars`` follows the text where it was cut.
    """
    cut = linededup.cut_lines(docs)
    columns = docs.columns
    text = columns.index("text")
    emptied = (F.col("n_removed") > 0) & ~F.coalesce(F.col("cut").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    values = {text: F.col("cut")}
    if "n_chars" in columns:
        place = columns.index("n_chars")
        length = F.when(F.col("n_removed") > 0, F.char_length("cut")).otherwise(F.col(f"_{place}"))
        values[place] = length.cast(docs.schema.fields[place].dataType)
    kept = cut.where(~emptied)
    return kept.select(*[values.get(i, F.col(f"_{i}")).alias(f"_{i}") for i in range(len(columns))]).toDF(*columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose word 5-grams are similar one stays."""
    return neardup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_passages(_bundled(docs), benchmark, carry=(_REST,))
    return _unbundled(found.where(F.size("runs") == 0), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into token sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

# Scores of a fitted model are no SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; the pieces of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
