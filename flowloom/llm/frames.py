"""What the operators of this package share: picking columns and mapping texts in batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from flowloom.session import ensure_checkpoint_dir

# Rows handed to a text function at once; bounds the Python objects alive in a task.
ROWS_AT_ONCE = 256

TextFunction = Callable[[list[str]], Sequence[Sequence]]


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, found by exact name, whatever else the frame holds.

    Other columns may repeat a name or differ from one in case only; of several
    columns with the very same name the first counts.
    """
    columns = df.columns
    missing = [n for n in names if n not in columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {columns}")
    bare = df.toDF(*[f"_{i}" for i in range(len(columns))])
    return bare.select(*[F.col(f"_{columns.index(n)}").alias(n) for n in names])


def map_texts(
    df: DataFrame, text: str, added: str, prepare: Callable[[], TextFunction], keep_text: bool = False
) -> DataFrame:
    """Append columns computed from a text column, batch by batch in Arrow.

    ``prepare`` runs once in each task and returns a function from a list of
    texts (null is the empty text) to one sequence of values per added column;
    ``added`` is their DDL.  The text itself is left out unless ``keep_text``.
    """
    place = df.columns.index(text)
    kept = [i for i in range(len(df.columns)) if keep_text or i != place]
    schema = StructType([df.schema.fields[i] for i in kept] + StructType.fromDDL(added).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        work = prepare()
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(begin, ROWS_AT_ONCE)
                texts = [t if t is not None else "" for t in part.column(place).to_pylist()]
                values = work(texts)
                arrays = [part.column(i).cast(arrow.field(k).type) for k, i in enumerate(kept)]
                arrays += [pa.array(v, type=arrow.field(len(kept) + k).type) for k, v in enumerate(values)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as a table in the shared checkpoint folder and read again.

    Cuts the lineage like a checkpoint, but compressed and with columns pruned on reading.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # Spark removes the shuffle files of plans written before once their objects are collected
    spark.sparkContext._jvm.System.gc()
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
