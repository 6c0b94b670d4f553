"""Writers for flow tables, per-pid tables, series and packet streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DoubleType

from flowloom.functions.scalars import render_number
from flowloom.schemas import FLOW_COLUMNS, PACKET
from flowloom.sources import idx


def write_flows(flows: DataFrame, path: str, fmt: str = "csv") -> None:
    """SNK-01: the flow table with its 13 columns in order."""
    writer = flows.select(*FLOW_COLUMNS).write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def render_numbers(df: DataFrame) -> DataFrame:
    """Doubles as text for CSV: whole values as integers, others with six decimals."""
    return df.select(
        *[
            render_number(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, DoubleType) else f"`{f.name}`"
            for f in df.schema.fields
        ]
    )


def write_by_pid(df: DataFrame, path: str, fmt: str = "parquet", order: Sequence[str] = ()) -> None:
    """SNK-02: one output folder per pid.

    Rows are first rebalanced by pid: small pids end up in few files, and AQE
    splits a pid with many rows over several tasks.  With ``order`` (SRT-02) they are
    partitioned by ranges of (pid, order) instead and sorted within tasks, nulls last: the names of a pid's files, in
    order, and the rows in each, in order, are the whole order.  One shuffle either way.
    """
    if order:
        along = [F.col("pid"), *[F.col(c).asc_nulls_last() for c in order]]
        rows = df.repartitionByRange(*along).sortWithinPartitions(*along)
    else:
        rows = df.hint("rebalance", "pid")
    if fmt == "csv":
        render_numbers(rows).write.mode("overwrite").partitionBy("pid").option("header", True).csv(path)
    else:
        rows.write.mode("overwrite").partitionBy("pid").format(fmt).save(path)


def write_idx_images(df: DataFrame, path: str, width: int) -> None:
    """Images of a ``pixels`` column (numbers from 0 to 255, row after row) as IDX files of a folder."""
    df.sparkSession.dataSource.register(idx.IdxImages)
    df.select("pixels").write.format(idx.FORMAT).option("width", width).mode("append").save(path)


def write_series(series: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """SNK-03: one output folder per (feature, pid); the folder is cleared first."""
    rows = series.select("feature", F.coalesce("pid", F.lit("system")).alias("pid"), "ts_ns", "value")
    writer = rows.hint("rebalance", "feature", "pid").write.mode(mode).partitionBy("feature", "pid")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def stream_series(series: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """SNK-03 for a stream: one folder per batch number, rewritten if the batch is retried."""

    def write(batch: DataFrame, number: int) -> None:
        write_series(batch, f"{path}/batch={number}")

    return series.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def write_packets(packets: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """SNK-04: append packets to CSV as they arrive; files are committed exactly once."""
    return (
        packets.select(*PACKET.names)
        .writeStream.outputMode("append")
        .format("csv")
        .option("header", True)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
