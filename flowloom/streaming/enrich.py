"""Streaming enrichment, metric ingestion, and running a stream into a table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from flowloom.config import ROWS_PER_TASK
from flowloom.operators.asof import extract_features
from flowloom.operators.filters import feature_allowlist
from flowloom.sources.proc import SNAPSHOT_FEATURES, file_features
from flowloom.streaming.batchwise import Keep, Step, run_batches

STATE_SCHEMA = StructType(
    [StructField(n, StringType()) for n in ("pid", "kind", "feature")]
    + [StructField("ts_ns", LongType()), StructField("value", DoubleType()), StructField("ord", LongType())]
)


def samples_to_keep(series: DataFrame, delay_ns: int) -> DataFrame:
    """What flows up to ``delay_ns`` late may still ask for.

    Of every (pid, kind, feature) the samples of the last ``delay_ns`` before the newest
    time seen in any series, and the last one ahead of them.
    """
    newest = series.agg(F.max("ts_ns")).scalar()
    marked = series.withColumn("_recent", F.coalesce(F.col("ts_ns") > newest - F.lit(delay_ns), F.lit(False)))
    ahead = (
        marked.where(~F.col("_recent"))
        .groupBy("pid", "kind", "feature")
        .agg(F.max(F.struct("ts_ns", "ord", "value")).alias("s"))
        .select("pid", "kind", "feature", "s.ts_ns", "s.value", "s.ord")
    )
    return marked.where("_recent").select(*ahead.columns).unionByName(ahead)


def asof_stream(
    rows: DataFrame,
    split: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    folder: str,
    polled: Sequence[str],
    events: Sequence[str],
    pids: DataFrame,
    rows_per_task: int = ROWS_PER_TASK,
    delay_ns: int = 3_600_000_000_000,
) -> StreamingQuery:
    """STR-03: last-value enrichment of a stream.

    ``split`` turns a micro-batch into (flows, samples).  Each batch is enriched
    by the batch as-of operator over its own samples and those kept of all earlier
    batches, so hot pids and bursts are handled as in batch.  Flows may come up to
    ``delay_ns`` after the newest sample of earlier batches; the samples may have been dropped that
    later ones would need, so these go to ``<folder>/late``, by batch, as they came and get no row.
    """

    step = asof_step(split, folder, polled, events, pids, rows_per_task, delay_ns)
    return run_batches(rows, step, STATE_SCHEMA, folder)


def asof_step(
    split: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    folder: str,
    polled: Sequence[str],
    events: Sequence[str],
    pids: DataFrame,
    rows_per_task: int = ROWS_PER_TASK,
    delay_ns: int = 3_600_000_000_000,
) -> Step:
    """What happens to one micro-batch of ``asof_stream``; done again, it writes the same folders again."""

    def step(batch: DataFrame, state: DataFrame, number: int, keep: Keep) -> tuple[DataFrame, DataFrame]:
        flows, samples = split(batch)
        horizon = state.agg(F.max("ts_ns")).head()[0]
        if horizon is not None:
            late = flows.where(F.col("start_ts_ns") <= horizon - delay_ns)
            late.write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
            flows = flows.where(~F.coalesce(F.col("start_ts_ns") <= horizon - delay_ns, F.lit(False)))
        held = samples.select("pid", "kind", "feature", "ts_ns", "value", "ord").unionByName(state)
        found = extract_features(flows, held, polled, events, pids, rows_per_task)
        return found, samples_to_keep(held, delay_ns)

    return step


def metric_stream(
    snapshots: DataFrame, path: str, checkpoint: str, features: Sequence[str] = SNAPSHOT_FEATURES
) -> StreamingQuery:
    """STR-07: logged proc snapshots to one folder per batch and feature, pids as a column.

    Every file speaks for itself, so the files of one snapshot may arrive in several
    batches; a file that never comes gives no rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        series = feature_allowlist(file_features(batch), features)
        rows = series.withColumn("pid", F.col("pid").cast("string")).hint("rebalance", "feature")
        rows.write.mode("overwrite").partitionBy("feature").parquet(f"{path}/batch={number}")

    return (
        snapshots.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Drain what a stream has available and read the result back from ``folder``.

    Append results go to a file sink.  Complete results are rewritten by every
    batch, so the last folder holds them all.
    """
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    spark = stream.sparkSession
    if mode == "append":
        writer.outputMode("append").format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/rows")

    def rewrite(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows")

    writer.outputMode(mode).foreachBatch(rewrite).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
