"""Training labels of a flow: rate, elephant flag, size of the next flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.config import ROWS_PER_TASK
from flowloom.operators.splits import CHUNK, HALO, Splits, find_splits, with_halo
from flowloom.schemas import require_columns


def as_number(column: Column) -> Column:
    """Text or number to double; anything unreadable, and NaN, becomes null."""
    value = column.try_cast("double")
    return F.when(~F.isnan(value), value)


def duration_s(start: Column, end: Column) -> Column:
    """SCL-10: end - start when positive, else null."""
    length = as_number(end) - as_number(start)
    return F.when(length > 0, length)


def avg_rate_bps(size: Column, duration: Column) -> Column:
    """SCL-11: bits per second; null without a duration."""
    return as_number(size) * 8 / duration


def y_is_elephant(rate: Column, threshold_bps: float) -> Column:
    """SCL-12: 1 strictly above the threshold; an unknown rate counts as 0."""
    return F.coalesce((rate > F.lit(float(threshold_bps))).cast("int"), F.lit(0))


def label_splits(df: DataFrame, rows_per_task: int) -> Splits:
    return find_splits(df, ("src_ip",), "start_ts_ns", None, rows_per_task)


def lead_next_size(
    df: DataFrame, rows_per_task: int = ROWS_PER_TASK, splits: Splits | None = None
) -> DataFrame:
    """WIN-04: ``y_next_size``, the total size of the source's next flow.

    Flows that start together keep their 4-tuple order.  A busy source - the
    vantage host sends about half of all flows - is cut along time, and the
    first flow behind each cut is copied across it.
    """
    if splits is None:
        splits = label_splits(df, rows_per_task)
    ties = [c for c in ("src_port", "dst_ip", "dst_port") if c in df.columns]
    keys = [*(["pid"] if "pid" in df.columns else []), "src_ip"]
    order = ["start_ts_ns", *ties]
    # flows of no known source have no next one and need no window
    known = F.col("src_ip").isNotNull()
    apart = df.where(~known).withColumn("y_next_size", F.lit(None).cast("bigint"))
    rows = splits.on("start_ts_ns").attach(df.where(known))
    rows = with_halo(rows, keys, order, after=1) if not splits.trivial else rows.withColumn(HALO, F.lit(False))
    line = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    following = F.lead(F.col("total_size").try_cast("bigint")).over(line)
    found = rows.withColumn("y_next_size", following).where(~F.col(HALO)).select(*df.columns, "y_next_size")
    return found.unionByName(apart)


def add_labels(
    df: DataFrame,
    threshold_bps: float = 1e8,
    rows_per_task: int = ROWS_PER_TASK,
    splits: Splits | None = None,
) -> DataFrame:
    """PIP-04: duration_s, avg_rate_bps, y_is_elephant and y_next_size."""
    require_columns(df, ["start_ts_ns", "start_time", "end_time", "total_size"], "labels input")
    own = df.columns
    labelled = (
        lead_next_size(df, rows_per_task, splits)
        .withColumn("duration_s", duration_s(F.col("start_time"), F.col("end_time")))
        .withColumn("avg_rate_bps", avg_rate_bps(F.col("total_size"), F.col("duration_s")))
        .withColumn("y_is_elephant", y_is_elephant(F.col("avg_rate_bps"), threshold_bps))
    )
    return labelled.select(*own, "duration_s", "avg_rate_bps", "y_is_elephant", "y_next_size")
