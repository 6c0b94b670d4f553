"""Lag features: the previous K flows of the same 4-tuple."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from flowloom.config import ROWS_PER_TASK
from flowloom.operators.splits import CHUNK, HALO, Splits, find_splits, with_halo
from flowloom.schemas import FLOW_KEY, require_columns

# The order of a written dataset, and the columns that never become history.
DATASET_ORDER = (*FLOW_KEY, "start_ts_ns")
NOT_HISTORY = ("flow_id", "start_time", "end_time", "start_ts_ns", "pid", *FLOW_KEY)


def numeric_columns(df: DataFrame, scan: bool = False) -> list[str]:
    """AGG-04: columns that hold numbers.

    By default the schema decides.  With ``scan`` a column qualifies if at least
    one of its values reads as a number: one aggregation for all columns.
    """
    candidates = [c for c in df.columns if c not in NOT_HISTORY]
    if not scan:
        return [c for c in candidates if isinstance(df.schema[c].dataType, NumericType)]
    if not candidates:
        return []
    found = df.agg(
        *[F.count(F.expr(f"nullif(try_cast(`{c}` as double), double('nan'))")).alias(c) for c in candidates]
    ).first()
    return [c for c in candidates if found[c] > 0]


def history_splits(df: DataFrame, rows_per_task: int) -> Splits:
    return find_splits(df, FLOW_KEY, "start_ts_ns", None, rows_per_task)


def add_history(
    df: DataFrame,
    k: int = 5,
    columns: Sequence[str] | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    splits: Splits | None = None,
    along: Sequence[str] = (),
) -> DataFrame:
    """WIN-03: ``<column>_t1 .. _tK`` from the K previous flows of the 4-tuple.

    Columns named in ``along``, of whatever type, get their lags as well.

    One shuffle and one sort: each row's numeric columns are lagged together as
    a struct.  Hot 4-tuples are cut along time, with the last K rows before each
    cut copied across it.
    """
    require_columns(df, [*FLOW_KEY, "start_ts_ns"], "history input")
    if k < 1:
        return df
    columns = [*(numeric_columns(df) if columns is None else columns), *along]
    if not columns:
        return df
    if splits is None:
        splits = history_splits(df, rows_per_task)
    keys = [*(["pid"] if "pid" in df.columns else []), *FLOW_KEY]
    whole = F.lit(True)
    for key in FLOW_KEY:
        whole = whole & F.col(key).isNotNull()
    # rows without a complete key have no history and need no window
    apart = df.where(~whole)
    rows = splits.on("start_ts_ns").attach(df.where(whole))
    rows = with_halo(rows, keys, ["start_ts_ns"], before=k) if not splits.trivial else rows.withColumn(
        HALO, F.lit(False)
    )
    line = Window.partitionBy(*keys, CHUNK).orderBy("start_ts_ns")
    past = F.struct(*[F.col(f"`{c}`") for c in columns])
    rows = rows.select(*df.columns, HALO, *[F.lag(past, j).over(line).alias(f"_h{j}") for j in range(1, k + 1)])
    lags = [F.col(f"_h{j}")[c].alias(f"{c}_t{j}") for j in range(1, k + 1) for c in columns]
    found = rows.where(~F.col(HALO)).select(*df.columns, *lags)
    none = [F.lit(None).cast(df.schema[c].dataType).alias(f"{c}_t{j}") for j in range(1, k + 1) for c in columns]
    return found.unionByName(apart.select(*df.columns, *none))
