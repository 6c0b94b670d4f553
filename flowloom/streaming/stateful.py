"""Interval accumulation with its state in the state store.

A key's new rows are handled by one task per micro-batch.  For streams in which one key may
dominate use the batchwise form in ``streaming.batchwise``; operators in event time are in ``streaming.timed``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from flowloom.operators.interval import emit_piece


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """One key's rows of this micro-batch in time order; bounded by the trigger's input."""
    return pd.concat(list(batches), ignore_index=True).sort_values(["ts_ns", "ord"], kind="stable")


def interval_stream(
    events: DataFrame, interval_ns: int, series: Sequence[str] = ("series",), exact: bool = False
) -> DataFrame:
    """STR-05: interval accumulation over an append-only stream.

    The state of a series is the time of its last emission and the bytes since.
    """
    series = list(series)
    keys = [events.schema[c] for c in series]
    output = StructType(keys + [StructField("ts_ns", LongType()), StructField("size", LongType())])
    state = StructType([StructField("prev", LongType()), StructField("pending", LongType())])

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        prev, pending = held.get if held.exists else (0, 0)
        rows = _in_order(batches)
        ts, size = rows["ts_ns"].to_numpy("int64"), rows["size"].to_numpy("int64")
        stamps, sums, times, _ = emit_piece(ts, size, interval_ns, prev, pending, exact)
        pending += int(size.sum())
        if stamps:
            # the last emission is the first event past the one before it by an interval
            last = int(np.searchsorted(ts, stamps[-1] + interval_ns, side="left"))
            prev, pending = times[-1], int(size[last + 1 :].sum())
        held.update((prev, pending))
        if stamps:
            out = pd.DataFrame({"ts_ns": stamps, "size": sums}, dtype="int64")
            for place, (name, value) in enumerate(zip(series, key)):
                out.insert(place, name, [value] * len(out))
            yield out

    rows = events.select(*series, "ts_ns", "size", "ord")
    return rows.groupBy(*series).applyInPandasWithState(
        step, output, state, "append", GroupStateTimeout.NoTimeout
    )
