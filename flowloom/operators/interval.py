"""Interval accumulation: sums of event sizes, emitted at most once per interval."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from flowloom.config import ROWS_PER_TASK
from flowloom.functions.scalars import mono_to_epoch
from flowloom.operators.splits import CHUNK, Splits, find_splits
from flowloom.session import checkpoint

# Summaries of neighbouring pieces that one group composes, or chains.
FAN = 32


def _next_emitting(ts: np.ndarray, interval_ns: int) -> np.ndarray:
    """For each event, the first event an interval or more later (len if none)."""
    return np.searchsorted(ts, ts + interval_ns, side="left")


def _last_emitting(follow: np.ndarray) -> np.ndarray:
    """For each event, the last emission of the chain that starts with it."""
    size = len(follow)
    jump = np.where(follow < size, follow, np.arange(size))
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return jump
        jump = further


def summarise_piece(ts: np.ndarray, size: np.ndarray, interval_ns: int) -> dict:
    """What a piece does to any state that enters it.

    The entering state only decides which event emits first, and that event lies
    within one interval of the piece's start.  Runs of such events that end in
    the same last emission share one entry: up to which threshold it applies,
    the time of the last emission, and the bytes left over after it.
    """
    total = np.cumsum(size)
    follow = _next_emitting(ts, interval_ns)
    last = _last_emitting(follow)
    reach = min(int(np.searchsorted(ts, ts[0] + interval_ns, side="left")) + 1, len(ts))
    ends = last[:reach]
    closing = np.append(np.flatnonzero(np.diff(ends)), reach - 1)
    return {
        "begin": int(ts[0]),
        "upto": ts[closing].tolist(),
        "exit_ts": ts[ends[closing]].tolist(),
        "left": (total[-1] - total[ends[closing]]).tolist(),
        "total": int(total[-1]),
    }


def leave(piece: dict, prev: int, pending: int, interval_ns: int) -> tuple[int, int]:
    """The state that leaves a piece, or a run of pieces, that the given one enters."""
    at = bisect_left(piece["upto"], prev + interval_ns)
    if at < len(piece["upto"]):
        return piece["exit_ts"][at], piece["left"][at]
    return prev, pending + piece["total"]


def compose(first: dict, second: dict, interval_ns: int) -> dict:
    """The summary of two neighbouring pieces as one; associative.

    A state that lets the first emit enters the second as the first leaves it; any other goes through
    the first with its bytes added and finds its emission, if any, in the second.  No entering state waits for
    longer than an interval after the first piece begins, so a composed summary is as short as that of a piece.
    """
    out = {"begin": first["begin"], "upto": [], "exit_ts": [], "left": [], "total": first["total"] + second["total"]}

    def add(upto: int, exit_ts: int, left: int) -> None:
        if out["upto"] and (out["exit_ts"][-1], out["left"][-1]) == (exit_ts, left):
            out["upto"][-1] = upto
        else:
            for name, value in (("upto", upto), ("exit_ts", exit_ts), ("left", left)):
                out[name].append(value)

    for upto, exit_ts, left in zip(first["upto"], first["exit_ts"], first["left"]):
        add(upto, *leave(second, exit_ts, left, interval_ns))
    for upto, exit_ts, left in zip(second["upto"], second["exit_ts"], second["left"]):
        if out["upto"][-1] >= first["begin"] + interval_ns:
            break
        if upto > first["upto"][-1]:
            add(upto, exit_ts, left)
    return out


def emit_piece(
    ts: np.ndarray, size: np.ndarray, interval_ns: int, prev_ts: int, pending: int, exact: bool
) -> tuple[list[int], list[int], list[int], list[int]]:
    """Emissions of one piece given the state at its start: stamps, sums, own times, and exact sums.

    An emission is stamped with the time of the emission before it.  The
    emitting event counts twice unless ``exact``.
    """
    follow = _next_emitting(ts, interval_ns).tolist()
    at = int(np.searchsorted(ts, prev_ts + interval_ns, side="left"))
    chosen = []
    while at < len(follow):
        chosen.append(at)
        at = follow[at]
    if not chosen:
        return [], [], [], []
    index = np.array(chosen)
    total = np.cumsum(size)
    own = np.diff(total[index], prepend=-pending)
    sums = own if exact else own + size[index]
    stamps = np.concatenate(([prev_ts], ts[index[:-1]]))
    return stamps.tolist(), sums.tolist(), ts[index].tolist(), own.tolist()


def interval_accumulate(
    events: DataFrame,
    interval_ns: int,
    series: Sequence[str] = ("series",),
    exact: bool = False,
    clock_offset_ns: int = 0,
    rows_per_task: int = ROWS_PER_TASK,
    splits: Splits | None = None,
    state: DataFrame | None = None,
    emission_times: bool = False,
) -> DataFrame:
    """STF-01: per series, running size sums emitted once an interval has passed.

    State (sum, previous time) starts at zero.  Each event adds its size; if at
    least ``interval_ns`` passed since the previous emission the sum is emitted,
    stamped with that previous time, and the state resets.  So the first event
    emits at once with stamp 0, and a trailing part is never emitted.

    Which events emit depends on all earlier ones, so this is the one batch
    operator with a Python body.  Ordinary series are one group each.  A hot
    series is cut along time: pieces are summarised in parallel, the summaries -
    one row per piece - go through a prefix scan, and the pieces then emit in
    parallel from their known starting state.

    ``state`` (series, prev, pending; keys not null) continues an earlier run;
    ``emission_times`` adds ``at_ns``, the time of each emitting event, and ``own``, its exact sum.
    """
    series = list(series)
    rows = events.select(*series, "ts_ns", "size", "ord")
    if splits is None:
        splits = find_splits(rows, series, "ts_ns", "ord", rows_per_task)
    cut = splits.attach(rows)
    keys = [cut.schema[c] for c in series]
    longs = ["ts_ns", "size"] + (["at_ns", "own"] if emission_times else [])
    out_schema = StructType(keys + [StructField(name, LongType()) for name in longs])
    zero = F.lit(0).cast("long")
    begun = _with_state(cut, series, state)
    if not splits.trivial:
        states = _piece_states(cut.where(F.col(CHUNK) > 0), series, keys, interval_ns, state, splits)
        # one row per cut: small whatever the input, so it is safe to broadcast
        begun = (
            begun.withColumnsRenamed({"_prev": "_prev0", "_pending": "_pending0"})
            .join(F.broadcast(states), [*series, CHUNK], "left")
            .withColumn("_prev", F.coalesce("_prev", "_prev0", zero))
            .withColumn("_pending", F.coalesce("_pending", "_pending0", zero))
            .drop("_prev0", "_pending0")
        )

    def emit(piece: pd.DataFrame) -> pd.DataFrame:
        piece = piece.sort_values(["ts_ns", "ord"], kind="stable")
        ts, size = piece["ts_ns"].to_numpy("int64"), piece["size"].to_numpy("int64")
        begun = int(piece["_prev"].iloc[0]), int(piece["_pending"].iloc[0])
        stamps, sums, times, own = emit_piece(ts, size, interval_ns, *begun, exact)
        if not stamps:
            return pd.DataFrame()
        out = pd.DataFrame({"ts_ns": stamps, "size": sums, "at_ns": times, "own": own}, dtype="int64")[longs]
        for place, name in enumerate(series):
            out.insert(place, name, [piece[name].iloc[0]] * len(out))
        return out

    emitted = begun.groupBy(*series, CHUNK).applyInPandas(emit, out_schema)
    return emitted.withColumn("ts_ns", mono_to_epoch(F.col("ts_ns"), clock_offset_ns))


def _with_state(rows: DataFrame, series: list[str], state: DataFrame | None) -> DataFrame:
    """Add the series' starting state, zero where there is none."""
    zero = F.lit(0).cast("long")
    if state is None:
        return rows.withColumn("_prev", zero).withColumn("_pending", zero)
    held = state.select(*series, F.col("prev").alias("_prev"), F.col("pending").alias("_pending"))
    return rows.join(held, series, "left").fillna(0, ["_prev", "_pending"])


def next_state(events: DataFrame, emitted: DataFrame, state: DataFrame, series: Sequence[str]) -> DataFrame:
    """The state after ``events``, from the exact sums (``own``) and times of what was emitted.

    Bytes are either emitted or pending, so the pending ones follow by subtraction.
    """
    series = list(series)
    none = F.lit(None).cast("long")
    changes = (
        state.select(*series, F.col("prev").alias("t"), F.col("pending").alias("b"))
        .unionByName(events.select(*series, none.alias("t"), F.col("size").alias("b")))
        .unionByName(emitted.select(*series, F.col("at_ns").alias("t"), (-F.col("own")).alias("b")))
    )
    return changes.groupBy(*series).agg(
        F.coalesce(F.max("t"), F.lit(0)).alias("prev"), F.sum("b").alias("pending")
    )


def _piece_states(
    cut: DataFrame, series: list[str], keys: list[StructField], interval_ns: int, state: DataFrame | None, splits: Splits
) -> DataFrame:
    """The state (previous time, pending bytes) with which each piece starts.

    A prefix scan in rounds: runs of ``FAN`` neighbours are composed to one summary each until one run is left
    per series; its entering states are then handed down, run by run.  No group has more than
    ``FAN`` rows, however many pieces a series has.
    """
    longs = ArrayType(LongType())
    chunk = StructField(CHUNK, LongType())
    summary = [StructField("begin", LongType()), *[StructField(n, longs) for n in ("upto", "exit_ts", "left")], StructField("total", LongType())]
    names = [f.name for f in summary]
    summary_schema = StructType([*keys, chunk, *summary])
    state_schema = StructType([*keys, chunk, StructField("_prev", LongType()), StructField("_pending", LongType())])

    def summarise(piece: pd.DataFrame) -> pd.DataFrame:
        piece = piece.sort_values(["ts_ns", "ord"], kind="stable")
        row = summarise_piece(
            piece["ts_ns"].to_numpy("int64"), piece["size"].to_numpy("int64"), interval_ns
        )
        head = {name: piece[name].iloc[0] for name in [*series, CHUNK]}
        return pd.DataFrame([{**head, **row}])

    def in_order(run: pd.DataFrame) -> list[dict]:
        rows = run.sort_values(CHUNK).to_dict("records")
        return [{**r, **{n: [int(x) for x in r[n]] for n in ("upto", "exit_ts", "left")}} for r in rows]

    def merge(run: pd.DataFrame) -> pd.DataFrame:
        rows = in_order(run)
        whole = {name: rows[0][name] for name in names}
        for row in rows[1:]:
            whole = compose(whole, row, interval_ns)
        head = {name: run[name].iloc[0] for name in series}
        return pd.DataFrame([{**head, CHUNK: rows[0][CHUNK] // FAN, **whole}])

    def hand_down(run: pd.DataFrame) -> pd.DataFrame:
        prev, pending = int(run["_prev"].iloc[0]), int(run["_pending"].iloc[0])
        out = []
        for row in in_order(run):
            out.append({**{name: row[name] for name in [*series, CHUNK]}, "_prev": prev, "_pending": pending})
            prev, pending = leave(row, prev, pending, interval_ns)
        return pd.DataFrame(out)

    # one row per piece; read again by every round, so it is written once
    levels = [checkpoint(cut.groupBy(*series, CHUNK).applyInPandas(summarise, summary_schema))]
    run = F.expr(f"{CHUNK} div {FAN}")
    last = splits.last_id
    while last >= FAN:
        levels.append(levels[-1].groupBy(*series, run.alias("_run")).applyInPandas(merge, summary_schema))
        last //= FAN
    entering = None
    for level in reversed(levels):
        rows = level.withColumn("_run", run)
        if entering is None:
            rows = _with_state(rows, series, state)
        else:
            rows = rows.join(entering.withColumnRenamed(CHUNK, "_run"), [*series, "_run"])
        entering = rows.groupBy(*series, "_run").applyInPandas(hand_down, state_schema)
    return entering
