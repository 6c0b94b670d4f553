"""Latest-known metric and event samples for every flow, per process."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.config import ROWS_PER_TASK
from flowloom.operators.splits import CHUNK, Splits, copy_to_salts, find_splits, spread
from flowloom.schemas import require_columns

POLLED = "polled"
EVENT = "event"
STATES = "_states"
# Pids whose states one pass over the flows looks up.
PIDS_AT_ONCE = 64


def attach_global_series(series: DataFrame) -> DataFrame:
    """JON-05: give each pid with a polled series the system-wide series too.

    A pid's own series of the same name wins; event-only pids get none.  The
    pair table holds (pid, name) and is left to AQE, which broadcasts it only
    after seeing its real size.
    """
    own = series.where(F.col("pid").isNotNull())
    polled = series.where(F.col("kind") == POLLED)
    shared = polled.where(F.col("pid").isNull())
    names = shared.agg(F.collect_set("feature").alias("n")).scalar()
    pairs = (
        polled.where(F.col("pid").isNotNull())
        .groupBy("pid")
        .agg(F.collect_set("feature").alias("mine"))
        .select("pid", F.explode(F.array_except(names, F.col("mine"))).alias("feature"))
    )
    copies = shared.drop("pid").join(pairs, "feature")
    return own.unionByName(copies.select(*own.columns))


def pid_union(series: DataFrame) -> DataFrame:
    """SET-01: the distinct pids that have any series."""
    return series.where(F.col("pid").isNotNull()).select("pid").distinct()


def pid_names(pids: DataFrame) -> list[str]:
    """The traced pids in order: a short list, one entry per process."""
    names = sorted(r["pid"] for r in pids.where(F.col("pid").isNotNull()).select("pid").distinct().collect())
    if not names:
        raise ValueError("no pids: there is no series to join flows with")
    return names


def series_names(series: DataFrame) -> tuple[list[str], list[str]]:
    """Names of the polled and event series, each sorted (names only, never samples)."""
    rows = series.select("kind", "feature").distinct().collect()
    polled = sorted(r["feature"] for r in rows if r["kind"] == POLLED)
    events = sorted(r["feature"] for r in rows if r["kind"] == EVENT)
    return polled, events


def time_splits(*tables: tuple[DataFrame, str], rows_per_task: int = ROWS_PER_TASK) -> Splits:
    """One global time line cut so that no piece holds much more than a task's rows."""
    basis = None
    for df, ts in tables:
        part = df.select(F.col(ts).alias("ts_ns"))
        basis = part if basis is None else basis.unionByName(part)
    return find_splits(basis, (), "ts_ns", None, rows_per_task)


def extract_features(
    flows: DataFrame,
    series: DataFrame,
    polled: Sequence[str] | None = None,
    events: Sequence[str] | None = None,
    pids: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    splits: Splits | None = None,
) -> DataFrame:
    """JON-01, JON-02, RSH-02: flows x pids with the last sample at or before start.

    ``series`` is long: pid, kind, feature, ts_ns, value, ord; later ``ord`` wins
    among equal times.  A polled series yields ``<name>``; an event series ``<name>`` and the age
    in seconds ``tt_<name>``.  If both kinds share a name the event value wins.
    """
    stated, features = flow_states(flows, series, polled, events, pids, rows_per_task, splits)
    return fan_out_by_pid(stated, features)


def flow_states(
    flows: DataFrame,
    series: DataFrame,
    polled: Sequence[str] | None = None,
    events: Sequence[str] | None = None,
    pids: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    splits: Splits | None = None,
) -> tuple[DataFrame, list[str]]:
    """Every flow once, with ``STATES``: an array of one struct per pid (its ``pid`` and features), in pid order.

    The samples of a pid are turned into its change points first: its state, the newest sample of
    every series, at each instant at which it changes.  They meet the flows once per time chunk, and one running
    lookup per pid finds the state at a flow's start.  So flows are neither copied per pid nor shuffled with
    copies; ``fan_out_by_pid`` copies them afterwards, where they are.  Above ``PIDS_AT_ONCE`` pids flows
    are shuffled once per so many of them.  The state at the start of a chunk enters it as ordinary, earlier samples.

    Also returns the names of the features.
    """
    require_columns(flows, ["start_ts_ns"], "flows")
    require_columns(series, ["pid", "kind", "feature", "ts_ns", "value", "ord"], "series")
    if polled is None or events is None:
        found_polled, found_events = series_names(series)
        polled = found_polled if polled is None else polled
        events = found_events if events is None else events
    polled = [f for f in polled if f not in events]
    names = pid_names(pids if pids is not None else pid_union(series))
    if splits is None:
        splits = time_splits((flows, "start_ts_ns"), (series, "ts_ns"), rows_per_task=rows_per_task)
    points = copy_to_salts(_change_points(attach_global_series(series), splits, polled, events), splits)

    named = flows.select(F.struct(*flows.columns).alias("_flow"), F.col("start_ts_ns").alias("ts_ns"))
    rows = spread(splits.on("ts_ns").attach(named, subdivide=False), splits, by=["_flow"])
    running = (
        Window.partitionBy(CHUNK, "_salt")
        .orderBy(F.col("ts_ns").asc_nulls_first(), F.col("_flow").isNotNull(), "ord")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found: list[Column] = []
    for begin in range(0, len(names), PIDS_AT_ONCE):
        some = names[begin : begin + PIDS_AT_ONCE]
        both = points.where(F.col("pid").isin(some)).unionByName(rows, allowMissingColumns=True)
        held = [c for c in rows.columns if c.startswith("_at")]
        newest = [
            F.last(F.when(F.col("pid") == name, F.col("_state")), ignorenulls=True).over(running).alias(f"_at{begin + i}")
            for i, name in enumerate(some)
        ]
        rows = both.select(CHUNK, "_salt", "_flow", "ts_ns", *held, *newest).where(F.col("_flow").isNotNull())
    features = [*polled, *[n for e in events for n in (e, f"tt_{e}")]]
    for i, name in enumerate(names):
        columns = [F.lit(name).alias("pid")]
        columns += [F.round(F.col(f"_at{i}")[f"p_{f}"], 6).alias(f) for f in polled]
        for e in events:
            seen = F.col(f"_at{i}")[f"e_{e}"]
            columns += [F.round(seen["value"], 6).alias(e), sample_age(F.col("ts_ns"), seen["ts_ns"]).alias(f"tt_{e}")]
        found.append(F.struct(*columns))
    return rows.select("_flow.*", F.array(*found).alias(STATES)), features


def _change_points(owned: DataFrame, splits: Splits, polled: Sequence[str], events: Sequence[str]) -> DataFrame:
    """The state of each pid from each of its samples on: pid, chunk, ts_ns, ord, _state."""
    kinds = (F.col("kind") == POLLED) & F.col("feature").isin(list(polled)) | (F.col("kind") == EVENT) & F.col("feature").isin(list(events))
    samples = splits.attach(owned.where(kinds), subdivide=False)
    if splits.heavy:
        # many samples of one instant: only the last of them can be seen
        samples = (
            samples.groupBy("pid", "kind", "feature", "ts_ns", CHUNK)
            .agg(F.max_by("value", "ord").alias("value"), F.max("ord").alias("ord"))
        )
    samples = samples.select("pid", CHUNK, "ts_ns", "kind", "feature", "ord", "value")
    if not splits.trivial:
        samples = samples.unionByName(_state_at_chunk_start(samples, splits.last_chunk))
    running = (
        Window.partitionBy("pid", CHUNK)
        .orderBy(F.col("ts_ns").asc_nulls_first(), "ord")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )

    def latest(kind: str, feature: str, what: Column) -> Column:
        mine = (F.col("kind") == kind) & (F.col("feature") == feature)
        return F.last(F.when(mine, what), ignorenulls=True).over(running)

    columns = [latest(POLLED, f, F.col("value")).alias(f"p_{f}") for f in polled]
    columns += [latest(EVENT, e, F.struct("ts_ns", "value")).alias(f"e_{e}") for e in events]
    if not columns:
        columns = [F.lit(None).cast("double").alias("none")]
    # a column of its own each, as window functions do not nest
    wide = samples.select("pid", CHUNK, "ts_ns", "ord", *columns)
    return wide.select("pid", CHUNK, "ts_ns", "ord", F.struct(*[c for c in wide.columns[4:]]).alias("_state"))


def fan_out_by_pid(
    stated: DataFrame, features: Sequence[str], lagged: Sequence[str] = (), k: int = 0, last: Sequence[str] = ()
) -> DataFrame:
    """JON-04: every pid gets a copy of every flow, with its own features; no shuffle.

    With ``k``, ``lagged`` names flow columns that have lags ``<name>_t1`` to ``_tK``, and ``STATES`` has them too; the
    lags of features follow those of the flow.  Columns named in ``last`` come at the end.
    """
    lags = {f"{c}_t{j}" for c in (*lagged, STATES) for j in range(1, k + 1)}
    front = [c for c in stated.columns if c != STATES and c not in lags and c not in last]
    rows = stated.select("*", F.posexplode(STATES).alias("_i", "_s"))
    past = []
    for j in range(1, k + 1):
        past += [F.col(f"{c}_t{j}") for c in lagged]
        before = F.get(F.col(f"{STATES}_t{j}"), F.col("_i"))
        past += [before[f].alias(f"{f}_t{j}") for f in features]
    return rows.select(F.col("_s")["pid"].alias("pid"), *front, *[F.col("_s")[f].alias(f) for f in features], *past, *last)


def sample_age(start: Column, sampled: Column) -> Column:
    """SCL-07: seconds between a sample and the flow start, never negative."""
    age = F.greatest(F.lit(0.0), (start - sampled).cast("double") / F.lit(1e9))
    return F.when(start.isNotNull() & sampled.isNotNull(), F.round(age, 6))


def _state_at_chunk_start(samples: DataFrame, last_chunk: int) -> DataFrame:
    """The newest sample of each series before a chunk, copied into that chunk.

    A chunk's newest sample is needed by the following chunks up to and
    including the next one that has samples of the series.
    """
    by_series = Window.partitionBy("pid", "kind", "feature").orderBy(CHUNK)
    newest = (
        samples.groupBy("pid", "kind", "feature", CHUNK)
        .agg(F.max(F.struct("ts_ns", "ord", "value")).alias("s"))
        .withColumn("_until", F.coalesce(F.lead(CHUNK).over(by_series), F.lit(last_chunk).cast("long")))
        .where(F.col("_until") > F.col(CHUNK))
    )
    return newest.select(
        "pid",
        F.explode(F.sequence(F.col(CHUNK) + 1, F.col("_until"))).alias(CHUNK),
        F.col("s.ts_ns").alias("ts_ns"),
        "kind",
        "feature",
        F.col("s.ord").alias("ord"),
        F.col("s.value").alias("value"),
    )


def missing_counts(features: DataFrame, series: DataFrame) -> DataFrame:
    """AGG-03: per pid and series, how many flows have no sample (only if any).

    Counts one row per pid first; a pid is only charged for series it has.
    """
    owned = attach_global_series(series).select("pid", "feature").distinct()
    skip = {"pid"}
    names = [
        r for r in features.columns if r not in skip and f"tt_{r}" in features.columns or r in _values(features)
    ]
    counted = features.groupBy("pid").agg(
        *[F.count_if(F.col(f"`{n}`").isNull()).cast("long").alias(n) for n in names]
    )
    return (
        counted.unpivot(["pid"], names, "feature", "missing")
        .where(F.col("missing") > 0)
        .join(owned, ["pid", "feature"], "left_semi")
    )


def _values(features: DataFrame) -> set[str]:
    """Double columns that are not sample ages: the feature values."""
    return {n for n, t in features.dtypes if t == "double" and not n.startswith("tt_")}
