"""Stateful streams run batch by batch with the batch operators.

A micro-batch is handled like a table, so a key that dominates it is cut and
spread over tasks.  The state between batches is a small table in the shared
folder, one version per batch number: a retried batch reads the version before
its own and rewrites its own folders.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from flowloom.config import ROWS_PER_TASK
from flowloom.operators.events import name_records, record_kinds
from flowloom.operators.interval import interval_accumulate, next_state
from flowloom.operators.pairing import ENTER, SEND, keep_target_enters, pair_socket_writes

Keep = Callable[[DataFrame], DataFrame]
Step = Callable[[DataFrame, DataFrame, int, Keep], tuple[DataFrame, DataFrame]]


def run_batches(stream: DataFrame, step: Step, state_schema: StructType, folder: str) -> StreamingQuery:
    """Apply ``step(rows, state, number, keep) -> (result, new state)`` to every micro-batch.

    Results gather below ``<folder>/rows``, in one sub-folder per batch.  The batch, and every frame
    that the step hands to ``keep``, stays in memory while the batch is handled, so a source is read once per trigger.
    What a step writes itself has to go to a sub-folder of the batch's ``number``, as a retried batch comes again.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number == 0:
            state = spark.createDataFrame([], state_schema)
        else:
            state = spark.read.schema(state_schema).parquet(f"{folder}/state/v={number - 1}")
        kept: list[DataFrame] = []

        def keep(df: DataFrame) -> DataFrame:
            kept.append(df.persist())
            return kept[-1]

        try:
            result, after = step(keep(batch), state, number, keep)
            result.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
            after.write.mode("overwrite").parquet(f"{folder}/state/v={number}")
        finally:
            for df in kept:
                df.unpersist()

    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def interval_batches(
    events: DataFrame,
    interval_ns: int,
    folder: str,
    series: Sequence[str] = ("series",),
    rows_per_task: int = ROWS_PER_TASK,
) -> StreamingQuery:
    """STR-05: interval accumulation; state is the last emission and the bytes since."""
    schema = StructType(
        [events.schema[c] for c in series] + [StructField("prev", LongType()), StructField("pending", LongType())]
    )

    def step(batch: DataFrame, state: DataFrame, number: int, keep: Keep) -> tuple[DataFrame, DataFrame]:
        emitted = keep(
            interval_accumulate(batch, interval_ns, series, rows_per_task=rows_per_task, state=state, emission_times=True)
        )
        return emitted.drop("at_ns", "own"), next_state(batch, emitted, state, series)

    return run_batches(events, step, schema, folder)


def write_pair_batches(
    log: DataFrame, folder: str, pid: int | None = None, rows_per_task: int = ROWS_PER_TASK
) -> StreamingQuery:
    """STR-06: socket writes; state is the entry, and a send if there was one, of every open call."""
    columns = ["ts_ns", "id", "kind", "ret", "ord"]
    schema = StructType(
        [StructField(c, StringType() if c == "kind" else LongType()) for c in columns]
    )

    def step(batch: DataFrame, state: DataFrame, number: int, keep: Keep) -> tuple[DataFrame, DataFrame]:
        rows = keep_target_enters(batch, pid).select(
            "ts_ns", "id", "kind", F.col("ret").cast("long").alias("ret"), "ord"
        )
        every = state.select(*columns).unionByName(rows)
        return pair_socket_writes(every, None, rows_per_task), _open_calls(every)

    return run_batches(log, step, schema, folder)


# The pid of sums over the whole system, and the record of a row that only names a known pid.
EVERYWHERE, KNOWN = "", ""


def routing_batches(
    probes: DataFrame,
    folder: str,
    interval_ns: int = 500_000,
    gpu: bool = False,
    pids: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> StreamingQuery:
    """STF-05: probe events routed to one series per (record, pid), batch by batch.

    One state holds the last emission and the bytes since of every summed series, system-wide ones under no
    pid, and the pids known so far: those of ``pids``, or else all that sent a probe yet.  Sums
    over the system go to every known pid; they are also kept once, in ``<folder>/shared``, so that a pid
    that comes later gets the earlier ones too and every pid ends with the rows it has in a batch run.
    """
    schema = StructType(
        [StructField("record", StringType()), StructField("pid", StringType())]
        + [StructField("prev", LongType()), StructField("pending", LongType())]
    )
    series = ["record", "pid"]
    direct, owned, shared = record_kinds(gpu)

    def step(batch: DataFrame, state: DataFrame, number: int, keep: Keep) -> tuple[DataFrame, DataFrame]:
        before = state.where(F.col("record") == KNOWN).select("pid")
        if pids is None:
            seen = batch.select(F.col("pid").cast("string").alias("pid")).where("pid is not null").unionByName(before)
        else:
            seen = pids.select(F.col("pid").cast("string").alias("pid"))
        known = keep(seen.distinct())
        named = name_records(batch, [*direct, *owned, *shared]).withColumn("pid", F.col("pid").cast("string"))
        everywhere = F.col("record").isin(shared)
        rows = (
            named.join(known.withColumn("_known", F.lit(True)), "pid", "left")
            .where(everywhere | F.col("_known"))
            .withColumn("pid", F.when(everywhere, F.lit(EVERYWHERE)).otherwise(F.col("pid")))
            .select("record", "pid", "ts_ns", "size", "ord")
        )
        summed = keep(rows.where(~F.col("record").isin(direct)))
        held = state.where(F.col("record") != KNOWN)
        emitted = keep(
            interval_accumulate(summed, interval_ns, series, rows_per_task=rows_per_task, state=held, emission_times=True)
        )
        totals = emitted.select("record", "pid", "ts_ns", "size")
        system = totals.where(F.col("pid") == EVERYWHERE).drop("pid")
        system.write.mode("overwrite").parquet(f"{folder}/shared/batch={number}")
        found = (
            rows.where(F.col("record").isin(direct))
            .select(*totals.columns)
            .unionByName(totals.where(F.col("pid") != EVERYWHERE))
            .unionByName(_copied(system, known).select(*totals.columns))
        )
        if number > 0:
            fresh = known.join(before, "pid", "left_anti")
            earlier = batch.sparkSession.read.schema(system.schema).parquet(
                *[f"{folder}/shared/batch={n}" for n in range(number)]
            )
            found = found.unionByName(_copied(earlier, fresh).select(*totals.columns))
        none = F.lit(None).cast("long")
        after = next_state(summed, emitted, held, series).unionByName(
            known.select(F.lit(KNOWN).alias("record"), "pid", none.alias("prev"), none.alias("pending"))
        )
        return found, after

    return run_batches(probes, step, schema, folder)


def _copied(rows: DataFrame, pids: DataFrame) -> DataFrame:
    """Every row once per pid; the list has one entry per traced process."""
    return rows.withColumn("pid", F.explode(pids.agg(F.collect_set("pid")).scalar()))


def _open_calls(log: DataFrame) -> DataFrame:
    """The rows that still matter: the entry of each open call, and its latest send."""
    place = F.struct("ts_ns", "ord")
    turn = F.when(F.col("kind") != SEND, F.struct("ts_ns", "ord", "kind"))
    last = log.groupBy("id").agg(F.max(turn).alias("turn"), F.max_by("kind", place).alias("kind"), F.max(place).alias("p"))
    zero = F.lit(0).cast("long")
    entry = F.struct(F.col("turn.ts_ns").alias("ts_ns"), F.lit(ENTER).alias("kind"), zero.alias("ret"), F.col("turn.ord").alias("ord"))
    send = F.struct(F.col("p.ts_ns").alias("ts_ns"), F.lit(SEND).alias("kind"), zero.alias("ret"), F.col("p.ord").alias("ord"))
    held = F.when(F.col("kind") == SEND, F.array(entry, send)).otherwise(F.array(entry))
    return (
        last.where(F.col("turn.kind") == ENTER)
        .select("id", F.inline(held))
        .select("ts_ns", "id", "kind", "ret", "ord")
    )
