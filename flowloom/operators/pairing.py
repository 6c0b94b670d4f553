"""Pairing call entries, socket sends and exits into socket writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.config import ROWS_PER_TASK
from flowloom.operators.splits import CHUNK, Splits, find_splits

# The probe kinds of the log.
ENTER, SEND, EXIT = "enter", "sock_sendmsg", "exit"


def keep_target_enters(log: DataFrame, pid: int | None) -> DataFrame:
    """Entries of other processes open nothing; sends and exits always count."""
    if pid is None:
        return log
    return log.where((F.col("kind") != ENTER) | (F.shiftright("id", 32) == pid))


def pair_socket_writes(
    log: DataFrame,
    pid: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    splits: Splits | None = None,
) -> DataFrame:
    """STF-02: one row per write call that reached a socket.

    Per thread id an exit emits its size if the latest entry or exit before it
    was an entry, and a send came after that entry - which is the case exactly
    when the row before the exit is a send.  Two running lookups therefore
    suffice; at the cuts of a hot thread they take over from the chunks before.
    """
    rows = keep_target_enters(log.where(F.col("kind").isin(ENTER, SEND, EXIT)), pid)
    if splits is None:
        splits = find_splits(log, ("id",), "ts_ns", "ord", rows_per_task)
    cut = splits.attach(rows)
    turn = F.when(F.col("kind") != SEND, F.col("kind"))
    line = Window.partitionBy("id", CHUNK).orderBy("ts_ns", "ord")
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    seen = cut.withColumn("_before", F.lag("kind").over(line)).withColumn(
        "_state", F.last(turn, ignorenulls=True).over(earlier)
    )
    if not splits.trivial:
        place = F.struct("ts_ns", "ord")
        chunks = Window.partitionBy("id").orderBy(CHUNK)
        carried = (
            cut.where(F.col(CHUNK) > 0)
            .groupBy("id", CHUNK)
            .agg(
                F.max_by("kind", place).alias("k"),
                F.max_by(turn, F.when(turn.isNotNull(), place)).alias("t"),
            )
            .select(
                "id",
                CHUNK,
                F.lag("k").over(chunks).alias("_k"),
                F.last("t", ignorenulls=True).over(chunks.rowsBetween(Window.unboundedPreceding, -1)).alias("_t"),
            )
        )
        # one row per cut
        seen = seen.join(F.broadcast(carried), ["id", CHUNK], "left")
        seen = seen.withColumn("_before", F.coalesce("_before", "_k")).withColumn(
            "_state", F.coalesce("_state", "_t")
        )
    return seen.where(
        (F.col("kind") == EXIT) & (F.col("_before") == SEND) & (F.col("_state") == ENTER)
    ).select("id", "ts_ns", F.col("ret").alias("size"), "ord")
