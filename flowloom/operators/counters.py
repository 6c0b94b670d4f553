"""Cumulative byte counters and their value just before each flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.config import ROWS_PER_TASK
from flowloom.operators.splits import CHUNK, Splits, copy_to_salts, find_splits, spread


def byte_moves(packets: DataFrame, vantage_ip: str | None) -> DataFrame:
    """Each packet as bytes entering and leaving an address.

    With a vantage address only its own traffic is kept, one row per packet;
    without one, every packet counts once for either end.
    """
    src, dst, size = F.col("source_ip"), F.col("destination_ip"), F.col("packet_size")
    zero = F.lit(0).cast("long")
    if vantage_ip:
        here = F.lit(vantage_ip)
        return packets.where((src == here) | (dst == here)).select(
            here.alias("ip"),
            "ts_ns",
            F.when(dst == here, size).otherwise(zero).alias("bytes_in"),
            F.when(src == here, size).otherwise(zero).alias("bytes_out"),
        )
    ends = F.array(
        F.struct(src.alias("ip"), zero.alias("bytes_in"), size.alias("bytes_out")),
        F.struct(dst.alias("ip"), size.alias("bytes_in"), zero.alias("bytes_out")),
    )
    return packets.select("ts_ns", F.inline(ends)).select("ip", "ts_ns", "bytes_in", "bytes_out")


def running_bytes(packets: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """AGG-02: bytes in and out of every address up to and including each instant.

    Rows are first summed per (address, instant), so the frame is a plain running
    sum; hot addresses are cut along time and get the totals of earlier chunks.
    """
    moves = byte_moves(packets, None)
    splits = find_splits(moves, ("ip",), "ts_ns", None, rows_per_task)
    steps = splits.attach(moves).groupBy("ip", CHUNK, "ts_ns").agg(
        F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out")
    )
    line = Window.partitionBy("ip", CHUNK).orderBy("ts_ns").rowsBetween(Window.unboundedPreceding, 0)
    local = steps.select(
        "ip",
        CHUNK,
        "ts_ns",
        F.sum("bytes_in").over(line).alias("in_cum"),
        F.sum("bytes_out").over(line).alias("out_cum"),
    )
    if not splits.trivial:
        early = Window.partitionBy("ip").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        carried = (
            splits.attach(moves)
            .where(F.col(CHUNK) > 0)
            .groupBy("ip", CHUNK)
            .agg(F.sum("bytes_in").alias("i"), F.sum("bytes_out").alias("o"))
            .select("ip", CHUNK, F.sum("i").over(early).alias("_in"), F.sum("o").over(early).alias("_out"))
        )
        # one row per cut: safe to broadcast
        local = local.join(F.broadcast(carried), ["ip", CHUNK], "left").select(
            "ip",
            "ts_ns",
            (F.col("in_cum") + F.coalesce(F.col("_in"), F.lit(0))).alias("in_cum"),
            (F.col("out_cum") + F.coalesce(F.col("_out"), F.lit(0))).alias("out_cum"),
        )
    return local.select("ip", "ts_ns", "in_cum", "out_cum")


def counter_splits(packets: DataFrame, vantage_ip: str | None, rows_per_task: int = ROWS_PER_TASK) -> Splits:
    """Cuts per address.  Flow starts are packet times, so packets stand for both sides."""
    if vantage_ip:
        # a single address: its whole time line is what needs cutting
        return find_splits(packets.select("ts_ns"), (), "ts_ns", None, rows_per_task)
    basis = byte_moves(packets, None).select("ip", "ts_ns")
    return find_splits(basis, ("ip",), "ts_ns", None, rows_per_task)


def asof_strict(
    flows: DataFrame,
    packets: DataFrame,
    vantage_ip: str | None,
    rows_per_task: int = ROWS_PER_TASK,
    splits: Splits | None = None,
) -> DataFrame:
    """JON-03: bytes in and out of the vantage strictly before each flow starts.

    Probes (flows) and moves (packets) meet in one shuffle on (address, chunk).
    The totals of earlier chunks enter each chunk as one more move at its front.
    Flows of other columns travel along as a struct and come out unchanged.
    """
    moves = byte_moves(packets, vantage_ip)
    ref = F.lit(vantage_ip) if vantage_ip else F.col("src_ip")
    probes = flows.select(
        ref.alias("ip"), F.col("start_ts_ns").alias("ts_ns"), F.struct(*flows.columns).alias("_flow")
    )
    if splits is None:
        splits = counter_splits(packets, vantage_ip, rows_per_task)
    cut_moves = splits.attach(moves)
    if splits.heavy:
        # one instant holds more packets than a task should: sum it before the shuffle
        cut_moves = cut_moves.groupBy("ip", CHUNK, "ts_ns").agg(
            F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out")
        )
    lines = cut_moves.select("ip", CHUNK, "ts_ns", "bytes_in", "bytes_out")
    if not splits.trivial:
        lines = lines.unionByName(_carry_forward(cut_moves, splits))
    both = copy_to_salts(lines, splits).unionByName(
        spread(splits.attach(probes), splits, by=["_flow"]), allowMissingColumns=True
    )
    # a probe precedes the moves of its own instant: they are not yet counted
    line = (
        Window.partitionBy("ip", CHUNK, "_salt")
        .orderBy(F.col("ts_ns").asc_nulls_first(), F.col("_flow").isNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        both.withColumn("neworkin", F.coalesce(F.sum("bytes_in").over(line), F.lit(0)))
        .withColumn("neworkout", F.coalesce(F.sum("bytes_out").over(line), F.lit(0)))
        .where(F.col("_flow").isNotNull())
        .select("_flow.*", "neworkin", "neworkout")
    )


def _carry_forward(cut_moves: DataFrame, splits: Splits) -> DataFrame:
    """Running totals placed at the front of every later chunk of the address."""
    by_ip = Window.partitionBy("ip").orderBy(CHUNK)
    upto = by_ip.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = (
        cut_moves.where(F.col(CHUNK) > 0)
        .groupBy("ip", CHUNK)
        .agg(F.sum("bytes_in").alias("i"), F.sum("bytes_out").alias("o"))
        .withColumn("bytes_in", F.sum("i").over(upto))
        .withColumn("bytes_out", F.sum("o").over(upto))
        .withColumn("_next", F.lead(CHUNK).over(by_ip))
    )
    if splits.keys:
        # one row per hot address
        totals = totals.join(F.broadcast(splits.hot_keys(cut_moves).select("ip", "_last")), "ip")
    else:
        totals = totals.withColumn("_last", F.lit(splits.last_chunk).cast("long"))
    totals = totals.withColumn("_until", F.coalesce("_next", "_last")).where(F.col("_until") > F.col(CHUNK))
    return totals.select(
        "ip",
        F.explode(F.sequence(F.col(CHUNK) + 1, F.col("_until"))).alias(CHUNK),
        F.lit(None).cast("long").alias("ts_ns"),
        "bytes_in",
        "bytes_out",
    )
