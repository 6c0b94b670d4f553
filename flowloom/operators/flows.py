"""Packets to flows: gap sessionizing, aggregation and numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.config import ROWS_PER_TASK
from flowloom.operators.splits import CHUNK, Splits, find_splits
from flowloom.schemas import FLOW_KEY, require_columns

_PARTIAL = (
    "start_ts_ns",
    "end_ts_ns",
    "start_time",
    "end_time",
    "packet_count",
    "total_size",
    "gap_ns",
    "first_ord",
    "key_ord",
)


def to_flow_key(packets: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Rename packet columns to the names flows use; ``ord`` is the file position.

    Columns named in ``carry`` stay.
    """
    require_columns(
        packets,
        ["ts_ns", "source_ip", "source_port", "destination_ip", "destination_port", "packet_size", "ord"],
        "packets",
    )
    raw = F.col("timestamp_epoch_s") if "timestamp_epoch_s" in packets.columns else F.lit("")
    return packets.select(
        F.col("source_ip").alias("src_ip"),
        F.col("source_port").alias("src_port"),
        F.col("destination_ip").alias("dst_ip"),
        F.col("destination_port").alias("dst_port"),
        "ts_ns",
        "ord",
        raw.alias("ts_raw"),
        F.col("packet_size").alias("size"),
        *carry,
    )


def _close_runs(df: DataFrame, part: list[str], order: list[str], gap_ns: int) -> DataFrame:
    """Merge consecutive pieces closer than the gap; one output row per run.

    Input pieces carry start and end, counts and sizes.  A run is emitted at
    its last piece, from running totals, so a single sort serves everything and
    no second aggregation is needed.
    """
    line = Window.partitionBy(*part).orderBy(*order)
    running = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    apart = F.col("start_ts_ns") - F.col("_prev_end")
    opened = (
        df.withColumn("_prev_end", F.lag("end_ts_ns").over(line))
        .withColumn("_next_start", F.lead("start_ts_ns").over(line))
        .withColumn("key_ord", F.min("key_ord").over(whole))
        .withColumn("_packets", F.sum("packet_count").over(running))
        .withColumn("_bytes", F.sum("total_size").over(running))
        .withColumn("_opens", F.col("_prev_end").isNull() | (apart > gap_ns))
        .withColumn(
            "_closes",
            F.col("_next_start").isNull() | (F.col("_next_start") - F.col("end_ts_ns") > gap_ns),
        )
    )
    head = F.struct(
        "start_ts_ns",
        "start_time",
        "first_ord",
        F.coalesce(F.col("gap_ns"), apart).alias("gap_ns"),
        F.col("_prev_end").isNull().alias("first"),
        (F.col("_packets") - F.col("packet_count")).alias("packets"),
        (F.col("_bytes") - F.col("total_size")).alias("bytes"),
    )
    return (
        opened.withColumn("_head", F.last(F.when(F.col("_opens"), head), ignorenulls=True).over(running))
        .where("_closes")
        .select(
            *part,
            F.col("_head.start_ts_ns").alias("start_ts_ns"),
            "end_ts_ns",
            F.col("_head.start_time").alias("start_time"),
            "end_time",
            (F.col("_packets") - F.col("_head.packets")).alias("packet_count"),
            (F.col("_bytes") - F.col("_head.bytes")).alias("total_size"),
            F.col("_head.gap_ns").alias("gap_ns"),
            F.col("_head.first_ord").alias("first_ord"),
            "key_ord",
            F.col("_head.first").alias("_is_first"),
            F.col("_next_start").isNull().alias("_is_last"),
        )
    )


def packet_splits(packets: DataFrame, rows_per_task: int) -> Splits:
    return find_splits(to_flow_key(packets), FLOW_KEY, "ts_ns", "ord", rows_per_task)


def flow_aggregate(
    packets: DataFrame,
    gap_us: int,
    rows_per_task: int = ROWS_PER_TASK,
    splits: Splits | None = None,
) -> DataFrame:
    """WIN-01, AGG-01, WIN-02: one row per flow.

    A flow is a run of packets of one directional 4-tuple in which no
    neighbours are more than ``gap_us`` apart.  Packets are shuffled once, on
    (4-tuple, chunk).  Where a hot 4-tuple was cut, the first and last runs of
    its chunks - and only those - meet again in a second, small pass.
    """
    gap_ns = gap_us * 1000
    keyed = to_flow_key(packets)
    if splits is None:
        splits = find_splits(keyed, FLOW_KEY, "ts_ns", "ord", rows_per_task)
    pieces = splits.attach(keyed).select(
        *FLOW_KEY,
        CHUNK,
        F.col("ts_ns").alias("start_ts_ns"),
        F.col("ts_ns").alias("end_ts_ns"),
        F.col("ts_raw").alias("start_time"),
        F.col("ts_raw").alias("end_time"),
        F.lit(1).cast("long").alias("packet_count"),
        F.col("size").alias("total_size"),
        F.lit(None).cast("long").alias("gap_ns"),
        F.col("ord").alias("first_ord"),
        F.col("ord").alias("key_ord"),
    )
    runs = _close_runs(pieces, [*FLOW_KEY, CHUNK], ["start_ts_ns", "first_ord"], gap_ns)
    if not splits.trivial:
        # ordinary keys and inner runs keep to themselves; border runs of a key share lane -1
        border = (F.col(CHUNK) > 0) & (F.col("_is_first") | F.col("_is_last"))
        lanes = runs.select(
            *FLOW_KEY, F.when(border, F.lit(-1)).otherwise(F.col(CHUNK)).cast("long").alias("_lane"), *_PARTIAL
        )
        runs = _close_runs(lanes, [*FLOW_KEY, "_lane"], ["start_ts_ns", "first_ord"], gap_ns)
        runs = _hot_key_positions(runs, keyed, splits)
    return runs.select(
        *FLOW_KEY,
        "start_time",
        "end_time",
        "start_ts_ns",
        "end_ts_ns",
        "packet_count",
        "total_size",
        F.coalesce(F.expr("gap_ns div 1000"), F.lit(0)).cast("long").alias("gap_us"),
        "key_ord",
    )


def _hot_key_positions(runs: DataFrame, keyed: DataFrame, splits: Splits) -> DataFrame:
    """First file position of the keys whose rows were spread over chunks."""
    hot = F.broadcast(splits.hot_keys(keyed).select(*FLOW_KEY))
    firsts = keyed.join(hot, list(FLOW_KEY), "left_semi").groupBy(*FLOW_KEY).agg(F.min("ord").alias("_hot_ord"))
    # one row per hot key
    return (
        runs.join(F.broadcast(firsts), list(FLOW_KEY), "left")
        .withColumn("key_ord", F.coalesce("_hot_ord", "key_ord"))
        .drop("_hot_ord")
    )


def number_flows(flows: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """WIN-05: dense ``flow_id``, 4-tuples by first appearance, then by time."""
    own = [c for c in flows.columns if c != "key_ord"]
    return dense_number(flows, "flow_id", "key_ord", "start_ts_ns", rows_per_task).select("flow_id", *own)


def dense_number(
    df: DataFrame, name: str, first: str, second: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Number rows 0.. by (first, second), both integral, without a global window."""
    splits = find_splits(df, (), first, second, rows_per_task)
    chunked = splits.attach(df)
    line = Window.partitionBy(CHUNK).orderBy(first, second)
    numbered = chunked.withColumn("_i", F.row_number().over(line))
    if splits.trivial:
        return numbered.select((F.col("_i") - 1).cast("long").alias(name), *df.columns)
    counts = chunked.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    # one row per chunk, so this running total stays small however large the table is
    total = Window.partitionBy("_all").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counts.withColumn("_all", F.col("_n") * 0)
        .withColumn("_before", F.coalesce(F.sum("_n").over(total), F.lit(0)))
        .select(CHUNK, "_before")
    )
    numbered = numbered.join(F.broadcast(offsets), CHUNK)
    return numbered.select((F.col("_before") + F.col("_i") - 1).cast("long").alias(name), *df.columns)
