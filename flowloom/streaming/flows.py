"""Streaming flows and byte counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators.counters import byte_moves
from flowloom.operators.flows import to_flow_key
from flowloom.schemas import FLOW_KEY
from flowloom.sources.readers import parse_capture_text


def packet_stream(lines: DataFrame) -> DataFrame:
    """STR-01: a stream of capture lines as packets (stateless; append)."""
    return parse_capture_text(lines)


def flow_stream(
    packets: DataFrame, gap_us: int, watermark: str = "10 minutes", carry: Sequence[str] = ()
) -> DataFrame:
    """STR-02: flows of a packet stream by session windows.

    Window times are microseconds: gaps that differ from the limit by less than
    one microsecond may be judged otherwise than in the batch operator.  In
    append mode a flow is written once the watermark has passed its end by the
    gap; later packets for it are dropped, so the watermark delay must cover
    the disorder of the source.  Columns named in ``carry`` are those of the first packet.
    """
    keyed = to_flow_key(packets, carry).withColumn("event_time", F.timestamp_micros(F.expr("ts_ns div 1000")))
    place = F.struct("ts_ns", "ord")
    session = F.session_window("event_time", f"{gap_us} microseconds")
    return (
        keyed.withWatermark("event_time", watermark)
        .groupBy(*FLOW_KEY, session.alias("session"))
        .agg(
            F.min_by("ts_raw", place).alias("start_time"),
            F.max_by("ts_raw", place).alias("end_time"),
            F.min("ts_ns").alias("start_ts_ns"),
            F.max("ts_ns").alias("end_ts_ns"),
            F.count(F.lit(1)).alias("packet_count"),
            F.sum("size").alias("total_size"),
            *[F.min_by(c, place).alias(c) for c in carry],
        )
        .drop("session")
    )


def counter_stream(packets: DataFrame) -> DataFrame:
    """STR-04: bytes in and out of every address so far (update or complete mode)."""
    return (
        byte_moves(packets, None)
        .groupBy("ip")
        .agg(F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"))
    )
