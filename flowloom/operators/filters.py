"""Row filters over packets, probe events and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.events import GPU_RECORDS

# The excluded port, and the smallest send that counts less one.
SSH_PORT = 22
SMALL_SEND = 32


def payload_filter(packets: DataFrame) -> DataFrame:
    """FLT-01: TCP packets that carry data and do not touch the SSH port.

    Raw headers (``proto, ip_len, ip_hl, tcp_off``; lengths in words) are used
    where present; on parsed packets the size column is the payload.
    """
    if "tcp_off" in packets.columns:
        payload = F.col("ip_len") - F.col("ip_hl") * 4 - F.col("tcp_off") * 4
        kept = packets.where((F.col("proto") == "tcp") & (payload > 0))
    else:
        kept = packets.where(F.col("packet_size") > 0)
    return kept.where((F.col("source_port") != SSH_PORT) & (F.col("destination_port") != SSH_PORT))


def owner_pid(id_column: str = "id") -> Column:
    """Process id in the upper half of a combined process/thread id."""
    return F.shiftright(F.col(id_column), 32)


def pid_filter(events: DataFrame, pid: int, id_column: str = "id") -> DataFrame:
    """FLT-02: events of one process."""
    return events.where(owner_pid(id_column) == pid)


def pid_set_semi(df: DataFrame, pids: DataFrame, own_pid: int | None = None) -> DataFrame:
    """JON-06: rows of the listed pids, leaving out the collector itself."""
    if own_pid is not None:
        df = df.where(F.col("pid").cast("bigint") != own_pid)
    return df.join(pids.select(F.col("pid").cast(df.schema["pid"].dataType)), "pid", "left_semi")


def send_size_filter(events: DataFrame, size: str = "size") -> DataFrame:
    """FLT-03: sends of more than 32 bytes; failed calls are negative and go too."""
    return events.where(F.col(size) > SMALL_SEND)


def feature_allowlist(series: DataFrame, features: Sequence[str]) -> DataFrame:
    """FLT-04: only the configured features."""
    return series.where(F.col("feature").isin(list(features)))


def gpu_toggle(events: DataFrame, enabled: bool) -> DataFrame:
    """FLT-05: drop the GPU and collective records unless they are wanted."""
    return events if enabled else events.where(~F.col("record").isin(list(GPU_RECORDS)))


def valid_labels(points: DataFrame, label: str = "label") -> DataFrame:
    """FLT-07: raise unless every label is 0 or 1 (one aggregate job)."""
    bad = points.agg(F.count_if(~F.coalesce(F.col(label).isin(0, 1), F.lit(False)))).first()[0]
    if bad:
        raise ValueError(f"{bad} labels are neither 0 nor 1")
    return points
