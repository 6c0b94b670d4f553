"""Probe events: record names, routing, allocation and collective sizes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.config import ROWS_PER_TASK
from flowloom.functions.scalars import collective_bytes, mono_to_epoch
from flowloom.operators.interval import interval_accumulate

# The record each probe writes.
PROBE_RECORD = {
    "cuda_mem": "cuda_allocations",
    "cpu_mem": "cpu_allocations",
    "nccl_mem": "cuda_collective",
    "kcache": "kcache",
    "sendmsg": "sendmsg",
    "sendto": "sendto",
    "tcpsendmsg": "tcpsendmsg",
    "write": "write",
}
SAMPLED_RECORDS = ("cuda_allocations", "cpu_allocations", "cuda_collective")
DIRECT_RECORDS = ("kcache", "sendmsg", "sendto", "tcpsendmsg", "write")
GPU_RECORDS = ("cuda_allocations", "cuda_collective")
SYSTEM_WIDE_RECORDS = ("cuda_allocations",)


def to_epoch(log: DataFrame, offset_ns: int) -> DataFrame:
    """SCL-03: a probe log whose times are of a monotonic clock, in epoch time."""
    return log.withColumn("ts_ns", mono_to_epoch(F.col("ts_ns"), offset_ns))


def cache_alloc_events(allocations: DataFrame, pid: int) -> DataFrame:
    """STF-03: one sample per kernel cache allocation of the process."""
    return allocations.where(F.shiftright("id", 32) == pid).select(
        F.lit(str(pid)).alias("pid"), "ts_ns", F.col("object_size").cast("bigint").alias("size")
    )


def collective_events(calls: DataFrame) -> DataFrame:
    """STF-04: collective calls as sized events, ready for interval sums."""
    keep = [c for c in calls.columns if c not in ("count", "dtype")]
    return calls.select(*keep, collective_bytes(F.col("count"), F.col("dtype")).cast("bigint").alias("size"))


def probes_of(records: Iterable[str]) -> list[str]:
    """The probes that write the given records."""
    wanted = set(records)
    return [probe for probe, record in PROBE_RECORD.items() if record in wanted]


def name_records(events: DataFrame, records: Iterable[str] = tuple(PROBE_RECORD.values())) -> DataFrame:
    """STF-05: the record a probe writes; events of other probes drop out.

    Rows are chosen by probe, so the choice can be pushed to the scan.
    """
    names = F.create_map(*[F.lit(word) for pair in PROBE_RECORD.items() for word in pair])
    return events.where(F.col("probe").isin(probes_of(records))).withColumn("record", names[F.col("probe")])


def record_kinds(gpu: bool) -> tuple[list[str], list[str], list[str]]:
    """The records that pass straight, those summed per pid, and those summed over the system."""
    wanted = [r for r in PROBE_RECORD.values() if gpu or r not in GPU_RECORDS]
    shared = [r for r in wanted if r in SYSTEM_WIDE_RECORDS]
    owned = [r for r in wanted if r in SAMPLED_RECORDS and r not in SYSTEM_WIDE_RECORDS]
    return [r for r in wanted if r in DIRECT_RECORDS], owned, shared


def route_records(
    events: DataFrame,
    pids: DataFrame,
    interval_ns: int = 500_000,
    gpu: bool = False,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """STF-05: probe events to one series per (record, pid).

    ``events`` has probe, pid, ts_ns, size, ord.  Allocation, copy and
    collective sizes are summed per interval; the rest pass straight through.
    System-wide probes are summed once and then copied to every pid.
    """
    direct, own, shared = record_kinds(gpu)
    traced = pids.select(F.col("pid").cast("string"))

    def owned(records: Iterable[str]) -> DataFrame:
        rows = name_records(events, records).withColumn("pid", F.col("pid").cast("string"))
        return rows.join(traced, "pid", "left_semi")

    columns = ["record", "pid", "ts_ns", "size", "ord"]
    straight = owned(direct)
    summed = owned(own).select(*columns)
    if shared:
        # an empty pid stands for the system: unlike null it is a key, so that a hot one can be cut
        everywhere = name_records(events, shared).withColumn("pid", F.lit(""))
        summed = summed.unionByName(everywhere.select(*columns))
    totals = interval_accumulate(summed, interval_ns, ("record", "pid"), rows_per_task=rows_per_task)
    listed = traced.agg(F.collect_set("pid").alias("p")).scalar()
    copied = totals.withColumn(
        "pid", F.explode(F.when(F.col("pid") != "", F.array("pid")).otherwise(listed))
    )
    return straight.select("record", "pid", "ts_ns", "size").unionByName(copied.select("record", "pid", "ts_ns", "size"))
