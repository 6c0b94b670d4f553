"""Process and system snapshots logged from the proc file system."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.scalars import kb_to_bytes

# Which field of which file gives each feature.
STATUS_FIELDS = {"vmsize_bytes": "VmSize", "vmrss_bytes": "VmRSS", "vmdata_bytes": "VmData"}
IO_FIELDS = {"disk_read_bytes": "read_bytes", "disk_write_bytes": "write_bytes"}
# Positions counted from 0 after the closing bracket of the command name.
STAT_FIELDS = {"utime_ticks": 11, "stime_ticks": 12}
SNAPSHOT_FEATURES = (*STAT_FIELDS, *STATUS_FIELDS, *IO_FIELDS)


def _of(file: str, value: Column) -> Column:
    return F.max(F.when(F.col("file") == file, value))


def _line_word(content: Column, field: str) -> Column:
    """The word that follows ``field:`` at the start of a line, else null.

    Plain string cutting: a pattern search would cost several times as much.
    """
    lines = F.concat(F.lit("\n"), content)
    mark = f"\n{field}:"
    rest = F.substring_index(F.substring_index(lines, mark, -1), "\n", 1)
    word = F.substring_index(F.ltrim(F.translate(rest, "\t", " ")), " ", 1)
    return F.when(F.contains(lines, F.lit(mark)), word)


def _line_number(content: Column, field: str) -> Column:
    word = _line_word(content, field)
    return F.when(word.rlike(r"^\d+$"), word.try_cast("bigint"))


def _features(content: Column) -> dict[str, dict[str, Column]]:
    """By file, the features read from its content."""
    words = F.split(F.trim(F.substring_index(content, ")", -1)), r"\s+")
    return {
        "stat": {name: F.get(words, F.lit(at)).try_cast("bigint") for name, at in STAT_FIELDS.items()},
        "status": {name: kb_to_bytes(_line_word(content, field)) for name, field in STATUS_FIELDS.items()},
        "io": {name: _line_number(content, field) for name, field in IO_FIELDS.items()},
    }


def file_features(log: DataFrame) -> DataFrame:
    """SRC-13 file by file: ``ts_ns, pid, feature, value`` of each logged file by itself.

    Fields that a file lacks are 0; a file that is not there gives no rows, so the
    files of a snapshot may come apart.  No grouping, hence no shuffle.
    """
    listed = None
    for file, fields in _features(F.col("content")).items():
        values = [
            F.struct(F.lit(name).alias("feature"), F.coalesce(value, F.lit(0)).cast("double").alias("value"))
            for name, value in fields.items()
        ]
        held = F.col("file") == file
        listed = F.when(held, F.array(*values)) if listed is None else listed.when(held, F.array(*values))
    return log.select("ts_ns", "pid", F.inline(listed))


def parse_proc_snapshots(log: DataFrame, keys: Sequence[str] = ("ts_ns", "pid")) -> DataFrame:
    """SRC-13: logged (ts_ns, pid, file, content) to one wide row per (time, pid).

    Where a log may hold several snapshots of a process at one time, ``keys`` also names the column that tells them apart.
    A process without a readable stat file has ticks 0; absent memory or I/O
    fields are 0 as well.
    """
    columns = [
        F.coalesce(_of(file, value), F.lit(0)).alias(name)
        for file, fields in _features(F.col("content")).items()
        for name, value in fields.items()
    ]
    processes = log.where(F.col("file").isin("stat", "status", "io"))
    return processes.groupBy(*keys).agg(*columns)


def parse_memavailable(log: DataFrame) -> DataFrame:
    """SRC-13: the system-wide available memory of each meminfo snapshot."""
    return log.where(F.col("file") == "meminfo").select(
        "ts_ns", kb_to_bytes(_line_word(F.col("content"), "MemAvailable")).cast("double").alias("value")
    )
