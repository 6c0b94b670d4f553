"""Scalar column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A decimal number, and an integer, as the series files write them.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INTEGER = r"^[+-]?\d+$"

# Bytes per element of each collective data type code; other codes count 1.
DTYPE_WIDTH = {0: 1, 1: 4, 2: 4, 3: 8, 4: 8, 5: 2}


def epoch_s_to_ns(seconds: Column) -> Column:
    """SCL-01: seconds (text or double) to nanoseconds by way of a double, truncated."""
    return (seconds.cast("double") * F.lit(1_000_000_000)).cast("bigint")


def epoch_s_text(seconds: Column) -> Column:
    """SCL-02: seconds with six decimals."""
    return F.format_string("%.6f", seconds.cast("double"))


def mono_to_epoch(ts_ns: Column, offset_ns: int) -> Column:
    """SCL-03: shift a monotonic clock reading to the epoch."""
    return ts_ns + F.lit(offset_ns).cast("bigint")


def series_file_feature(name: Column) -> Column:
    """SCL-04: the part of a series file name before its first ``_pid``."""
    return F.regexp_extract(name, r"^(.*?)_pid(.+)\.csv$", 1)


def series_file_pid(name: Column) -> Column:
    """SCL-04: the pid part of a series file name, stripped."""
    return strip(F.regexp_extract(name, r"^(.*?)_pid(.+)\.csv$", 2))


def tolerant_int(text: Column) -> Column:
    """SCL-05: an integer, or null."""
    trimmed = strip(text)
    return F.when(trimmed.rlike(INTEGER), trimmed.try_cast("bigint"))


def tolerant_number(text: Column) -> Column:
    """SCL-05: a finite decimal number, or null; refuses nan, inf and suffixes."""
    trimmed = strip(text)
    return F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double"))


def render_number(value: Column) -> Column:
    """SCL-06: whole values as integers, others with six decimals; for text sinks."""
    whole = F.format_string("%.0f", value)
    return F.when(value.isNull(), F.lit(None)).when(value == F.floor(value), whole).otherwise(
        F.format_string("%.6f", value)
    )


def kb_to_bytes(text: Column) -> Column:
    """SCL-08: a count of kB to bytes; absent or not all digits gives 0."""
    return F.coalesce(F.when(text.rlike(r"^\d+$"), text.try_cast("bigint")), F.lit(0)) * 1024


def collective_bytes(count: Column, dtype: Column) -> Column:
    """SCL-09: bytes moved by a collective, from element count and type code."""
    width = F.lit(1)
    for code, size in DTYPE_WIDTH.items():
        width = F.when(dtype == code, F.lit(size)).otherwise(width)
    return count * width


def strip(text: Column) -> Column:
    """SCL-14: drop white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def svm_score(features: Column, weights: list[float], intercept: float = 0.0, threshold: float | None = 0.0) -> Column:
    """SCL-19: margin of a linear model over an array column, or its 0/1 decision.

    ``threshold=None`` returns the raw margin; otherwise 1.0 strictly above it.
    """
    terms = F.zip_with(features, F.lit(list(map(float, weights))), lambda x, w: x * w)
    margin = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t) + F.lit(float(intercept))
    if threshold is None:
        return margin
    return F.when(margin > F.lit(float(threshold)), F.lit(1.0)).otherwise(F.lit(0.0))
