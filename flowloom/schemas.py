"""Column layouts of the tables that pass between stages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _struct(*pairs):
    return StructType([StructField(name, kind) for name, kind in pairs])


# Column names and order of the packet and flow tables.
PACKET = _struct(
    ("ts_ns", LongType()),
    ("timestamp_epoch_s", StringType()),
    ("source_ip", StringType()),
    ("source_port", IntegerType()),
    ("destination_ip", StringType()),
    ("destination_port", IntegerType()),
    ("packet_size", LongType()),
)

FLOW = _struct(
    ("flow_id", LongType()),
    ("src_ip", StringType()),
    ("src_port", IntegerType()),
    ("dst_ip", StringType()),
    ("dst_port", IntegerType()),
    ("start_time", StringType()),
    ("end_time", StringType()),
    ("start_ts_ns", LongType()),
    ("packet_count", LongType()),
    ("total_size", LongType()),
    ("gap_us", LongType()),
    ("neworkin", LongType()),
    ("neworkout", LongType()),
)

# Long form of every metric or event timeline; pid is null for a system-wide series.
SERIES = _struct(
    ("pid", StringType()),
    ("feature", StringType()),
    ("ts_ns", LongType()),
    ("value", DoubleType()),
)

QA_DOCUMENT = StructType(
    [
        StructField(
            "data",
            _struct(
                ("title", StringType()),
                (
                    "paragraphs",
                    ArrayType(
                        _struct(
                            ("context", StringType()),
                            (
                                "qas",
                                ArrayType(
                                    _struct(
                                        ("question", StringType()),
                                        ("answers", ArrayType(_struct(("text", StringType())))),
                                    )
                                ),
                            ),
                        )
                    ),
                ),
            ),
        )
    ]
)

FLOW_KEY = ("src_ip", "src_port", "dst_ip", "dst_port")
FLOW_COLUMNS = tuple(FLOW.names)


def require_columns(df: DataFrame, names: Iterable[str], what: str = "input") -> DataFrame:
    """FLT-08: fail, naming what is missing; looks at the schema only, no job."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing columns: {', '.join(sorted(missing))}")
    return df
