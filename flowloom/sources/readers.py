"""Readers for captures, series, stage tables, graphs, vectors and documents."""

from __future__ import annotations

import re
import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowloom.functions.scalars import (
    epoch_s_text,
    epoch_s_to_ns,
    series_file_feature,
    series_file_pid,
    strip,
    tolerant_int,
    tolerant_number,
)
from flowloom.schemas import PACKET, QA_DOCUMENT
from flowloom.sources import idx, tail

# One captured packet per line, and the header of a series file.
CAPTURE_LINE = (
    r"^(\d+\.\d+)\s+IP\s+"
    r"(\d+\.\d+\.\d+\.\d+)\.(\d+)\s+>\s+"
    r"(\d+\.\d+\.\d+\.\d+)\.(\d+):.*length\s+(\d+)"
)
GLOBAL_SERIES = "memavailable_bytes"
# Parts of a packet's place: files, splits of a file (in units of 4 MB), rows of a task.
FILE_BITS, SPLIT_BITS, ROW_BITS = 20, 18, 25
SPLIT_UNIT = 4 << 20
SIGNED_PID = r"^[+-]?\d+$"


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01: the packet CSV; a malformed number or another header raises.

    ``ord`` is the position among all files in the order of their paths; it orders packets of equal time.
    """
    rows = (
        spark.read.schema(PACKET)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return with_file_order(rows)


def with_file_order(rows: DataFrame) -> DataFrame:
    """Add ``ord``: rank of the file by path, then place of the row's split in it, then of the row in its split.

    Spark reads large files first and in splits, so the position in the scan is no order of files.
    The list of files is the one the driver already has.
    """
    # one file may be written with one slash after the scheme here and with three there
    files = sorted(re.sub("^([^/]*:)/+", r"\1/", f) for f in rows.inputFiles())
    path = F.regexp_replace("_metadata.file_path", "^([^/]*:)/+", "$1/")
    if len(files) >= 1 << FILE_BITS:
        raise ValueError(f"{len(files)} files; their order is kept for fewer than {1 << FILE_BITS}")
    found = rows.select(
        "*", F.expr(f"_metadata.file_block_start div {SPLIT_UNIT}").alias("_split"), path.alias("_path")
    )
    if len(files) > 1:
        ranks = rows.sparkSession.createDataFrame(list(enumerate(files)), "_file long, _path string")
        found = found.join(F.broadcast(ranks), "_path", "left")
    else:
        found = found.withColumn("_file", F.lit(0).cast("long"))
    # ids grow within a split, and a task reads few enough rows for the bits left to it
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    known = F.coalesce("_file", F.raise_error(F.lit("a file that was not listed")).cast("long"))
    place = F.shiftleft(F.shiftleft(known, SPLIT_BITS) + F.col("_split"), ROW_BITS) + row
    return found.select(*rows.columns, place.alias("ord"))


def stream_packets(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """SRC-01 as a stream over packet CSV files arriving in a folder.

    Another header raises, as in batch.  ``ord`` is the time a packet's file arrived; streams
    number no rows, so packets of equal time within one file have no order.
    """
    rows = (
        spark.readStream.schema(PACKET)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .options(**options)
        .csv(path)
    )
    return rows.withColumn("ord", F.unix_micros("_metadata.file_modification_time"))


def parse_capture_text(lines: DataFrame, column: str = "value") -> DataFrame:
    """SRC-02: capture lines to packets; other lines drop out.

    Greedy matching takes the last ``length`` of a line.
    """
    text = F.col(column)
    rest = [c for c in lines.columns if c != column]
    # one match per line: the six parts, joined by blanks that none of them contains
    parts = F.split(F.regexp_replace(text, CAPTURE_LINE + ".*$", "$1 $2 $3 $4 $5 $6"), " ")
    found = lines.where(text.rlike(CAPTURE_LINE)).select(parts.alias("_parts"), *rest)

    def part(i: int):
        return F.col("_parts")[i]

    return found.select(
        epoch_s_to_ns(part(0)).alias("ts_ns"),
        epoch_s_text(part(0)).alias("timestamp_epoch_s"),
        part(1).alias("source_ip"),
        part(2).cast("int").alias("source_port"),
        part(3).alias("destination_ip"),
        part(4).cast("int").alias("destination_port"),
        part(5).cast("bigint").alias("packet_size"),
        *rest,
    )


def _text_rows(spark: SparkSession, path: str) -> DataFrame:
    """Every line of the files as its CSV fields, with file name and position."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"),
        F.monotonically_increasing_id().alias("ord"),
        (F.col("_metadata.file_block_start") == 0).alias("front"),
    )
    return lines.select(_fields("value").alias("fields"), "file", "path", "ord", "front")


def _fields(line: str) -> Column:
    """The CSV fields of a line; quotes are dropped, as no field of these files holds a comma."""
    return F.transform(F.split(F.replace(line, F.lit('"'), F.lit("")), ","), lambda x: F.trim(x))


def _text_pairs(rows: DataFrame) -> DataFrame:
    """The first two fields of rows without a header."""
    return rows.select(F.get("fields", F.lit(0)).alias("first"), F.get("fields", F.lit(1)).alias("second"), "file", "ord")


def _samples(pairs: DataFrame, kind: str, pid, feature) -> DataFrame:
    """Rows that parse, as long series; anything else is skipped."""
    return pairs.select(
        pid.alias("pid"),
        F.lit(kind).alias("kind"),
        feature.alias("feature"),
        tolerant_int(F.col("first")).alias("ts_ns"),
        tolerant_number(F.col("second")).alias("value"),
        "ord",
    ).transform(drop_malformed_samples)


def drop_malformed_samples(series: DataFrame) -> DataFrame:
    """FLT-06: keep samples whose time and value both parsed."""
    return series.where(F.col("ts_ns").isNotNull() & F.col("value").isNotNull())


def _named_for_pid(pairs: DataFrame) -> DataFrame:
    return (
        pairs.withColumn("_feature", series_file_feature(F.col("file")))
        .withColumn("_pid", series_file_pid(F.col("file")))
        .where((F.col("_pid") != "") & (F.col("file") != f"{GLOBAL_SERIES}.csv"))
    )


def _with_header(rows: DataFrame) -> DataFrame:
    """Rows below a header that names ``ts_ns`` and ``value``, at whatever places.

    The header is a file's first line; files without those names give no rows.  The
    list of headers holds one row per file and is joined by size, so it is broadcast
    only when AQE has seen that it is small.
    """
    first = rows.where("front").groupBy("path").agg(F.min(F.struct("ord", "fields")).alias("top"))
    headers = first.select("path", F.col("top.ord").alias("head"), F.col("top.fields").alias("names"))
    return _named_fields(rows.join(headers, "path").where("ord <> head"))


def _named_fields(rows: DataFrame) -> DataFrame:
    """Time and value of rows whose file names both in its header (``names``), at whatever places."""
    at = lambda name: F.array_position("names", name).cast("int")
    below = rows.withColumns({"time": at("ts_ns"), "held": at("value")}).where("time > 0 and held > 0")
    return below.select(
        F.get("fields", F.col("time") - 1).alias("first"), F.get("fields", F.col("held") - 1).alias("second"), "file", "ord"
    )


def _growing_rows(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """Lines of series files as they come, as CSV fields; ``ord`` is where a line begins in its file."""
    spark.dataSource.register(tail.GrowingLines)
    lines = spark.readStream.format(tail.FORMAT).options(pattern="*_pid*.csv", **options).load(folder)
    return lines.select(_fields("value").alias("fields"), _fields("head").alias("names"), "file", F.col("place").alias("ord"))


def stream_polled(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """SRC-03 as a stream: the lines that come to ``<feature>_pid<PID>.csv`` files of a folder.

    Files may appear late and grow while they are read; each keeps its own header, which is read again
    from its first line.  A last line without a line break waits for it.  A file that shrinks
    raises.  ``ord`` orders the samples of one file.
    """
    rows = _growing_rows(spark, folder, **options).where("ord > 0")
    return _samples(_named_for_pid(_named_fields(rows)), "polled", F.col("_pid"), F.col("_feature"))


def stream_events(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """SRC-05 as a stream: the lines that come to headerless event files of a folder, as above."""
    pairs = _named_for_pid(_text_pairs(_growing_rows(spark, folder, **options)))
    return _samples(pairs, "event", F.col("_pid"), F.col("_feature"))


def read_polled(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-03: every ``<feature>_pid<PID>.csv`` below a folder as long series."""
    pairs = _named_for_pid(_with_header(_text_rows(spark, f"{folder}/*_pid*.csv")))
    return _samples(pairs, "polled", F.col("_pid"), F.col("_feature"))


def read_global_series(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-04: the system-wide series, pid null; no rows if the file is absent."""
    try:
        pairs = _with_header(_text_rows(spark, f"{folder}/{GLOBAL_SERIES}.csv"))
        return _samples(pairs, "polled", F.lit(None).cast("string"), F.lit(GLOBAL_SERIES))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        empty = spark.createDataFrame([], "first string, second string, file string, ord long")
        return _samples(empty, "polled", F.lit(None).cast("string"), F.lit(GLOBAL_SERIES))


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-05, AGG-10: headerless event files; the files of one (pid, record) merge."""
    pairs = _named_for_pid(_text_pairs(_text_rows(spark, f"{folder}/*_pid*.csv")))
    return _samples(pairs, "event", F.col("_pid"), F.col("_feature"))


def read_stage_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """SRC-06: a stage's CSV output; empty fields are null.

    Give the schema where it is known: inferring it reads the files twice.
    """
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def discover_partitions(
    spark: SparkSession, base: str, fmt: str = "parquet", schema: StructType | None = None
) -> DataFrame:
    """SRC-07: a stage table by pid if it is partitioned so, else whole with pid null."""
    reader = spark.read.format(fmt).option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "csv":
        reader = reader.option("inferSchema", True)
    df = reader.load(base)
    if "pid" in df.columns:
        return df.withColumn("pid", F.col("pid").cast("string"))
    return df.withColumn("pid", F.lit(None).cast("string"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """SRC-08: ``src dst`` per line, split on commas or blanks; bad lines drop out."""
    return parse_edges(spark.read.text(path))


def parse_edges(lines: DataFrame, column: str = "value") -> DataFrame:
    """The first two parts of every line, if both are numbers; a line is taken apart once, below the filters."""
    line, digit = F.col(column), lambda c: c.between("0", "9")
    # most lines begin and end with a digit, where nothing is to be stripped
    line = F.when(digit(F.left(line, F.lit(1))) & digit(F.right(line, F.lit(1))), line).otherwise(strip(line))
    part = F.split(F.regexp_replace(line, r"[,\s]+", " "), " ")
    # filters are not pushed below an explode, so they do not repeat what is in it
    parts = lines.select(F.explode(F.array(part)).alias("part"))
    s, d, digits = F.get("part", F.lit(0)), F.get("part", F.lit(1)), r"^\d+$"
    return (
        parts.where(s.rlike(digits) & d.rlike(digits))
        .select(s.try_cast("bigint").alias("src"), d.try_cast("bigint").alias("dst"))
        .where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    )


def read_idx_images(spark: SparkSession, path: str, range_bytes: int = idx.RANGE_BYTES) -> DataFrame:
    """SRC-09: one row per image of a file, of the files of a folder, or of those that match a pattern.

    A file is read by as many tasks as it has ranges of ``range_bytes``; one that is too short raises.
    """
    spark.dataSource.register(idx.IdxImages)
    return spark.read.format(idx.FORMAT).option("rangeBytes", range_bytes).load(path)


def read_libsvm(spark: SparkSession, path: str, features: int | None = None) -> DataFrame:
    """SRC-10: labelled points; without ``features`` Spark scans for the largest index."""
    reader = spark.read.format("libsvm")
    if features is not None:
        reader = reader.option("numFeatures", features)
    return reader.load(path)


def read_qa_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """SRC-11: nested question-answer documents with a fixed schema."""
    return spark.read.schema(QA_DOCUMENT).option("multiLine", multi_line).json(path)


def read_pid_list(
    spark: SparkSession, path: str, extra: list[int] | None = None, signed: bool = False
) -> DataFrame:
    """SRC-12: distinct pids of a list file and any given ones, in order.

    ``signed`` is the event collectors' variant: signs are accepted, and lines that are no pid - blank
    ones aside - are counted in a warning.
    """
    lines = spark.read.text(path)
    if signed:
        text = strip(F.col("value"))
        bad = lines.where((text != "") & ~text.rlike(SIGNED_PID)).count()
        if bad:
            warnings.warn(f"{path}: {bad} lines are no pid and are skipped", stacklevel=2)
    return parse_pid_list(lines, extra, signed)


def parse_pid_list(lines: DataFrame, extra: list[int] | None = None, signed: bool = False) -> DataFrame:
    """One pid per line; ``signed`` accepts a sign, as the event variant does."""
    pattern = SIGNED_PID if signed else r"^\d+$"
    found = lines.select(strip(F.col("value")).alias("v")).where(F.col("v").rlike(pattern))
    pids = found.select(F.col("v").try_cast("bigint").alias("pid")).where(F.col("pid").isNotNull())
    if extra:
        pids = pids.unionByName(lines.sparkSession.createDataFrame([(int(p),) for p in extra], "pid bigint"))
    return pids.distinct().orderBy("pid")
