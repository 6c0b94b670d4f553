"""Flow-shaped inputs derived from the general test tables (see FIXTURES.md).

``events`` stands in for packets, metric samples and probe logs; ``lineitem``
for an edge list; ``embeddings`` for vectors; ``conversations`` for QA
documents.  Nothing here samples or limits its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.config import Settings

# Surrogate parameters: spacing per key is about 1.7 h and rates are tens of bit/s.
SURROGATE = Settings(
    flow_gap_us=3_600_000_000,
    link_mbps=0.0006,
    sample_interval_ns=6 * 3600 * 1_000_000_000,
    polled_features=("memavailable_bytes", "utime_ticks", "vmrss_bytes"),
)
EVENT_RECORDS = ("cpu_allocations", "sendmsg")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return shape_events(table(spark, sf_dir, "events"))


def shape_events(raw: DataFrame) -> DataFrame:
    """The event columns the surrogates use; the session zone must be UTC."""
    return raw.select(
        "event_id",
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"),
        "user_id",
        "event_type",
        "value",
        F.round(F.col("value") * 100).cast("long").alias("size"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_of(events(spark, sf_dir))


def packets_of(ev: DataFrame) -> DataFrame:
    """Even events leave the host, odd ones reach it; works on streams as well."""
    host = F.lit(SURROGATE.host_ip)
    peer = F.concat(F.lit("10.0.0."), (F.col("user_id") % 4).cast("string"))
    port = (F.lit(40000) + F.col("user_id") % 3).cast("int")
    out = F.col("event_id") % 2 == 0
    return ev.select(
        "ts_ns",
        F.format_string("%.6f", F.col("ts_ns") / F.lit(1e9)).alias("timestamp_epoch_s"),
        F.when(out, host).otherwise(peer).alias("source_ip"),
        F.when(out, port).otherwise(F.lit(443)).alias("source_port"),
        F.when(out, peer).otherwise(host).alias("destination_ip"),
        F.when(out, F.lit(443)).otherwise(port).alias("destination_port"),
        F.col("size").alias("packet_size"),
        F.col("event_id").alias("ord"),
    )


def capture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets as capture text, each followed by a line that is not a packet."""
    p = packets(spark, sf_dir)
    line = F.format_string(
        "%s IP %s.%d > %s.%d: Flags [P.], seq 1:9, length 8 payload, length %d",
        "timestamp_epoch_s",
        "source_ip",
        "source_port",
        "destination_ip",
        "destination_port",
        "packet_size",
    )
    junk = F.format_string("%s ARP, Request who-has %s, length 28", "timestamp_epoch_s", "source_ip")
    return p.select(F.explode(F.array(line, junk)).alias("value"))


def polled_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polled_of(events(spark, sf_dir))


def polled_of(ev: DataFrame) -> DataFrame:
    pid = (F.lit(1000) + F.col("user_id") % 3).cast("string")
    name = (
        F.when(F.col("event_type") == "view", "vmrss_bytes")
        .when(F.col("event_type") == "click", "utime_ticks")
        .when(F.col("event_type") == "error", "memavailable_bytes")
    )
    return ev.where(F.col("event_type").isin("view", "click", "error")).select(
        F.when(F.col("event_type") != "error", pid).alias("pid"),
        F.lit("polled").alias("kind"),
        name.alias("feature"),
        "ts_ns",
        "value",
        F.col("event_id").alias("ord"),
    )


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_series_of(events(spark, sf_dir))


def event_series_of(ev: DataFrame) -> DataFrame:
    return ev.where(F.col("event_type").isin("purchase", "signup")).select(
        (F.lit(1000) + F.col("user_id") % 4).cast("string").alias("pid"),
        F.lit("event").alias("kind"),
        F.when(F.col("event_type") == "purchase", "sendmsg").otherwise("cpu_allocations").alias("feature"),
        "ts_ns",
        "value",
        F.col("event_id").alias("ord"),
    )


def alloc_events_of(ev: DataFrame) -> DataFrame:
    return ev.select((F.col("user_id") % 5).alias("series"), "ts_ns", "size", F.col("event_id").alias("ord"))


def probe_log_of(ev: DataFrame) -> DataFrame:
    step = F.col("event_id") % 3
    kind = F.when(step == 0, "enter").when(step == 1, "sock_sendmsg").otherwise("exit")
    return ev.select(
        "ts_ns",
        (F.col("user_id") % 5).alias("id"),
        kind.alias("kind"),
        F.col("size").alias("ret"),
        F.col("event_id").alias("ord"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.col("label"),
    )


IMAGE_WIDTH = 67


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as images of one row: three pixels of the id, and a pixel per dimension."""
    digits = [(F.expr(f"vec_id div {by}") % 256).cast("int") for by in (65536, 256, 1)]
    shade = F.transform("embedding", lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + 4) * 32))).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.array(*digits), shade).alias("pixels"))


def _awkward_text():
    """Turns with what cleaning is for: outer blanks, empty answers, date preambles."""
    role, conv, text = F.col("role"), F.col("conv_id"), F.col("text")
    preamble = F.lit("Cutting Knowledge Date: May\nToday Date: June\n\n")
    return (
        F.when((role == "user") & (conv % 3 == 0), F.concat(F.lit("  "), text, F.lit(" \n")))
        .when((role == "assistant") & (conv % 5 == 0), F.lit(""))
        .when((role == "assistant") & (conv % 5 == 1), F.concat(F.lit(" "), text, F.lit("  ")))
        .when((role == "system") & (conv % 4 == 0), F.concat(preamble, text))
        .otherwise(text)
    )


def qa_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per user turn: its question, with the conversation's system turn as context.

    The answer is the assistant turn numbered directly after the question.  It
    is found by an equi-join on (conversation, turn), so a very long
    conversation is neither sorted in one task nor gathered into one row.
    """
    turns = table(spark, sf_dir, "conversations").withColumn("text", _awkward_text())
    replies = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.array(F.struct(F.col("text"))).alias("reply")
    )
    heads = turns.where(F.col("role") == "system").groupBy("conv_id").agg(F.max("text").alias("context"))
    asked = (
        turns.where(F.col("role") == "user")
        .join(replies, ["conv_id", "turn"], "left")
        .join(heads, "conv_id", "left")
    )
    answers = F.coalesce("reply", F.array().cast("array<struct<text:string>>"))
    question = F.struct(F.col("text").alias("question"), answers.alias("answers"))
    paragraph = F.struct(
        F.coalesce("context", F.lit("")).alias("context"), F.array(question).alias("qas")
    )
    return asked.select(
        F.struct(F.col("conv_id").cast("string").alias("title"), F.array(paragraph).alias("paragraphs")).alias("data")
    )


def write_series_files(
    spark: SparkSession, sf_dir: str, folder: str, upto: Column | None = None, parts: int = 1
) -> None:
    """The series as CSV files of the names readers look for, with rows and files that must be skipped.

    Polled files carry a header, those of odd pids with the columns the other way round
    and a third one between; event files carry none, and come in two parts each.  With ``upto``, a
    condition on ``pid`` and ``ord``, only these rows are written; files of the same name are replaced.
    With several ``parts`` a series is cut along its order into files of the folders ``p0``, ``p1``, ..., each with a header
    of its own, so that no task writes a whole series.
    """
    feature, pid, time, value = F.col("feature"), F.col("pid"), F.col("ts_ns").cast("string"), F.col("value").cast("string")
    plain, turned = F.concat_ws(",", time, value), F.concat_ws(",", value, F.lit("x"), time)
    odd = F.coalesce(pid.cast("int") % 2 == 1, F.lit(False))
    (last,) = events(spark, sf_dir).agg(F.max("event_id")).head() if parts > 1 else (0,)
    below = F.concat(F.lit("p"), F.expr(f"cast(ord * {parts} div {last + 1} as string)"), F.lit("~")) if parts > 1 else F.lit("")
    polled = polled_series(spark, sf_dir).select(
        F.concat(below, feature, F.coalesce(F.concat(F.lit("_pid"), pid), F.lit("")), F.lit(".csv")).alias("name"),
        "ord",
        F.when(odd, turned).otherwise(plain).alias("line"),
        F.when(odd, "value,note,ts_ns").otherwise("ts_ns,value").alias("top"),
    )
    header = polled.groupBy("name").agg(F.lit(-1).cast("long").alias("ord"), F.first("top").alias("line"))
    part = F.when(F.col("ord") % 2 == 0, "more").otherwise("events")
    evented = event_series(spark, sf_dir).select(
        F.concat(below, part, F.lit("~"), feature, F.lit("_pid"), pid, F.lit(".csv")).alias("name"), "ord", plain.alias("line")
    )
    unnamed = header.select(F.lit("free_pid1.csv").alias("name"), "ord", F.lit("time,reading").alias("line")).distinct()
    rows = polled.drop("top").unionByName(header).unionByName(evented).unionByName(unnamed)
    if upto is not None:
        pid = F.regexp_extract("name", "_pid(\\d+)", 1)
        rows = rows.withColumn("pid", pid).where(upto).drop("pid")
    bad = F.when(F.col("ord") >= 0, F.array("line", F.lit("not,a,sample"))).otherwise(F.array("line"))
    written = rows.select("name", "ord", F.explode(bad).alias("line")).repartition("name").sortWithinPartitions("name", "ord")
    written.select("name", F.col("line").alias("value")).write.mode("overwrite").partitionBy("name").text(f"{folder}-parts")
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for place in [f"/p{k}" for k in range(parts)] if parts > 1 else [""]:
        for sub in ("", "/events", "/more"):
            store.mkdirs(path(folder + place + sub))
    for found in store.globStatus(path(f"{folder}-parts/name=*/part-*")):
        name = found.getPath().getParent().getName().removeprefix("name=").replace("~", "/").replace("%7E", "/")
        store.delete(path(f"{folder}/{name}"), False)
        store.rename(found.getPath(), path(f"{folder}/{name}"))
