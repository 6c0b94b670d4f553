"""Shards over fixed virtual slots.

Records are hashed into a fixed number of slots once and for all.  A map says
which shard owns each slot; it is planned from the bytes per slot, stored under a
version, and a new version is an edit that moves as few slots as balance needs.
Slots are thousands and records never change theirs, so every table here but the
records themselves has at most ``slots`` rows times the input partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.llm.frames import pick
from flowloom.session import checkpoint

SLOTS = 4096
SHARDS = 16
# Share by which a shard may exceed the mean before an edit takes slots from it.
SLACK = 0.002


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Small records of the documents: id, size, text checksum, virtual slot and input partition.

    Size is the UTF-8 bytes of the text plus one.  The hash covers id and text, so
    that ids which many rows share are spread; null texts count as empty.
    """
    text = F.coalesce("text", F.lit(""))
    return pick(docs, "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", text), F.lit(slots)).cast("int").alias("vslot"),
        F.spark_partition_id().alias("part"),
    )


def slot_bytes(small: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every slot, empty ones included: ``vslot, bytes, n_rows``."""
    seen = small.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))
    every = small.sparkSession.range(0, slots, 1, 1).select(F.col("id").cast("int").alias("vslot"))
    return every.join(seen, "vslot", "left").select(
        "vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("n_rows", F.lit(0)).alias("n_rows")
    )


def plan_map(sizes: DataFrame, shards: int = SHARDS, old: DataFrame | None = None, slack: float = SLACK) -> DataFrame:
    """The next version of the slot map: ``version, vslot, shard, bytes, moved``.

    Slots stay with their shard of the ``old`` map, largest first, while the shard
    is within the mean plus ``slack``; the others go, largest first, to whichever
    shard is lightest then.  Without an old map all slots are dealt that way.
    Shards that no longer exist give up all slots; new ones fill up with the surplus.
    """
    if old is None:
        known = sizes.withColumns({"home": F.lit(None).cast("int"), "before": F.lit(0)})
    else:
        latest = old.select("vslot", F.col("shard").alias("home"), F.col("version").alias("before"))
        known = sizes.join(F.broadcast(latest), "vslot", "left").withColumn("before", F.coalesce("before", F.lit(0)))
    weight = F.greatest("bytes", F.lit(1))
    mean = F.sum(weight).over(Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / shards
    along = Window.partitionBy("home").orderBy(F.desc("bytes"), "vslot")
    settled = (F.col("home") < shards) & (F.sum(weight).over(along) <= F.col("mean") * (1 + slack))
    judged = known.withColumn("mean", mean).withColumn("stays", F.coalesce(settled, F.lit(False)))
    # at most ``slots`` entries: the loads that stay, and the slots to deal out
    per_home = judged.groupBy("home", "before").agg(
        F.sum(F.when(F.col("stays"), weight).otherwise(0)).alias("load"),
        F.collect_list(F.when(~F.col("stays"), F.struct((-weight).alias("minus"), "vslot", "bytes"))).alias("pool"),
    )
    whole = per_home.agg(
        F.map_from_entries(
            F.collect_list(F.when(F.col("home").isNotNull() & (F.col("load") > 0), F.struct("home", "load")))
        ).alias("loads"),
        F.sort_array(F.flatten(F.collect_list("pool"))).alias("pool"),
    )
    start = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.coalesce(F.try_element_at("loads", k), F.lit(0).cast("long"))
    )
    empty = F.expr("cast(array() as array<struct<vslot:int,shard:int>>)")

    def deal(state, slot):
        lightest = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        return F.struct(
            F.transform(state["loads"], lambda x, k: F.when(k == lightest, x - slot["minus"]).otherwise(x)).alias("loads"),
            F.array_append(state["dealt"], F.struct(slot["vslot"].alias("vslot"), lightest.alias("shard"))).alias("dealt"),
        )

    fold = F.aggregate("pool", F.struct(start.alias("loads"), empty.alias("dealt")), deal, lambda s: s["dealt"])
    dealt = whole.select(F.inline(fold)).select("vslot", F.col("shard").alias("new"))
    return judged.join(F.broadcast(dealt), "vslot", "left").select(
        (F.col("before") + 1).alias("version"),
        "vslot",
        F.when(F.col("stays"), F.col("home")).otherwise(F.col("new")).cast("int").alias("shard"),
        "bytes",
        (F.col("home").isNotNull() & ~F.col("stays")).alias("moved"),
    )


def store_map(slot_map: DataFrame, folder: str) -> None:
    """Add a version to the stored map; earlier ones stay as they are."""
    slot_map.coalesce(1).write.partitionBy("version").mode("append").parquet(folder)


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A stored version, the latest by default."""
    stored = spark.read.parquet(folder)
    if version is None:
        version = stored.agg(F.max("version")).head()[0]
    return stored.where(F.col("version") == version)


def place(small: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard and gapless position of every record under a map.

    ``small`` must be stored rows (see ``shard``), as it is read twice.  A position
    is the rows of earlier slots of the shard, plus those of earlier input
    partitions of the slot, plus a number within slot and partition; no window
    spans more than the rows of one slot in one partition.
    """
    owner = F.broadcast(slot_map.select("vslot", "shard"))
    pieces = small.groupBy("vslot", "part").agg(F.count(F.lit(1)).alias("n"))
    by_part = Window.partitionBy("vslot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("in_slot", F.coalesce(F.sum("n").over(by_part), F.lit(0)))
    by_slot = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    slots = (
        pieces.groupBy("vslot")
        .agg(F.sum("n").alias("n"))
        .join(owner, "vslot")
        .select("vslot", "shard", F.coalesce(F.sum("n").over(by_slot), F.lit(0)).alias("in_shard"))
    )
    begins = pieces.join(F.broadcast(slots), "vslot").select(
        "vslot", "part", "shard", (F.col("in_slot") + F.col("in_shard")).alias("begin")
    )
    inner = Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        small.withColumn("k", F.row_number().over(inner) - 1)
        .join(begins, ["vslot", "part"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("begin") + F.col("k")).alias("slot"), "vslot")
    )


def shard(docs: DataFrame, folder: str, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Put documents into shards of near equal bytes; the slot map is stored below ``folder``.

    Takes ``doc_id`` and ``text``; other columns are left out.  Where ``folder``
    holds a map already, its next version is an edit of the latest one.
    Output: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version``.
    The law is ``bytes``, so ``grown_shard`` is null.  Null texts have size 1; null ids
    and repeated rows are records like any other; an empty table gives no rows.  A
    single document larger than the mean of the shards cannot be evened out.
    """
    small = checkpoint(records(docs, slots))
    spark = docs.sparkSession
    old = load_map(spark, folder) if _holds_map(spark, folder) else None
    store_map(plan_map(slot_bytes(small, slots), shards, old), folder)
    current = load_map(spark, folder)
    placed = place(small, current)
    version = current.agg(F.max("version")).head()[0]
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot").alias("virtual_slot"),
        F.lit(version).cast("int").alias("map_version"),
    )


def _holds_map(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
