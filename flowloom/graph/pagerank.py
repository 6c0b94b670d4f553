"""PageRank over edge lists with joins and map-side combined sums."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators.splits import SAMPLES_PER_TASK
from flowloom.session import checkpoint, ensure_checkpoint_dir

# Reset probability and starting rank.
RESET = 0.15
FIRST_RANK = 1.0


def exists_check(df: DataFrame, what: str) -> DataFrame:
    """SRT-03: raise if there is not even one row."""
    if df.isEmpty():
        raise ValueError(f"no valid {what}")
    return df


@dataclass
class Graph:
    """``edges``: src, dst, copies, lane, bucketed by ``join_on``.  ``vertices``: id, outdeg, lanes, bucketed by id."""

    edges: DataFrame
    vertices: DataFrame
    join_on: list[str]
    tables: list[str]

    def forget(self) -> None:
        """Take the tables out of the catalog; their files stay in the shared folder until it is cleared."""
        for name in self.tables:
            self.edges.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def _bucketed(df: DataFrame, keys: list[str]) -> tuple[str, DataFrame]:
    """The frame as a table in the shared folder, one sorted file per bucket of the keys."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"graph_{uuid.uuid4().hex}"
    (
        df.repartition(buckets, *keys)
        .write.bucketBy(buckets, *keys)
        .sortBy(*keys)
        .option("path", f"{ensure_checkpoint_dir(spark)}/{name}")
        .saveAsTable(name)
    )
    return name, spark.table(name)


def _hubs(edges: DataFrame, rows_per_task: int) -> list[tuple[int, int]]:
    """Sources with more edges than a task should hold, and how many lanes they need.

    Found in a sample; at most edges / rows_per_task of them.
    """
    fraction = min(1.0, SAMPLES_PER_TASK / rows_per_task)
    step = max(1, round(rows_per_task * fraction))
    sample = edges.select("src") if fraction == 1.0 else edges.select("src").sample(fraction=fraction, seed=17)
    found = sample.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2 * step)
    return [(r["src"], -(-r["n"] // step)) for r in found.collect()]


def build_graph(edges: DataFrame, rows_per_task: int = 4_000_000) -> Graph:
    """GRF-01: vertices are all endpoints; parallel edges and self-loops count.

    Parallel edges become one row with a count, summed before the shuffle.  The
    edges of a hub are spread over lanes by destination, so that the join on
    source never puts them all into one task.  Edges and vertices are written once, in buckets of the keys
    that rounds join on: a round shuffles neither, and a lost executor costs its buckets read again.
    """
    hubs = _hubs(edges, rows_per_task)
    weighted = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("copies"))
    if hubs:
        table = edges.sparkSession.createDataFrame(hubs, "src long, lanes long")
        weighted = weighted.join(F.broadcast(table), "src", "left").withColumn(
            "lane", F.pmod(F.xxhash64("dst"), F.coalesce("lanes", F.lit(1)))
        )
        join_on = ["src", "lane"]
    else:
        weighted = weighted.withColumn("lane", F.lit(0).cast("long"))
        join_on = ["src"]
    placed_as, placed = _bucketed(weighted.select("src", "dst", "copies", "lane"), join_on)
    none = F.lit(0).cast("long")
    ends = F.array(
        F.struct(F.col("src").alias("id"), F.col("copies").alias("out")), F.struct(F.col("dst").alias("id"), none.alias("out"))
    )
    vertices = placed.select(F.inline(ends)).groupBy("id").agg(F.sum("out").alias("outdeg"))
    if hubs:
        wide = table.withColumnRenamed("src", "id")
        vertices = vertices.join(F.broadcast(wide), "id", "left").withColumn("lanes", F.coalesce("lanes", F.lit(1)))
    else:
        vertices = vertices.withColumn("lanes", F.lit(1).cast("long"))
    known_as, known = _bucketed(vertices, ["id"])
    return Graph(placed, known, join_on, [placed_as, known_as])


def inflows(graph: Graph, ranks: DataFrame) -> DataFrame:
    """What every vertex receives in one round: ``id``, ``inflow``."""
    share = ranks.where(F.col("outdeg") > 0).select(
        F.col("id").alias("src"), (F.col("rank") / F.col("outdeg")).alias("share"), "lanes"
    )
    if "lane" in graph.join_on:
        share = share.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lanes") - 1)))
    return (
        # the vertices of a bucket are hashed; a merge would sort the edges again in every round
        graph.edges.join(share.hint("shuffle_hash"), graph.join_on)
        .groupBy(F.col("dst").alias("id"))
        .agg(F.sum(F.col("share") * F.col("copies")).alias("inflow"))
    )


def static_pagerank(
    edges: DataFrame, iterations: int, checkpoint_every: int = 10, rows_per_task: int = 4_000_000
) -> DataFrame:
    """GRF-02: a fixed number of rounds, ranks finally scaled to sum to the vertex count.

    Each round joins the ranks to the buckets of edges and sums by destination
    after partial sums on the map side; these sums are what it shuffles.  Ranks are
    checkpointed to the shared folder every few rounds to keep plans short.
    """
    graph = build_graph(edges, rows_per_task)
    vertices = graph.vertices
    ranks = vertices.withColumn("rank", F.lit(FIRST_RANK))
    for step in range(1, iterations + 1):
        inflow = inflows(graph, ranks)
        ranks = vertices.join(inflow, "id", "left").select(
            "id",
            "outdeg",
            "lanes",
            (F.lit(RESET) + F.lit(1.0 - RESET) * F.coalesce("inflow", F.lit(0.0))).alias("rank"),
        )
        if step % checkpoint_every == 0 and step < iterations:
            ranks = checkpoint(ranks)
    ranks = checkpoint(ranks.select("id", "rank"))
    graph.forget()
    scale = ranks.agg((F.count(F.lit(1)) / F.sum("rank")).alias("s")).scalar()
    return ranks.select("id", (F.col("rank") * scale).alias("rank"))


def top_k(ranks: DataFrame, k: int = 10) -> DataFrame:
    """SRT-04: the k highest ranks, larger id first among equals."""
    return ranks.orderBy(F.col("rank").desc(), F.col("id").desc()).limit(k)


def pagerank_top_k(edges: DataFrame, iterations: int, k: int = 10) -> DataFrame:
    """GRF-03."""
    return top_k(static_pagerank(edges, iterations), k)
