"""Connected components of an edge table, by minimum labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.frames import stored


def components(edges: DataFrame) -> DataFrame:
    """The smallest node of each node's component: ``id, root`` for every node on an edge.

    ``edges`` has long columns ``a`` and ``b`` and is read in each round, so store it
    first.  Each round takes the least root among the neighbours, then the root of
    that root, which halves paths; it ends when nothing changes.  Rounds are written
    to the shared folder; a node's neighbours are never gathered, only their minimum.
    """
    ways = stored(edges.select("a", "b").union(edges.select("b", "a")).toDF("id", "other").distinct(), "ways")
    roots = stored(ways.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("root")), "roots")
    while True:
        theirs = roots.select(F.col("id").alias("other"), F.col("root").alias("m"))
        near = ways.join(theirs, "other").groupBy("id").agg(F.min("m").alias("m"))
        lowered = roots.join(near, "id").select("id", F.least("root", "m").alias("next"), F.col("root").alias("before"))
        over = roots.select(F.col("id").alias("next"), F.col("root").alias("beyond"))
        jumped = lowered.join(over, "next").select("id", F.least("next", "beyond").alias("root"), "before")
        after = stored(jumped, "roots")
        moved = after.where(F.col("root") != F.col("before")).limit(1).count()
        roots = after.select("id", "root")
        if not moved:
            return roots
