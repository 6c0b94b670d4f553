"""K-means over vector columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_count_guard(df: DataFrame, what: str = "rows") -> int:
    """AGG-05: the row count; raises on zero."""
    n = df.count()
    if n == 0:
        raise ValueError(f"no {what}")
    return n


def as_vectors(df: DataFrame, column: str = "features") -> DataFrame:
    return df.withColumn(column, array_to_vector(F.col(column)))


def kmeans_fit(df: DataFrame, k: int, iterations: int, seed: int = 1) -> KMeansModel:
    """ML-01: k-means|| start, Lloyd steps; ``features`` is a vector column."""
    return KMeans(k=k, maxIter=iterations, seed=seed, featuresCol="features").fit(df)


def kmeans_predict(model: KMeansModel, df: DataFrame) -> DataFrame:
    """ML-02: nearest centre as ``prediction``."""
    return model.transform(df)


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest centre, the first among equals.

    Squares are added up plainly, in the order of the dimensions: where centres are equally far, as with pixels, the
    rounding of the sums decides, and so it is the same for a point in any batch and in SQL.
    """
    best = np.zeros(len(points), dtype="int64")
    least = np.full(len(points), np.inf)
    columns = np.ascontiguousarray(points.T)
    for index, centre in enumerate(centres):
        squared = np.zeros(len(points))
        for column, at in zip(columns, centre):
            gap = column - at
            squared += gap * gap
        closer = squared < least
        best[closer], least[closer] = index, squared[closer]
    return best, least


def assign(df: DataFrame, centres: Sequence[Sequence[float]]) -> DataFrame:
    """(id, prediction, cost) for an array column; batches of vectors at a time."""
    fixed = np.asarray(centres, dtype="float64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                points = np.stack(batch["features"].to_numpy()).astype("float64")
                best, least = nearest(points, fixed)
                yield pd.DataFrame({"id": batch["id"], "prediction": best, "cost": least})

    return df.select("id", "features").mapInPandas(run, "id bigint, prediction bigint, cost double")


def lloyd_step(df: DataFrame, centres: Sequence[Sequence[float]]) -> list[list[float]]:
    """One Lloyd step: partial sums per batch, then one row per cluster to the driver.

    A centre that attracts no points stays where it is.
    """
    fixed = np.asarray(centres, dtype="float64")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros_like(fixed), np.zeros(len(fixed), dtype="int64")
        for batch in batches:
            if len(batch):
                points = np.stack(batch["features"].to_numpy()).astype("float64")
                best, _ = nearest(points, fixed)
                for index in np.unique(best):
                    sums[index] += points[best == index].sum(axis=0)
                counts += np.bincount(best, minlength=len(fixed))
        used = np.flatnonzero(counts)
        # a task without rows has no sums, and pandas no type for an empty list of them
        if len(used):
            yield pd.DataFrame({"c": used, "n": counts[used], "s": list(sums[used])})

    def add(group: pa.Table) -> pa.Table:
        sums = group["s"].combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1).sum(axis=0)
        return pa.table({"c": group["c"][:1], "n": [sum(group["n"].to_pylist())], "s": [sums.tolist()]})

    layout = "c bigint, n bigint, s array<double>"
    # one row per task and cluster, then one per cluster
    rows = df.select("features").mapInPandas(partial, layout).groupBy("c").applyInArrow(add, layout).collect()
    moved = fixed.copy()
    for row in rows:
        moved[row["c"]] = np.array(row["s"]) / row["n"]
    return moved.tolist()


def lloyd(df: DataFrame, centres: Sequence[Sequence[float]], iterations: int) -> list[list[float]]:
    """ML-01 from given centres: a fixed number of Lloyd steps over cached rows."""
    held = df.select("features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for _ in range(iterations):
            centres = lloyd_step(held, centres)
    finally:
        held.unpersist()
    return [list(c) for c in centres]


def cluster_sizes(predicted: DataFrame) -> DataFrame:
    """AGG-06: rows per cluster, by id."""
    return predicted.groupBy("prediction").count().orderBy("prediction")


def wssse(assigned: DataFrame) -> DataFrame:
    """AGG-07: sum of squared distances to the nearest centre."""
    return assigned.agg(F.sum("cost").alias("wssse"))
