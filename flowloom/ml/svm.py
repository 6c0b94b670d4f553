"""Linear SVM by mini-batch gradient descent, and its evaluation."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.classification import SVMWithSGD
from pyspark.mllib.linalg import Vectors
from pyspark.mllib.regression import LabeledPoint
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from flowloom.functions.scalars import svm_score
from flowloom.operators.filters import valid_labels
from flowloom.operators.splits import CHUNK

# Fixed value: training stops early only below this relative change of weights.
CONVERGENCE_TOL = 1e-12
# Sums of tasks are added up in so many lanes before they come to the driver.
LANES = 16
SUMS = "lane long, n long, g array<double>"


@dataclass
class SvmModel:
    """Weights of a trained model; ``threshold`` None scores raw margins."""

    weights: list[float]
    intercept: float = 0.0
    threshold: float | None = 0.0

    def set_threshold(self, value: float) -> "SvmModel":
        return SvmModel(self.weights, self.intercept, value)

    def clear_threshold(self) -> "SvmModel":
        return SvmModel(self.weights, self.intercept, None)

    def predict(self, points: DataFrame, output: str = "score") -> DataFrame:
        """SCL-19 over the ``features`` column, an array or a vector."""
        features = F.col("features")
        if not isinstance(points.schema["features"].dataType, ArrayType):
            features = vector_to_array(features)
        return points.withColumn(output, svm_score(features, self.weights, self.intercept, self.threshold))


def random_split(df: DataFrame, weights: Sequence[float] = (0.8, 0.2), seed: int = 11) -> list[DataFrame]:
    """ML-04: random train and test parts."""
    return df.randomSplit(list(weights), seed)


def hash_split(df: DataFrame, key: str, train_tenths: int = 8) -> list[DataFrame]:
    """ML-04 by hash of a key: the same rows on every run and every cluster."""
    bucket = F.pmod(F.xxhash64(key), F.lit(10))
    return [df.where(bucket < train_tenths), df.where(bucket >= train_tenths)]


def svm_sgd_train(
    points: DataFrame,
    iterations: int = 100,
    step: float = 1.0,
    reg: float = 0.01,
    fraction: float = 1.0,
    initial_weights: Sequence[float] | None = None,
    key: str | None = None,
    folder: str | None = None,
    save_every: int = 100,
) -> SvmModel:
    """ML-03: hinge loss, squared L2 updates, no intercept; mini-batch gradient descent over batches of rows.

    Each step is one job: every task sums the gradients of its Arrow batches as matrix products, the sums of
    the tasks are added up in lanes, and one row per lane comes to the driver.  A step uses the rows
    whose hash of (``key``, step) falls below ``fraction``; without a key rows that are equal are drawn together.
    So a retried task draws the same rows.  Training ends early when the weights hardly change.

    With ``folder`` the weights are written there every ``save_every`` steps, and a later call with the same
    folder goes on from the last ones.
    """
    checked = valid_labels(points)
    dense = F.col("features") if isinstance(checked.schema["features"].dataType, ArrayType) else vector_to_array("features")
    y = F.when(F.col("label") > 0.5, F.lit(1.0)).otherwise(F.lit(-1.0))
    draw = F.xxhash64(key) if key else F.xxhash64("label", dense)
    rows = checked.select(y.alias("y"), dense.alias("x"), draw.alias("draw")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        many = rows.rdd.getNumPartitions() > LANES
        width = rows.agg(F.max(F.size("x"))).head()[0]
        if width is None:
            raise ValueError("no labelled points")
        weights = np.zeros(width) if initial_weights is None else np.array(initial_weights, dtype="float64")
        first = 1
        if folder:
            saved = _saved_weights(points.sparkSession, folder)
            first, weights = (saved[0] + 1, saved[1]) if saved else (first, weights)
        for number in range(first, iterations + 1):
            n, gradient = _hinge_gradient(rows, weights, number, fraction, many)
            if n == 0:
                continue
            rate = step / math.sqrt(number)
            before, weights = weights, weights * (1.0 - rate * reg) - rate * gradient / n
            if folder and number % save_every == 0:
                _save_weights(points.sparkSession, folder, number, weights)
            moved = float(np.linalg.norm(weights - before))
            if number > 1 and moved < CONVERGENCE_TOL * max(float(np.linalg.norm(weights)), 1.0):
                break
    finally:
        rows.unpersist()
    return SvmModel(weights.tolist())


def _hinge_gradient(
    rows: DataFrame, weights: np.ndarray, number: int, fraction: float, many: bool
) -> tuple[int, np.ndarray]:
    """Rows drawn in a step, and the sum of their gradients."""
    if fraction < 1.0:
        share = F.pmod(F.xxhash64("draw", F.lit(number)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        rows = rows.where(share < fraction)
    width = len(weights)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, total = 0, np.zeros(width)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            signed = batch.column(0).to_numpy()
            total -= (signed * (signed * (x @ weights) < 1.0)) @ x
            n += batch.num_rows
        lane = TaskContext.get().partitionId() % LANES
        yield pa.RecordBatch.from_pydict({"lane": [lane], "n": [n], "g": [total.tolist()]})

    def add(group: pa.Table) -> pa.Table:
        sums = np.sum([np.asarray(g) for g in group["g"].to_pylist()], axis=0)
        n = sum(group["n"].to_pylist())
        return pa.table({"lane": group["lane"][:1], "n": [n], "g": [sums.tolist()]})

    parts = rows.select("y", "x").mapInArrow(partial, SUMS)
    if many:
        parts = parts.groupBy("lane").applyInArrow(add, SUMS)
    # one row per lane
    found = parts.collect()
    return sum(r["n"] for r in found), np.sum([np.array(r["g"]) for r in found], axis=0)


def _save_weights(spark: SparkSession, folder: str, number: int, weights: np.ndarray) -> None:
    row = spark.createDataFrame([(weights.tolist(),)], "weights array<double>")
    row.coalesce(1).write.mode("overwrite").parquet(f"{folder}/step={number}")


def _saved_weights(spark: SparkSession, folder: str) -> tuple[int, np.ndarray] | None:
    """The last saved step and its weights; none where nothing was saved."""
    try:
        saved = spark.read.parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    row = saved.orderBy(F.desc("step")).head()
    return int(row["step"]), np.array(row["weights"])


def svm_mllib_train(
    points: DataFrame, iterations: int = 100, step: float = 1.0, reg: float = 0.01, fraction: float = 1.0
) -> SvmModel:
    """ML-03 by MLlib's own optimizer, which takes rows one by one as Python objects; for small tables."""
    checked = valid_labels(points)
    dense = F.col("features") if isinstance(checked.schema["features"].dataType, ArrayType) else vector_to_array("features")
    rows = checked.select(F.col("label").cast("double").alias("label"), dense.alias("x"))
    training = rows.rdd.map(lambda r: LabeledPoint(r["label"], Vectors.dense(r["x"]))).cache()
    try:
        model = SVMWithSGD.train(
            training,
            iterations=iterations,
            step=step,
            regParam=reg,
            miniBatchFraction=fraction,
            regType="l2",
            intercept=False,
            validateData=False,
            convergenceTol=CONVERGENCE_TOL,
        )
    finally:
        training.unpersist()
    return SvmModel([float(w) for w in model.weights], float(model.intercept))


def auroc(scored: DataFrame, rows_per_task: int = 4_000_000) -> DataFrame:
    """AGG-08: area under the ROC curve of (score, label), ties sharing their area.

    Rows are first counted per distinct score.  Each positive beats the
    negatives of lower scores and half of those of its own.  The running count
    of negatives is taken per score range and continued from range totals, so
    no window covers the whole table.
    """
    counts = scored.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")
    )
    edges: list[float] = []
    pieces = counts.count() // rows_per_task
    if pieces >= 2:
        wanted = [i / pieces for i in range(1, pieces)]
        found = counts.agg(F.percentile_approx("score", wanted, max(10_000, 20 * pieces))).first()[0]
        edges = sorted(set(found))
    chunked = _score_chunks(counts, edges)
    line = Window.partitionBy(CHUNK).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    local = chunked.withColumn("_below", F.coalesce(F.sum("neg").over(line), F.lit(0)))
    parts = local.groupBy(CHUNK).agg(
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
        F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2.0)).alias("area"),
    )
    # one row per score range
    ranges = Window.partitionBy("_all").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.withColumn("_all", F.col("pos") * 0)
        .withColumn("_lower", F.coalesce(F.sum("neg").over(ranges), F.lit(0)))
        .agg(
            F.try_divide(
                F.sum(F.col("area") + F.col("pos") * F.col("_lower")),
                F.sum("pos").cast("double") * F.sum("neg"),
            ).alias("auroc")
        )
    )


def _score_chunks(counts: DataFrame, edges: list[float]) -> DataFrame:
    if not edges:
        return counts.withColumn(CHUNK, F.lit(0).cast("long"))
    cut = Bucketizer(
        splits=[float("-inf"), *edges, float("inf")], inputCol="score", outputCol="_b", handleInvalid="keep"
    ).transform(counts)
    return cut.withColumn(CHUNK, F.col("_b").cast("long")).drop("_b")


def svm_evaluate(model: SvmModel, test: DataFrame) -> DataFrame:
    """ML-05: raw margins on the test part, then the area under the curve."""
    scored = model.clear_threshold().predict(test)
    return auroc(scored.select("score", "label"))
