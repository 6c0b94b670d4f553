"""Ready-made jobs over files: PageRank, k-means, SVM and QA shaping."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.text import ChatTemplate
from flowloom.graph.pagerank import exists_check, pagerank_top_k
from flowloom.ml import clustering, svm
from flowloom.operators.reshape import flatten_qa_eval, flatten_qa_train, repartition, replicate_n
from flowloom.sources.readers import read_edges, read_idx_images, read_libsvm, read_qa_json


def pagerank_job(spark: SparkSession, path: str, iterations: int = 40, partitions: int = 256, k: int = 10) -> DataFrame:
    """PIP-06: the k highest ranked vertices of an edge list file.

    The edges are spread over ``partitions`` unless the file is read in as many parts anyway.
    """
    edges = exists_check(read_edges(spark, path), "edges")
    if edges.rdd.getNumPartitions() < partitions:
        edges = repartition(edges, partitions)
    return pagerank_top_k(edges, iterations, k)


@dataclass
class KMeansResult:
    count: int
    wssse: float
    sizes: DataFrame
    centres: list[list[float]]


def kmeans_job(
    spark: SparkSession,
    path: str,
    k: int = 10,
    iterations: int = 60,
    partitions: int = 64,
    copies: int = 4,
    seed: int = 1,
    centres: Sequence[Sequence[float]] | None = None,
) -> KMeansResult:
    """PIP-07: cluster the images of IDX files, from a random start or from given ``centres``."""
    images = read_idx_images(spark, path).select(F.col("image").alias("id"), "features")
    rows = repartition(replicate_n(images, copies), partitions).persist(StorageLevel.MEMORY_AND_DISK)
    n = clustering.row_count_guard(rows, "images")
    if centres is not None:
        found = clustering.lloyd(rows, centres, iterations)
        assigned = clustering.assign(rows, found)
        cost = clustering.wssse(assigned).head()[0]
        return KMeansResult(n, float(cost), clustering.cluster_sizes(assigned), found)
    vectors = clustering.as_vectors(rows)
    model = clustering.kmeans_fit(vectors, k, iterations, seed)
    sizes = clustering.cluster_sizes(clustering.kmeans_predict(model, vectors))
    return KMeansResult(
        n, float(model.summary.trainingCost), sizes, [[float(x) for x in c] for c in model.clusterCenters()]
    )


def svm_job(
    spark: SparkSession,
    path: str,
    iterations: int = 270_000,
    step: float = 10.0,
    reg: float = 0.01,
    held_out: Column | None = None,
) -> tuple[svm.SvmModel, DataFrame]:
    """PIP-08: train on a part of a LIBSVM file and evaluate on the rest, by default a random fifth.

    ``held_out`` is a condition on ``label`` and ``x``, the features as an array, that names the rest.
    """
    points = read_libsvm(spark, path).select("label", vector_to_array("features").alias("x"))
    if held_out is None:
        train, test = svm.random_split(points)
    else:
        train, test = points.where(~held_out), points.where(held_out)
    train, test = (part.withColumnRenamed("x", "features") for part in (train, test))
    model = svm.svm_sgd_train(train, iterations, step, reg)
    return model, svm.svm_evaluate(model, test)


def qa_train(spark: SparkSession, path: str, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """PIP-09: prompt and completion rows."""
    return flatten_qa_train(read_qa_json(spark, path), template)


def qa_eval(spark: SparkSession, path: str, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """PIP-09: prompts with all their answers."""
    return flatten_qa_eval(read_qa_json(spark, path), template)
