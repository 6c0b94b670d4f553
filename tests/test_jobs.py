import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.functions import text as T
from flowloom.graph import pagerank as G
from flowloom.ml import clustering as C
from flowloom.ml import svm as V
from flowloom.operators import reshape
from flowloom.plans import jobs
from flowloom.schemas import QA_DOCUMENT
from tests import model


def ranks_of(edges, rounds):
    ids = sorted({v for e in edges for v in e})
    out = {v: sum(1 for s, _ in edges if s == v) for v in ids}
    rank = dict.fromkeys(ids, 1.0)
    for _ in range(rounds):
        rank = {v: 0.15 + 0.85 * sum(rank[s] / out[s] for s, d in edges if d == v) for v in ids}
    scale = len(ids) / sum(rank.values())
    return {v: r * scale for v, r in rank.items()}


@pytest.mark.parametrize("rows_per_task", [10**6, 3])
def test_pagerank_with_parallel_edges_loops_sinks_and_a_hub(spark, rows_per_task):
    rng = random.Random(2)
    edges = [(1, rng.randint(1, 20)) for _ in range(40)] + [(rng.randint(1, 9), rng.randint(1, 25)) for _ in range(40)]
    df = model.table(spark, edges, "src long, dst long")
    found = {r.id: r["rank"] for r in G.static_pagerank(df, 4, checkpoint_every=2, rows_per_task=rows_per_task).collect()}
    assert found == pytest.approx(ranks_of(edges, 4))


def test_pagerank_job_and_ties_in_the_top(spark, tmp_path):
    (tmp_path / "e.txt").write_text("1 2\n2 1\n3 4\n4 3\n")
    top = jobs.pagerank_job(spark, str(tmp_path / "e.txt"), iterations=3, partitions=2, k=3)
    assert [r.id for r in top.collect()] == [4, 3, 2]
    (tmp_path / "none.txt").write_text("a b\n")
    with pytest.raises(ValueError):
        jobs.pagerank_job(spark, str(tmp_path / "none.txt"))


def test_lloyd_keeps_an_empty_centre(spark):
    points = model.table(spark, [(i, [float(i), 0.0]) for i in range(6)], "id long, features array<double>")
    centres = C.lloyd(points, [[0.0, 0.0], [5.0, 0.0], [100.0, 100.0]], 3)
    assert centres == [[1.0, 0.0], [4.0, 0.0], [100.0, 100.0]]
    found = C.assign(points, centres)
    assert [tuple(r) for r in C.cluster_sizes(found).collect()] == [(0, 3), (1, 3)]
    assert C.wssse(found).first()[0] == pytest.approx(4.0)
    with pytest.raises(ValueError):
        C.row_count_guard(points.where("id < 0"))


@pytest.mark.parametrize("rows_per_task", [10**6, 10])
def test_auroc_with_ties(spark, rows_per_task):
    rng = random.Random(4)
    rows = [(rng.randint(0, 40) / 4, float(rng.random() < 0.4)) for _ in range(200)]
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    found = V.auroc(model.table(spark, rows, "score double, label double"), rows_per_task).first()[0]
    assert found == pytest.approx(want)


def test_svm_separates_and_scores(spark, tmp_path):
    rng = random.Random(5)
    rows = [(float(i % 2), [rng.random() + (i % 2), rng.random() - 2.0 * (i % 2)]) for i in range(60)]
    points = model.table(spark, rows, "label double, features array<double>")
    model_ = V.svm_sgd_train(points, 50, 1.0, 0.01)
    assert V.svm_evaluate(model_, points).first()[0] == 1.0
    margins = model_.clear_threshold().predict(points).select("score", "features").collect()
    for r in margins[:5]:
        assert r.score == pytest.approx(sum(w * x for w, x in zip(model_.weights, r.features)))
    assert set(r.score for r in model_.set_threshold(0.0).predict(points).collect()) <= {0.0, 1.0}
    C.as_vectors(points).write.format("libsvm").save(str(tmp_path / "svm"))
    _, area = jobs.svm_job(spark, str(tmp_path / "svm"), iterations=10)
    assert 0.0 <= area.first()[0] <= 1.0
    parts = V.hash_split(points.withColumn("id", F.monotonically_increasing_id()), "id")
    assert sum(p.count() for p in parts) == 60


def test_batched_gradients_are_mllibs(spark):
    """Full batches: the same weights as the optimizer that takes rows one by one, over many partitions or few."""
    rng = random.Random(6)
    rows = [(i, float(rng.random() < 0.4), [rng.gauss(0, 1) for _ in range(5)]) for i in range(80)]
    points = model.table(spark, rows, "id long, label double, features array<double>")
    want = V.svm_mllib_train(points, 12, 2.0, 0.05).weights
    for parts in (2, 40):
        found = V.svm_sgd_train(points.repartition(parts), 12, 2.0, 0.05)
        assert found.weights == pytest.approx(want, abs=1e-9)


def test_samples_follow_the_key_and_training_goes_on(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, float(i % 2), [rng.gauss(i % 2, 1), rng.gauss(0, 1)]) for i in range(120)]
    points = model.table(spark, rows, "id long, label double, features array<double>")
    train = lambda df, n, **how: V.svm_sgd_train(df, n, 1.0, 0.01, fraction=0.5, key="id", **how).weights
    whole = train(points, 6)
    assert train(points.repartition(5), 6) == pytest.approx(whole)
    folder = str(tmp_path / "weights")
    train(points, 4, folder=folder, save_every=2)
    assert train(points, 6, folder=folder, save_every=2) == pytest.approx(whole)
    with pytest.raises(ValueError, match="no labelled points"):
        V.svm_sgd_train(points.where("id < 0"), 1)


def test_a_round_shuffles_no_edges(spark):
    edges = model.table(spark, [(i % 7, i % 5) for i in range(60)], "src long, dst long")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows_per_task in (10**6, 3):
            graph = G.build_graph(edges, rows_per_task)
            round_ = G.inflows(graph, graph.vertices.withColumn("rank", F.lit(1.0)))
            plan = round_._jdf.queryExecution().executedPlan().toString()
            assert "SelectedBucketsCount" in plan
            # the sums by destination, and where there are hubs the shares of their lanes
            assert plan.count("Exchange hashpartitioning") <= len(graph.join_on)
            graph.forget()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_a_round_sorts_no_edges(spark):
    edges = model.table(spark, [(i % 7, i % 5) for i in range(60)], "src long, dst long")
    graph = G.build_graph(edges)
    plan = G.inflows(graph, graph.vertices.withColumn("rank", F.lit(1.0)))._jdf.queryExecution().executedPlan().toString()
    graph.forget()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan


def test_the_job_moves_no_edges_of_a_file_in_many_parts(spark, tmp_path, monkeypatch):
    moved = []
    monkeypatch.setattr(jobs, "repartition", lambda df, n: moved.append(n) or df.repartition(n))
    spark.range(40).repartition(4).select(F.concat_ws(" ", F.lit(1), "id").alias("value")).write.text(str(tmp_path / "e"))
    parts = jobs.read_edges(spark, str(tmp_path / "e")).rdd.getNumPartitions()
    few, many = (jobs.pagerank_job(spark, str(tmp_path / "e"), 2, n, 3).collect() for n in (parts, parts + 1))
    assert moved == [parts + 1] and [r.id for r in few] == [r.id for r in many]


DOCS = [
    ({"title": " T\n", "paragraphs": [{"context": "\tC ", "qas": [
        {"question": " q1 ", "answers": [{"text": " yes "}, {"text": ""}, {"text": "  "}]},
        {"question": "q2", "answers": []},
    ]}]},),
    ({"title": "U", "paragraphs": [{"context": "Cutting Knowledge Date: x\nToday Date: y\n\nrest<|begin_of_text|>", "qas": [
        {"question": "q3", "answers": [{"text": "a"}]}]}]},),
]


def test_qa_rows(spark):
    docs = spark.createDataFrame(DOCS, QA_DOCUMENT)
    train = reshape.flatten_qa_train(docs).collect()
    assert sorted(r.completion for r in train) == ["<|im_end|>", "No responde<|im_end|>", "a<|im_end|>", "yes<|im_end|>"]
    first = next(r.prompt for r in train if r.completion.startswith("yes"))
    assert first == (
        "<|im_start|>system\n<Título>\nT\n</Título>\n<Contexto>\nC\n</Contexto><|im_end|>\n"
        "<|im_start|>user\nq1<|im_end|>\n<|im_start|>assistant\n"
    )
    assert any("<Contexto>\nrest\n</Contexto>" in r.prompt for r in train)
    held = [r.answers for r in reshape.flatten_qa_eval(docs).collect()]
    assert sorted(held) == [[], [" yes ", "", "  "], ["a"]]


def test_prompt_endings(spark):
    df = spark.createDataFrame([("x",), ("",), (None,)], "a string")
    lit = F.lit
    found = [r[0] for r in df.select(T.chat_prompt(lit("t"), lit("c"), lit("q"), answer=F.col("a"))).collect()]
    assert found[0].endswith("<|im_start|>assistant\nx<|im_end|>\n")
    assert found[1].endswith("q<|im_end|>\n") and found[2].endswith("<|im_start|>assistant\n")


def test_copies(spark):
    df = spark.range(3)
    assert reshape.replicate_n(df, 4).count() == 12 and reshape.replicate_n(df, 0).count() == 3


def test_lloyd_over_tasks_without_rows(spark):
    points = model.table(spark, [(i, [float(i), 0.0]) for i in range(6)], "id long, features array<double>").repartition(20)
    centres = C.lloyd(points, [[0.0, 0.0], [5.0, 0.0]], 3)
    assert centres == [[1.0, 0.0], [4.0, 0.0]]
    assert [tuple(r) for r in C.cluster_sizes(C.assign(points, centres)).collect()] == [(0, 3), (1, 3)]


def test_distances_are_sums_in_the_order_of_dimensions():
    rng = np.random.default_rng(8)
    points, centres = rng.integers(0, 256, (40, 67)) / 255.0, rng.integers(0, 256, (3, 67)) / 255.0
    best, least = C.nearest(points, centres)
    for point, index, cost in zip(points.tolist(), best, least):
        sums = []
        for centre in centres.tolist():
            total = 0.0
            for x, c in zip(point, centre):
                total += (x - c) * (x - c)
            sums.append(total)
        assert (cost, index) == (min(sums), sums.index(min(sums)))
