import os

import pytest

from tests.oracle_check import compare, connect

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
# One query per family; tests/oracle_check.py runs all of them.
NAMES = ("parse_capture", "full_dataset", "event_routing", "socket_writes", "pagerank", "auroc", "qa_train", "stream_writes", "stream_polled", "ordered_dataset", "idx_file", "features_cut", "flow_labels_cut", "interval_cut", "socket_writes_cut", "auroc_cut")


def test_every_query_has_a_name_and_most_have_sql():
    from __spark_entry__ import oracle_sql, queries
    from flowloom.catalogue import QUERIES
    from flowloom.oracles import ORACLES

    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())
    assert set(QUERIES) - set(ORACLES) == {"kmeans_copies", "svm_train"}


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    from __spark_entry__ import oracle_sql, queries

    assert compare(queries()[name](spark, SF), connect(SF), oracle_sql()[name]) is None


def test_cut_queries_do_cut(spark):
    """At their rows per task the small tables have hot keys, sources and time lines to cut."""
    from flowloom import surrogates as S
    from flowloom.catalogue import CUT_ROWS
    from flowloom.graph.pagerank import _hubs
    from flowloom.operators.asof import time_splits
    from flowloom.operators.flows import packet_splits
    from flowloom.operators.splits import find_splits

    if os.path.isdir(LARGER):
        # no 4-tuple of the smallest table has enough packets
        assert not packet_splits(S.packets(spark, LARGER), CUT_ROWS).trivial
    packets = S.packets(spark, SF)
    assert not find_splits(packets, ("source_ip",), "ts_ns", None, CUT_ROWS).trivial
    assert not time_splits((packets, "ts_ns"), rows_per_task=CUT_ROWS).trivial
    assert not find_splits(S.probe_log_of(S.events(spark, SF)), ("id",), "ts_ns", "ord", CUT_ROWS // 4).trivial
    assert _hubs(S.edges(spark, SF), 10)


def test_cutting_goes_by_rows_not_by_bytes(spark, tmp_path):
    """One key, rows that compress to next to nothing: still cut into pieces of bounded size."""
    from pyspark.sql import functions as F

    from flowloom.operators.splits import CHUNK, find_splits

    spark.range(40_000).select(F.lit(1).alias("k"), F.col("id").alias("t")).coalesce(1).write.parquet(str(tmp_path / "one"))
    rows = spark.read.parquet(str(tmp_path / "one"))
    splits = find_splits(rows, ("k",), "t", None, 2_000)
    assert not splits.trivial
    assert max(r["count"] for r in splits.attach(rows).groupBy(CHUNK).count().collect()) <= 2 * 2_000


def test_small_pieces_give_a_bounded_number_of_cuts(spark):
    """However few rows a piece is to have, the driver holds no more cuts than it is meant to, with and without keys."""
    from pyspark.sql import functions as F

    from flowloom.operators.splits import CHUNK, MAX_CUTS, find_splits

    n = 100_000
    rows = spark.range(0, n, 1, 4).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"))
    for keys in (("k",), ()):
        splits = find_splits(rows, keys, "t", None, 3)
        assert MAX_CUTS / 2 < len(splits.cuts) < 1.2 * MAX_CUTS
        pieces = splits.attach(rows).groupBy(*keys, CHUNK).count().agg(F.max("count"), F.sum("count")).first()
        assert pieces[0] < 10 * n / MAX_CUTS and pieces[1] == n
