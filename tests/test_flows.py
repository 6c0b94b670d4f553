import pytest
from pyspark.sql import functions as F

from flowloom.config import Settings
from flowloom.operators import counters, flows
from flowloom.operators.splits import CHUNK, find_splits
from flowloom.plans.dataset import extract_flows
from flowloom.schemas import FLOW_COLUMNS, FLOW_KEY
from tests import model


def frame(spark, rows):
    return model.table(spark, rows, model.PACKET_DDL)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("rows_per_task", [1_000_000, 40, 7])
@pytest.mark.parametrize("vantage", ["h", None])
def test_flows_match_model(spark, rows_per_task, vantage):
    packets = model.random_packets(3, 600, hot=0.4)
    settings = Settings(host_ip=vantage, flow_gap_us=9, rows_per_task=rows_per_task)
    found = extract_flows(frame(spark, packets), settings)
    assert found.columns == list(FLOW_COLUMNS)
    assert rows(found) == sorted(model.flows(packets, 9, vantage))


@pytest.mark.parametrize("rows_per_task", [30, 5])
def test_flows_with_a_third_of_all_rows_at_one_instant(spark, rows_per_task):
    packets = model.random_packets(5, 500, hot=0.6, burst=0.4)
    settings = Settings(host_ip=None, flow_gap_us=4, rows_per_task=rows_per_task)
    assert rows(extract_flows(frame(spark, packets), settings)) == sorted(model.flows(packets, 4, None))


def test_everything_at_one_instant(spark):
    packets = [(5000, "t", "h", 1, "a", 2, 1, i) for i in range(200)]
    settings = Settings(host_ip="h", flow_gap_us=1, rows_per_task=10)
    (flow,) = extract_flows(frame(spark, packets), settings).collect()
    assert (flow.packet_count, flow.total_size, flow.neworkin, flow.neworkout) == (200, 200, 0, 0)


def test_hot_keys_are_cut_into_bounded_pieces(spark):
    packets = model.random_packets(7, 3000, hot=0.5, burst=0.2)
    keyed = flows.to_flow_key(frame(spark, packets))
    splits = find_splits(keyed, FLOW_KEY, "ts_ns", "ord", 50)
    assert not splits.trivial and splits.heavy
    sizes = splits.attach(keyed).groupBy(*FLOW_KEY, CHUNK).count()
    assert sizes.agg(F.max("count")).first()[0] <= 150
    assert sizes.agg(F.sum("count")).first()[0] == 3000


def test_a_gap_equal_to_the_limit_does_not_split(spark):
    def packet(ts, i):
        return (ts, str(ts), "h", 1, "a", 2, 10, i)

    packets = frame(spark, [packet(1_000_000, 0), packet(6_000_000, 1), packet(11_000_001, 2)])
    found = sorted(flows.flow_aggregate(packets, 5000).collect(), key=lambda r: r.start_ts_ns)
    assert [(f.start_ts_ns, f.packet_count, f.gap_us) for f in found] == [(1_000_000, 2, 0), (11_000_001, 1, 5000)]


def test_packets_and_bytes_are_preserved(spark):
    packets = frame(spark, model.random_packets(11, 800, hot=0.3))
    found = flows.flow_aggregate(packets, 10, rows_per_task=25)
    assert tuple(found.agg(F.sum("packet_count"), F.sum("total_size")).first()) == tuple(
        packets.agg(F.count("*"), F.sum("packet_size")).first()
    )


@pytest.mark.parametrize("rows_per_task", [1_000_000, 20])
def test_running_bytes(spark, rows_per_task):
    packets = model.random_packets(13, 300, hot=0.5, burst=0.2)
    found = counters.running_bytes(frame(spark, packets), rows_per_task).collect()
    assert len(found) == len({(ip, p[0]) for p in packets for ip in (p[2], p[4])})
    for row in found:
        assert row.in_cum == sum(p[6] for p in packets if p[4] == row.ip and p[0] <= row.ts_ns)
        assert row.out_cum == sum(p[6] for p in packets if p[2] == row.ip and p[0] <= row.ts_ns)


@pytest.mark.parametrize("rows_per_task", [1_000_000, 15])
def test_dense_numbers_over_repeated_values(spark, rows_per_task):
    values = [(i % 3 if i % 2 else 7, i) for i in range(400)]
    df = model.table(spark, values, "a long, b long")
    found = flows.dense_number(df, "n", "a", "b", rows_per_task).orderBy("n").collect()
    assert [r.n for r in found] == list(range(400))
    assert [(r.a, r.b) for r in found] == sorted(values)


def test_no_global_window_and_no_cartesian_product(spark):
    packets = frame(spark, model.random_packets(17, 600, hot=0.4))
    found = extract_flows(packets, Settings(host_ip="h", flow_gap_us=9, rows_per_task=40))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "Pandas" not in plan
