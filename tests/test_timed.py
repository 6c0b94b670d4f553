"""Streams in event time: disorder within the delay changes nothing, and idle keys leave no state."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from flowloom.operators import asof, flows
from flowloom.operators.counters import asof_strict, running_bytes
from flowloom.operators.events import route_records
from flowloom.operators.pairing import pair_socket_writes
from flowloom.streaming import batchwise, enrich, timed
from flowloom.streaming import flows as stream_ops
from tests import model
from tests.test_streaming import in_files, same

SECOND = 1_000_000_000


def disordered(rng, rows, by=0):
    """Rows sorted by time but for up to 20 seconds, and the place each is read at."""
    return sorted(rows, key=lambda r: r[by] + rng.randint(0, 20) * SECOND)


def test_counters_over_files_out_of_order(spark, tmp_path):
    rng = random.Random(1)
    packets = [
        (rng.randint(100, 140) * SECOND + rng.choice([0, 1, 999]), "0.0", rng.choice("ab"), 1, rng.choice("abc"), 2, rng.randint(0, 9), i)
        for i in range(160)
    ]
    packets += [(*p[:7], 1000 + i) for i, p in enumerate(packets[:10])]
    closing = (10**6 * SECOND, "9", "a", 1, "b", 2, 5, 9999)
    rows = [*disordered(rng, packets), closing]
    spark.createDataFrame(packets, model.PACKET_DDL).write.parquet(str(tmp_path / "table"))
    table = spark.read.parquet(str(tmp_path / "table"))
    places = {r: k for k, r in enumerate(rows)}
    stream, _ = in_files(spark, tmp_path, rows, model.PACKET_DDL, 5, places.get)
    for lanes in (1, 3):
        folder = str(tmp_path / f"lanes{lanes}")
        timed.counted_packets(stream, folder, "25 seconds", lanes).awaitTermination()
        found = spark.read.parquet(f"{folder}/rows")
        probes = table.select(F.col("source_ip").alias("src_ip"), F.col("ts_ns").alias("start_ts_ns"), "ord", "packet_size")
        want = asof_strict(probes, table, None)
        same(
            want,
            found.select(
                F.col("source_ip").alias("src_ip"), F.col("ts_ns").alias("start_ts_ns"), "ord", "packet_size", "neworkin", "neworkout"
            ),
        )
        assert found.select("batch").distinct().count() > 2
    running = enrich.run_to_table(timed.running_bytes_stream(stream, "25 seconds"), str(tmp_path / "running"))
    same(running, running_bytes(table))


def test_flows_carry_the_counters_of_their_first_packet(spark, tmp_path):
    packets = model.random_packets(5, 120, hot=0.4)
    ddl = model.PACKET_DDL + ", neworkin long"
    stream, table = in_files(spark, tmp_path, [(*p, 100 + p[7]) for p in packets], ddl, 3, lambda r: (r[0], r[7]))
    found = enrich.run_to_table(stream_ops.flow_stream(stream, 9, carry=("neworkin",)), str(tmp_path / "out"), "complete")
    first = table.groupBy("source_ip", "source_port", "destination_ip", "destination_port", "ts_ns").agg(F.min("ord").alias("o"))
    starts = {(r.source_ip, r.source_port, r.destination_ip, r.destination_port, r.ts_ns): r.o for r in first.collect()}
    got = found.collect()
    assert len(got) == flows.flow_aggregate(table, 9).count()
    assert all(r.neworkin == 100 + starts[r.src_ip, r.src_port, r.dst_ip, r.dst_port, r.start_ts_ns] for r in got)


def test_writes_out_of_order_and_idle_threads(spark, tmp_path):
    rng = random.Random(2)
    ddl = "ts_ns long, id long, kind string, ret long, ord long"
    log = [(rng.randint(1, 60) * SECOND, rng.choice([1, 2]), rng.choice(["enter", "sock_sendmsg", "exit"]), i, i) for i in range(200)]
    # thread 3 enters a call, sends, and ends there; its exit comes long after it was forgotten
    log += [(5 * SECOND, 3, "enter", 0, 500), (6 * SECOND, 3, "sock_sendmsg", 0, 501), (900 * SECOND, 3, "exit", 7, 502)]
    closing = [(500 * SECOND, 9, "enter", 0, 600), (2000 * SECOND, 9, "enter", 0, 601), (9000 * SECOND, 9, "enter", 0, 602)]
    early = [r for r in log if r[0] < 500 * SECOND]
    rows = [*disordered(rng, early), closing[0], log[-1], *closing[1:]]
    places = {r: k for k, r in enumerate(rows)}
    stream, table = in_files(spark, tmp_path, rows, ddl, 8, places.get)
    found = enrich.run_to_table(timed.write_pairs(stream, "25 seconds", idle_ms=100_000), str(tmp_path / "out"))
    want = pair_socket_writes(table).where("id <> 3")
    assert want.count() > 5
    same(found, want)
    state = spark.read.format("statestore").option("stateVarName", "phase").load(str(tmp_path / "out" / "checkpoint"))
    assert {r.key.id for r in state.collect()} <= {9}


def test_last_values_out_of_order(spark, tmp_path):
    rng = random.Random(3)
    ddl = "ts_ns long, ord long, pid string, kind string, feature string, value double, flow string"
    rows = []
    for i in range(150):
        what = rng.choice(["flow", "rss", "rss", "send", "mem"])
        kind = {"flow": None, "send": "event"}.get(what, "polled")
        pid = None if what in ("flow", "mem") else rng.choice("12")
        flow = f'{{"flow_id":{i}}}' if what == "flow" else None
        rows.append((rng.randint(100, 160) * SECOND + i % 3, i, pid, kind, None if flow else what, None if flow else float(i), flow))
    closing = (10**6 * SECOND, 999, None, None, None, None, '{"flow_id":999}')
    late = [*disordered(rng, rows), closing]
    places = {r: k for k, r in enumerate(late)}
    stream, table = in_files(spark, tmp_path, late, ddl, 5, places.get)
    found = timed.last_values(stream, ["rss", "mem"], ["send"], ["1", "2", "3"], ["1", "2"], "25 seconds", 10**9)
    found = enrich.run_to_table(found.withColumn("flow_id", F.get_json_object("flow", "$.flow_id")).drop("flow"), str(tmp_path / "out"))
    asked = table.where("flow is not null and ord < 999").select(F.get_json_object("flow", "$.flow_id").alias("flow_id"), F.col("ts_ns").alias("start_ts_ns"))
    series = table.where("flow is null").drop("flow")
    want = asof.extract_features(asked, series, ["rss", "mem"], ["send"], spark.createDataFrame([("1",), ("2",), ("3",)], "pid string"))
    same(found, want.drop("start_ts_ns"))


def test_routing_gives_late_pids_the_earlier_sums(spark, tmp_path):
    rng = random.Random(4)
    kinds = ["cuda_mem", "cpu_mem", "nccl_mem", "kcache", "write", "unlisted"]
    # pid 9 comes in the last quarter
    rows = [(rng.choice(kinds), 9 if i > 180 and i % 3 else rng.choice([1, 2]), i * 7, rng.randint(1, 9), i) for i in range(240)]
    stream, table = in_files(spark, tmp_path, rows, "probe string, pid long, ts_ns long, size long, ord long", 4, lambda r: r[2])
    want = route_records(table, table.select("pid").distinct(), 50, gpu=True)
    for rows_per_task in (10**6, 10):
        folder = str(tmp_path / f"out{rows_per_task}")
        batchwise.routing_batches(stream, folder, 50, gpu=True, rows_per_task=rows_per_task).awaitTermination()
        same(spark.read.parquet(f"{folder}/rows").drop("batch"), want)
    folder = str(tmp_path / "listed")
    listed = spark.createDataFrame([(1,), (9,)], "pid long")
    batchwise.routing_batches(stream, folder, 50, gpu=True, pids=listed).awaitTermination()
    same(spark.read.parquet(f"{folder}/rows").drop("batch"), route_records(table, listed, 50, gpu=True))


def test_a_retried_batch_writes_late_flows_once(spark, tmp_path):
    folder = str(tmp_path)
    state = spark.createDataFrame([("7", "polled", "rss", 100, 1.0, 0)], enrich.STATE_SCHEMA)
    batch = spark.createDataFrame([(1, 5), (2, 99)], "flow_id long, start_ts_ns long")
    pids = spark.createDataFrame([("7",)], "pid string")

    def split(rows):
        return rows, spark.createDataFrame([], "pid string, kind string, feature string, ts_ns long, value double, ord long")

    step = enrich.asof_step(split, folder, ["rss"], [], pids, delay_ns=15)
    for _ in range(2):
        found, _ = step(batch, state, 3, lambda df: df)
        assert [r.flow_id for r in found.collect()] == [2]
    assert [r.flow_id for r in spark.read.parquet(f"{folder}/late").collect()] == [1]


class Held:
    """A value, or a map, of a state store; and the handle that opens them."""

    def __init__(self):
        self.held, self.timers = {}, []
        self.exists, self.get, self.clear = lambda: bool(self.held), lambda: self.held[None], lambda: self.held.clear()
        self.update, self.updateValue = lambda v: self.held.update({None: v}), lambda k, v: self.held.update({k: v})
        self.getValue, self.removeKey = lambda k: self.held[k], lambda k: self.held.pop(k)
        self.getValueState = self.getMapState = lambda *_: Held()
        self.registerTimer = self.timers.append


def test_a_step_holds_a_bounded_part_of_a_keys_rows(monkeypatch):
    monkeypatch.setattr(timed, "ROWS_AT_ONCE", 100, raising=False)
    monkeypatch.setattr(timed, "BLOCK_ROWS", 8, raising=False)
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"ts_ns": rng.integers(1, 3_000, 2_000) * 1_000_000, "ord": np.arange(2_000), "bytes_in": 1, "bytes_out": 2})

    class Seen(timed.RunningBytes):
        sizes = []

        def step(self, key, part):
            self.sizes.append(len(part))
            return super().step(key, part)

    class Watermark:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    operator = Seen()
    operator.init(Held())
    found = []
    for ms, begin in ((0, 0), (0, 500), (0, 1_000), (0, 1_500), (1_500, None), (5_000, None)):
        if begin is not None:
            operator.handleInputRows(("a",), iter(rows[at : at + 50] for at in range(begin, begin + 500, 50)), None)
        else:
            found += operator.handleExpiredTimer(("a",), Watermark(ms), None)
    found = pd.concat(found)
    want = rows.groupby("ts_ns")[["bytes_in", "bytes_out"]].sum().cumsum()
    assert found["ts_ns"].tolist() == want.index.tolist()
    assert found["in_cum"].tolist() == want["bytes_in"].tolist() and found["out_cum"].tolist() == want["bytes_out"].tolist()
    assert max(operator.sizes) < 400 and not operator.index.exists() and not operator.waiting.exists()
