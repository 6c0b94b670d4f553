import random

from pyspark.sql import functions as F

from flowloom.operators import asof, flows
from flowloom.operators.interval import interval_accumulate
from flowloom.operators.pairing import pair_socket_writes
from flowloom.streaming import batchwise, enrich, stateful
from flowloom.streaming import flows as stream_ops
from tests import model


def in_files(spark, tmp_path, rows, ddl, parts, by):
    """Rows in time order over several files, one micro-batch each, as a stream and as a table."""
    rows = sorted(rows, key=by)
    size = -(-len(rows) // parts)
    for part in range(parts):
        chunk = rows[part * size : (part + 1) * size]
        spark.createDataFrame(chunk, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    stream = (
        spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    )
    return stream, table


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_interval_state_survives_batches(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i * 7, rng.randint(1, 9), i) for i in range(120)]
    stream, table = in_files(spark, tmp_path, rows, "series string, ts_ns long, size long, ord long", 4, lambda r: r[1])
    found = enrich.run_to_table(stateful.interval_stream(stream, 50), str(tmp_path / "out"))
    same(found, interval_accumulate(table, 50))
    for rows_per_task in (10**6, 8):
        folder = str(tmp_path / f"batchwise{rows_per_task}")
        batchwise.interval_batches(stream, 50, folder, rows_per_task=rows_per_task).awaitTermination()
        same(spark.read.parquet(f"{folder}/rows").drop("batch"), interval_accumulate(table, 50))


def test_open_writes_survive_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 2]), rng.choice(["enter", "sock_sendmsg", "exit"]), i, i) for i in range(200)]
    stream, table = in_files(spark, tmp_path, rows, "ts_ns long, id long, kind string, ret long, ord long", 5, lambda r: r[0])
    for rows_per_task in (10**6, 10):
        folder = str(tmp_path / f"batchwise{rows_per_task}")
        batchwise.write_pair_batches(stream, folder, rows_per_task=rows_per_task).awaitTermination()
        same(spark.read.parquet(f"{folder}/rows").drop("batch"), pair_socket_writes(table))


def test_last_values_survive_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [
        (i * 10, rng.choice(["flow", "rss", "send"]), rng.choice(["1", "2"]), float(rng.randint(0, 9)), i) for i in range(90)
    ]
    stream, table = in_files(spark, tmp_path, rows, "ts_ns long, what string, pid string, value double, ord long", 3, lambda r: r[0])

    def split(df):
        probes = df.where("what = 'flow'").select(F.col("ord").alias("flow_id"), F.col("ts_ns").alias("start_ts_ns"))
        kind = F.when(F.col("what") == "rss", "polled").otherwise("event")
        samples = df.where("what != 'flow'").select("pid", kind.alias("kind"), F.col("what").alias("feature"), "ts_ns", "value", "ord")
        return probes, samples

    pids = spark.createDataFrame([("1",), ("2",)], "pid string")
    enrich.asof_stream(stream, split, str(tmp_path / "out"), ["rss"], ["send"], pids).awaitTermination()
    want = asof.extract_features(*split(table), ["rss"], ["send"], pids)
    assert want.where("rss is not null").count() > 0
    same(spark.read.parquet(str(tmp_path / "out" / "rows")).drop("batch"), want)


def test_stream_flows_and_counters_equal_batch(spark, tmp_path):
    packets = model.random_packets(4, 150, hot=0.4)
    stream, table = in_files(spark, tmp_path, packets, model.PACKET_DDL, 3, lambda r: (r[0], r[7]))
    found = enrich.run_to_table(stream_ops.flow_stream(stream, 9), str(tmp_path / "flows"), "complete")
    same(found, flows.flow_aggregate(table, 9))
    totals = enrich.run_to_table(stream_ops.counter_stream(stream), str(tmp_path / "bytes"), "complete").collect()
    for row in totals:
        assert row.bytes_in == sum(p[6] for p in packets if p[4] == row.ip)
        assert row.bytes_out == sum(p[6] for p in packets if p[2] == row.ip)


def test_append_mode_writes_a_flow_once_the_watermark_has_passed(spark, tmp_path):
    far = 10_000_000_000
    packets = [(1000, "a", "h", 1, "a", 2, 10, 0), (3000, "b", "h", 1, "a", 2, 10, 1), (far, "c", "h", 1, "a", 2, 10, 2), (2 * far, "d", "z", 1, "z", 2, 1, 3)]
    stream, _ = in_files(spark, tmp_path, packets, model.PACKET_DDL, 4, lambda r: r[0])
    found = enrich.run_to_table(stream_ops.flow_stream(stream, 5, "1 second"), str(tmp_path / "out")).collect()
    assert sorted((r.start_ts_ns, r.packet_count) for r in found) == [(1000, 2), (far, 1)]


def test_flows_behind_the_samples_of_earlier_batches(spark, tmp_path):
    """Samples at 10 and 30, then flows at 20 and, beyond the delay, at 5."""
    rows = [("s", 10, 1.0, 0), ("s", 30, 3.0, 1)], [("f", 20, None, 2), ("f", 5, None, 3), ("s", 31, 4.0, 4)]
    for part in rows:
        spark.createDataFrame(part, "kind string, ts long, value double, id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def split(batch):
        flows = batch.where("kind = 'f'").selectExpr("id as flow_id", "ts as start_ts_ns")
        return flows, batch.where("kind = 's'").selectExpr("'7' as pid", "'polled' as kind", "'rss' as feature", "ts as ts_ns", "value", "id as ord")

    pids = spark.createDataFrame([("7",)], "pid string")
    enrich.asof_stream(stream, split, str(tmp_path / "out"), ["rss"], [], pids, delay_ns=15).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out" / "rows")).collect()
    assert [(r.flow_id, r.rss) for r in found] == [(2, 1.0)]
    assert [r.flow_id for r in spark.read.parquet(str(tmp_path / "out" / "late")).collect()] == [3]
