import struct

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from flowloom.functions import scalars
from flowloom.plans import jobs
from flowloom.schemas import FLOW
from flowloom.sources import idx as idx_files
from flowloom.sources import proc, readers, sinks
from tests import model


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_capture_lines(spark):
    lines = [
        "1700000000.123456 IP 10.0.0.1.443 > 10.0.0.2.5000: Flags [P.], length 8: HTTP, length 100",
        "1700000000.5 IP 10.0.0.1.443 > 10.0.0.2.5000: Flags [.], length 0",
        "1700000000.5 IP6 fe80::1.443 > fe80::2.5000: Flags [.], length 7",
        "tcpdump: listening on eth0",
        "1700000000.5 IP 10.0.0.1.http > 10.0.0.2.5000: length 7",
    ]
    found = readers.parse_capture_text(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [tuple(r) for r in found] == [
        (int(1700000000.123456 * 1_000_000_000), "1700000000.123456", "10.0.0.1", 443, "10.0.0.2", 5000, 100),
        (1700000000500000000, "1700000000.500000", "10.0.0.1", 443, "10.0.0.2", 5000, 0),
    ]


HEADER = "ts_ns,timestamp_epoch_s,source_ip,source_port,destination_ip,destination_port,packet_size\n"


def test_packet_csv_keeps_order_and_refuses_bad_numbers(spark, tmp_path):
    good = write(tmp_path / "p.csv", HEADER + "5,0.1,a,1,b,2,10\n5,0.2,a,1,b,2,20\n")
    assert [r.packet_size for r in readers.read_packets(spark, good).orderBy("ord").collect()] == [10, 20]
    for text in (HEADER + "x,0.1,a,1,b,2,10\n", HEADER.replace("ts_ns,timestamp_epoch_s", "timestamp_epoch_s,ts_ns") + "1,2,a,1,b,2,3\n"):
        bad = write(tmp_path / str(len(text)) / "q.csv", text)
        with pytest.raises(Exception):
            readers.read_packets(spark, bad).collect()


def test_series_files(spark, tmp_path):
    write(tmp_path / "vm_pid_a_pid7.csv", "ts_ns,value\n1,5\n 2 , 6.5 \nx,1\n3,nan\n4,inf\n5,1e2\n6,\n7\n8,1.5d\n")
    write(tmp_path / "vm_pid8.csv", "1,5\n2,6\n")
    write(tmp_path / "other.csv", "ts_ns,value\n1,5\n")
    write(tmp_path / "memavailable_bytes.csv", "ts_ns,value\n1,9\n")
    found = readers.read_polled(spark, str(tmp_path)).orderBy("ts_ns").collect()
    assert [(r.pid, r.feature, r.ts_ns, r.value) for r in found] == [
        ("_a_pid7", "vm", 1, 5.0),
        ("_a_pid7", "vm", 2, 6.5),
        ("_a_pid7", "vm", 5, 100.0),
    ]
    assert [(r.pid, r.value) for r in readers.read_global_series(spark, str(tmp_path)).collect()] == [(None, 9.0)]
    assert readers.read_global_series(spark, str(tmp_path / "nowhere")).count() == 0
    events = readers.read_events(spark, str(tmp_path)).collect()
    assert {(r.pid, r.ts_ns) for r in events if r.pid == "8"} == {("8", 1), ("8", 2)}


def test_numbers(spark):
    texts = ["1", " 2.5 ", "-3e2", ".5", "5.", "nan", "inf", "1.5d", "", "1 2", "0x1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        scalars.tolerant_number(F.col("t")).alias("n"), scalars.tolerant_int(F.col("t")).alias("i")
    )
    assert [r.n for r in df.collect()] == [1.0, 2.5, -300.0, 0.5, 5.0] + [None] * 6
    assert [r.i for r in df.collect()] == [1] + [None] * 10
    shown = spark.createDataFrame([(3.0,), (1.23456789,), (None,)], "v double").select(scalars.render_number(F.col("v")))
    assert [r[0] for r in shown.collect()] == ["3", "1.234568", None]
    ns = spark.createDataFrame([("1700000000.123456",)], "s string").select(scalars.epoch_s_to_ns(F.col("s")))
    assert ns.first()[0] == int(float("1700000000.123456") * 1_000_000_000)


def test_proc_snapshots(spark):
    log = [
        (1, 5, "stat", "5 (a) b) S " + " ".join(str(i) for i in range(1, 20))),
        (1, 5, "status", "Name:\tx\nVmSize:\t 10 kB\nVmRSS:\t bad kB\nXVmData: 4 kB\n"),
        (1, 5, "io", "read_bytes: 7\ncancelled_write_bytes: 9\n"),
        (1, 0, "meminfo", "MemTotal: 1 kB\nMemAvailable:    3 kB\n"),
        (2, 6, "io", "write_bytes: 8"),
    ]
    df = model.table(spark, log, "ts_ns long, pid int, file string, content string")
    found = {r.pid: r for r in proc.parse_proc_snapshots(df).collect()}
    assert set(found) == {5, 6}
    first = found[5]
    assert (first.utime_ticks, first.stime_ticks) == (11, 12)
    assert (first.vmsize_bytes, first.vmrss_bytes, first.vmdata_bytes) == (10240, 0, 0)
    assert (first.disk_read_bytes, first.disk_write_bytes, found[6].disk_write_bytes) == (7, 0, 8)
    assert [tuple(r) for r in proc.parse_memavailable(df).collect()] == [(1, 3072.0)]


def test_edges_and_pids(spark, tmp_path):
    text = "1 2\n 3,4 extra\n\nx 5\n6\n99999999999999999999 1\n7\t 8\n-1 2\n"
    found = readers.read_edges(spark, write(tmp_path / "e.txt", text)).collect()
    assert {tuple(r) for r in found} == {(1, 2), (3, 4), (7, 8)}
    pids = readers.read_pid_list(spark, write(tmp_path / "pids.txt", " 5 \nx\n\n5\n3\n"), [9])
    assert [r.pid for r in pids.collect()] == [3, 5, 9]


def test_a_line_of_an_edge_list_is_taken_apart_once(spark):
    lines = ["1\u00a02", "\u00a03\u20034\u00a0", "\u20035 6\u2003", "7,,8", "9 , 10 x", "11 12,", ",13 14", "15 16x", "+17 18", "01 002", None]
    edges = readers.parse_edges(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted(tuple(r) for r in edges.collect()) == [(1, 2), (5, 6), (7, 8), (9, 10), (11, 12)]
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1


def idx(images):
    n, h, w = images.shape
    return struct.pack(">iiii", 2051, n, h, w) + images.astype("uint8").tobytes()


def test_idx_images_and_the_kmeans_job(spark, tmp_path):
    images = np.arange(2 * 2 * 3).reshape(2, 2, 3)
    (tmp_path / "a.idx").write_bytes(idx(images))
    found = readers.read_idx_images(spark, str(tmp_path), range_bytes=1).orderBy("image").collect()
    assert [r.features for r in found] == [(images[i].ravel() / 255.0).tolist() for i in (0, 1)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "b.idx").write_bytes(idx(images)[:-1])
    with pytest.raises(Exception):
        readers.read_idx_images(spark, str(tmp_path / "bad")).collect()
    result = jobs.kmeans_job(spark, str(tmp_path / "a.idx"), k=2, iterations=3, partitions=2, copies=3)
    assert result.count == 6 and result.wssse < 1e-9
    assert [r["count"] for r in result.sizes.collect()] == [3, 3]


@pytest.mark.parametrize("range_bytes,per_file", [(1, 3), (13, 1000), (10**6, 7)])
def test_idx_files_cut_anywhere(spark, tmp_path, monkeypatch, range_bytes, per_file):
    monkeypatch.setattr(idx_files, "IMAGES_PER_FILE", per_file)
    rows = [([i, *((i * k) % 256 for k in range(1, 6))],) for i in range(40)]
    sinks.write_idx_images(model.table(spark, rows, "pixels array<int>").repartition(3), str(tmp_path / "idx"), 3)
    assert all(f.stat().st_size <= 16 + 6 * per_file for f in (tmp_path / "idx").iterdir())
    found = readers.read_idx_images(spark, str(tmp_path / "idx"), range_bytes).select("features").collect()
    assert sorted([round(x * 255) for x in r.features] for r in found) == sorted(r[0] for r in rows)


def test_a_dataset_in_order(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(str(p), None if i == 3 else int(v), i) for i, (p, v) in enumerate(zip(rng.integers(0, 3, 300), rng.permutation(300)))]
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_by_pid(model.table(spark, rows, "pid string, a long, b long"), str(tmp_path / "t"), order=["a", "b"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    assert max(len(list(f.glob("*.parquet"))) for f in (tmp_path / "t").glob("pid=*")) > 1
    for pid in "012":
        files = sorted((tmp_path / "t" / f"pid={pid}").glob("*.parquet"))
        read = [tuple(r.values()) for f in files for r in pq.read_table(f, partitioning=None).to_pylist()]
        want = sorted(((a, b) for p, a, b in rows if p == pid), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        assert read == want


def test_packets_of_many_files_are_in_the_order_of_their_names(spark, tmp_path):
    head = "ts_ns,timestamp_epoch_s,source_ip,source_port,destination_ip,destination_port,packet_size\n"
    for k, rows in enumerate([2, 40, 1, 9]):
        write(tmp_path / "p" / f"part-{k}.csv", head + "".join(f"5,0.1,a,1,b,2,{1000 * k + i}\n" for i in range(rows)))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        found = [r.packet_size for r in readers.read_packets(spark, str(tmp_path / "p")).orderBy("ord").collect()]
        one = [r.packet_size for r in readers.read_packets(spark, str(tmp_path / "p" / "part-3.csv")).orderBy("ord").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert sorted(one) == list(range(3000, 3009))
    # splits of 300 bytes lie in one unit, so only files are told apart here
    assert [x // 1000 for x in found] == [0] * 2 + [1] * 40 + [2] + [3] * 9


def test_files_of_one_name_keep_their_own_headers(spark, tmp_path):
    write(tmp_path / "p0" / "rss_pid7.csv", "ts_ns,value\n1,2\n")
    write(tmp_path / "p1" / "rss_pid7.csv", "value,ts_ns\n5,3\n")
    found = readers.read_polled(spark, str(tmp_path / "p*"))
    assert sorted((r.ts_ns, r.value) for r in found.collect()) == [(1, 2.0), (3, 5.0)]


def test_signed_pids_warn(spark, tmp_path):
    path = write(tmp_path / "pids.txt", "+5\n\n -7\nx y\n5\n")
    with pytest.warns(UserWarning, match="1 lines"):
        assert [r.pid for r in readers.read_pid_list(spark, path, signed=True).collect()] == [-7, 5]


def test_tables_come_back_as_written(spark, tmp_path):
    flow = model.table(spark, [(0, "a", 1, "b", 2, "1.0", "2.0", 5, 3, 30, 0, 1, 2)], FLOW)
    sinks.write_flows(flow, str(tmp_path / "flows"))
    assert readers.read_stage_table(spark, str(tmp_path / "flows"), FLOW).collect() == flow.collect()
    assert readers.discover_partitions(spark, str(tmp_path / "flows"), "csv").first().pid is None
    sinks.write_by_pid(flow.withColumn("pid", F.lit("7")), str(tmp_path / "by_pid"), "csv")
    assert readers.discover_partitions(spark, str(tmp_path / "by_pid"), "csv").first().pid == "7"


def test_polled_columns_are_found_by_name(spark, tmp_path):
    write(tmp_path / "rss_pid1.csv", "value,ts_ns\n5,1\nts_ns,value\n6,2\n")
    write(tmp_path / "cpu_pid1.csv", "note,ts_ns,more,value\nx,100,y,7\n")
    write(tmp_path / "gpu_pid1.csv", "time,reading\nts_ns,value\n1,5\n")
    found = sorted((r.feature, r.ts_ns, r.value) for r in readers.read_polled(spark, str(tmp_path)).collect())
    assert found == [("cpu", 100, 7.0), ("rss", 1, 5.0), ("rss", 2, 6.0)]


def test_packet_streams_refuse_other_headers(spark, tmp_path):
    good = write(tmp_path / "in" / "a.csv", HEADER + "5,0.1,a,1,b,2,10\n5,0.2,a,1,b,2,20\n")
    query = readers.stream_packets(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("seen_packets")
    query.trigger(availableNow=True).start().awaitTermination()
    assert [r.packet_size for r in spark.table("seen_packets").orderBy("packet_size").collect()] == [10, 20], good
    turned = HEADER.replace("source_ip,source_port,destination_ip,destination_port", "destination_ip,destination_port,source_ip,source_port")
    write(tmp_path / "other" / "a.csv", turned + "5,0.1,a,1,b,2,10\n")
    with pytest.raises(Exception):
        stream = readers.stream_packets(spark, str(tmp_path / "other")).writeStream.format("memory").queryName("bad_packets")
        stream.trigger(availableNow=True).start().awaitTermination()


def test_no_pids_is_an_error(spark):
    from flowloom.operators.asof import pid_names

    with pytest.raises(ValueError, match="no pids"):
        pid_names(spark.createDataFrame([], "pid string"))


def test_snapshots_of_one_time_stay_apart(spark):
    log = [(5, 7, s, "io", f"read_bytes: {10 + s}\n") for s in (0, 1)] + [(5, 7, 1, "stat", "7 (a) S" + " 1" * 10 + " 42 43")]
    df = model.table(spark, log, "ts_ns long, pid int, snapshot long, file string, content string")
    found = proc.parse_proc_snapshots(df, ("ts_ns", "pid", "snapshot")).collect()
    assert sorted((r.snapshot, r.disk_read_bytes, r.utime_ticks) for r in found) == [(0, 10, 0), (1, 11, 42)]
