import random

import pytest
from pyspark.sql import functions as F

from flowloom.config import Settings
from flowloom.operators import asof, history, labels, splits
from flowloom.plans.dataset import build_dataset, extract_flows
from tests import model

SERIES = "pid string, kind string, feature string, ts_ns long, value double, ord long"
FLOW = "flow_id long, start_ts_ns long"


def series(seed, count, hot=0.0, burst=0.0):
    rng = random.Random(seed)
    names = [("polled", "rss"), ("polled", "ticks"), ("event", "send"), ("event", "alloc")]
    rows = []
    for i in range(count):
        kind, feature = names[2] if rng.random() < hot else rng.choice(names)
        pid = "1" if rng.random() < hot else rng.choice(["1", "2", "3"])
        if kind == "polled" and pid == "3":
            kind, feature = "event", "alloc"
        ts = 500 if rng.random() < burst else rng.randint(0, 1000)
        rows.append((pid, kind, feature, ts, float(rng.randint(0, 99)) / 8, i))
    for i in range(count, count + 20):
        rows.append((None, "polled", "mem", rng.randint(0, 1000), float(i), i))
    return rows


def expected(flows, rows):
    pids = sorted({r[0] for r in rows if r[0]})
    polled = {(r[0], r[2]) for r in rows if r[0] and r[1] == "polled"}
    out = {}
    for pid in pids:
        for flow_id, start in flows:
            cells = {}
            for kind, feature in [("polled", "rss"), ("polled", "ticks"), ("polled", "mem"), ("event", "send"), ("event", "alloc")]:
                owner = None if feature == "mem" else pid
                mine = [(r[3], r[5], r[4]) for r in rows if r[0] == owner and r[1] == kind and r[2] == feature]
                if feature == "mem" and not any(p == pid for p, _ in polled):
                    mine = []
                hit = model.last_sample(mine, start) if start is not None else None
                cells[feature] = hit and round(hit[1], 6)
                if kind == "event":
                    cells[f"tt_{feature}"] = hit and round(max(0, (start - hit[0]) / 1e9), 6)
            out[(pid, flow_id)] = cells
    return out


@pytest.mark.parametrize("rows_per_task,hot,burst", [(10**6, 0, 0), (40, 0.5, 0), (15, 0.4, 0.4)])
def test_asof_matches_model(spark, rows_per_task, hot, burst):
    rng = random.Random(1)
    starts = [(i, 500 if rng.random() < burst else rng.randint(0, 1000)) for i in range(150)] + [(150, None), (151, -5)]
    rows = series(2, 300, hot, burst)
    found = asof.extract_features(
        model.table(spark, starts, FLOW), model.table(spark, rows, SERIES), rows_per_task=rows_per_task
    )
    assert found.columns == ["pid", "flow_id", "start_ts_ns", "mem", "rss", "ticks", "alloc", "tt_alloc", "send", "tt_send"]
    want = expected(starts, rows)
    got = found.collect()
    assert len(got) == len(want)
    for r in got:
        assert {c: r[c] for c in found.columns[3:]} == want[(r.pid, r.flow_id)]


def test_a_sample_at_the_start_counts_and_the_later_of_two_wins(spark):
    rows = [("1", "polled", "a", 100, 1.0, 0), ("1", "polled", "a", 100, 2.0, 1), ("1", "polled", "a", 101, 3.0, 2)]
    found = asof.extract_features(model.table(spark, [(0, 100), (1, 99)], FLOW), model.table(spark, rows, SERIES))
    assert {r.flow_id: r.a for r in found.collect()} == {0: 2.0, 1: None}


def test_an_own_series_beats_the_global_one_and_an_event_beats_a_polled_name(spark):
    rows = [
        (None, "polled", "mem", 1, 9.0, 0),
        ("1", "polled", "mem", 1, 1.0, 1),
        ("2", "polled", "x", 1, 2.0, 2),
        ("2", "event", "x", 1, 5.0, 3),
    ]
    found = asof.extract_features(model.table(spark, [(0, 10)], FLOW), model.table(spark, rows, SERIES))
    assert {r.pid: (r.mem, r.x) for r in found.collect()} == {"1": (1.0, None), "2": (9.0, 5.0)}


def test_missing_counts_only_name_series_the_pid_has(spark):
    rows = [("1", "polled", "a", 50, 1.0, 0), ("2", "event", "b", 10, 1.0, 1)]
    frame = model.table(spark, rows, SERIES)
    found = asof.extract_features(model.table(spark, [(0, 20), (1, 60)], FLOW), frame)
    assert [tuple(r) for r in asof.missing_counts(found, frame).collect()] == [("1", "a", 1)]


KEYED = "src_ip string, src_port int, dst_ip string, dst_port int, start_ts_ns long, total_size long, note string"


def keyed_rows(seed, count, hot):
    rng = random.Random(seed)
    times = rng.sample(range(count * 3), count)
    return [
        ("h", 1, "a", 2, t, t * 7, "n") if rng.random() < hot else (rng.choice("ab"), rng.randint(1, 2), "c", 3, t, t * 7, "n")
        for t in times
    ]


@pytest.mark.parametrize("rows_per_task", [10**6, 25, 2])
def test_history_is_the_previous_rows_of_the_key(spark, rows_per_task):
    rows = keyed_rows(4, 300, 0.5)
    found = history.add_history(model.table(spark, rows, KEYED), 3, rows_per_task=rows_per_task)
    assert [c for c in found.columns if c.startswith("total_size_t")] == [f"total_size_t{j}" for j in (1, 2, 3)]
    got = found.collect()
    assert len(got) == 300
    for r in got:
        past = sorted((x[4] for x in rows if x[:4] == tuple(r[:4]) and x[4] < r.start_ts_ns), reverse=True)
        want = [t * 7 for t in past[:3]] + [None] * (3 - len(past[:3]))
        assert [r.total_size_t1, r.total_size_t2, r.total_size_t3] == want


def test_rows_with_a_null_key_have_no_history(spark):
    rows = [(None, 1, "a", 2, t, t, "n") for t in range(5)]
    found = history.add_history(model.table(spark, rows, KEYED), 1).collect()
    assert len(found) == 5 and all(r.total_size_t1 is None for r in found)


def test_numeric_scan_looks_at_values(spark):
    df = model.table(spark, [("x", "1", None, "nan"), ("y", "z", None, "q")], "a string, b string, c string, d string")
    assert history.numeric_columns(df, scan=True) == ["b"]
    assert history.numeric_columns(df) == []


@pytest.mark.parametrize("rows_per_task", [10**6, 20, 3])
def test_next_size_of_the_source(spark, rows_per_task):
    rng = random.Random(6)
    rows = [(rng.choice("hhha"), rng.randint(1, 3), rng.choice("xyz"), i, rng.randint(0, 60), i, "n") for i in range(250)]
    found = labels.lead_next_size(model.table(spark, rows, KEYED), rows_per_task).collect()
    for src in "ha":
        line = sorted((r for r in rows if r[0] == src), key=lambda r: (r[4], r[1], r[2], r[3]))
        want = {a[5]: b[5] for a, b in zip(line, line[1:])} | {line[-1][5]: None}
        assert {r.total_size: r.y_next_size for r in found if r.src_ip == src} == want


def test_labels_at_their_boundaries(spark):
    rows = [("a", "1.0", "1.0", 100, 1), ("a", "1.0", "2.0", 12_500_000, 2), ("a", "1.0", "2.0", 12_500_001, 3), ("a", "nan", "x", 5, 4)]
    df = model.table(spark, rows, "src_ip string, start_time string, end_time string, total_size long, start_ts_ns long")
    found = {r.start_ts_ns: r for r in labels.add_labels(df).collect()}
    assert (found[1].duration_s, found[1].avg_rate_bps, found[1].y_is_elephant) == (None, None, 0)
    assert (found[2].avg_rate_bps, found[2].y_is_elephant) == (1e8, 0)
    assert found[3].y_is_elephant == 1
    assert (found[4].duration_s, found[4].y_is_elephant, found[4].y_next_size) == (None, 0, None)


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="end_time, start_time"):
        labels.add_labels(model.table(spark, [(1, 2)], "start_ts_ns long, total_size long"))


@pytest.mark.parametrize("rows_per_task", [10**6, 30])
def test_the_whole_dataset_equals_its_stages(spark, rows_per_task):
    packets = model.table(spark, 
        [(p[0], f"{p[0] / 1e9:.6f}", *p[2:]) for p in model.random_packets(21, 400, hot=0.4)], model.PACKET_DDL
    )
    rows = [(p, k, f, t * 4000, v, o) for p, k, f, t, v, o in series(8, 200)]
    samples = model.table(spark, rows, SERIES)
    settings = Settings(host_ip="h", flow_gap_us=9, rows_per_task=10**6)
    staged = asof.extract_features(extract_flows(packets, settings), samples)
    staged = labels.add_labels(history.add_history(staged, 5), settings.elephant_bps)
    whole = build_dataset(packets, samples, settings.with_(rows_per_task=rows_per_task), durable=rows_per_task == 30)
    assert whole.columns == staged.columns
    assert sorted(map(str, whole.collect())) == sorted(map(str, staged.collect()))
    assert whole.count() == 3 * whole.select("flow_id").distinct().count()
    assert whole.agg(F.max("flow_id")).first()[0] + 1 == whole.select("flow_id").distinct().count()


def test_the_whole_dataset_with_few_cuts_for_pieces_of_three_rows(spark, monkeypatch):
    """The driver's bound on cuts makes pieces larger and changes no row."""
    found = []
    find = splits._global_cuts
    monkeypatch.setattr(splits, "_global_cuts", lambda *a: found.append(find(*a)) or found[-1])
    packets = model.table(spark, [(p[0], f"{p[0] / 1e9:.6f}", *p[2:]) for p in model.random_packets(21, 200, hot=0.4)], model.PACKET_DDL)
    samples = model.table(spark, [(p, k, f, t * 4000, v, o) for p, k, f, t, v, o in series(8, 100)], SERIES)
    settings = Settings(host_ip="h", flow_gap_us=9)
    whole = sorted(map(str, build_dataset(packets, samples, settings).collect()))
    monkeypatch.setattr(splits, "MAX_CUTS", 6)
    assert sorted(map(str, build_dataset(packets, samples, settings.with_(rows_per_task=3)).collect())) == whole
    assert 0 < max(len(s.cuts) for s in found) <= 2 * 6


def test_a_time_line_of_three_million_rows_is_cut(spark):
    rows = spark.range(3_000_000).select(F.col("id").alias("ts_ns"))
    cut = asof.time_splits((rows, "ts_ns")).attach(rows).groupBy("_chunk").count().collect()
    assert len(cut) > 1 and max(r["count"] for r in cut) <= 2_000_000
