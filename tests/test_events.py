import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.functions import scalars
from flowloom.operators import events, filters, interval
from flowloom.operators.interval import interval_accumulate
from flowloom.operators.pairing import pair_socket_writes
from tests import model

ALLOC = "series string, ts_ns long, size long, ord long"
LOG = "ts_ns long, id long, kind string, ret long, ord long"


def allocations(seed, count, span, burst=0.0):
    rng = random.Random(seed)
    return [
        (rng.choice("aaaab"), span // 2 if rng.random() < burst else rng.randint(100, 100 + span), rng.randint(1, 50), i)
        for i in range(count)
    ]


def test_any_run_of_pieces_is_one_summary():
    """Composed in any way, a run of pieces does to every entering state what its events do."""
    rng = random.Random(9)
    for _ in range(300):
        step = rng.choice([1, 5, 40])
        ts = np.sort(np.array([rng.randint(100, 100 + 8 * step) for _ in range(rng.randint(4, 40))]))
        size = np.array([rng.randint(1, 9) for _ in ts])
        cuts = [0, *sorted(rng.sample(range(1, len(ts)), rng.randint(1, 3))), len(ts)]
        pieces = [interval.summarise_piece(ts[a:b], size[a:b], step) for a, b in zip(cuts, cuts[1:])]
        while len(pieces) > 1:
            k = rng.randrange(len(pieces) - 1)
            pieces[k : k + 2] = [interval.compose(pieces[k], pieces[k + 1], step)]
        for prev in [0, *range(int(ts[0]) - step, int(ts[0]) + 1)]:
            pending = 11
            _, _, times, own = interval.emit_piece(ts, size, step, prev, pending, True)
            left = pending + int(size.sum()) - sum(own)
            assert interval.leave(pieces[0], prev, pending, step) == ((times[-1] if times else prev), left)


@pytest.mark.parametrize("fan", [2, 3])
def test_a_prefix_scan_of_many_rounds(spark, monkeypatch, fan):
    monkeypatch.setattr(interval, "FAN", fan)
    rows = allocations(3, 400, 2000, 0.2)
    found = interval_accumulate(model.table(spark, rows, ALLOC), 30, rows_per_task=9)
    whole = interval_accumulate(model.table(spark, rows, ALLOC), 30)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize("rows_per_task,every,burst", [(10**6, 50, 0), (20, 50, 0), (20, 5, 0.3), (9, 900, 0.2), (15, 1, 0)])
@pytest.mark.parametrize("exact", [False, True])
def test_interval_sums_match_model(spark, rows_per_task, every, burst, exact):
    rows = allocations(every, 300, 2000, burst)
    found = interval_accumulate(
        model.table(spark, rows, ALLOC), every, exact=exact, rows_per_task=rows_per_task
    ).collect()
    for name in "ab":
        mine = [(ts, position, size) for s, ts, size, position in rows if s == name]
        want = model.intervals(mine, every, exact)
        assert sorted((r.ts_ns, r["size"]) for r in found if r.series == name) == sorted(want)


def test_the_first_event_emits_with_stamp_zero_and_the_tail_never(spark):
    rows = [("a", 1000, 10, 0), ("a", 1001, 5, 1), ("a", 1010, 7, 2), ("a", 1011, 9, 3)]
    found = interval_accumulate(model.table(spark, rows, ALLOC), 10, clock_offset_ns=3).collect()
    assert sorted((r.ts_ns, r["size"]) for r in found) == [(3, 20), (1003, 19)]


@pytest.mark.parametrize("rows_per_task", [10**6, 25, 4])
def test_socket_writes_match_model(spark, rows_per_task):
    rng = random.Random(9)
    log = [
        (rng.randint(0, 150), rng.choice([7, 7, 7, 8]), rng.choice(["enter", "sock_sendmsg", "exit", "other"]), rng.randint(-1, 99), i)
        for i in range(400)
    ]
    found = pair_socket_writes(model.table(spark, log, LOG), rows_per_task=rows_per_task).collect()
    for thread in (7, 8):
        mine = [(ts, position, kind, ret) for ts, t, kind, ret, position in log if t == thread]
        assert sorted((r.ts_ns, r["size"]) for r in found if r.id == thread) == sorted(model.writes(mine))


def test_only_entries_of_the_target_open_a_call(spark):
    mine, other = (5 << 32) + 1, (6 << 32) + 1
    log = [(t, i, k, 40, t) for i in (mine, other) for t, k in enumerate(["enter", "sock_sendmsg", "exit"])]
    found = pair_socket_writes(model.table(spark, log, LOG), pid=5).collect()
    assert [(r.id, r.ts_ns) for r in found] == [(mine, 2)]


def test_routing_sums_shared_probes_once_and_copies_them(spark):
    rows = [("cuda_mem", 1, 100, 5, 0), ("cuda_mem", 9, 120, 6, 1), ("sendto", 1, 50, 40, 2), ("sendto", 3, 51, 41, 3), ("odd", 1, 1, 1, 4)]
    probes = model.table(spark, rows, "probe string, pid int, ts_ns long, size long, ord long")
    pids = model.table(spark, [("1",), ("2",)], "pid string")
    found = {tuple(r) for r in events.route_records(probes, pids, 10, gpu=True).collect()}
    shared = {("cuda_allocations", p, t, s) for p in "12" for t, s in [(0, 10), (100, 12)]}
    assert found == shared | {("sendto", "1", 50, 40)}
    assert {r.record for r in events.route_records(probes, pids, 10).collect()} == {"sendto"}


def test_collective_sizes(spark):
    rows = [(c, 10) for c in range(8)]
    df = model.table(spark, rows, "dtype int, count long").select(
        "dtype", scalars.collective_bytes(F.col("count"), F.col("dtype")).alias("b")
    )
    assert {r.dtype: r.b for r in df.collect()} == {0: 10, 1: 40, 2: 40, 3: 80, 4: 80, 5: 20, 6: 10, 7: 10}


def test_filters(spark):
    sends = model.table(spark, [(33,), (32,), (-1,)], "size long")
    assert [r["size"] for r in filters.send_size_filter(sends).collect()] == [33]
    raw = [("tcp", 60, 5, 5, 80, 90), ("tcp", 40, 5, 5, 80, 90), ("tcp", 60, 5, 5, 22, 90), ("udp", 60, 5, 5, 80, 90)]
    headers = model.table(spark, raw, "proto string, ip_len int, ip_hl int, tcp_off int, source_port int, destination_port int")
    assert filters.payload_filter(headers).count() == 1
    with pytest.raises(ValueError):
        filters.valid_labels(model.table(spark, [(1.0,), (2.0,), (None,)], "label double"))
