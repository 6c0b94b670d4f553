"""Plain Python models of the stages, written from their description, for comparison."""

from __future__ import annotations

import random
import tempfile


def random_packets(seed: int, count: int, hot: float = 0.0, burst: float = 0.0, span: int = 4000):
    """Packets of a few keys, with many equal times; a share on one key, a share at one instant."""
    rng = random.Random(seed)
    hosts = ["h", "a", "b", "c"]
    rows = []
    for position in range(count):
        if rng.random() < hot:
            key = ("h", 1, "a", 2)
        else:
            src, dst = rng.sample(hosts, 2)
            key = (src, rng.randint(1, 2), dst, rng.randint(1, 2))
        ts = 777_000 if rng.random() < burst else rng.randint(0, span) * 1000
        rows.append((ts, f"{ts / 1e9:.9f}#{position}", *key, rng.randint(0, 90), position))
    return rows


PACKET_DDL = (
    "ts_ns long, timestamp_epoch_s string, source_ip string, source_port int, "
    "destination_ip string, destination_port int, packet_size long, ord long"
)


def flows(packets, gap_us: int, vantage):
    groups: dict = {}
    for p in packets:
        groups.setdefault(p[2:6], []).append(p)
    found = []
    for key, rows in groups.items():
        rows = sorted(rows, key=lambda r: (r[0], r[7]))
        runs = [[rows[0]]]
        for r in rows[1:]:
            if r[0] - runs[-1][-1][0] > gap_us * 1000:
                runs.append([])
            runs[-1].append(r)
        end = None
        for run in runs:
            start = run[0][0]
            who = vantage or key[0]
            found.append(
                (
                    len(found),
                    *key,
                    run[0][1],
                    run[-1][1],
                    start,
                    len(run),
                    sum(r[6] for r in run),
                    0 if end is None else (start - end) // 1000,
                    sum(p[6] for p in packets if p[4] == who and p[0] < start),
                    sum(p[6] for p in packets if p[2] == who and p[0] < start),
                )
            )
            end = run[-1][0]
    return found


def last_sample(samples, at):
    """Newest (ts, value) at or before ``at``; among equal times the later position."""
    best = None
    for ts, position, value in samples:
        if ts <= at and (best is None or (ts, position) >= best[:2]):
            best = (ts, position, value)
    return best and (best[0], best[2])


def intervals(events, interval, exact=False):
    total, prev, out = 0, 0, []
    for ts, _, size in sorted(events):
        total += size
        if ts - prev >= interval:
            out.append((prev, total if exact else total + size))
            prev, total = ts, 0
    return out


def writes(log):
    """log: (ts, position, kind, ret) of one thread."""
    state, out = None, []
    for ts, position, kind, ret in sorted(log):
        if kind == "enter":
            state = False
        elif kind == "sock_sendmsg" and state is not None:
            state = True
        elif kind == "exit":
            if state:
                out.append((ts, ret))
            state = None
    return out


def table(spark, rows, ddl):
    """Rows as a Parquet table: cheap to read again in every branch of a plan."""
    path = tempfile.mkdtemp(prefix="flowloom-test-") + "/rows"
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)
