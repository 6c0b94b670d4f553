"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores.  Every query is run
to completion into a sink that discards rows; each is run twice and the better
time counts, so that code generation is not measured with the first one.  The flow gap is 600 s, so that flows
stay short at sf0.1; the number of flows is reported, and one run of the flow queries at a gap of one hour.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

HEADLINE = (
    "parse_capture",
    "flow_table",
    "flow_counters",
    "features",
    "flow_history",
    "flow_labels",
    "full_dataset",
    "interval_sample",
    "socket_writes",
    "event_routing",
    "metrics_unpivot",
    "pagerank",
    "kmeans_lloyd",
    "auroc",
    "qa_train",
    "full_dataset_cut",
)
BENCH_GAP_US = 600_000_000
HOUR_GAP_US = 3_600_000_000
HOUR_GAP = ("flow_table", "flow_counters", "features", "flow_history", "flow_labels", "full_dataset")
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from dataclasses import replace

    from flowloom import catalogue, surrogates
    from flowloom.session import build_session

    surrogates.SURROGATE = replace(surrogates.SURROGATE, flow_gap_us=BENCH_GAP_US)
    # at this size the cut variant gets pieces that are still worth a task
    catalogue.CUT = replace(surrogates.SURROGATE, rows_per_task=20_000)
    QUERIES = catalogue.QUERIES

    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="flowloom-bench-"))
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    first: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(RUNS):
            begun = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - begun
            first.setdefault(name, round(took, 3))
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    n_flows = QUERIES["flow_table"](spark, sf_dir).count()
    # the flow queries at the surrogate's own gap of one hour, so that figures of rounds with either gap compare
    surrogates.SURROGATE = replace(surrogates.SURROGATE, flow_gap_us=HOUR_GAP_US)
    catalogue.CUT = replace(surrogates.SURROGATE, rows_per_task=20_000)
    hour: dict[str, float] = {}
    for name in [n for n in HOUR_GAP if n in names]:
        begun = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        hour[name] = round(time.perf_counter() - begun, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "first": first,
                "flows": n_flows,
                "hour_gap": hour,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
