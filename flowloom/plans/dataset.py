"""The dataset build: packets to flows, features, history and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame

from flowloom.config import Settings
from flowloom.operators.asof import STATES, fan_out_by_pid, flow_states, series_names, time_splits
from flowloom.operators.asof import extract_features as _features
from flowloom.operators.counters import asof_strict
from flowloom.operators.flows import flow_aggregate, number_flows, packet_splits
from flowloom.operators.history import add_history, numeric_columns
from flowloom.operators.labels import add_labels
from flowloom.operators.splits import Splits, find_splits
from flowloom.schemas import FLOW_COLUMNS
from flowloom.session import checkpoint

LABEL_COLUMNS = ("duration_s", "avg_rate_bps", "y_is_elephant", "y_next_size")


def extract_flows(
    packets: DataFrame, settings: Settings = Settings(), durable: bool = False
) -> DataFrame:
    """PIP-01: the 13-column flow table of a packet table.

    ``durable`` checkpoints the flows before they are numbered, since numbering
    reads its input up to three times: ask for it wherever flows are costly to redo.
    """
    rows = settings.rows_per_task
    flows = flow_aggregate(packets, settings.flow_gap_us, rows)
    counted = asof_strict(flows, packets, settings.host_ip, rows)
    if durable:
        counted = checkpoint(counted)
    return number_flows(counted, rows).select(*FLOW_COLUMNS)


def extract_features(
    flows: DataFrame, series: DataFrame, settings: Settings = Settings(), **names
) -> DataFrame:
    """PIP-02: every flow once per pid, with its latest samples."""
    return _features(flows, series, rows_per_task=settings.rows_per_task, **names)


def add_feature_history(
    flows: DataFrame,
    series: DataFrame,
    packets: DataFrame,
    settings: Settings = Settings(),
    polled: list[str] | None = None,
    events: list[str] | None = None,
) -> DataFrame:
    """PIP-02 and PIP-03: features and the history of flows and features, with cuts found in the source tables."""
    rows = settings.rows_per_task
    by_time = time_splits((packets, "ts_ns"), (series, "ts_ns"), rows_per_task=rows)
    return _featured_history(flows, series, settings, polled, events, packet_splits(packets, rows), by_time)


def _featured_history(
    flows: DataFrame,
    series: DataFrame,
    settings: Settings,
    polled: list[str] | None,
    events: list[str] | None,
    by_flow: Splits,
    by_time: Splits,
    labels: tuple[str, ...] = (),
) -> DataFrame:
    """Each flow meets its states and its past once, and is copied per pid at the very end.

    Pids share their flows, so the K flows before one are the same for all of them.
    """
    rows, k = settings.rows_per_task, settings.history_k
    stated, features = flow_states(flows, series, polled, events, rows_per_task=rows, splits=by_time)
    lagged = [c for c in numeric_columns(flows) if c not in labels]
    past = add_history(stated, k, lagged, rows, by_flow, along=[STATES])
    return fan_out_by_pid(past, features, lagged, k, labels)


def build_dataset(
    packets: DataFrame,
    series: DataFrame,
    settings: Settings = Settings(),
    polled: list[str] | None = None,
    events: list[str] | None = None,
    durable: bool = False,
) -> DataFrame:
    """PIP-05: flows, features, history and labels in one plan.

    Labels depend on flows alone, and the past of a flow is the same for all pids, so flows are
    copied per pid at the very end.  All cut points come from the source tables, never from the
    flows being computed.  With ``durable`` the
    flow table is checkpointed to the shared folder, so that later stages and lost executors do
    not replay the packets.
    """
    rows = settings.rows_per_task
    by_flow = packet_splits(packets, rows)
    sources = packets.withColumnRenamed("source_ip", "src_ip")
    by_source = find_splits(sources, ("src_ip",), "ts_ns", None, rows)
    by_time = time_splits((packets, "ts_ns"), (series, "ts_ns"), rows_per_task=rows)
    if polled is None or events is None:
        polled, events = series_names(series)

    flows = flow_aggregate(packets, settings.flow_gap_us, rows, by_flow)
    flows = asof_strict(flows, packets, settings.host_ip, rows)
    if durable:
        flows = checkpoint(flows)
    flows = number_flows(flows, rows).select(*FLOW_COLUMNS)
    labelled = add_labels(flows, settings.elephant_bps, rows, by_source)
    return _featured_history(labelled, series, settings, polled, events, by_flow, by_time, LABEL_COLUMNS)
