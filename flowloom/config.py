"""Run parameters shared by the operators and plans."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any, Mapping

# Default polled features, in configured order.
POLLED_FEATURES = (
    "disk_read_bytes",
    "disk_write_bytes",
    "vmsize_bytes",
    "stime_ticks",
    "vmdata_bytes",
    "vmrss_bytes",
    "utime_ticks",
)


# Rows of a key, or of a time line, that one task sorts: keys of twice as many are cut. A sort of so many
# wide rows takes some hundred megabytes.
ROWS_PER_TASK = 1_000_000


@dataclass(frozen=True)
class Settings:
    """Parameters of the dataset build.

    ``rows_per_task`` is the only physical setting: a key with clearly more
    rows than this is cut into several time-ordered pieces, so that no single
    task has to sort the whole key (see ``operators.splits``).
    """

    host_ip: str | None = "192.168.60.81"
    flow_gap_us: int = 5000
    polled_features: tuple[str, ...] = POLLED_FEATURES
    sample_interval_ns: int = 500_000
    history_k: int = 5
    elephant_fraction: float = 0.10
    link_mbps: float = 1000.0
    rows_per_task: int = ROWS_PER_TASK

    @property
    def elephant_bps(self) -> float:
        return self.elephant_fraction * self.link_mbps * 1_000_000.0

    def with_(self, **changes: Any) -> "Settings":
        return replace(self, **changes)

    @classmethod
    def from_mapping(cls, values: Mapping[str, Any]) -> "Settings":
        """Build settings from a flat mapping, refusing unknown names."""
        known = {f.name for f in fields(cls)}
        unknown = sorted(set(values) - known)
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        fixed = dict(values)
        if "polled_features" in fixed:
            fixed["polled_features"] = tuple(fixed["polled_features"])
        return cls(**fixed)
