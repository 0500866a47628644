"""Parameters of an audit run and their canonical text form."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace


class ContractError(ValueError):
    """A data contract does not hold and the profile does not tolerate it."""


@dataclass(frozen=True)
class AuditConfig:
    """Every tunable of the audit.  Defaults are for hourly series."""

    profile: str = "commercial"
    strict: bool = True
    synthetic: bool = False
    merge_how: str = "inner"
    min_overlap: float = 0.98
    min_continuity: float = 0.98
    fit_ratio: float = 0.60
    calib_ratio: float = 0.20
    calib_start: str = "2023-10-01"
    test_start: str = "2024-01-01"
    events_per_period: float = 1.0
    rows_per_period: int = 168
    rolling_days: float = 7.0
    block_days: float = 1.0
    min_rolling_rows: int = 84
    cap_ratio: float = 1.5
    threshold_q: float = 0.999
    min_n: int = 6
    w: int = 5
    k: int = 3
    low_ratio: float = 0.98
    cooldown_hours: float = 24.0
    auto_tune: bool = True
    w_grid: tuple[int, ...] = (3, 5, 7)
    k_grid: tuple[int, ...] = (2, 3, 4)
    allow_unsatisfiable: bool = False
    z_threshold: float = 3.0
    model_ratio_alert: float = 1.05
    drift_days: float = 14.0
    drift_ratio_alert: float = 1.25
    shift_days: float = 14.0
    shift_q: float = 0.95
    shift_ratio_alert: float = 1.25
    season: tuple[str, ...] = ("hour", "is_weekend")
    fallback: str = "hour"
    lags: tuple[int, ...] = (1, 24, 168)

    def with_(self, **changes) -> "AuditConfig":
        return replace(self, **changes)

    def canonical(self) -> str:
        """Sorted, compact JSON; the text that gets digested."""
        return json.dumps(asdict(self), sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    def check_profile(self) -> None:
        """Generated data is for demonstrations only, and those are not strict."""
        if self.profile not in ("commercial", "paper", "demo"):
            raise ContractError(f"unknown profile: {self.profile}")
        if self.synthetic and self.profile != "demo":
            raise ContractError("synthetic data needs profile 'demo'")
        if self.profile == "demo" and self.strict:
            raise ContractError("profile 'demo' needs strict=False")


#: Settings for one-row-per-day series: monthly season, weekly blocks.
DAILY = AuditConfig(
    season=("month", "is_weekend"),
    fallback="month",
    lags=(1, 7, 28),
    cooldown_hours=168.0,
    rolling_days=84.0,
    block_days=7.0,
    min_rolling_rows=42,
)
