"""Parameters that every report takes; ``now`` is always given, never read from a clock."""

from __future__ import annotations

from dataclasses import dataclass

PERIODS = ("daily", "weekly", "monthly")


@dataclass(frozen=True)
class ReportParams:
    start: str
    end: str
    period: str = "daily"
    limit: int = 10
    now: str = "2024-02-01 00:00:00"

    def __post_init__(self) -> None:
        if self.period not in PERIODS:  # an unknown period counts as daily
            object.__setattr__(self, "period", "daily")
