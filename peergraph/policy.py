"""The thresholds of the analysis: one immutable record. Its values become literals in plans."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Policy:
    # Names and defaults.
    min_cohort: int = 5
    cohort_basis_floor: int = 5
    outlier_factor: float = 3.0
    min_fan_in: int = 5
    top: int = 15
    high_cc: int = 10
    min_decision_cc: int = 5
    concealed_top_rank: float = 3.0
    boundary_top_fraction: float = 0.05
    hub_min: int = 5
    god_object_members: int = 20
    min_kind_span: int = 3
    stable_threshold: float = 0.2
    isolated_threshold: float = 0.8
    breaks_alone_min_fan_in: int = 1
    concealed_fan_in_ceiling: float = 2.0
    concealed_fan_out_ceiling: float = 2.0
    blast_fan_in_multiple: float = 2.0
    blast_top_fraction: float = 0.05
    blast_complexity_percentile: float = 70.0
    change_cost_top_fraction: float = 0.05
    roll_call_divisor: int = 3
    surface_outlier_multiple: float = 1.5
    surface_outlier_floor: float = 1.0
    max_named_surfaces: int = 5
    global_fan_in_percentile: float = 90.0
    global_complexity_percentile: float = 90.0
    global_complexity_floor: float = 1.0
    min_tangle: int = 4

    def __post_init__(self) -> None:
        for name, value in self.values():
            if not math.isfinite(value) or value < 0:
                raise ValueError(f"{name} must be a finite number of 0 or more, not {value}")
            if name.endswith("_percentile") and value > 100:
                raise ValueError(f"{name} must be at most 100, not {value}")
            if name.endswith("_fraction") and value > 1:
                raise ValueError(f"{name} must be at most 1, not {value}")
        for name, least in (("roll_call_divisor", 1), ("max_named_surfaces", 1), ("min_cohort", 2), ("cohort_basis_floor", 2)):
            if getattr(self, name) < least:
                raise ValueError(f"{name} must be at least {least}")
        if self.boundary_top_fraction <= 0:
            raise ValueError("boundary_top_fraction must be above 0")

    def values(self) -> list[tuple[str, float]]:
        """All values in order."""
        return [(f.name, getattr(self, f.name)) for f in fields(self)]

    def overrides(self) -> list[tuple[str, float]]:
        """The values that differ from the defaults, in order."""
        return [(f.name, getattr(self, f.name)) for f in fields(self) if getattr(self, f.name) != f.default]

    def is_default(self) -> bool:
        return not self.overrides()

    @property
    def roll_call_threshold(self) -> int:
        return self.top // self.roll_call_divisor

    def surface_threshold(self, median: float) -> float:
        return max(median * self.surface_outlier_multiple, self.surface_outlier_floor)

    @staticmethod
    def flag_for(name: str) -> str:
        """The command-line flag of a value."""
        return "--" + name.replace("_", "-")
