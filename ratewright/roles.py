"""Which column of a table plays which part, and the limits a study sets."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Roles:
    unit: str
    period: str
    filed: str
    ties: tuple[str, ...]  # break ties between filings of one day, greatest first
    group: str
    region: str
    owner: str
    code: str
    workers: str
    exposure: str
    severe_cases: tuple[str, ...]  # the cases that count towards the severe rate
    other_cases: tuple[str, ...]
    deaths: str
    size_code: str
    none_flag: str

    @property
    def cases(self) -> tuple[str, ...]:
        return (*self.severe_cases, *self.other_cases)


@dataclass(frozen=True)
class Band:
    label: str
    code: int  # the reported size code that means this band
    below: float | None = None  # workers below this; None for the last band


@dataclass(frozen=True)
class Limits:
    period_from: int | None
    period_to: int | None
    min_exposure: int
    min_ratio: float
    max_ratio: float
    prefix_length: int
    code_pattern: str  # what a well-formed code looks like
    bands: tuple[Band, ...]
    legacy_code: int
    legacy_covers: tuple[int, ...]  # size codes the legacy code spans
    target_region: str
    scope_group: str  # the group shown as a scope of its own
    scope_all_label: str
    total_label: str
    min_n: int = 30
    min_deaths: int = 10
    owner_labels: Mapping[object, str] = field(default_factory=dict)
    owner_unknown: str = "4 unknown / not coded"
    rules: tuple[str, ...] = ()
    checks: tuple[str, ...] = ()
