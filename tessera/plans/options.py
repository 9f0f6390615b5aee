"""Option records of the operators; they check themselves when made."""

from __future__ import annotations

from dataclasses import dataclass


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class SortOptions:
    descending: bool = False
    nulls: str = "last"

    def __post_init__(self) -> None:
        _need(self.nulls in ("first", "last"), "nulls must be first or last")


@dataclass(frozen=True)
class JoinOptions:
    right_suffix: str = "_right"


@dataclass(frozen=True)
class AsofOptions:
    strategy: str = "previous"
    right_suffix: str = "_right"

    def __post_init__(self) -> None:
        _need(self.strategy in ("previous", "next", "nearest"), "strategy must be previous, next or nearest")


@dataclass(frozen=True)
class RollingOptions:
    """``min_periods`` left out means a full window."""

    window: int
    min_periods: int | None = None

    def __post_init__(self) -> None:
        _need(self.window > 0, "window must be positive")
        if self.min_periods is None:
            object.__setattr__(self, "min_periods", self.window)
        _need(0 < self.min_periods <= self.window, "min_periods must lie between 1 and window")


@dataclass(frozen=True)
class ExpandingOptions:
    min_periods: int = 1

    def __post_init__(self) -> None:
        _need(self.min_periods > 0, "min_periods must be positive")


@dataclass(frozen=True)
class LagOptions:
    periods: int = 1

    def __post_init__(self) -> None:
        _need(self.periods > 0, "periods must be positive")


@dataclass(frozen=True)
class BucketOptions:
    buckets: int = 10
    lower_quantile: float = 0.05
    upper_quantile: float = 0.95
    min_periods: int = 1

    def __post_init__(self) -> None:
        _need(self.buckets > 0 and self.min_periods > 0, "buckets and min_periods must be positive")
        _need(0 <= self.lower_quantile <= self.upper_quantile <= 1, "quantiles must be ordered and between 0 and 1")


@dataclass(frozen=True)
class EmaOptions:
    alpha: float = 0.5
    min_periods: int = 1

    def __post_init__(self) -> None:
        _need(0 < self.alpha <= 1 and self.min_periods > 0, "alpha must lie in (0, 1], min_periods be positive")


@dataclass(frozen=True)
class ClipOptions:
    lower: float
    upper: float

    def __post_init__(self) -> None:
        _need(self.lower <= self.upper, "lower must not exceed upper")
