"""Detector settings."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from fractions import Fraction

SECOND_US = 1_000_000


@dataclass(frozen=True)
class DetectionConfig:
    """Thresholds and windows of the six brute-force rules; durations are in seconds.

    ``rapid_window`` is the short gap that earns the rapid-attempt bonus. It is a setting of its own and
    does not follow ``burst_window``.
    """

    failed_login_score: int = 2
    repeat_penalty: int = 3
    rapid_attempt_bonus: int = 5
    risk_threshold: int = 10
    time_window: float = 60
    burst_window: float = 5
    burst_threshold: int = 3
    alert_cooldown: float = 30
    ip_ttl: float = 600
    score_decay_per_second: float | Fraction = 0.5
    baseline_min_samples: int = 10
    baseline_max_history: int = 100
    baseline_default_threshold: int = 5
    baseline_std_multiplier: float = 2.0
    global_time_window: float = 60
    global_threshold: int = 50
    escalation_window: float = 300
    escalation_threshold: int = 10
    subnet_window: float = 60
    subnet_threshold: int = 30
    subnet_prefixlen: int = 24
    rapid_window: float = 5

    def __post_init__(self):
        for name in DURATIONS:
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        for name in ("time_window", "global_time_window", "escalation_window", "subnet_window"):
            if self.us(name) < 1:
                raise ValueError(f"{name} must be at least one microsecond")
        if self.score_decay_per_second < 0 or self.baseline_std_multiplier < 0:
            raise ValueError("score_decay_per_second and baseline_std_multiplier must not be negative")
        if self.baseline_max_history < 1:
            raise ValueError("baseline_max_history must be at least 1")

    @classmethod
    def from_dict(cls, values: dict) -> "DetectionConfig":
        known = {f.name for f in fields(cls)}
        unknown = sorted(set(values) - known)
        if unknown:
            raise ValueError(f"unknown detection settings: {unknown}")
        return cls(**values)

    def scaled(self, k: int) -> "DetectionConfig":
        """The same rules on a clock that runs ``k`` times slower."""
        longer = {name: getattr(self, name) * k for name in DURATIONS}
        return replace(self, score_decay_per_second=self.decay_rate / k, **longer)

    def us(self, name: str) -> int:
        """A duration in microseconds."""
        return round(getattr(self, name) * SECOND_US)

    @property
    def decay_rate(self) -> Fraction:
        return as_fraction(self.score_decay_per_second)

    @property
    def decay_units(self) -> int:
        """Score units lost per microsecond, a whole number by choice of ``units_per_point``."""
        return self.decay_rate.numerator

    @property
    def units_per_point(self) -> int:
        return SECOND_US * self.decay_rate.denominator


DURATIONS = (
    "time_window",
    "burst_window",
    "alert_cooldown",
    "ip_ttl",
    "global_time_window",
    "escalation_window",
    "subnet_window",
    "rapid_window",
)


def as_fraction(value) -> Fraction:
    if isinstance(value, Fraction):
        return value
    return Fraction(str(value))
