"""Settings, with their defaults. Frozen, so that they can be captured in plans."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

# FATF lists (illustrative), as ISO codes.
HIGH_RISK = (
    "AF", "IR", "KP", "MM", "SY", "YE",
    "AL", "BB", "BF", "CM", "CD", "GI", "HT", "JM", "JO", "ML",
    "MZ", "NI", "PK", "PA", "PH", "SN", "SS", "TZ", "TT", "UG", "VU", "VN",
)
RULES = ("structuring", "rapid_movement", "round_tripping", "geographic_risk", "dormant_reactivation", "velocity")


@dataclass(frozen=True)
class RuleConfig:
    ctr_threshold: float = 10_000.0
    structuring_low: float = 8_000.0
    structuring_high: float = 9_999.99
    structuring_hours: int = 24
    structuring_min_count: int = 2
    rapid_hours: int = 4
    rapid_min_amount: float = 5_000.0
    rapid_ratio: float = 0.80
    trip_max_hops: int = 5
    trip_days: int = 30
    trip_min_amount: float = 1_000.0
    jurisdictions: tuple[str, ...] = HIGH_RISK
    dormant_days: int = 90
    dormant_min_amount: float = 5_000.0
    velocity: tuple[tuple[int, int], ...] = ((1, 5), (6, 15), (24, 30), (168, 100))  # hours, threshold
    weights: tuple[tuple[str, float], ...] = tuple(zip(RULES, (0.25, 0.20, 0.30, 0.10, 0.15, 0.10)))
    flag_above: float = 0.3


@dataclass(frozen=True)
class FeatureConfig:
    windows_days: tuple[int, ...] = (1, 7, 30, 90)
    round_thresholds: tuple[int, ...] = (100, 500, 1_000, 5_000, 10_000)
    formats: tuple[str, ...] = ("ach", "cash", "check", "credit_card", "other", "reinvestment", "wire")


@dataclass(frozen=True)
class GraphConfig:
    min_amount: float = 100.0
    window_days: int = 30
    resolution: float = 1.0
    min_community: int = 3
    max_cycle: int = 6
    max_cycles: int = 10_000
    damping: float = 0.85
    iterations: int = 100
    tolerance: float = 1e-6
    top_k: int = 100
    max_hops: int = 3
    max_subgraph: int = 500


@dataclass(frozen=True)
class ModelConfig:
    minority_ratio: float = 0.1
    neighbours: int = 5
    rounds: int = 30
    stop_gain: float = 0.01
    target_recall: float = 0.80
    thresholds: int = 100
    folds: int = 5
    test_share: float = 0.2
    seed: int = 42


@dataclass(frozen=True)
class TriageConfig:
    retries: int = 3
    wait_seconds: float = 5.0
    batch: int = 10
    pause_seconds: float = 1.0
    max_transactions: int = 50
    strictness: float = 0.90
    max_alerts: int = 50


@dataclass(frozen=True)
class AlertConfig:
    weight_rule: float = 0.30
    weight_ml: float = 0.45
    weight_graph: float = 0.25
    threshold: float = 0.50
    high: float = 0.80
    medium: float = 0.60
    sla_hours: tuple[tuple[str, int], ...] = (("HIGH", 24), ("MEDIUM", 72), ("LOW", 168))


@dataclass(frozen=True)
class Config:
    rules: RuleConfig = field(default_factory=RuleConfig)
    features: FeatureConfig = field(default_factory=FeatureConfig)
    graph: GraphConfig = field(default_factory=GraphConfig)
    model: ModelConfig = field(default_factory=ModelConfig)
    triage: TriageConfig = field(default_factory=TriageConfig)
    alerts: AlertConfig = field(default_factory=AlertConfig)

    def validate(self) -> None:
        """Raises ValueError on settings that contradict each other."""
        a = self.alerts
        if abs(a.weight_rule + a.weight_ml + a.weight_graph - 1) > 1e-9:
            raise ValueError("the weights of an alert's layers must sum to 1")
        if not a.threshold <= a.medium <= a.high:
            raise ValueError("severity thresholds must ascend")
        if self.rules.structuring_low >= self.rules.structuring_high:
            raise ValueError("the structuring range is empty")
        for part in fields(self):
            for f in fields(getattr(self, part.name)):
                if (v := getattr(getattr(self, part.name), f.name)) is not None and isinstance(v, (int, float)) and v < 0:
                    raise ValueError(f"{part.name}.{f.name} is negative")
