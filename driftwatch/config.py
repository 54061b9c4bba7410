"""Thresholds, weights, rules and texts, kept apart from the operators that use them."""

from __future__ import annotations

from dataclasses import dataclass, field

KEY = "elder_id"
DAY = "date"

# ---------------------------------------------------------------------------
# Feature order and weights (must equal the published defaults).
# ---------------------------------------------------------------------------
WEIGHTS: dict[str, float] = {
    "sad_ratio": 2.5,
    "avg_speed": 2.0,
    "pitch_variability": 1.5,
    "distress_events": 2.0,
    "sleep_efficiency": 2.5,
    "deep_sleep_ratio": 2.0,
    "sfi": 2.0,
    "hrv_rmssd": 1.5,
    "daily_activity": 2.0,
    "social_turns": 3.0,
}
FEATURES: list[str] = list(WEIGHTS)

MODALITIES: dict[str, list[str]] = {
    "acoustic": ["sad_ratio", "avg_speed", "pitch_variability", "distress_events"],
    "sleep": ["sleep_efficiency", "deep_sleep_ratio", "sfi", "hrv_rmssd"],
    "activity": ["daily_activity"],
    "social": ["social_turns"],
}

# Acoustic constants used when nothing was heard.
ACOUSTIC_DEFAULTS: dict[str, float] = {
    "sad_ratio": 0.05,
    "avg_speed": 4.0,
    "pitch_variability": 25.0,
    "distress_events": 0.0,
}

# Emotion tags in priority order, distress vocabularies.
EMOTION_TAGS: list[tuple[str, str]] = [
    ("<|HAPPY|>", "happy"),
    ("<|SAD|>", "sad"),
    ("<|ANGRY|>", "angry"),
    ("<|NEUTRAL|>", "neutral"),
    ("<|FEARFUL|>", "fearful"),
    ("<|DISGUSTED|>", "disgusted"),
    ("<|SURPRISED|>", "surprised"),
]
DISTRESS_SOUNDS = ["cry", "scream", "sigh", "groan", "moan"]
DISTRESS_EMOTIONS = ["sad", "angry", "fearful"]

# Labels and texts.
LEVEL_LABELS = {0: "正常", 1: "关注", 2: "提醒", 3: "严重"}
UNKNOWN_LABEL = "未知"
LEVEL_NAMES = {0: "NORMAL", 1: "ATTENTION", 2: "WARNING", 3: "SEVERE"}


@dataclass(frozen=True)
class RiskRule:
    """One risk type; features, directions and weights run in parallel."""

    key: str
    name: str
    features: tuple[str, ...]
    directions: tuple[str, ...]
    weights: tuple[float, ...]
    threshold_ratio: float = 2.0
    consecutive_days: int = 3

    def __post_init__(self) -> None:
        if not len(self.features) == len(self.directions) == len(self.weights):
            raise ValueError("features, directions and weights must have the same length")
        unknown = set(self.directions) - {"up", "down", "any"}
        if unknown:
            raise ValueError(f"unknown direction: {sorted(unknown)}")


def _rule(key, name, parts, ratio, days):
    feats = tuple(f for f, _ in parts)
    return RiskRule(key, name, feats, tuple(d for _, d in parts),
                    tuple(WEIGHTS[f] for f in feats), ratio, days)


# The three predefined risk types.
RISK_RULES: tuple[RiskRule, ...] = (
    _rule("depression", "抑郁风险",
          [("sad_ratio", "up"), ("avg_speed", "down"),
           ("pitch_variability", "down"), ("distress_events", "up")], 2.0, 3),
    _rule("sleep_problem", "睡眠问题",
          [("sleep_efficiency", "down"), ("deep_sleep_ratio", "down"),
           ("sfi", "up"), ("hrv_rmssd", "down")], 1.5, 3),
    _rule("social_isolation", "社交孤独",
          [("social_turns", "down"), ("daily_activity", "down"), ("sad_ratio", "up")], 1.5, 5),
)


@dataclass(frozen=True)
class Settings:
    """Every threshold of the daily and weekly jobs."""

    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    rules: tuple[RiskRule, ...] = RISK_RULES
    # data quality
    max_missing: int = 3
    offline_days: int = 3
    implausible_below: float = -100.0
    max_forward_days: int = 3
    # enrolment gate
    enrol_days: int = 14
    window: int = 7
    z_threshold: float = 3.5
    min_bad_features: int = 2
    max_outlier_ratio: float = 0.5
    # cold start
    fallback_min_days: int = 5
    fallback_lookback: int = 14
    fallback_sigma: float = 3.0
    # scoring
    sigma: float = 2.5
    ewma_alpha: float = 0.05
    ewma_min_samples: int = 20
    observation_days: int = 7
    # fine-tuning
    recent_days: int = 30
    finetune_min_days: int = 14
    merge_alpha: float = 0.3
    # levels
    attention_days: int = 1
    warning_days: int = 3
    severe_days: int = 5
    sustained_avg: float = 1.0
    high_spike: float = 1.5
    # forecaster
    hidden: int = 16
    epochs: int = 150
    lr: float = 1e-3
    patience: int = 20
    dropout: float = 0.2
    finetune_epochs: int = 50
    finetune_lr: float = 3e-4

    def __post_init__(self) -> None:
        if not 0 < self.ewma_alpha < 1:
            raise ValueError(f"ewma_alpha must lie in (0, 1), got {self.ewma_alpha}")

    def weight(self, feature: str) -> float:
        return self.weights.get(feature, 1.0)

    @property
    def weight_sum(self) -> float:
        return sum(self.weight(f) for f in FEATURES)


DEFAULTS = Settings()
