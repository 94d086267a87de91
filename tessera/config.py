"""Parameters of the operators as frozen records that check themselves."""

from __future__ import annotations

from dataclasses import dataclass, fields


def _sums_to_one(x, names: tuple[str, ...]) -> None:
    total = sum(getattr(x, n) for n in names)
    if abs(total - 1) > 0.01:
        raise ValueError(f"{type(x).__name__}: the weights sum to {total}, not 1")


@dataclass(frozen=True)
class ConfidenceConfig:
    agreement: float = 0.4
    count: float = 0.3
    quality: float = 0.2
    recency: float = 0.1
    least: int = 2
    most: int = 10
    decay_days: int = 365

    def __post_init__(self):
        _sums_to_one(self, ("agreement", "count", "quality", "recency"))
        if not 1 <= self.least <= self.most:
            raise ValueError("ConfidenceConfig: 1 <= least <= most must hold")


@dataclass(frozen=True)
class QualityConfig:
    authority: float = 0.3
    content: float = 0.25
    recency: float = 0.2
    corroboration: float = 0.15
    relevance: float = 0.1

    def __post_init__(self):
        _sums_to_one(self, tuple(f.name for f in fields(self)))


@dataclass(frozen=True)
class PromptConfig:
    confidence_threshold: float = 0.7
    max_evidence_length: int = 500

    def __post_init__(self):
        if not 0 <= self.confidence_threshold <= 1:
            raise ValueError("PromptConfig: confidence_threshold must be in [0, 1]")
        if self.max_evidence_length < 50:
            raise ValueError("PromptConfig: max_evidence_length must be at least 50")
