"""Tunables of the curation engine, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    """Defaults of a build and its audit."""

    seed: int = 42
    max_per_shape: int = 2
    max_source_share: float = 0.70
    normal_per_attack: int = 3
    train_fraction: float = 0.80
    min_len: int = 2
    max_len: int = 4096
    source_row_ceiling: dict[str, int] = field(default_factory=dict)
    warn_class_share: float = 0.50
    shape_conflict_threshold: float = 0.05
    threshold: float = 0.5
    z95: float = 1.959963984540054
    small_n: int = 30
    length_tolerance: int = 5
    length_tolerance_share: float = 0.10
    neardup_strict: float = 0.90
    neardup_loose: float = 0.80
    difflib_ratio: float = 0.90
    separability_cap: int = 3000
    separability_min_train: int = 25
    separability_min_test: int = 10
    bootstrap_rounds: int = 2000


DEFAULT = Config()
