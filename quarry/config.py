"""Defaults of all operators in one place.  The numbers are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # source
    max_entries: int = 100_000
    train_ratio: float = 0.9
    shuffle_k_train: int = 1
    shuffle_k_test: int = 2
    # encoder
    filters: int = 24
    filter_len: int = 8
    sparsity: int = 32
    height: int = 12
    # pattern mining
    support_from: int = 200
    support_to: int = 10
    support_step: int = 5
    max_trigger: int = 1000
    max_keep: int = 500
    base_quantile: float = 0.01
    base_support: int = 3
    levels: tuple[float, ...] = (0.05, 0.15, 0.25, 0.35, 0.45, 0.5, 0.65, 0.75)
    # matrices
    ps_ic: float = 0.0001
    ps_freq: float = 0.01
    ps_allr: float = 0.01
    ic_effective: float = 0.5
    ic_window: int = 3
    # trim and expansion
    ic_trim: float = 1.0
    ic_expand: float = 0.1
    coverage: float = 0.975
    expand_pseudo: float = 1.0
    min_width: int = 8
    # merging
    allr: float = 0.875
    max_len_gap: int = 80
    redundancy_window: int = 5
    redundancy_jaccard: float = 0.95
    offset_tolerance: int = 4
    # thresholds
    granularity: float = 0.1
    p_small: float = 0.0003
    p_mid: float = 0.0001
    p_large: float = 0.0001
    max_segment: int = 15
    grid_step: float = 0.5
    # report
    significance: float = 1e-5
    insignificance: float = 1e-10
    component_cut: float = 2.75
    big_pattern: int = 80

    def touzet_p(self, width: int) -> float:
        return self.p_small if width <= 9 else self.p_mid if width <= 11 else self.p_large

    @staticmethod
    def epochs(n: int) -> int:
        """Training epochs by the number of sequences."""
        return 25 if n < 1_000 else 10 if n < 10_000 else 5 if n < 100_000 else 3


DEFAULT = Config()
