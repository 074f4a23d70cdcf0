"""Parameters of the pipeline, with their defaults."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class Config:
    seed: int = 42
    # rows of the splits in the order of time; the rest is for monitoring
    train_n: int = 273_000
    val_n: int = 58_500
    test_n: int = 58_500
    full_n: int = 590_540
    window_rows: int = 3000
    windows: int = 50
    sample_n: int = 0
    # rows that statistics are fitted on: train, or all (which leaks, for comparison)
    fit_on: str = "train"
    # columns that go, by the training rows
    drop_missing: float = 0.90
    near_const_share: float = 0.995
    flag_min: float = 0.05
    flags_for_any_missing: bool = False
    # imputation
    knn_max: float = 0.50
    knn_k: int = 5
    knn_ref: int = 50_000
    knn_anchor_max: int = 24
    anchor_missing: float = 0.01
    # outliers and skew
    winsor: tuple[float, float] = (0.01, 0.99)
    skew_abs: float = 2.0
    skew_method: str = "signed_log1p"
    # reduction
    drop_duplicates: bool = False
    corr_thr: float = 0.95
    k_sel: int = 48
    track_b_max: int = 64
    pca_var: float = 0.95
    pca_max_per_block: int = 5
    pca_single_block: bool = False
    drift_filter: bool = False
    psi_high: float = 0.25
    auc_ties: str = "average"
    importance: str = "auc"
    gbt_rounds: int = 400
    # month and year are no features, since they tell the time of the split
    exclude_time_proxies: bool = True
    # encoding
    freq_top: int = 50_000
    freq_normalize: bool = False
    missing_code: int | None = None
    # whether M columns with other values than T and F are coded by rank, instead of -1 for these values
    flags_by_rank: bool = False
    use_d1_uid: bool = True
    reference_epoch: int = 1_512_086_400
    day_of_week_offset: int = 4
    # Features that reduction never drops, and raw columns that column pruning leaves alone
    protect: tuple[str, ...] = ("TransactionAmt_log", "card_velocity", "amt_to_avg_card_ratio", "transaction_hour", "card1_freq")
    never_drop: tuple[str, ...] = (
        *("TransactionAmt", "card1", "card2", "card3", "card4", "card5", "card6", "addr1", "addr2", "ProductCD"),
        *(f"C{i}" for i in range(1, 15)),
        *("D1", "D15", "P_emaildomain", "R_emaildomain"),
        *(f"M{i}" for i in range(1, 10)),
    )

    def __post_init__(self) -> None:
        if self.skew_method not in ("signed_log1p", "yeo_johnson"):
            raise ValueError(f"unknown skew_method {self.skew_method!r}")
        if self.fit_on not in ("train", "all"):
            raise ValueError(f"unknown fit_on {self.fit_on!r}")
        if self.auc_ties not in ("average", "ordinal"):
            raise ValueError(f"unknown auc_ties {self.auc_ties!r}")
        if self.importance not in ("auc", "gbt"):
            raise ValueError(f"unknown importance {self.importance!r}")
        if not 0 <= self.winsor[0] < self.winsor[1] <= 1:
            raise ValueError("winsor must be two rising shares")

    def sampled(self, n: int) -> Config:
        """The splits scaled to a sample of n rows."""
        scale = lambda rows: int(rows * n / self.full_n)
        return replace(self, sample_n=n, train_n=scale(self.train_n), val_n=scale(self.val_n), test_n=scale(self.test_n))

    def key(self) -> str:
        """A digest of all parameters: checkpoints of other parameters aren't taken for these."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]
