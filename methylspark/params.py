"""Analysis parameters, validated on construction."""

from __future__ import annotations

from dataclasses import dataclass

METRICS = ("nhd", "l1", "l2", "corr", "jaccard")
MISSING_PAIR_STRATEGIES = ("max_dist", "skip")


@dataclass(frozen=True)
class Params:
    """Thresholds shared by the operators.

    Coordinates and probabilities are plain numbers; ``window`` is the half
    width in bp around a variant.
    """

    window: int = 1000
    min_mapq: int = 20
    min_read_length: int = 1000
    min_base_quality: int = 20
    require_mm_ml: bool = True
    methyl_high: float = 0.8
    methyl_low: float = 0.2
    min_site_coverage: int = 5
    min_common_coverage: int = 3
    missing_pairs: str = "max_dist"
    metric: str = "nhd"
    pmd_gating: bool = True
    mod_code: str = "C+m?"
    compat_ml_offset: bool = False
    #: Count modified bases of reverse reads from their end on the complement.
    original_strand: bool = False
    #: Skip windows whose reads are not of one phase set, by this share of the phased ones.
    phase_gate: bool = False
    min_phase_share: float = 0.9

    def __post_init__(self) -> None:
        if self.window <= 0:
            raise ValueError("window must be positive")
        for name in ("methyl_high", "methyl_low", "min_phase_share"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must lie in [0, 1]")
        if self.methyl_high <= self.methyl_low:
            raise ValueError("methyl_high must exceed methyl_low")
        for name in ("min_mapq", "min_read_length", "min_base_quality",
                     "min_site_coverage", "min_common_coverage"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if self.metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")
        if self.missing_pairs not in MISSING_PAIR_STRATEGIES:
            raise ValueError(f"missing_pairs must be one of {MISSING_PAIR_STRATEGIES}")
