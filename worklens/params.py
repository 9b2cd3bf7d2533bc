"""Every tunable of the engine in one immutable object, passed to each step that needs it."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    # cohorts
    min_group: int = 10
    flat_std: float = 1e-6
    z_cut: float = 2.5
    upper_pct: float = 95.0
    extreme_pct: float = 99.0
    # calendar
    covid_years: tuple[int, ...] = (2020, 2021, 2022)
    covid_from: str = "2020-03-01"
    covid_to: str = "2021-12-31"
    works_years: tuple[int, int] = (2024, 2025)
    payment_years: tuple[int, int] = (2025, 2026)
    default_year: int = 2022
    days_per_month: float = 30.4375
    # text
    vocabulary: int = 10_000
    min_df: int = 2
    similar_at: float = 0.85
    # isolation forest
    trees: int = 100
    tree_rows: int = 256
    contamination: float = 0.05
    seed: int = 42
    stability_seeds: tuple[int, ...] = (42, 100, 2024, 7, 999)
    sensitivity: tuple[float, ...] = (0.01, 0.03, 0.05, 0.10)
    # risk score
    w_financial: float = 0.30
    w_temporal: float = 0.20
    w_isolation: float = 0.25
    w_vendor: float = 0.15
    w_works: float = 0.10
    low_max: float = 39.99
    medium_max: float = 49.99
    # areas
    min_works: int = 5
    state_high_works: int = 10
    constituency_high_works: int = 5
    # screening
    screening_days: int = 180
    screening_rec_date: str = "2026-09-01"

    def but(self, **changes) -> "Params":
        return replace(self, **changes)


#: Cut-offs as documented rather than as run: HIGH starts at 70.
PUBLISHED = Params(medium_max=69.99)
