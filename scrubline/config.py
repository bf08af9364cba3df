"""All thresholds in one place; two presets."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class CleanConfig:
    """Thresholds of the cleaning passes. The defaults are the current rules."""

    # roles
    sample_values: int = 50
    date_sample_values: int = 20
    email_share: float = 0.5
    currency_share: float = 0.3
    percent_share: float = 0.3
    date_share: float = 0.6
    max_categories: int = 50
    max_category_ratio: float = 0.5
    use_roles: bool = True

    # missing values
    drop_null_share: float = 0.60
    min_numeric_values: int = 3
    mean_skew_limit: float | None = 0.5  # None: always the median
    unknown_share: float | None = 0.3  # None: the mode whenever there is one
    unknown_text: str = "Unknown"

    # text and numbers stored as text
    coerce_numeric: bool = False
    coerce_share: float = 0.5

    # duplicates
    business_key: bool = True
    require_both_keys: bool = False

    # dates
    date_mode: str = "infer_first"  # or "mixed"
    date_parse_share: float = 0.5
    derive_dates: bool = True
    min_distinct_dates: int = 10

    # outliers
    fence_factor: float = 1.5
    min_outlier_values: int = 10
    min_outlier_distinct: int = 5  # must be exceeded
    z_limit: float = 3.0

    # quality score
    max_consistent_skew: float = 2.0

    def but(self, **changes) -> "CleanConfig":
        return replace(self, **changes)


CURRENT = CleanConfig()

# The older variant: types instead of roles, median only, no business key.
LEGACY = CleanConfig(
    use_roles=False,
    drop_null_share=0.50,
    mean_skew_limit=None,
    min_numeric_values=0,
    unknown_share=None,
    business_key=False,
    derive_dates=False,
    sample_values=20,
    min_outlier_values=0,
    min_outlier_distinct=10,
)


@dataclass(frozen=True)
class InsightConfig:
    """Thresholds of the findings."""

    stat_columns: int = 5
    min_stat_rows: int = 5
    skew_limit: float = 1.5
    variation_limit: float = 60.0
    normality_columns: int = 3
    min_normality_rows: int = 10
    normal_p: float = 0.05
    strong_r: float = 0.70
    very_strong_r: float = 0.90
    moderate_r: float = 0.40
    text_columns: int = 4
    binary_distinct: int = 2
    binary_share: float = 0.80
    dominant_share: float = 0.5
    few_distinct: int = 5
    date_columns: int = 2
    large_rows: int = 50_000
    many_duplicates: int = 10


INSIGHTS = InsightConfig()
LEGACY_INSIGHTS = InsightConfig(
    min_stat_rows=3, skew_limit=1.0, variation_limit=50.0, large_rows=10_000
)
