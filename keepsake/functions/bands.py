"""Banding rules: each is a plain `when` chain, so it stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (upper bound, label); the last label has no bound.
TENURE_BUCKETS = [
    (6, "0-6 months"), (12, "7-12 months"), (24, "13-24 months"), (48, "25-48 months"),
    (None, "49+ months"),
]
CHARGE_BANDS = [(30, "$0-30"), (50, "$30-50"), (70, "$50-70"), (90, "$70-90"), (None, "$90+")]
# Fixed values: (lower bound, label).
TENURE_COHORTS = [
    (60, "Early Adopters (5+ years)"), (48, "Established (4-5 years)"), (36, "Mature (3-4 years)"),
    (24, "Growing (2-3 years)"), (12, "Developing (1-2 years)"), (None, "New (< 1 year)"),
]
REPORT_BINS = [
    (0.25, "Low (0-25%)"), (0.5, "Medium (25-50%)"), (0.75, "High (50-75%)"),
    (1.0, "Critical (75-100%)"),
]


def first_match(rules: list[tuple[Column | None, object]]) -> Column:
    """The value of the first rule that holds; a rule without condition is the default."""
    out = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        if condition is None:
            return value if out is None else out.otherwise(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def up_to(value: Column, bands, labels=True, inclusive=True) -> Column:
    """Band label (or 1-based order) by upper bounds."""
    rules = []
    for order, (bound, label) in enumerate(bands, start=1):
        held = None
        if bound is not None:
            held = value <= bound if inclusive else value < bound
        rules.append((held, label if labels else order))
    return first_match(rules)


def at_least(value: Column, bands, labels=True) -> Column:
    """Band label (or 1-based order) by lower bounds."""
    rules = []
    for order, (bound, label) in enumerate(bands, start=1):
        rules.append((None if bound is None else value >= bound, label if labels else order))
    return first_match(rules)


def model_risk_level(probability: Column) -> Column:
    """Four levels used when scoring."""
    return first_match(
        [
            (probability >= 0.75, "Critical"),
            (probability >= 0.50, "High"),
            (probability >= 0.25, "Medium"),
            (None, "Low"),
        ]
    )


def table_risk_level(probability: Column) -> Column:
    """Three levels stored in the predictions table; probability as decimal(5,4)."""
    stored = probability.cast("decimal(5,4)")
    return first_match([(stored >= 0.7, "high"), (stored >= 0.4, "medium"), (None, "low")])


def report_bin(probability: Column) -> Column:
    """Right-closed report bins: exactly 0 falls outside all of them."""
    return F.when(probability > 0, up_to(probability, REPORT_BINS))
