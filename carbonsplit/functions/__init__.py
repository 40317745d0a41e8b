"""Column expressions shared by the operators."""

from carbonsplit.functions.aggregates import (
    grouped_by_level,
    skipping_mean,
    skipping_sum,
    strict_max,
    strict_min,
    strict_sum,
)
from carbonsplit.functions.scalars import (
    clamp,
    is_finite,
    per_capita,
    ratio,
    round_half_even,
)

__all__ = [
    "clamp",
    "grouped_by_level",
    "is_finite",
    "per_capita",
    "ratio",
    "round_half_even",
    "skipping_mean",
    "skipping_sum",
    "strict_max",
    "strict_min",
    "strict_sum",
]
