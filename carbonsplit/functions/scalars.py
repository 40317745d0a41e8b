"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PEOPLE_PER_MT = 1e6  # one Mt over this many people is one tonne each


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``, null where the denominator is 0 or null."""
    return F.try_divide(numerator, denominator)


def per_capita(value_mt: Column, population: Column) -> Column:
    """Mt spread over people, in tonnes per person."""
    return ratio(value_mt * F.lit(PEOPLE_PER_MT), population)


def is_finite(col: Column) -> Column:
    """True for ordinary numbers only: not null, NaN or infinite."""
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) < F.lit(float("inf")))


def clamp(col: Column, limit: float) -> Column:
    """Pull values beyond ``+-limit`` back to the limit; null stays null."""
    return (
        F.when(col > limit, F.lit(float(limit)))
        .when(col < -limit, F.lit(float(-limit)))
        .otherwise(col)
    )


def round_half_even(col: Column, digits: int = 0) -> Column:
    """Round with ties to the even neighbour (Spark's ``round`` goes away from 0)."""
    return F.bround(col, digits)
