"""Aggregates with an explicit missing-value rule.

Spark's own ``sum``/``min``/``max`` skip nulls.  The ``strict_*`` forms return
null as soon as one input is null, which is how a gap in a panel is made
visible instead of being counted as zero.  All of them are plain declarative
aggregates, so they keep partial (map-side) aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _when_complete(col: Column, value: Column) -> Column:
    return F.when(F.count(col) == F.count(F.lit(1)), value)


def strict_sum(col: Column | str) -> Column:
    """Sum that is null if any input is null."""
    col = _column(col)
    return _when_complete(col, F.sum(col))


def strict_min(col: Column | str) -> Column:
    """Minimum that is null if any input is null."""
    col = _column(col)
    return _when_complete(col, F.min(col))


def strict_max(col: Column | str) -> Column:
    """Maximum that is null if any input is null."""
    col = _column(col)
    return _when_complete(col, F.max(col))


def skipping_sum(col: Column | str) -> Column:
    """Sum over the non-null inputs; 0.0 when there are none."""
    return F.coalesce(F.sum(_column(col)), F.lit(0.0))


def skipping_mean(col: Column | str) -> Column:
    """Mean over the non-null inputs; null when there are none."""
    return F.avg(_column(col))


def _column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def grouped_by_level(
    df: DataFrame, common: Sequence[str], levels: Mapping[str, Sequence[str]], aggregates: Sequence[Column]
) -> DataFrame:
    """Several groupings of one frame from one scan and one shuffle, by grouping sets.

    Every level groups by ``common`` and its own columns; ``level`` names it, and the
    columns of the other levels are null in its rows.
    """
    by = list(dict.fromkeys(c for columns in levels.values() for c in columns))
    everything = [*common, *by]
    sets = [[F.col(c) for c in (*common, *columns)] for columns in levels.values()]
    summed = df.groupingSets(sets, *[F.col(c) for c in everything]).agg(F.grouping_id().alias("_set"), *aggregates)
    # the grouping id has a bit for every column that a set leaves out
    level = F.lit(None).cast("string")
    for name, columns in levels.items():
        left_out = [n for n, c in enumerate(everything) if c not in common and c not in columns]
        bits = sum(1 << (len(everything) - 1 - n) for n in left_out)
        level = F.when(F.col("_set") == bits, name).otherwise(level)
    return summed.withColumn("level", level).drop("_set")
