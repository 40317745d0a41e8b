"""Year gaps of allocation series, their percentages, and country roll-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from carbonsplit.functions import clamp, grouped_by_level, is_finite, ratio, skipping_sum, strict_sum
from carbonsplit.operators.joins import compact_join
from carbonsplit.operators.pathway import SCENARIO

COUNTRY_PREFIX = 3
PCT_LIMIT = 300.0


def year_gap(
    series: DataFrame,
    entity: str,
    first: int,
    second: int,
    keys: Sequence[str] = (SCENARIO,),
) -> DataFrame:
    """Two years of a series with the change on the later row (null on the earlier).

    The filter comes before the window, so an entity contributes two rows.
    """
    earlier = F.lag("value_mt").over(Window.partitionBy(*keys, entity).orderBy("year"))
    return (
        series.where(F.col("year").isin(first, second))
        .select(*keys, entity, "year", "value_mt")
        .withColumn("gap_mt", F.col("value_mt") - earlier)
    )


def pct_gap_clamped(
    gap: DataFrame,
    entity: str,
    limit: float = PCT_LIMIT,
    keys: Sequence[str] = (SCENARIO,),
) -> DataFrame:
    """Gap in percent of the earlier value; only finite ones, pulled in to ``+-limit``."""
    earlier = F.lag("value_mt").over(Window.partitionBy(*keys, entity).orderBy("year"))
    raw = F.col("gap_pct_raw")
    return (
        gap.withColumn("gap_pct_raw", ratio(F.col("gap_mt") * F.lit(100.0), earlier))
        .where(is_finite(raw))
        .select(*keys, entity, "gap_mt", clamp(raw, limit).alias("gap_pct"), "gap_pct_raw")
    )


def rollup_gap(
    gap: DataFrame,
    entity: str = "region",
    prefix: int = COUNTRY_PREFIX,
    sovereigns: DataFrame | None = None,
    keys: Sequence[str] = (SCENARIO,),
) -> DataFrame:
    """Country sums of gap and value per year; unknown gaps count as nothing.

    The country is the start of the entity id; ``sovereigns`` (``country,
    sovereign``) rolls territories up further.
    """
    rows = gap.withColumn("country", F.substring(entity, 1, prefix))
    if sovereigns is not None:
        rows = compact_join(rows, sovereigns, ["country"], "left")
        rows = rows.withColumn("country", F.coalesce("sovereign", "country"))
    return (
        rows.where(F.col("country").isNotNull())
        .groupBy(*keys, "country", "year")
        .agg(
            skipping_sum("gap_mt").alias("gap_mt"),
            skipping_sum("value_mt").alias("value_mt"),
        )
    )


GAP_LEVELS: Mapping[str, Sequence[str]] = {"country": ("country",), "sovereign": ("sovereign",)}


def rollup_gap_levels(
    gap: DataFrame,
    sovereigns: DataFrame,
    entity: str = "region",
    prefix: int = COUNTRY_PREFIX,
    keys: Sequence[str] = (SCENARIO,),
) -> DataFrame:
    """Sums of gap and value per country and per sovereign from one pass; ``level`` tells them apart.

    A country without a sovereign is its own.
    """
    rows = gap.withColumn("country", F.substring(entity, 1, prefix)).where(F.col("country").isNotNull())
    rows = compact_join(rows, sovereigns.select("country", "sovereign"), ["country"], "left")
    rows = rows.withColumn("sovereign", F.coalesce("sovereign", "country"))
    sums = [skipping_sum(m).alias(m) for m in ("gap_mt", "value_mt")]
    return grouped_by_level(rows, [*keys, "year"], GAP_LEVELS, sums)


def rollup_pct_gap(
    gap: DataFrame,
    entity: str = "region",
    prefix: int = COUNTRY_PREFIX,
    limit: float = PCT_LIMIT,
    sovereigns: DataFrame | None = None,
    keys: Sequence[str] = (SCENARIO,),
) -> DataFrame:
    """Country gap in percent of the country's earlier value, clamped."""
    return pct_gap_clamped(rollup_gap(gap, entity, prefix, sovereigns, keys), "country", limit, keys)


def world_trend(
    series: DataFrame, value: str = "value_mt", keys: Sequence[str] = (SCENARIO,)
) -> DataFrame:
    """World sum per year."""
    return series.groupBy(*keys, "year").agg(strict_sum(value).alias(value))
