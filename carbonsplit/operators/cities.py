"""City level: downscaling a region's allocation and reading city points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from carbonsplit.functions import ratio
from carbonsplit.operators.joins import compact_join, repeat_for_each
from carbonsplit.operators.pathway import SCENARIO
from carbonsplit.operators.responsibility import scenarios, stack_after_history

POINT_SCHEMA = "type string, coordinates array<double>"


def city_population_ratios(
    city_map: DataFrame,
    region_population: DataFrame,
    city_population: DataFrame,
    after: int,
    lo: float = 0.95,
    hi: float = 1.05,
) -> DataFrame:
    """City share of its region's people per future year.

    A city whose largest share reaches ``hi`` is left out, as is one with a year
    it has no share for; a largest share above ``lo`` makes the city the whole
    region (share 1).
    """
    regions = region_population.where(F.col("year") > after).select(
        "country", "region", "year", F.col("population").alias("region_population")
    )
    rows = (
        compact_join(city_map, regions, ["region"])
        .join(city_population.select("city", "year", "population"), ["city", "year"], "left")
        .withColumn("pop_ratio", ratio(F.col("population"), F.col("region_population")))
    )
    # A city holds one row per calendar year here, so its window stays small.
    city = Window.partitionBy("city")
    largest = F.when(
        F.count("pop_ratio").over(city) == F.count(F.lit(1)).over(city),
        F.max("pop_ratio").over(city),
    )
    return (
        rows.withColumn("max_ratio", largest)
        .where(F.col("max_ratio") < hi)
        .withColumn(
            "pop_ratio",
            F.when(F.col("max_ratio") > lo, F.lit(1.0)).otherwise(F.col("pop_ratio")),
        )
    )


def downscale_by_population(
    city_map: DataFrame,
    region_population: DataFrame,
    city_population: DataFrame,
    region_allocation: DataFrame,
    pathway: DataFrame,
    after: int,
    lo: float = 0.95,
    hi: float = 1.05,
    keys: Sequence[str] = (SCENARIO,),
) -> DataFrame:
    """City allocation: the region's amount times the city's share of its people."""
    place = ["country", "region", "year"]
    ratios = city_population_ratios(
        city_map, region_population, city_population, after, lo, hi
    )
    wanted = region_population.where(F.col("year") > after).select(*place).distinct()
    amounts = repeat_for_each(wanted, scenarios(pathway, keys), place).join(
        region_allocation.select(
            *keys, *place, F.col("allocation_mt").alias("region_allocation_mt")
        ),
        [*keys, *place],
        "left",
    )
    rows = compact_join(ratios, amounts, place)
    return rows.select(
        *keys,
        "city",
        *place,
        "population",
        "region_population",
        "pop_ratio",
        "max_ratio",
        "region_allocation_mt",
        (F.col("region_allocation_mt") * F.col("pop_ratio")).alias("allocation_mt"),
    )


def city_capacity_total(
    emissions: DataFrame,
    city_wide: DataFrame,
    pathway: DataFrame,
    keys: Sequence[str] = (SCENARIO,),
) -> DataFrame:
    """City history followed by the downscaled allocation, per scenario."""
    return stack_after_history(emissions, city_wide, pathway, "city", keys)


def point_from_geojson(
    df: DataFrame, column: str, lon: str = "lon", lat: str = "lat"
) -> DataFrame:
    """Longitude and latitude columns from GeoJSON point text, replacing the text."""
    point = F.from_json(F.col(column), POINT_SCHEMA)
    return df.withColumns(
        {
            lon: F.try_element_at(point["coordinates"], F.lit(1)),
            lat: F.try_element_at(point["coordinates"], F.lit(2)),
        }
    ).drop(column)
