"""Allocation by economic capacity, nested: world to country, country to region.

Positive amounts go by population squared over GDP, removals by GDP.  Rows with
zero or unknown GDP are dropped before the denominators are formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from carbonsplit.functions import ratio, strict_sum
from carbonsplit.operators.joins import compact_join, repeat_for_each
from carbonsplit.operators.pathway import SCENARIO
from carbonsplit.operators.responsibility import scenarios, stack_after_history


def capacity_country_wide(
    population: DataFrame,
    gdp: DataFrame,
    pathway: DataFrame,
    after: int,
    keys: Sequence[str] = (SCENARIO,),
) -> DataFrame:
    """Country amounts per scenario and future year, both parts and their sum."""
    future = pathway.where(F.col("year") > after).select(
        *keys,
        "year",
        F.col("positive_mt").alias("given_positive_mt"),
        F.col("removal_mt").alias("given_removal_mt"),
    )
    weights = _weights(population, gdp, after, ["country"])
    return _split(weights, future, scenarios(pathway, keys), [], ["country"], keys)


def capacity_country_positive(
    population: DataFrame,
    gdp: DataFrame,
    pathway: DataFrame,
    after: int,
    keys: Sequence[str] = (SCENARIO,),
) -> DataFrame:
    """Positive pathway by population squared over GDP, per country and year."""
    wide = capacity_country_wide(population, gdp, pathway, after, keys)
    return _positive_view(wide, [*keys, "country", "year"])


def capacity_country_removal(
    population: DataFrame,
    gdp: DataFrame,
    pathway: DataFrame,
    after: int,
    keys: Sequence[str] = (SCENARIO,),
) -> DataFrame:
    """Removal pathway by GDP, per country and year."""
    wide = capacity_country_wide(population, gdp, pathway, after, keys)
    return _removal_view(wide, [*keys, "country", "year"])


def capacity_country_total(
    emissions: DataFrame,
    population: DataFrame,
    gdp: DataFrame,
    pathway: DataFrame,
    after: int,
    keys: Sequence[str] = (SCENARIO,),
) -> DataFrame:
    """Country history followed by the country allocation, per scenario."""
    wide = capacity_country_wide(population, gdp, pathway, after, keys)
    history = emissions.groupBy("country", "year").agg(strict_sum("ghg_mt").alias("ghg_mt"))
    return stack_after_history(history, wide, pathway, "country", keys)


def capacity_region_wide(
    population: DataFrame,
    gdp: DataFrame,
    country_wide: DataFrame,
    pathway: DataFrame,
    after: int,
    keys: Sequence[str] = (SCENARIO,),
) -> DataFrame:
    """Each country's amounts (from ``capacity_country_wide``) split over its regions."""
    given = country_wide.select(
        *keys,
        "country",
        "year",
        F.col("positive_mt").alias("given_positive_mt"),
        F.col("removal_mt").alias("given_removal_mt"),
    )
    weights = _weights(population, gdp, after, ["country", "region"])
    return _split(
        weights, given, scenarios(pathway, keys), ["country"], ["country", "region"], keys
    )


def capacity_region_positive(
    population: DataFrame,
    gdp: DataFrame,
    country_wide: DataFrame,
    pathway: DataFrame,
    after: int,
    keys: Sequence[str] = (SCENARIO,),
) -> DataFrame:
    """Country positive amount by population squared over GDP within country and year."""
    wide = capacity_region_wide(population, gdp, country_wide, pathway, after, keys)
    return _positive_view(wide, [*keys, "country", "region", "year"])


def capacity_region_removal(
    population: DataFrame,
    gdp: DataFrame,
    country_wide: DataFrame,
    pathway: DataFrame,
    after: int,
    keys: Sequence[str] = (SCENARIO,),
) -> DataFrame:
    """Country removal amount by GDP within country and year."""
    wide = capacity_region_wide(population, gdp, country_wide, pathway, after, keys)
    return _removal_view(wide, [*keys, "country", "region", "year"])


def capacity_region_total(
    emissions: DataFrame,
    region_wide: DataFrame,
    pathway: DataFrame,
    keys: Sequence[str] = (SCENARIO,),
) -> DataFrame:
    """Region history followed by the region allocation, per scenario."""
    return stack_after_history(emissions, region_wide, pathway, "region", keys)


def _weights(
    population: DataFrame, gdp: DataFrame, after: int, place: Sequence[str]
) -> DataFrame:
    """People, GDP and population squared over GDP per place and future year."""
    later = F.col("year") > after
    people = population.where(later).groupBy(*place, "year").agg(
        strict_sum("population").alias("population")
    )
    output = gdp.where(later).groupBy(*place, "year").agg(strict_sum("gdp").alias("gdp"))
    return (
        people.join(output, [*place, "year"], "left")
        .where(F.col("gdp") != 0)
        .withColumn("pop2_gdp", ratio(F.pow("population", F.lit(2.0)), F.col("gdp")))
    )


def _split(
    weights: DataFrame,
    given: DataFrame,
    scenario_list: DataFrame,
    within: Sequence[str],
    place: Sequence[str],
    keys: Sequence[str],
) -> DataFrame:
    """Share the ``given`` amounts over the places inside each ``within`` and year.

    The denominators are a grouped sum joined back (partial aggregation, one
    small row per group and year), never a window over all places of a year.
    A group without a given amount keeps its rows, with null amounts.
    """
    group = [*within, "year"]
    totals = weights.groupBy(*group).agg(
        strict_sum("pop2_gdp").alias("pop2_gdp_total"), strict_sum("gdp").alias("gdp_total")
    )
    amounts = repeat_for_each(totals, scenario_list, group).join(given, [*keys, *group], "left")
    rows = compact_join(weights, amounts, group)
    return rows.select(
        *keys,
        *place,
        "year",
        "population",
        "gdp",
        "pop2_gdp",
        "pop2_gdp_total",
        "gdp_total",
        "given_positive_mt",
        "given_removal_mt",
        ratio(F.col("given_positive_mt") * F.col("pop2_gdp"), F.col("pop2_gdp_total")).alias(
            "positive_mt"
        ),
        ratio(F.col("given_removal_mt") * F.col("gdp"), F.col("gdp_total")).alias("removal_mt"),
    ).withColumn("allocation_mt", F.col("positive_mt") + F.col("removal_mt"))


def _positive_view(wide: DataFrame, ids: Sequence[str]) -> DataFrame:
    return wide.select(
        *ids,
        "population",
        "gdp",
        "given_positive_mt",
        "pop2_gdp",
        "pop2_gdp_total",
        F.col("positive_mt").alias("allocation_mt"),
    )


def _removal_view(wide: DataFrame, ids: Sequence[str]) -> DataFrame:
    return wide.select(
        *ids,
        "population",
        "gdp",
        "given_removal_mt",
        "gdp_total",
        F.col("removal_mt").alias("allocation_mt"),
    )
