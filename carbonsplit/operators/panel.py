"""Entity x year panels: assembling, weighting gases, profiling and screening."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from carbonsplit.functions import (
    per_capita,
    ratio,
    round_half_even,
    strict_min,
    strict_sum,
)
from carbonsplit.operators.joins import without_listed
from carbonsplit.sources.shared import shared_table

# Warming weights per tonne of gas, CO2-equivalent.
GAS_WEIGHTS: Mapping[str, float] = {"CO2": 1.0, "CH4": 25.0, "N2O": 298.0}
TONNES_PER_MT = 1e6
# Fixed value: the divisor of the per-year intensity.
PROFILE_YEARS = 53


def stitch_eras(
    early: DataFrame,
    middle: DataFrame,
    late: DataFrame,
    first_boundary: int,
    second_boundary: int,
    year: str = "year",
) -> DataFrame:
    """One panel from three overlapping eras; shared years come from the middle one."""
    return (
        early.where(F.col(year) != first_boundary)
        .unionByName(middle)
        .unionByName(late.where(F.col(year) != second_boundary))
    )


def round_population(panel: DataFrame, column: str = "population") -> DataFrame:
    """Whole people, ties to even."""
    return panel.withColumn(column, round_half_even(F.col(column)))


def zero_count_census(
    panel: DataFrame, keys: Sequence[str] = ("country",), column: str = "population"
) -> DataFrame:
    """How many rows per key round to zero people; keys without any are absent."""
    return (
        round_population(panel, column)
        .where(F.col(column) == 0)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def co2e_total(
    long: DataFrame,
    ids: Sequence[str],
    weights: Mapping[str, float] = GAS_WEIGHTS,
    scale: float = TONNES_PER_MT,
    since: int = 1990,
    drop: Sequence[str] = ("sector",),
    missing: float | None = None,
) -> DataFrame:
    """Weighted gas total per id and year, in Mt CO2e (``ghg_mt``).

    ``long`` has ``ids`` + ``year, gas, amount_t``.  A gas without a row, or with
    an unknown amount, makes the total null unless ``missing`` gives the amount
    to assume.  Gases without a weight do not count.  ``drop`` names ids that
    separate rows but are not kept (several sectors stay several rows).
    """
    amount = F.col("amount_t")

    def gas_amount(gas: str):
        mine = F.col("gas") == gas
        total = F.when(
            F.count(F.when(mine, F.lit(1))) == F.count(F.when(mine, amount)),
            F.sum(F.when(mine, amount)),
        )
        return total if missing is None else F.coalesce(total, F.lit(float(missing)))

    parts = {f"_gas_{i}": (gas, w) for i, (gas, w) in enumerate(weights.items())}
    wide = (
        long.where(F.col("year") >= since)
        .groupBy(*ids, "year")
        .agg(*[gas_amount(gas).alias(c) for c, (gas, _) in parts.items()])
    )
    total = sum((F.col(c) * F.lit(w) for c, (_, w) in parts.items()), F.lit(0.0))
    kept = [c for c in ids if c not in drop]
    return wide.select(*kept, "year", (total / F.lit(scale)).alias("ghg_mt"))


def entity_year_panel(emissions: DataFrame, population: DataFrame, gdp: DataFrame) -> DataFrame:
    """Emissions with population and GDP of the same country, region and year."""
    keys = ["country", "region", "year"]
    return emissions.join(population, keys, "left").join(gdp, keys, "left")


def intensity_profile(panel: DataFrame, years: float = PROFILE_YEARS) -> DataFrame:
    """Sums per region, their ratios, and the share of the whole frame in percent."""
    totals = panel.groupBy("region", "country", "name").agg(
        strict_sum("ghg_mt").alias("ghg_mt"),
        strict_sum("population").alias("population"),
        strict_sum("gdp").alias("gdp"),
    )
    world = totals.agg(strict_sum("ghg_mt").alias("world")).scalar()
    ghg = F.col("ghg_mt")
    return totals.select(
        "*",
        per_capita(ghg, F.col("population")).alias("ghg_t_per_person"),
        ratio(ghg * F.lit(TONNES_PER_MT), F.col("gdp")).alias("ghg_t_per_gdp"),
        (ghg * F.lit(TONNES_PER_MT) / F.lit(float(years))).alias("ghg_t_per_year"),
        ratio(ghg * F.lit(100.0), world).alias("ghg_share_pct"),
        F.concat_ws(", ", "name", "country").alias("label"),
    )


def small_population_screen(
    population: DataFrame, gdp: DataFrame, minimum: float = 100
) -> DataFrame:
    """All rows of regions whose smallest yearly population is below ``minimum``.

    One unknown population makes the smallest unknown, and the region is not
    listed.  The minimum is a grouped one joined back on the same keys, so the
    join reuses its partitioning.
    """
    keys = ["country", "region"]
    smallest = (
        population.groupBy(*keys)
        .agg(strict_min("population").alias("min_population"))
        .where(F.col("min_population") < minimum)
    )
    return population.join(smallest, keys).join(gdp, [*keys, "year"], "left")


def zero_denominator_screen(profile: DataFrame, column: str) -> DataFrame:
    """Profile rows whose ``column`` (population or GDP) sums to zero."""
    return profile.where(F.col(column) == 0)


def code_screen(profile: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Profile rows of the listed country codes."""
    return profile.where(F.col("country").isin(list(codes)))


def screened_ids(screens: Iterable[tuple[DataFrame, str]]) -> list[tuple[DataFrame, str]]:
    """The listed ids of all screens, one written table per key, so that any number of frames reads them."""
    listed: dict[str, DataFrame] = {}
    for screen, key in screens:
        ids = screen.select(key)
        listed[key] = listed[key].unionByName(ids) if key in listed else ids
    return [(shared_table(ids.distinct(), f"screened-{key}"), key) for key, ids in listed.items()]


def apply_screens(df: DataFrame, screens: Iterable[tuple[DataFrame, str]]) -> DataFrame:
    """Drop rows whose key is listed by any ``(screen, key)``.

    Screens on the same key are merged into one anti join.  Give the result of
    ``screened_ids`` when several frames are screened.
    """
    listed: dict[str, DataFrame] = {}
    for screen, key in screens:
        ids = screen.select(key)
        listed[key] = listed[key].unionByName(ids) if key in listed else ids
    for key, ids in listed.items():
        df = without_listed(df, ids, key)
    return df


def coverage_share(profile: DataFrame) -> DataFrame:
    """Percent of the world total covered by the given profile rows."""
    return profile.agg(strict_sum("ghg_share_pct").alias("covered_pct"))
