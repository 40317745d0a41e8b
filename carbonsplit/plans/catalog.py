"""One registered query per operator, bound to the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from carbonsplit.operators import (
    alignment,
    breaks,
    capacity,
    cities,
    constraints,
    enrich,
    gaps,
    panel,
    pathway,
    responsibility,
    targets,
)
from carbonsplit.operators.joins import compact_join
from carbonsplit.plans import bindings as b
from carbonsplit.plans.bindings import Star

Query = Callable[[Star], DataFrame]

_REGISTRY: dict[str, Query] = {}

# Decimals compared: amounts in Mt and shares are small, money, tonnes and
# tonnes per person are large and carry their summation noise further left.
DIGITS = 6
LARGE_DIGITS = 3
LARGE_COLUMNS = ("gdp", "gdp_total", "amount_t", "value_t", "ghg_t_per_person", "ghg_t_per_year")
LARGE_SUFFIX = "_t_pc"


def query(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def decimals(column: str) -> int:
    large = column in LARGE_COLUMNS or column.endswith(LARGE_SUFFIX)
    return LARGE_DIGITS if large else DIGITS


def present(df: DataFrame) -> DataFrame:
    """Comparable output: rounded doubles without negative zero, bigint integers."""

    def shown(field: T.StructField):
        col = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.DecimalType)):
            col = F.round(col.cast("double"), decimals(field.name))
            col = F.when(col == 0, F.lit(0.0)).otherwise(col)
        elif isinstance(field.dataType, (T.IntegerType, T.LongType)):
            col = col.cast("bigint")
        elif isinstance(field.dataType, T.BinaryType):
            col = F.hex(col)
        return col.alias(field.name)

    return df.select(*[shown(f) for f in df.schema.fields])


# Results the queries read back from shared tables, in the order they build on each other.
STORED = (
    "city_year",
    "region_year",
    "history_table",
    "city_map_table",
    "city_history_table",
    "profile",
    "pathway",
    "catalogue",
    "pathway_of_models",
    "region_responsibility",
    "country_capacity",
    "region_capacity_wide",
    "region_capacity",
    "city_responsibility",
    "city_wide",
    "city_capacity",
    "region_attributed",
    "city_attributed",
    "region_targets",
    "country_targets",
    "city_targets",
)


def registered(*known: Star) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries; those of one call share the stored tables of a session and folder."""
    stars = {(s.spark.sparkContext.applicationId, s.folder): s for s in known}

    def star(spark: SparkSession, folder: str) -> Star:
        key = (spark.sparkContext.applicationId, folder)
        if key not in stars:
            stars[key] = Star(spark, folder)
        return stars[key]

    def runner(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: present(fn(star(spark, folder)))

    return {name: runner(fn) for name, fn in _REGISTRY.items()}


# -- sources ---------------------------------------------------------------------


@query
def p02_csv_scan(s: Star) -> DataFrame:
    return s.scanned_csv()[0]


@query
def p02_unparsed_cells(s: Star) -> DataFrame:
    """Cells of a CSV that held text but no value, as the scan counted them."""
    counts = s.scanned_csv()[1]
    rows = [(c, counts["n_rows"], n) for c, n in counts.items() if c != "n_rows"]
    return s.spark.createDataFrame(rows, "column string, n_rows long, n_cells long")


# -- panel ---------------------------------------------------------------------


@query
def d01_stitch_eras(s: Star) -> DataFrame:
    year = F.col("year")
    return panel.stitch_eras(
        s.population.where(year <= 1997),
        s.population.where(year.between(1997, 1999)),
        s.population.where(year >= 1999),
        1997,
        1999,
    )


@query
def d02_zero_count_census(s: Star) -> DataFrame:
    return panel.zero_count_census(s.fractional_city_population)


@query
def d02_round_population(s: Star) -> DataFrame:
    return panel.round_population(s.fractional_city_population)


@query
def d03_co2e_total(s: Star) -> DataFrame:
    ids = ["country", "region", "name", "sector"]
    return panel.co2e_total(s.region_emissions_long, ids, since=1996)


@query
def d03_co2e_total_city(s: Star) -> DataFrame:
    return panel.co2e_total(s.city_emissions_long, ["city", "sector"], since=1996)


@query
def d04_entity_year_panel(s: Star) -> DataFrame:
    return panel.entity_year_panel(s.history, s.population_with_gaps, s.gdp)


@query
def d05_intensity_profile(s: Star) -> DataFrame:
    return s.profile


@query
def d06_small_population_screen(s: Star) -> DataFrame:
    return panel.small_population_screen(s.population_with_gaps, s.gdp, b.SMALL_POPULATION)


@query
def d07_zero_gdp_screen(s: Star) -> DataFrame:
    return panel.zero_denominator_screen(s.stored("profile"), "gdp").select("country", "region", "gdp", "ghg_mt")


@query
def d07_zero_population_screen(s: Star) -> DataFrame:
    return panel.zero_denominator_screen(s.stored("profile"), "population").select("country", "region", "population")


@query
def d08_code_screen(s: Star) -> DataFrame:
    return panel.code_screen(s.stored("profile"), b.MICRO_CODES).select("country", "region", "ghg_mt")


@query
def d09_apply_screens(s: Star) -> DataFrame:
    return panel.apply_screens(s.history, s.screens)


@query
def d09_apply_screens_population(s: Star) -> DataFrame:
    return panel.apply_screens(s.population_with_gaps, s.screens)


@query
def d10_coverage_share(s: Star) -> DataFrame:
    return panel.coverage_share(panel.apply_screens(s.stored("profile"), s.screens))


# -- pathway -------------------------------------------------------------------


@query
def d11_melt_scenario(s: Star) -> DataFrame:
    return pathway.melt_scenario(s.sheet, b.SHEET_IDS, b.PATHWAY_START)


@query
def d11_pathway_catalogue(s: Star) -> DataFrame:
    """Pathways of a sheet with two models, two regions and a scenario of one model only."""
    return s.catalogue


@query
def d12_scenario_co2e_models(s: Star) -> DataFrame:
    return pathway.scenario_co2e(pathway.melt_scenario(s.sheet_by_pathway, b.SHEET_IDS, b.PATHWAY_START))


@query
def d13_net_pathway_models(s: Star) -> DataFrame:
    return pathway.net_pathway(s.sheet_by_pathway, b.SHEET_IDS, since=b.PATHWAY_START)


@query
def d14_removal_pathway_models(s: Star) -> DataFrame:
    return pathway.removal_pathway(s.sheet_by_pathway, b.SHEET_IDS, since=b.PATHWAY_START)


@query
def d15_landuse_by_scenario(s: Star) -> DataFrame:
    return pathway.landuse_by_scenario(s.landuse_table, s.stored("catalogue"))


@query
def d16_decompose_pathway_models(s: Star) -> DataFrame:
    return s.pathway_of_models


@query
def d12_scenario_co2e(s: Star) -> DataFrame:
    return pathway.scenario_co2e(pathway.melt_scenario(s.sheet, b.SHEET_IDS, b.PATHWAY_START))


@query
def d13_interpolate_yearly(s: Star) -> DataFrame:
    """City amounts per gas; years without an order are filled in."""
    return pathway.interpolate_yearly(s.city_emissions_long, ["city", "gas"], y="amount_t")


@query
def d13_net_pathway(s: Star) -> DataFrame:
    return s.net


@query
def d14_removal_pathway(s: Star) -> DataFrame:
    return s.removal


@query
def d15_pick_landuse(s: Star) -> DataFrame:
    return s.landuse


@query
def d16_decompose_pathway(s: Star) -> DataFrame:
    return pathway.decompose_pathway(s.net, s.removal, s.landuse)


@query
def d17_history_and_pathway_long(s: Star) -> DataFrame:
    return pathway.history_and_pathway_long(s.history, s.stored("pathway"))


@query
def d18_world_history(s: Star) -> DataFrame:
    return pathway.world_history(s.history)


@query
def d18_world_history_city(s: Star) -> DataFrame:
    return pathway.world_history(s.city_history)


@query
def d18_world_history_incomplete(s: Star) -> DataFrame:
    """One region without a total makes the world total unknown."""
    ids = ["country", "region", "name", "sector"]
    return pathway.world_history(panel.co2e_total(s.region_emissions_long, ids))


@query
def d19_remaining_budget(s: Star) -> DataFrame:
    return pathway.remaining_budget(s.stored("pathway"), b.CUTOFF)


@query
def d19_remaining_budget_removal(s: Star) -> DataFrame:
    return pathway.remaining_budget(s.stored("pathway"), b.CUTOFF, "removal_mt")


@query
def d51_pathway_sanity(s: Star) -> DataFrame:
    return pathway.pathway_sanity(s.history, s.stored("pathway"), b.CUTOFF)


# -- responsibility --------------------------------------------------------------


@query
def d20_responsibility_positive(s: Star) -> DataFrame:
    return responsibility.responsibility_positive(s.history, s.population, s.stored("pathway"), b.CUTOFF)


@query
def d21_responsibility_removal(s: Star) -> DataFrame:
    return responsibility.responsibility_removal(s.history, s.population, s.stored("pathway"), b.CUTOFF)


@query
def d22_responsibility_wide(s: Star) -> DataFrame:
    return responsibility.responsibility_wide(s.history, s.population, s.stored("pathway"), b.CUTOFF)


@query
def d22_responsibility_total(s: Star) -> DataFrame:
    return s.region_responsibility


@query
def d29_responsibility_subset(s: Star) -> DataFrame:
    return s.city_responsibility


# -- capacity ----------------------------------------------------------------------


@query
def d23_capacity_country_positive(s: Star) -> DataFrame:
    return capacity.capacity_country_positive(s.population, s.gdp, s.stored("pathway"), b.CUTOFF)


@query
def d24_capacity_country_removal(s: Star) -> DataFrame:
    return capacity.capacity_country_removal(s.population, s.gdp, s.stored("pathway"), b.CUTOFF)


@query
def d25_capacity_country_wide(s: Star) -> DataFrame:
    return s.country_capacity_wide


@query
def d25_capacity_country_total(s: Star) -> DataFrame:
    return s.country_capacity


@query
def d26_capacity_region_positive(s: Star) -> DataFrame:
    return capacity.capacity_region_positive(
        s.population, s.gdp, s.country_capacity_wide, s.stored("pathway"), b.CUTOFF
    )


@query
def d27_capacity_region_removal(s: Star) -> DataFrame:
    return capacity.capacity_region_removal(
        s.population, s.gdp, s.country_capacity_wide, s.stored("pathway"), b.CUTOFF
    )


@query
def d28_capacity_region_wide(s: Star) -> DataFrame:
    return s.region_capacity_wide


@query
def d28_capacity_region_total(s: Star) -> DataFrame:
    return s.region_capacity


# -- cities ------------------------------------------------------------------------


@query
def d30_city_population_ratios(s: Star) -> DataFrame:
    return cities.city_population_ratios(
        s.city_map, s.population, s.city_population, b.CUTOFF, b.RATIO_LO, b.RATIO_HI
    )


@query
def d30_downscale_by_population(s: Star) -> DataFrame:
    return s.city_wide


@query
def d30_city_capacity_total(s: Star) -> DataFrame:
    return s.city_capacity


@query
def d48_point_from_geojson(s: Star) -> DataFrame:
    return cities.point_from_geojson(s.city_points, "centroid")


@query
def d48_classified_city_points(s: Star) -> DataFrame:
    points = cities.point_from_geojson(s.city_points, "centroid")
    return _city_classes(s).join(points, "city", "left")


# -- gaps --------------------------------------------------------------------------


def _gap(series: DataFrame, entity: str, second: int) -> DataFrame:
    return gaps.year_gap(series, entity, b.BASE_YEAR, second)


@query
def d31_year_gap_responsibility(s: Star) -> DataFrame:
    return _gap(s.stored("region_responsibility"), "region", 1999)


@query
def d31_year_gap_responsibility_check_year(s: Star) -> DataFrame:
    return _gap(s.stored("region_responsibility"), "region", b.CHECK_YEAR)


@query
def d31_year_gap_capacity_country(s: Star) -> DataFrame:
    return _gap(s.stored("country_capacity"), "country", b.CHECK_YEAR)


@query
def d31_year_gap_capacity_region(s: Star) -> DataFrame:
    return _gap(s.stored("region_capacity"), "region", b.CHECK_YEAR)


@query
def d32_pct_gap_responsibility(s: Star) -> DataFrame:
    return gaps.pct_gap_clamped(_gap(s.stored("region_responsibility"), "region", b.CHECK_YEAR), "region", 50)


@query
def d32_pct_gap_capacity_region(s: Star) -> DataFrame:
    return gaps.pct_gap_clamped(_gap(s.stored("region_capacity"), "region", b.CHECK_YEAR), "region", 50)


@query
def d32_pct_gap_capacity_country(s: Star) -> DataFrame:
    return gaps.pct_gap_clamped(_gap(s.stored("country_capacity"), "country", b.CHECK_YEAR), "country", 50)


@query
def d33_rollup_gap(s: Star) -> DataFrame:
    return gaps.rollup_gap(_gap(s.stored("region_responsibility"), "region", 1999))


@query
def d33_rollup_pct_gap(s: Star) -> DataFrame:
    return gaps.rollup_pct_gap(_gap(s.stored("region_responsibility"), "region", b.CHECK_YEAR), limit=20)


@query
def d33_rollup_pct_gap_sovereign(s: Star) -> DataFrame:
    gap = _gap(s.stored("region_responsibility"), "region", b.CHECK_YEAR)
    return gaps.rollup_pct_gap(gap, limit=20, sovereigns=s.sovereigns)


@query
def d33_rollup_gap_levels(s: Star) -> DataFrame:
    """Countries and sovereigns from one aggregate."""
    return gaps.rollup_gap_levels(_gap(s.stored("region_responsibility"), "region", b.CHECK_YEAR), s.sovereigns)


@query
def d34_sovereign_remap(s: Star) -> DataFrame:
    return enrich.sovereign_remap(s.region_layer, s.sovereigns, b.DROPPED_SOVEREIGNS)


@query
def d34_drop_codes(s: Star) -> DataFrame:
    return enrich.drop_codes(s.country_layer, b.DROPPED_SOVEREIGNS)


@query
def d35_attribute_entities(s: Star) -> DataFrame:
    return s.region_attributed


@query
def d35_attribute_entities_city(s: Star) -> DataFrame:
    return s.city_attributed


@query
def d35_name_violations(s: Star) -> DataFrame:
    return s.unique_names()[1]


@query
def d35_attribute_entities_one_name(s: Star) -> DataFrame:
    """Names that are not unique do not multiply rows."""
    return enrich.attribute_entities(
        s.stored("region_responsibility"),
        s.stored("region_capacity"),
        s.population,
        s.classes,
        s.members,
        names=s.unique_names()[0],
    )


@query
def d35_group_mean(s: Star) -> DataFrame:
    return enrich.with_group_mean(s.stored("region_attributed"))


@query
def d35_group_mean_city(s: Star) -> DataFrame:
    return enrich.with_group_mean(s.stored("city_attributed"))


@query
def d36_rollup_per_capita_country(s: Star) -> DataFrame:
    return s.country_rollup


@query
def d36_rollup_per_capita_group(s: Star) -> DataFrame:
    return enrich.rollup_per_capita(s.stored("region_attributed"), ["group", "year"])


@query
def d36_rollup_by_class(s: Star) -> DataFrame:
    return enrich.rollup_by_class(s.stored("region_attributed"))


@query
def d36_rollup_levels(s: Star) -> DataFrame:
    """Countries, groups and classes from one aggregate."""
    return enrich.rollup_levels(s.stored("region_attributed"))


@query
def d36_year_slice(s: Star) -> DataFrame:
    grouped = enrich.rollup_per_capita(s.stored("region_attributed"), ["group", "year"])
    return enrich.year_slice(grouped, b.CHECK_YEAR)


@query
def d37_index_region(s: Star) -> DataFrame:
    return _index(enrich.index_to_base_year(
        s.stored("region_attributed"), "region", b.BASE_YEAR, b.DISPLAY_COUNTRIES
    ), "region")


@query
def d37_index_country(s: Star) -> DataFrame:
    return _index(enrich.index_to_base_year(
        s.country_rollup, "country", b.BASE_YEAR, b.DISPLAY_COUNTRIES
    ), "country")


@query
def d37_index_city(s: Star) -> DataFrame:
    return _index(enrich.index_to_base_year(
        s.stored("city_attributed"), "city", b.BASE_YEAR, b.DISPLAY_COUNTRIES
    ), "city")


@query
def d37_base_year_violations(s: Star) -> DataFrame:
    """Cities without exactly one row in the base year of the index."""
    return constraints.base_row_counts(s.once("city_attributed"), "city", b.BASE_YEAR)


def _index(df: DataFrame, entity: str) -> DataFrame:
    return df.select(
        "scenario_id", entity, "year", "display_rank",
        "capc_base_t_pc", "resp_base_t_pc", "capc_index", "resp_index",
    )


@query
def d50_world_trend_responsibility(s: Star) -> DataFrame:
    return gaps.world_trend(s.stored("region_responsibility"))


@query
def d50_world_trend_capacity(s: Star) -> DataFrame:
    return gaps.world_trend(s.stored("region_capacity"))


@query
def d50_world_trend_city_population(s: Star) -> DataFrame:
    return gaps.world_trend(s.city_population, "population", [])


@query
def d52_attach_to_region_layer(s: Star) -> DataFrame:
    """Region layer with the responsibility gap of every scenario."""
    return enrich.attach_to_layer(s.region_layer, d32_pct_gap_responsibility(s), ["region"])


@query
def d52_attach_to_country_layer(s: Star) -> DataFrame:
    return enrich.attach_to_layer(s.country_layer, d33_rollup_pct_gap(s), ["country"])


# -- targets -----------------------------------------------------------------------


@query
def d38_target_points(s: Star) -> DataFrame:
    return s.region_points.withColumnRenamed("value", "value_t")


@query
def d38_target_points_city(s: Star) -> DataFrame:
    return s.city_target_points


@query
def d39_average_national_pledges(s: Star) -> DataFrame:
    pledges = targets.average_national_pledges(s.national_pledges, s.extra_pledges)
    return pledges.withColumnRenamed("value", "value_t")


@query
def d40_anchor_single_targets(s: Star) -> DataFrame:
    anchors = targets.anchor_single_targets(s.region_points, year=b.BASE_YEAR)
    return anchors.withColumnRenamed("value", "value_t")


@query
def d40_anchor_single_targets_observed(s: Star) -> DataFrame:
    observed = s.history.select("region", "year", (F.col("ghg_mt") * F.lit(1e6)).alias("value"))
    anchors = targets.anchor_single_targets(
        s.region_points, year=b.BASE_YEAR, anchor="observed", history=observed
    )
    return anchors.withColumnRenamed("value", "value_t")


@query
def d41_target_trajectory(s: Star) -> DataFrame:
    return s.region_targets


@query
def d41_target_trajectory_city(s: Star) -> DataFrame:
    return s.city_targets


@query
def d42_fairness_flags_region(s: Star) -> DataFrame:
    return targets.fairness_flags(
        s.stored("region_attributed"), s.stored("region_targets"), s.scenarios, "region", b.CHECK_YEAR
    )


@query
def d42_fairness_flags_country(s: Star) -> DataFrame:
    return targets.fairness_flags(
        s.country_rollup, s.stored("country_targets"), s.scenarios, "country", b.CHECK_YEAR
    )


# -- alignment ---------------------------------------------------------------------


def _paired(df: DataFrame, entity: str) -> DataFrame:
    rows = df.select("scenario_id", entity, "year", "resp_mt", "capc_mt")
    return alignment.pair_scenarios(rows, b.WIDE, b.TIGHT, [entity, "year"])


def _region_classes(s: Star) -> DataFrame:
    """As reported: regions without a class stay in."""
    return alignment.classify_alignment(
        _paired(s.stored("region_attributed"), "region"), s.stored("region_targets"), "region", b.CHECK_YEAR, drop_null=False
    )


def _country_classes(s: Star) -> DataFrame:
    return alignment.classify_alignment(
        _paired(s.country_rollup, "country"), s.stored("country_targets"), "country", b.CHECK_YEAR
    )


def _city_classes(s: Star) -> DataFrame:
    return alignment.classify_alignment(
        _paired(s.once("city_attributed"), "city"), s.stored("city_targets"), "city", b.CHECK_YEAR
    )


@query
def d43_pair_scenarios_region(s: Star) -> DataFrame:
    return _paired(s.stored("region_attributed"), "region")


@query
def d43_pair_scenarios_country(s: Star) -> DataFrame:
    return _paired(s.country_rollup, "country")


@query
def d43_pair_scenarios_city(s: Star) -> DataFrame:
    return _paired(s.stored("city_attributed"), "city")


@query
def d43_pair_scenarios_models(s: Star) -> DataFrame:
    """Responsibility on the pathways of two models, each model's scenarios side by side."""
    series = responsibility.responsibility_wide(s.history, s.population, s.stored("pathway_of_models"), b.CUTOFF)
    pathways = s.stored("catalogue").select("scenario_id", "model", "scenario")
    rows = compact_join(series, pathways, ["scenario_id"]).select("model", "scenario", "region", "year", "allocation_mt")
    return alignment.pair_scenarios(
        rows, b.WIDE, b.TIGHT, ["model", "region", "year"], ["allocation_mt"], scenario="scenario"
    )


@query
def d44_classify_alignment_region(s: Star) -> DataFrame:
    return _region_classes(s)


@query
def d44_classify_alignment_country(s: Star) -> DataFrame:
    return _country_classes(s)


@query
def d44_classify_alignment_city(s: Star) -> DataFrame:
    return _city_classes(s)


@query
def d45_alignment_summary(s: Star) -> DataFrame:
    return alignment.alignment_summary(_region_classes(s), _country_classes(s), _city_classes(s))


@query
def d46_relative_ambition(s: Star) -> DataFrame:
    return alignment.relative_ambition(_region_classes(s), _city_classes(s), _country_classes(s))


@query
def d46_relative_ambition_strict(s: Star) -> DataFrame:
    return alignment.relative_ambition(
        _region_classes(s), _city_classes(s), _country_classes(s), strict=True
    )


@query
def d47_ambition_summary(s: Star) -> DataFrame:
    return alignment.ambition_summary(d46_relative_ambition(s))


# -- scale -------------------------------------------------------------------------


@query
def d49_diverging_breaks_linear(s: Star) -> DataFrame:
    return breaks.diverging_breaks(d32_pct_gap_responsibility(s), "gap_pct_raw", 100.0)


@query
def d49_diverging_breaks_linear_bounded(s: Star) -> DataFrame:
    return breaks.diverging_breaks(d32_pct_gap_responsibility(s), "gap_pct_raw", lo=-50)


@query
def d49_diverging_breaks_asinh(s: Star) -> DataFrame:
    return breaks.diverging_breaks(d32_pct_gap_responsibility(s), "gap_mt", 0.01, "asinh")


@query
def d49_diverging_breaks_asinh_bounded(s: Star) -> DataFrame:
    return breaks.diverging_breaks(
        d32_pct_gap_responsibility(s), "gap_pct_raw", 1.0, "asinh", hi=300
    )
