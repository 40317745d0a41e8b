"""Region run: panels, screens, pathway, both allocations, gaps and target points."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from carbonsplit.operators import capacity, gaps, panel, pathway, responsibility, targets
from carbonsplit.operators.constraints import Uniqueness
from carbonsplit.plans.inputs import Inputs, Results
from carbonsplit.plans.settings import Settings
from carbonsplit.sources import shared_table


def region_run(inputs: Inputs, out: Results, settings: Settings = Settings()) -> None:
    """Write every result table of the region level, for all scenarios at once."""
    s = settings
    write = out.write
    unique = Uniqueness()

    population, emissions, gdp = _panels(inputs, s, write, unique)
    path = _pathway(inputs, emissions, s, write, unique)

    write(
        "region_responsibility",
        responsibility.responsibility_total(emissions, population, path, s.cutoff),
    )
    country_wide = write(
        "country_capacity_wide",
        capacity.capacity_country_wide(population, gdp, path, s.cutoff),
    )
    country_history = emissions.groupBy("country", "year").agg(
        panel.strict_sum("ghg_mt").alias("ghg_mt")
    )
    write(
        "country_capacity",
        responsibility.stack_after_history(country_history, country_wide, path, "country"),
    )
    region_wide = write(
        "region_capacity_wide",
        capacity.capacity_region_wide(population, gdp, country_wide, path, s.cutoff),
    )
    write("region_capacity", capacity.capacity_region_total(emissions, region_wide, path))

    for name, entity in (
        ("region_responsibility", "region"),
        ("country_capacity", "country"),
        ("region_capacity", "region"),
    ):
        series = out.read(name)
        for second in (s.next_year, s.check_year):
            write(f"{name}_gap_{second}", gaps.year_gap(series, entity, s.cutoff, second))

    write("region_target_points", targets.target_points(inputs.table("region_pledges")))
    write(
        "country_target_points",
        targets.average_national_pledges(
            inputs.table("national_pledges"), inputs.table("extra_pledges"), s.pledge_category
        ),
    )
    write("region_violations", unique.violations())


def _panels(inputs: Inputs, s: Settings, write, unique: Uniqueness) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Screened population, emissions and GDP; the unscreened population is kept as well."""
    stitched = panel.stitch_eras(
        inputs.table("region_population_early"),
        inputs.table("region_population_middle"),
        inputs.table("region_population_late"),
        s.first_boundary,
        s.second_boundary,
    )
    write("region_zero_population", panel.zero_count_census(stitched))
    population = write("region_population", panel.round_population(stitched))
    gdp = inputs.table("region_gdp")
    for name, df in (("region_population", population), ("region_gdp", gdp)):
        unique.report(name, df, ["country", "region", "year"])
    # read for the profile and again for the screened emissions, so the lines are summed once
    totals = shared_table(
        panel.co2e_total(
            inputs.table("region_emissions"),
            ["country", "region", "name", "sector"],
            since=s.panel_start,
            missing=s.missing_gas,
        ),
        "region_totals",
    )
    profile = write(
        "region_profile",
        panel.intensity_profile(panel.entity_year_panel(totals, population, gdp), s.profile_years),
    )
    screens = [
        (panel.small_population_screen(population, gdp, s.min_population), "region"),
        (panel.zero_denominator_screen(profile, "gdp"), "region"),
    ]
    if s.micro_codes:
        screens.append((panel.code_screen(profile, s.micro_codes), "country"))
    screens = panel.screened_ids(screens)
    write("coverage", panel.coverage_share(panel.apply_screens(profile, screens)))
    return (
        write("region_population_screened", panel.apply_screens(population, screens)),
        write("region_emissions", panel.apply_screens(totals, screens)),
        write("region_gdp_screened", panel.apply_screens(gdp, screens)),
    )


def _pathway(inputs: Inputs, emissions: DataFrame, s: Settings, write, unique: Uniqueness) -> DataFrame:
    wide = inputs.sheet(s.sheet_ids)
    catalogue = write(
        "pathway_catalogue", pathway.pathway_catalogue(wide, s.sheet_region, s.temperature, s.levels()), partition_by=()
    )
    if catalogue.isEmpty():
        raise ValueError(f"the scenario sheet has no rows of region {s.sheet_region}")
    sheet = pathway.select_pathways(wide, catalogue)
    landuse = unique.one_per_key("landuse", inputs.table("landuse").select("temperature", "year", "landuse_mt"), ["temperature", "year"])
    parts = pathway.decompose_pathway(
        pathway.net_pathway(sheet, s.sheet_ids, since=s.pathway_start),
        pathway.removal_pathway(sheet, s.sheet_ids, since=s.pathway_start),
        pathway.landuse_by_scenario(landuse, catalogue),
    )
    path = write("pathway", parts)
    unique.report("pathway", path, [pathway.SCENARIO, "year"])
    write("pathway_unmatched_years", unmatched_pathway_years(path), partition_by=())
    write("world_history", pathway.world_history(emissions))
    write("history_and_pathway", pathway.history_and_pathway_long(emissions, path))
    write("pathway_sanity", pathway.pathway_sanity(emissions, path, s.cutoff))
    write(
        "remaining_budget",
        pathway.remaining_budget(path, s.cutoff)
        .withColumnRenamed("budget_mt", "positive_budget_mt")
        .join(
            pathway.remaining_budget(path, s.cutoff, "removal_mt").withColumnRenamed(
                "budget_mt", "removal_budget_mt"
            ),
            pathway.SCENARIO,
        ),
    )
    return path


def unmatched_pathway_years(path: DataFrame) -> DataFrame:
    """Pathway years without a removal or land-use value, which make budgets unknown."""
    return path.where(F.col("positive_mt").isNull())
