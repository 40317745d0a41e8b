"""City run: city panel, responsibility within the world, downscaled capacity, targets."""

from __future__ import annotations

from carbonsplit.operators import cities, gaps, panel, pathway, responsibility, targets
from carbonsplit.operators.constraints import Uniqueness
from carbonsplit.plans.inputs import Inputs, Results
from carbonsplit.plans.settings import Settings


def city_run(inputs: Inputs, out: Results, settings: Settings = Settings()) -> None:
    """Write every result table of the city level; needs those of the region run."""
    s = settings
    write = out.write
    unique = Uniqueness()

    stitched = panel.stitch_eras(
        inputs.table("city_population_early"),
        inputs.table("city_population_middle"),
        inputs.table("city_population_late"),
        s.first_boundary,
        s.second_boundary,
    )
    population = write("city_population", stitched)
    unique.report("city_population", population, ["city", "year"])
    write("city_zero_population", panel.zero_count_census(population, ["city"]))
    write("city_population_trend", gaps.world_trend(population, "population", []))
    emissions = write(
        "city_emissions",
        panel.co2e_total(
            inputs.table("city_emissions"),
            ["city", "sector"],
            since=s.panel_start,
            missing=s.missing_gas,
        ),
    )
    write("city_history", pathway.world_history(emissions))
    path = out.read("pathway")
    # The denominators are the unscreened regions: the whole world, not the cities.
    regions = out.read("region_population")
    write(
        "city_responsibility",
        responsibility.responsibility_total(
            emissions, population, path, s.cutoff, entity="city", world_population=regions
        ),
    )
    wide = write(
        "city_capacity_wide",
        cities.downscale_by_population(
            unique.one_per_key("city_map", inputs.table("city_map"), ["city"]),
            regions,
            population,
            out.read("region_capacity_wide"),
            path,
            s.cutoff,
            s.ratio_lo,
            s.ratio_hi,
        ),
    )
    write("city_capacity", cities.city_capacity_total(emissions, wide, path))
    write(
        "city_target_points",
        targets.target_points(
            inputs.table("city_pledges"), "city", panel.TONNES_PER_MT, with_cut=True
        ),
    )
    write("city_violations", unique.violations())
