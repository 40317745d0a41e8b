"""Analysis run: gaps on map layers, per-capita views, indices, targets, classes, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from carbonsplit.operators import alignment, breaks, cities, enrich, gaps, responsibility, targets
from carbonsplit.operators.constraints import Uniqueness
from carbonsplit.operators.joins import compact_join
from carbonsplit.operators.panel import TONNES_PER_MT, strict_sum
from carbonsplit.plans.inputs import Inputs, Results
from carbonsplit.plans.settings import Settings


def analysis_run(inputs: Inputs, out: Results, settings: Settings = Settings()) -> None:
    """Write every table of the analysis; needs the region and city runs' results."""
    s = settings
    write = out.write
    unique = Uniqueness()
    sovereigns = unique.one_per_key("sovereigns", inputs.table("sovereigns"), ["country"])
    catalogue = out.read("pathway_catalogue")
    models = _paired_models(catalogue, s)

    for name in ("region_responsibility", "region_capacity"):
        write(f"world_trend_{name}", gaps.world_trend(out.read(name)))
    layers = {
        "region": enrich.sovereign_remap(
            inputs.table("region_layer"), sovereigns, s.dropped_codes
        ),
        "country": enrich.drop_codes(inputs.table("country_layer"), s.dropped_codes),
    }

    def on_map(name: str, values: DataFrame, entity: str) -> DataFrame:
        return write(name, enrich.attach_to_layer(layers[entity], values, [entity]))

    _gap_tables(out, s, write, on_map, sovereigns if s.rollup_to_sovereigns else None)
    views = _views(inputs, out, s, write, unique)
    _assessment(inputs, out, s, write, on_map, catalogue, models, *views)
    write("analysis_violations", unique.violations())


def _paired_models(catalogue: DataFrame, s: Settings) -> DataFrame:
    """``model``: those with both configured scenarios; without any there is nothing to compare."""
    wanted = catalogue.where(F.col("scenario").isin(s.tight_scenario, s.wide_scenario))
    models = wanted.groupBy("model").agg(F.count_distinct("scenario").alias("n")).where("n = 2").select("model")
    if models.isEmpty():
        known = sorted({r.scenario for r in catalogue.select("scenario").distinct().collect()})
        raise ValueError(f"no model has both scenarios {s.tight_scenario} and {s.wide_scenario}; the sheet has {known}")
    return models


def _gap_tables(out: Results, s: Settings, write, on_map, sovereigns: DataFrame | None) -> None:
    """Gap percentages on the map layers, and the break points of their scales."""
    for second in (s.next_year, s.check_year):
        for name in ("region_responsibility", "region_capacity"):
            pct = write(
                f"{name}_pct_{second}",
                gaps.pct_gap_clamped(out.read(f"{name}_gap_{second}"), "region", s.pct_limit),
            )
            on_map(f"{name}_map_{second}", pct, "region")
        capacity_gap = out.read(f"country_capacity_gap_{second}")
        pct = write(
            f"country_capacity_pct_{second}",
            gaps.pct_gap_clamped(capacity_gap, "country", s.pct_limit),
        )
        on_map(f"country_capacity_map_{second}", pct, "country")
        rolled = write(
            f"country_responsibility_gap_{second}",
            gaps.rollup_gap(out.read(f"region_responsibility_gap_{second}"), sovereigns=sovereigns),
        )
        pct = write(
            f"country_responsibility_pct_{second}",
            gaps.pct_gap_clamped(rolled, "country", s.pct_limit),
        )
        on_map(f"country_responsibility_map_{second}", pct, "country")
    write("gap_breaks", _map_breaks(out, s))


MAPS = ("region_responsibility", "region_capacity", "country_responsibility", "country_capacity")


def _map_breaks(out: Results, s: Settings) -> DataFrame:
    """Break points of the four maps of the check year: of the data and of the clamp, evenly and by asinh."""
    parts = None
    for name in MAPS:
        pct = out.read(f"{name}_pct_{s.check_year}")
        for bounds, lo, hi in (("data", None, None), ("limit", -s.pct_limit, s.pct_limit)):
            for method in ("linear", "asinh"):
                found = breaks.diverging_breaks(pct, "gap_pct", method=method, lo=lo, hi=hi)
                part = found.select(F.lit(name).alias("map"), F.lit(bounds).alias("bounds"), F.lit(method).alias("method"), "position", "break")
                parts = part if parts is None else parts.unionByName(part)
    return parts


def _views(inputs: Inputs, out: Results, s: Settings, write, unique: Uniqueness):
    """Enriched series and their roll-ups and indices."""
    classes = unique.one_per_key("classes", inputs.table("classes").select("country", "class_region", "income_group"), ["country"])
    override = unique.one_per_key("override", inputs.table("override"), ["country"])
    names = unique.one_per_key("region_names", out.read("region_profile").select("region", "name").distinct(), ["region"])
    region = write(
        "region_attributed",
        enrich.attribute_entities(
            out.read("region_responsibility"),
            out.read("region_capacity"),
            out.read("region_population"),
            classes,
            override,
            names=names,
        ),
    )
    city = write(
        "city_attributed",
        enrich.attribute_entities(
            out.read("city_responsibility"),
            out.read("city_capacity"),
            out.read("city_population"),
            classes,
            override,
            entity="city",
        ),
    )
    write("region_enriched", enrich.with_group_mean(region))
    write("city_enriched", enrich.with_group_mean(city))
    rollups = write("rollups", enrich.rollup_levels(region))
    country = write("country_rollup", enrich.roll_up(rollups, "country"))
    group = write("group_rollup", enrich.roll_up(rollups, "group"))
    by_class = enrich.roll_up(rollups, "class").where(F.col("class_region").isNotNull())
    write("class_rollup", by_class.select("scenario_id", "year", "class_region", "resp_mt", "capc_mt"))
    for name, frame in (("region", region), ("group", group), ("city", city)):
        write(f"{name}_{s.check_year}", enrich.year_slice(frame, s.check_year))
    for entity, frame in (("region", region), ("country", country), ("city", city)):
        unique.report_base_rows(f"{entity}_index", frame, entity, s.cutoff)
        write(
            f"{entity}_index",
            enrich.index_to_base_year(
                frame, entity, s.cutoff, s.display_countries or None
            ),
        )
    return region, country, city


def _assessment(
    inputs, out: Results, s: Settings, write, on_map, catalogue: DataFrame, models: DataFrame, region, country, city
) -> None:
    """Target lines, fairness flags, temperature classes and the summary tables."""
    region_points = out.read("region_target_points")
    region_targets = write("region_targets", _trajectory(region_points, "region", TONNES_PER_MT, s, out))
    city_points = out.read("city_target_points").drop("cut_pct")
    city_targets = write("city_targets", _trajectory(city_points, "city", 1.0, s, out))
    country_targets = write(
        "country_targets",
        out.read("country_target_points").select(
            "country", "year", (F.col("value") / F.lit(TONNES_PER_MT)).alias("target_mt")
        ),
    )
    scenario_list = responsibility.scenarios(out.read("pathway"))
    for entity, frame, goal in (
        ("region", region, region_targets),
        ("country", country, country_targets),
    ):
        flags = write(
            f"{entity}_fairness",
            targets.fairness_flags(frame, goal, scenario_list, entity, s.check_year),
        )
        on_map(f"{entity}_fairness_map", flags, entity)
    classes = {}
    pathways = catalogue.select("scenario_id", "model", "scenario")
    for entity, frame, goal, drop_null in (
        ("region", region, region_targets, False),
        ("country", country, country_targets, True),
        ("city", city, city_targets, True),
    ):
        rows = frame.select("scenario_id", entity, "year", "resp_mt", "capc_mt")
        rows = compact_join(rows, pathways, ["scenario_id"]).drop("scenario_id")
        on = ["model", entity, "year"]
        paired = write(
            f"{entity}_paired",
            alignment.pair_scenarios(rows, s.wide_scenario, s.tight_scenario, on, scenario="scenario"),
        )
        classed = alignment.classify_alignment(paired, goal, entity, s.check_year, drop_null, models)
        if entity == "city":
            points = cities.point_from_geojson(inputs.table("city_points"), "centroid")
            classed = classed.join(points, "city", "left")
        classes[entity] = write(f"{entity}_alignment", classed)
        if entity != "city":
            on_map(f"{entity}_alignment_map", classes[entity], entity)
    write(
        "alignment_summary",
        alignment.alignment_summary(classes["region"], classes["country"], classes["city"], ["model"]),
    )
    ambition = write(
        "relative_ambition",
        alignment.relative_ambition(
            classes["region"], classes["city"], classes["country"], s.strict_ambition, ["model"]
        ),
    )
    write("ambition_summary", alignment.ambition_summary(ambition, ["model"]))


def _trajectory(points: DataFrame, entity: str, scale: float, s: Settings, out: Results) -> DataFrame:
    """Target lines; ``scale`` is what a point's unit has to be divided by to be Mt."""
    history = None
    if s.anchor == "observed":
        total = out.read(f"{entity}_emissions").groupBy(entity, "year").agg(strict_sum("ghg_mt").alias("value"))
        history = total.withColumn("value", F.col("value") * F.lit(scale))
    anchors = targets.anchor_single_targets(points, entity, s.cutoff, s.anchor, history)
    return targets.target_trajectory(points, anchors, entity, scale)
