"""All three levels from input files to result tables, against the operators applied directly."""

import os

import pytest
from pyspark.sql import functions as F

from carbonsplit.__main__ import main
from carbonsplit.operators import alignment, capacity, responsibility, targets
from carbonsplit.plans import bindings as b
from carbonsplit.plans.analysis_run import _paired_models
from carbonsplit.plans.bindings import Star
from carbonsplit.plans.inputs import CSV_TABLES, Results
from carbonsplit.plans.settings import Settings
from carbonsplit.sources import SCHEMAS

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def eras(frame):
    year = F.col("year")
    return {
        "early": frame.where(year <= 1997),
        "middle": frame.where(year.between(1997, 1999)),
        "late": frame.where(year >= 1999),
    }


@pytest.fixture(scope="module")
def star(spark):
    return Star(spark, FOLDER)


@pytest.fixture(scope="module")
def gdp(star):
    """Without zeros, so that the screens remove nothing."""
    return star.stored("region_year").select(
        "country", "region", "year", (F.col("turnover_e2") / F.lit(1e2)).alias("gdp")
    )


@pytest.fixture(scope="module")
def out(spark, star, gdp, tmp_path_factory):
    folder = tmp_path_factory.mktemp("inputs")
    region_long = b._gas_rows(
        star.stored("region_year").withColumn("sector", F.lit("TOTAL")),
        ["country", "region", "name", "sector"],
    )
    tables = {
        "region_gdp": gdp,
        "region_emissions": region_long,
        "city_emissions": star.city_emissions_long,
        "city_map": star.city_map,
        "landuse": star.landuse_table,
        "classes": star.classes.withColumn("name", F.lit("x, y")),
        "override": star.members,
        "sovereigns": star.sovereigns,
        "region_pledges": star.region_pledges,
        "city_pledges": star.city_pledges,
        "national_pledges": star.national_pledges,
        "extra_pledges": star.extra_pledges,
        "city_points": star.city_points.withColumn("area", F.lit(1.0)),
        "region_layer": star.region_layer,
        "country_layer": star.country_layer,
    }
    for kind, people in (("region", star.population), ("city", star.city_population)):
        for era, part in eras(people).items():
            tables[f"{kind}_population_{era}"] = part
    for name, df in tables.items():
        schema = SCHEMAS[name if name in SCHEMAS else name.rsplit("_", 1)[0]]
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        if name in CSV_TABLES:
            df.toPandas().to_csv(folder / f"{name}.csv", index=False)
        else:
            df.write.parquet(str(folder / f"{name}.parquet"))
    sheet = star.sheet_of_models.withColumnsRenamed({"model": "Model", "scenario_id": "Scenario", "region": "Region"})
    sheet.toPandas().to_csv(folder / "scenario_sheet.csv", index=False)
    # names of a file's own, a class row too many and two cells that are no numbers
    text = (folder / "classes.csv").read_text().replace("country,", "iso,", 1).replace(",country", ",iso", 1)
    (folder / "classes.csv").write_text(text + text.splitlines()[1] + "\n")
    (folder / "extra_pledges.csv").open("a").write("024,20x0,1.0\n024,2010,-\n")
    (folder / "columns.json").write_text(
        '{"classes": {"iso": "country"}, "scenario_sheet": {"Model": "model", "Scenario": "scenario_id", "Region": "region"}}'
    )
    results = str(tmp_path_factory.mktemp("results"))
    main(
        [
            "all", "--inputs", str(folder), "--results", results,
            "--cutoff", "1998", "--next-year", "1999", "--check-year", "2000",
            "--panel-start", "1995", "--pathway-start", "1997",
            "--first-boundary", "1997", "--second-boundary", "1999",
            "--min-population", "0", "--ratio-lo", "0.3", "--ratio-hi", "0.4",
            "--tight-scenario", "s15", "--wide-scenario", "s20", "--missing-gas", "0",
            "--sheet-ids", *b.SHEET_IDS, "--display-countries", "007", "003",
            "--dropped-codes", "010", "--columns", str(folder / "columns.json"),
            "--scenario-levels", "s15=1.6", "s30=2.7", "--rollup-to-sovereigns", "--strict-ambition",
            "--anchor", "observed",
        ]
    )
    return Results(spark, results)


def same(got, want, keys):
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)

    def shown(df):
        return sorted(
            (tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in df.select(columns).collect()),
            key=str,
        )

    left, right = shown(got), shown(want)
    assert left and left == right


def test_panels_and_pathway(out, star):
    same(out.read("region_population"), star.population, ["region", "year"])
    same(out.read("region_emissions"), star.history, ["region", "year"])
    same(out.read("pathway"), star.pathway_of_models, ["scenario_id", "year"])
    same(out.read("pathway_catalogue"), star.catalogue, ["scenario_id"])
    assert out.read("pathway_unmatched_years").count() == 0
    assert out.read("coverage").collect()[0].covered_pct == pytest.approx(100.0)


def test_series(out, star, gdp):
    path = star.stored("pathway_of_models")
    want = responsibility.responsibility_total(star.history, star.population, path, 1998)
    same(out.read("region_responsibility"), want, ["region"])
    country = capacity.capacity_country_wide(star.population, gdp, path, 1998)
    same(out.read("country_capacity_wide"), country, ["country"])
    region = capacity.capacity_region_wide(star.population, gdp, country, path, 1998)
    same(out.read("region_capacity_wide"), region, ["region"])
    want = responsibility.responsibility_total(
        star.city_history, star.city_population, path, 1998, "city", star.population
    )
    same(out.read("city_responsibility"), want, ["city"])


def test_capacity_adds_up_at_both_levels(out):
    """Country amounts sum to the pathway, region amounts to their country."""
    path = {(r.scenario_id, r.year): r.positive_mt for r in out.read("pathway").collect()}
    country = out.read("country_capacity_wide")
    for r in country.groupBy("scenario_id", "year").agg(F.sum("positive_mt").alias("mt")).collect():
        assert r.mt == pytest.approx(path[(r.scenario_id, r.year)])
    keys = ["scenario_id", "country", "year"]
    summed = out.read("region_capacity_wide").groupBy(*keys).agg(F.sum("positive_mt").alias("mt"))
    joined = country.join(summed, keys).select("positive_mt", "mt").collect()
    assert len(joined) == country.count()
    for r in joined:
        assert r.mt == pytest.approx(r.positive_mt)


def test_targets_and_classes(out, star):
    same(out.read("country_targets").where("year < 2010"), star.country_targets, ["country"])
    observed = star.history.select("region", "year", (F.col("ghg_mt") * F.lit(1e6)).alias("value"))
    anchors = targets.anchor_single_targets(star.region_points, year=1998, anchor="observed", history=observed)
    same(out.read("region_targets"), targets.target_trajectory(star.region_points, anchors), ["region"])
    totals = {}
    for r in out.read("alignment_summary").collect():
        totals[r.model, r.entity_type] = totals.get((r.model, r.entity_type), 0) + r.percent
    assert set(totals) == {(m, e) for m in ("star", "nova") for e in ("Region", "Country", "City")}
    assert all(v == pytest.approx(100, abs=0.05) for v in totals.values())
    assert out.read("city_alignment").columns[-2:] == ["lon", "lat"]


def test_classes_of_each_model(out, star):
    """Both models are classed, each as if it were alone."""
    attributed = out.read("region_attributed")
    for model in ("star", "nova"):
        alone = attributed.where(F.col("scenario_id").startswith(f"{model}|"))
        paired = alignment.pair_scenarios(
            alone.select("scenario_id", "region", "year", "resp_mt", "capc_mt"), f"{model}|s20", f"{model}|s15", ["region", "year"]
        )
        want = alignment.classify_alignment(paired, out.read("region_targets"), "region", 2000, False)
        same(out.read("region_alignment").where(F.col("model") == model).drop("model"), want, ["region"])


def test_reports(out):
    cells = {(r.table, r.column): r.n_cells for r in out.read("input_unparsed").where("n_cells > 0").collect()}
    assert cells == {("extra_pledges", "year"): 1, ("extra_pledges", "value"): 1}
    broken = {(r.table, r.key): r.n_rows for r in out.read("analysis_violations").where("table = 'classes'").collect()}
    assert broken == {("classes", "country"): 2}
    assert out.read("region_violations").count() == 0 and out.read("city_violations").count() == 0
    attributed = out.read("region_attributed")
    assert attributed.count() == out.read("region_responsibility").count()
    assert {(r.map, r.bounds, r.method): r.n for r in out.read("gap_breaks").groupBy("map", "bounds", "method").agg(F.count("break").alias("n")).collect()} == {
        (m, b, w): 7
        for m in ("region_responsibility", "region_capacity", "country_responsibility", "country_capacity")
        for b in ("data", "limit")
        for w in ("linear", "asinh")
    }


def test_a_scenario_that_no_model_has_stops_the_analysis(out):
    with pytest.raises(ValueError, match="no model has both"):
        _paired_models(out.read("pathway_catalogue"), Settings(tight_scenario="15", wide_scenario="s20"))


def test_every_level_left_its_tables(out):
    written = set(os.listdir(out.folder))
    assert {
        "region_zero_population", "region_profile", "world_history", "history_and_pathway",
        "pathway_sanity", "remaining_budget", "region_responsibility_gap_1999",
        "country_capacity_gap_2000", "region_capacity_gap_2000", "city_zero_population",
        "city_population_trend", "city_history", "city_capacity", "region_responsibility_map_2000",
        "country_responsibility_map_1999", "gap_breaks", "rollups", "class_rollup",
        "group_2000", "region_index", "city_index", "country_index", "region_fairness",
        "country_fairness_map", "region_alignment_map", "relative_ambition", "ambition_summary",
    } <= written
    assert "010" not in {r.country for r in out.read("region_alignment_map").collect()}
