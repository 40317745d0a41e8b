"""Sheets with several regions and models."""

from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from carbonsplit.operators import pathway
from carbonsplit.operators.constraints import Uniqueness
from carbonsplit.plans import region_run
from carbonsplit.plans.settings import Settings

IDS = Settings().sheet_ids
SCHEMA = "model string, scenario_id string, region string, variable string, unit string, `2020` double, `2030` double"


@pytest.fixture(scope="module")
def sheet(frame):
    return frame(
        SCHEMA,
        ("m1", "20", "World", "Emissions|CO2", "Mt", 10.0, 20.0),
        ("m1", "20", "Europe", "Emissions|CO2", "Mt", 1.0, 2.0),
        ("m2", "20", "World", "Emissions|CO2", "Mt", 100.0, 200.0),
        ("m2", "20", "Europe", "Emissions|CO2", "Mt", 5.0, 6.0),
        ("m2", "15", "World", "Emissions|CO2", "Mt", 7.0, 8.0),
    )


class FakeInputs:
    def __init__(self, sheet, landuse):
        self._sheet, self._landuse = sheet, landuse

    def sheet(self, ids):
        return self._sheet

    def table(self, name):
        return self._landuse


def of_run(sheet, frame, settings, *landuse):
    found = {}

    def write(name, df, **_):
        found[name] = df
        return df

    landuse = landuse or [(2.0, y, 0.0) for y in range(2020, 2031)]
    table = frame("temperature double, year int, landuse_mt double", *landuse)
    emissions = frame("country string, region string, year int, ghg_mt double", ("a", "b", 2020, 1.0))
    unique = Uniqueness()
    region_run._pathway(FakeInputs(sheet, table), emissions, settings, write, unique)
    return found["pathway"], found["pathway_catalogue"], unique.violations()


def test_run_keeps_models_and_regions_apart(sheet, frame, rows):
    got, catalogue, _ = of_run(sheet, frame, Settings())
    got = got.where("year in (2020, 2030)")
    assert rows(got, "scenario_id", "year", "net_mt") == [
        ("15", 2020, 7.0), ("15", 2030, 8.0),
        ("m1|20", 2020, 10.0), ("m1|20", 2030, 20.0),
        ("m2|20", 2020, 100.0), ("m2|20", 2030, 200.0),
    ]
    assert rows(got.where("year = 2020"), "scenario_id", "removal_mt") == [("15", -0.0007), ("m1|20", -0.001), ("m2|20", -0.01)]
    assert rows(catalogue) == [
        ("15", "m2", "15", "World", 2.0), ("m1|20", "m1", "20", "World", 2.0), ("m2|20", "m2", "20", "World", 2.0),
    ]


def test_region_is_a_setting(sheet, frame, rows):
    got, *_ = of_run(sheet, frame, Settings(sheet_region="Europe"))
    assert rows(got.where("year = 2020"), "scenario_id", "net_mt") == [("m1|20", 1.0), ("m2|20", 5.0)]
    with pytest.raises(ValueError, match="no rows of region"):
        of_run(sheet, frame, Settings(sheet_region="Asia"))


def test_land_use_is_that_of_the_nearest_level(sheet, frame, rows):
    series = [(level, y, 100 * level) for level in (1.0, 1.5, 2.0, 4.0) for y in range(2020, 2031)]
    settings = Settings(temperature=3.0, scenario_levels=("15=1.6",))
    got, _, violations = of_run(sheet, frame, settings, *series, (1.5, 2020, 150.0))
    # 3.0 lies between 2.0 and 4.0, and the lower level counts
    assert rows(got.where("year = 2020"), "scenario_id", "landuse_mt") == [("15", 150.0), ("m1|20", 200.0), ("m2|20", 200.0)]
    assert rows(violations) == [("landuse", "temperature,year", "1.5|2020", 2)]


def test_one_model_keeps_its_names(sheet, rows):
    one = sheet.where("model = 'm2'")
    got = pathway.select_pathways(one, pathway.pathway_catalogue(one, "World"))
    assert got.columns == sheet.columns
    assert rows(got, "scenario_id") == [("15",), ("20",)]


def test_sheet_without_model_and_region(sheet, rows):
    bare = sheet.where("model = 'm2' AND region = 'World'").drop("model", "region")
    catalogue = pathway.pathway_catalogue(bare, "World")
    assert rows(catalogue, "scenario_id", "model", "region") == [("15", "", ""), ("20", "", "")]
    assert rows(pathway.select_pathways(bare, catalogue)) == rows(bare)
    unknown = sheet.withColumn("model", F.lit(None).cast("string"))
    assert pathway.select_pathways(unknown, pathway.pathway_catalogue(unknown, "World")).count() == 3
