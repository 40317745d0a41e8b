import pytest
from pyspark.sql import functions as F

from carbonsplit.operators import capacity as c

POP = "country string, region string, year int, population double"
GDP = "country string, region string, year int, gdp double"
PATH = "scenario_id string, year int, positive_mt double, removal_mt double"


@pytest.fixture(scope="module")
def world(frame):
    population = frame(
        POP,
        ("A", "A.1", 2023, 2.0), ("A", "A.2", 2023, 4.0), ("A", "A.3", 2023, 4.0),
        ("B", "B.1", 2023, 5.0), ("Z", "Z.1", 2023, 9.0), ("A", "A.1", 2022, 1.0),
    )
    gdp = frame(
        GDP,
        ("A", "A.1", 2023, 2.0), ("A", "A.2", 2023, 8.0), ("A", "A.3", 2023, 0.0),
        ("B", "B.1", 2023, 5.0), ("Z", "Z.1", 2023, 0.0), ("A", "A.1", 2022, 1.0),
    )
    path = frame(PATH, ("s", 2022, 1.0, 1.0), ("s", 2023, 30.0, -3.0), ("t", 2023, 15.0, -6.0))
    return population, gdp, path


def test_country_split(world, rows):
    # A: population 10 (with its zero-GDP region), GDP 10 -> 10; B: 25/5 -> 5; Z has no GDP.
    assert rows(
        c.capacity_country_positive(*world, 2022),
        "scenario_id", "country", "pop2_gdp", "pop2_gdp_total", "allocation_mt",
    ) == [
        ("s", "A", 10.0, 15.0, 20.0), ("s", "B", 5.0, 15.0, 10.0),
        ("t", "A", 10.0, 15.0, 10.0), ("t", "B", 5.0, 15.0, 5.0),
    ]
    assert rows(
        c.capacity_country_removal(*world, 2022), "scenario_id", "country", "gdp_total", "allocation_mt"
    ) == [("s", "A", 15.0, -2.0), ("s", "B", 15.0, -1.0), ("t", "A", 15.0, -4.0), ("t", "B", 15.0, -2.0)]


def test_region_split_is_nested(world, rows):
    population, gdp, path = world
    country = c.capacity_country_wide(population, gdp, path, 2022)
    region = c.capacity_region_wide(population, gdp, country, path, 2022)
    # within A: 4/2 = 2 and 16/8 = 2; the zero-GDP region is gone before the denominator
    assert rows(region.where("scenario_id = 's'"), "region", "positive_mt", "removal_mt", "allocation_mt") == [
        ("A.1", 10.0, -0.4, 9.6), ("A.2", 10.0, -1.6, 8.4), ("B.1", 10.0, -1.0, 9.0),
    ]
    sums = region.groupBy("scenario_id").agg(F.sum("positive_mt"), F.sum("removal_mt")).collect()
    assert {tuple(r) for r in sums} == {("s", 30.0, -3.0), ("t", 15.0, -6.0)}


def test_unknown_population_spoils_its_year_only(frame, rows):
    population = frame(POP, ("A", "A.1", 2023, None), ("B", "B.1", 2023, 5.0), ("B", "B.1", 2024, 5.0))
    gdp = frame(GDP, ("A", "A.1", 2023, 1.0), ("B", "B.1", 2023, 5.0), ("B", "B.1", 2024, 5.0))
    path = frame(PATH, ("s", 2023, 30.0, -3.0), ("s", 2024, 20.0, -2.0))
    got = rows(c.capacity_country_wide(population, gdp, path, 2022), "year", "country", "positive_mt")
    assert got == [(2023, "A", None), (2023, "B", None), (2024, "B", 20.0)]


def test_year_without_a_pathway_value_stays_with_null(frame, rows):
    population = frame(POP, ("A", "A.1", 2023, 1.0), ("A", "A.1", 2024, 1.0))
    gdp = frame(GDP, ("A", "A.1", 2023, 1.0), ("A", "A.1", 2024, 1.0))
    path = frame(PATH, ("s", 2023, 30.0, -3.0))
    got = c.capacity_country_wide(population, gdp, path, 2022)
    assert rows(got, "scenario_id", "year", "allocation_mt") == [("s", 2023, 27.0), ("s", 2024, None)]


def test_series_put_history_in_front(world, frame, rows):
    population, gdp, path = world
    emissions = frame(
        "country string, region string, year int, ghg_mt double",
        ("A", "A.1", 2022, 1.0), ("A", "A.2", 2022, 2.0), ("B", "B.1", 2022, None),
    )
    series = c.capacity_country_total(emissions, population, gdp, path, 2022)
    assert rows(series.where("scenario_id = 's'"), "country", "year", "value_mt") == [
        ("A", 2022, 3.0), ("A", 2023, 18.0), ("B", 2022, None), ("B", 2023, 9.0),
    ]
    country = c.capacity_country_wide(population, gdp, path, 2022)
    region = c.capacity_region_wide(population, gdp, country, path, 2022)
    series = c.capacity_region_total(emissions, region, path)
    assert series.where("scenario_id = 't' AND year = 2022").count() == 3
    assert series.where("year = 2023").count() == 6
