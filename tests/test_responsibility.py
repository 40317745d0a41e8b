import pytest
from pyspark.sql import functions as F

from carbonsplit.operators import responsibility as r

EM = "region string, year int, ghg_mt double"
POP = "region string, year int, population double"
PATH = "scenario_id string, year int, positive_mt double, removal_mt double"


@pytest.fixture(scope="module")
def world(frame):
    emissions = frame(EM, ("a", 2021, 10.0), ("a", 2022, 20.0), ("b", 2022, 10.0), ("c", 2022, 0.0))
    population = frame(
        POP, ("a", 2022, 1.0), ("a", 2050, 1.0), ("b", 2022, 5.0), ("c", 2022, 1.0), ("d", 2022, 2.0)
    )
    path = frame(
        PATH,
        ("s", 2022, 99.0, -9.0), ("s", 2023, 40.0, -1.0), ("s", 2024, 20.0, -3.0),
        ("t", 2023, 10.0, -2.0),
    )
    return emissions, population, path


def test_positive_formula(world, rows):
    got = rows(
        r.responsibility_positive(*world, 2022).where("region = 'a'"),
        "scenario_id", "year", "entity_hist_mt", "world_hist_mt", "budget_mt", "cumulative_mt",
        "population_share", "entity_cumulative_mt", "entity_budget_mt", "allocation_mt",
    )
    assert got == [
        ("s", 2023, 30.0, 40.0, 60.0, 100.0, 0.2, 20.0, -10.0, round(-10 / 60 * 40, 9)),
        ("s", 2024, 30.0, 40.0, 60.0, 100.0, 0.2, 20.0, -10.0, round(-10 / 60 * 20, 9)),
        ("t", 2023, 30.0, 40.0, 10.0, 50.0, 0.2, 10.0, -20.0, -20.0),
    ]


def test_removal_is_population_share(world, rows):
    got = rows(
        r.responsibility_removal(*world, 2022).where("region = 'b'"),
        "scenario_id", "year", "entity_hist_mt", "world_hist_mt", "allocation_mt",
    )
    assert got == [("s", 2023, 0.0, 0.0, -0.5), ("s", 2024, 0.0, 0.0, -1.5), ("t", 2023, 0.0, 0.0, -1.0)]


def test_total_is_history_then_both_parts(world, rows):
    emissions, population, path = world
    got = dict(
        ((s, y), v)
        for s, e, y, v in rows(
            r.responsibility_total(emissions, population, path, 2022),
            "scenario_id", "region", "year", "value_mt",
        )
        if e == "a"
    )
    assert got[("s", 2021)] == got[("t", 2021)] == 10.0
    assert got[("t", 2023)] == pytest.approx(-20.0 - 0.4)
    assert sorted(got) == [("s", 2021), ("s", 2022), ("s", 2023), ("s", 2024), ("t", 2021), ("t", 2022), ("t", 2023)]


def test_allocations_add_up_to_the_world(frame, world):
    emissions, _, path = world
    population = frame(POP, ("a", 2022, 3.0), ("b", 2022, 4.0), ("c", 2030, 5.0))
    total = (
        r.responsibility_wide(emissions, population, path, 2022)
        .groupBy("scenario_id", "year").agg(F.sum("positive_mt"), F.sum("removal_mt"))
    )
    want = {(p.scenario_id, p.year): (p.positive_mt, p.removal_mt) for p in path.collect()}
    for s, y, positive, removal in total.collect():
        assert (positive, removal) == pytest.approx(want[(s, y)])


def test_missing_population_and_missing_history(frame, world, rows):
    emissions, population, path = world
    some = population.where("region <> 'b'")
    got = rows(r.responsibility_wide(emissions, some, path, 2023), "scenario_id", "region", "allocation_mt")
    assert [(s, e, v is None) for s, e, v in got] == [("s", "a", False), ("s", "b", True), ("s", "c", False)]
    unknown = emissions.unionByName(frame(EM, ("c", 2020, None)))
    values = r.responsibility_wide(unknown, population, path, 2022).select("positive_mt").collect()
    assert values and all(v[0] is None for v in values)


def test_subset_uses_the_given_denominator(frame, rows):
    emissions = frame("city string, year int, ghg_mt double", ("x", 2022, 5.0), ("y", 2022, 15.0))
    population = frame("city string, year int, population double", ("x", 2022, 1.0), ("y", 2022, 1.0))
    world = frame("region string, year int, population double", ("r", 2022, 10.0))
    path = frame(PATH, ("s", 2023, 30.0, -10.0))
    got = r.responsibility_wide(emissions, population, path, 2022, "city", world)
    assert rows(got, "city", "positive_mt", "removal_mt") == [
        ("x", round((50 * 0.1 - 5) / 30 * 30, 9), -1.0),
        ("y", round(50 * 0.1 - 15, 9), -1.0),
    ]


def test_unknown_pathway_year_makes_the_budget_unknown(frame, world, rows):
    emissions, population, _ = world
    path = frame(PATH, ("s", 2023, 40.0, -1.0), ("s", 2024, 20.0, None))
    got = rows(r.responsibility_wide(emissions, population, path, 2022), "removal_mt", "region")
    assert {v for v, _ in got} == {None}
