import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from carbonsplit.operators import pathway

IDS = ["model", "scenario_id", "region", "variable", "unit"]


@pytest.fixture(scope="module")
def sheet(frame):
    return frame(
        "model string, scenario_id string, region string, variable string, unit string, "
        "`2010` double, `2020` double, `2025` double, `2030` double",
        ("m", "s", "World", "Emissions|CO2", "Mt", 1.0, 100.0, 0.0, 50.0),
        ("m", "s", "World", "Emissions|CH4", "Mt", 1.0, 2.0, 1.0, 1.0),
        ("m", "s", "World", "Emissions|N2O", "kt", 1.0, 1000.0, None, 2000.0),
        ("m", "s", "World", "Emissions|CO2|AFOLU", "Mt", 1.0, 10.0, 0.0, -10.0),
        ("m", "s", "World", "Price|Carbon", "USD", 1.0, 9.0, 9.0, 9.0),
    )


def test_melt_keeps_nonzero_emission_anchors_since(sheet, rows):
    got = pathway.melt_scenario(sheet, IDS)
    assert rows(got, "variable", "year", "value") == [
        ("Emissions|CH4", 2020, 2.0), ("Emissions|CH4", 2025, 1.0), ("Emissions|CH4", 2030, 1.0),
        ("Emissions|CO2", 2020, 100.0), ("Emissions|CO2", 2030, 50.0),
        ("Emissions|CO2|AFOLU", 2020, 10.0), ("Emissions|CO2|AFOLU", 2030, -10.0),
        ("Emissions|N2O", 2020, 1000.0), ("Emissions|N2O", 2030, 2000.0),
    ]


def test_melt_ignores_columns_that_are_no_year(frame, rows):
    wide = frame("variable string, note double, `2020` double", ("Emissions|CO2", 5.0, 1.0))
    assert rows(pathway.melt_scenario(wide, ["variable"]), "year", "value") == [(2020, 1.0)]


def test_co2e_converts_units(sheet, rows):
    got = pathway.scenario_co2e(pathway.melt_scenario(sheet, IDS))
    assert rows(got, "year", "value") == [
        (2020, 100 + 50 + 298 + 10.0), (2025, 25.0), (2030, 50 + 25 + 596 - 10.0),
    ]


def test_net_bridges_dropped_zeros(sheet, rows):
    got = dict(rows(pathway.net_pathway(sheet, IDS), "year", "net_mt"))
    assert sorted(got) == list(range(2020, 2031))
    assert got[2025] == 25.0 and got[2021] == pytest.approx(458 + (25 - 458) / 5)


def test_removal_sums_nonnegative_unweighted(sheet, rows):
    got = dict(rows(pathway.removal_pathway(sheet, IDS), "year", "removal_mt"))
    assert got[2020] == pytest.approx(-(100 + 2 + 1000 + 10) / 10_000)
    assert got[2025] == pytest.approx(-(0 + 1 + 0) / 10_000)
    assert got[2030] == pytest.approx(-(50 + 1 + 2000) / 10_000)


POINTS = "k string, year int, value double"


def test_interpolation_edges(frame, rows):
    df = frame(
        POINTS,
        ("dup", 1, 1.0), ("dup", 1, 3.0), ("dup", 3, 6.0),
        ("one", 1, 1.0),
        ("same_year", 1, 1.0), ("same_year", 1, 2.0),
        ("unknown_inside", 1, 1.0), ("unknown_inside", 2, None), ("unknown_inside", 3, 3.0),
        ("unknown_end", 1, None), ("unknown_end", 2, 2.0), ("unknown_end", 3, 4.0), ("unknown_end", 4, None),
        ("all_unknown", 1, None), ("all_unknown", 2, None),
        ("one_known", 1, None), ("one_known", 2, 5.0),
    )
    assert rows(pathway.interpolate_yearly(df, ["k"]), "k", "year", "value") == [
        ("dup", 1, 2.0), ("dup", 2, 4.0), ("dup", 3, 6.0),
        ("unknown_end", 1, None), ("unknown_end", 2, 2.0), ("unknown_end", 3, 4.0), ("unknown_end", 4, None),
        ("unknown_inside", 1, 1.0), ("unknown_inside", 2, 2.0), ("unknown_inside", 3, 3.0),
    ]
    lowest = pathway.interpolate_yearly(df, ["k"], ties="min")
    assert rows(lowest, "k", "year", "value")[:3] == [("dup", 1, 1.0), ("dup", 2, 3.5), ("dup", 3, 6.0)]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.dictionaries(st.integers(1990, 2050), st.floats(-1e6, 1e6), min_size=2, max_size=12),
        min_size=1,
        max_size=6,
    )
)
def test_interpolation_matches_numpy_and_its_anchors(frame, groups):
    data = [(str(i), y, v) for i, g in enumerate(groups) for y, v in g.items()]
    got = pathway.interpolate_yearly(frame(POINTS, *data), ["k"]).collect()
    for i, anchors in enumerate(groups):
        mine = sorted((r["year"], r["value"]) for r in got if r["k"] == str(i))
        xs = sorted(anchors)
        assert [y for y, _ in mine] == list(range(xs[0], xs[-1] + 1))
        want = np.interp([y for y, _ in mine], xs, [anchors[x] for x in xs])
        np.testing.assert_allclose([v for _, v in mine], want, rtol=1e-9, atol=1e-6)
        for year, value in mine:
            if year in anchors:
                assert value == anchors[year]


def test_year_span_is_unbounded_unless_asked(frame):
    df = frame(POINTS, ("k", 0, 0.0), ("k", 20_000, 2.0))
    assert pathway.interpolate_yearly(df, ["k"]).count() == 20_001
    with pytest.raises(Exception, match="year span above 10000"):
        pathway.interpolate_yearly(df, ["k"], max_span=10_000).collect()


def test_decompose_and_budget(frame, rows):
    net = frame("scenario_id string, year int, net_mt double", ("s", 2022, 9.0), ("s", 2023, 10.0), ("s", 2024, 8.0))
    removal = frame("scenario_id string, year int, removal_mt double", ("s", 2022, -1.0), ("s", 2023, -1.0), ("s", 2024, -2.0))
    landuse = frame("year int, landuse_mt double", (2022, 1.0), (2023, 2.0), (2024, 3.0))
    path = pathway.decompose_pathway(net, removal, landuse)
    assert rows(path, "year", "net_excl_landuse_mt", "positive_mt") == [
        (2022, 8.0, 9.0), (2023, 8.0, 9.0), (2024, 5.0, 7.0),
    ]
    assert rows(pathway.remaining_budget(path, 2022)) == [("s", 16.0)]
    assert rows(pathway.remaining_budget(path, 2022, "removal_mt")) == [("s", -3.0)]
    gap = pathway.decompose_pathway(net, removal, landuse.where("year < 2024"))
    assert rows(pathway.remaining_budget(gap, 2022)) == [("s", None)]


def test_landuse_level(frame, rows):
    table = frame("temperature double, year int, landuse_mt double", (1.5, 2020, 1.0), (2.0, 2020, 2.0))
    assert rows(pathway.pick_landuse(table)) == [(2020, 2.0)]
    assert rows(pathway.pick_landuse(table, 1.5)) == [(2020, 1.0)]


def test_history_and_pathway_long_and_sanity(frame, rows):
    em = frame("region string, year int, ghg_mt double", ("a", 2022, 1000.0), ("b", 2022, 2000.0))
    path = frame(
        "scenario_id string, year int, net_mt double, removal_mt double, landuse_mt double, "
        "net_excl_landuse_mt double, positive_mt double",
        ("s", 2022, 1.0, 2.0, 3.0, 4.0, 5000.0),
    )
    assert rows(pathway.world_history(em)) == [(2022, 3000.0)]
    got = pathway.history_and_pathway_long(em, path)
    assert rows(got, "series", "scenario_id", "year", "value_mt") == [
        ("Historic Emissions", None, 2022, 3000.0),
        ("LULUCF Emissions", "s", 2022, 3.0),
        ("Negative Emissions", "s", 2022, 2.0),
        ("Net Emissions with LULUCF", "s", 2022, 1.0),
        ("Net Emissions without LULUCF", "s", 2022, 4.0),
        ("Positive Emissions", "s", 2022, 5000.0),
    ]
    assert rows(pathway.pathway_sanity(em, path, 2022)) == [("s", 3.0, 5.0)]
