from carbonsplit.operators import panel


def test_boundary_years_come_from_the_middle_era(frame, rows):
    early = frame("region string, year int, population double", ("r", 1999, 1.0), ("r", 2000, 2.0))
    middle = frame("year int, region string, population double", (2000, "r", 3.0), (2020, "r", 4.0))
    late = frame("region string, year int, population double", ("r", 2020, 5.0), ("r", 2021, 6.0))
    got = panel.stitch_eras(early, middle, late, 2000, 2020)
    assert rows(got, "region", "year", "population") == [
        ("r", 1999, 1.0), ("r", 2000, 3.0), ("r", 2020, 4.0), ("r", 2021, 6.0),
    ]


def test_zero_census_rounds_half_to_even(frame, rows):
    df = frame(
        "country string, population double",
        ("a", 0.5), ("a", 0.4), ("a", 1.5), ("b", 2.0), ("c", None),
    )
    assert rows(panel.zero_count_census(df), "country", "n") == [("a", 2)]


GAS = "region string, sector string, year int, gas string, amount_t double"


def test_co2e_weights_and_missing_gas(frame, rows):
    long = frame(
        GAS,
        ("r", "T", 1990, "CO2", 1e6), ("r", "T", 1990, "CH4", 1e6), ("r", "T", 1990, "N2O", 1e6),
        ("r", "T", 1989, "CO2", 1e6),
        ("s", "T", 1990, "CO2", 2e6), ("s", "T", 1990, "CH4", None), ("s", "T", 1990, "N2O", 0.0),
        ("u", "T", 1990, "CO2", 3e6),
        ("v", "T", 1990, "CO2bio", 3e6),
    )
    got = panel.co2e_total(long, ["region", "sector"])
    assert rows(got, "region", "year", "ghg_mt") == [
        ("r", 1990, 324.0), ("s", 1990, None), ("u", 1990, None), ("v", 1990, None),
    ]
    filled = panel.co2e_total(long, ["region", "sector"], missing=0.0)
    assert rows(filled, "region", "ghg_mt")[1:] == [("s", 2.0), ("u", 3.0), ("v", 0.0)]


def test_sectors_stay_separate_rows(frame, rows):
    long = frame(
        GAS,
        *[("r", sector, 1990, gas, 1e6) for sector in "AB" for gas in ("CO2", "CH4", "N2O")],
    )
    got = panel.co2e_total(long, ["region", "sector"])
    assert rows(got) == [("r", 1990, 324.0), ("r", 1990, 324.0)]


PANEL = "country string, region string, name string, year int, ghg_mt double, population double, gdp double"


def test_profile_sums_ratios_and_share(frame, rows):
    df = frame(
        PANEL,
        ("A", "A.1", "one", 1990, 1.0, 1e6, 0.0), ("A", "A.1", "one", 1991, 2.0, 2e6, 0.0),
        ("B", "B.1", "two", 1990, 9.0, None, 3.0),
    )
    got = panel.intensity_profile(df)
    assert rows(
        got, "region", "ghg_t_per_person", "ghg_t_per_gdp", "ghg_share_pct", "label"
    ) == [("A.1", 1.0, None, 25.0, "one, A"), ("B.1", None, 3e6, 75.0, "two, B")]
    assert rows(got, "region", "ghg_t_per_year")[0] == ("A.1", round(3e6 / 53, 9))


def test_one_unknown_total_makes_every_share_unknown(frame, rows):
    df = frame(
        PANEL, ("A", "A.1", "one", 1990, 1.0, 1.0, 1.0), ("B", "B.1", "two", 1990, None, 1.0, 1.0)
    )
    assert rows(panel.intensity_profile(df), "ghg_share_pct") == [(None,), (None,)]


POP = "country string, region string, year int, population double"
GDP = "country string, region string, year int, gdp double"


def test_small_population_screen_keeps_whole_regions(frame, rows):
    pop = frame(
        POP,
        ("A", "small", 1, 99.0), ("A", "small", 2, 500.0),
        ("A", "big", 1, 100.0),
        ("A", "unknown", 1, 5.0), ("A", "unknown", 2, None),
    )
    gdp = frame(GDP, ("A", "small", 1, 7.0))
    got = panel.small_population_screen(pop, gdp, 100)
    assert rows(got, "region", "year", "gdp", "min_population") == [
        ("small", 1, 7.0, 99.0), ("small", 2, None, 99.0),
    ]


def test_screens_and_coverage(frame, rows):
    profile = frame(
        "country string, region string, gdp double, population double, ghg_share_pct double",
        ("A", "A.1", 0.0, 1.0, 10.0), ("A", "A.2", 1.0, 0.0, 20.0),
        ("X", "X.1", 1.0, 1.0, 30.0), (None, None, 1.0, 1.0, 40.0),
    )
    zero_gdp = panel.zero_denominator_screen(profile, "gdp")
    codes = panel.code_screen(profile, ["X"])
    assert rows(panel.zero_denominator_screen(profile, "population"), "region") == [("A.2",)]
    kept = panel.apply_screens(profile, [(zero_gdp, "region"), (codes, "country")])
    assert rows(kept, "region") == [("A.2",), (None,)]
    assert rows(panel.coverage_share(kept)) == [(60.0,)]
    merged = panel.apply_screens(profile, [(zero_gdp, "region"), (codes, "region")])
    assert rows(merged, "region") == [("A.2",), (None,)]


def test_entity_year_panel_keeps_emission_rows(frame, rows):
    em = frame("country string, region string, year int, ghg_mt double", ("A", "r", 1, 1.0), ("A", "r", 2, 2.0))
    got = panel.entity_year_panel(em, frame(POP, ("A", "r", 1, 5.0)), frame(GDP, ("A", "r", 2, 6.0)))
    assert rows(got, "year", "ghg_mt", "population", "gdp") == [(1, 1.0, 5.0, None), (2, 2.0, None, 6.0)]
