import pytest

from carbonsplit.operators import alignment as a, breaks, targets as t

PLEDGE = (
    "region string, name string, country string, baseline_value double, baseline_year int, "
    "cut_pct double, target_year int"
)


def pledges(frame):
    return frame(
        PLEDGE,
        ("r", "R", "A", 100.0, 2010, 40.0, 2030), ("r", "R", "A", 100.0, 2010, 100.0, 2050),
        ("single", "S", "A", 50.0, None, 20.0, 2030),
        ("none", "N", "A", None, 2010, 20.0, 2030),
        ("nameless", None, "A", 1.0, 2010, 20.0, 2030),
        ("base", "B", "A", 50.0, None, 20.0, 2022),
    )


def test_target_points(frame, rows):
    got = t.target_points(pledges(frame))
    assert rows(got, "region", "year", "value") == [
        ("base", 2022, 40.0), ("r", 2010, 100.0), ("r", 2030, 60.0), ("r", 2050, 0.0), ("single", 2030, 40.0),
    ]
    cut = t.target_points(pledges(frame), scale=10, with_cut=True)
    assert rows(cut.where("region = 'r'"), "year", "value", "cut_pct") == [
        (2010, 10.0, 0.0), (2030, 6.0, 40.0), (2050, 0.0, 100.0),
    ]


def test_anchors_and_trajectory(frame, rows):
    points = t.target_points(pledges(frame))
    anchors = t.anchor_single_targets(points)
    assert rows(anchors, "region", "year", "value") == [("base", 2022, 40.0), ("single", 2022, 40.0)]
    observed = frame("region string, year int, value double", ("single", 2022, 48.0), ("single", 2021, 1.0))
    assert rows(
        t.anchor_single_targets(points, anchor="observed", history=observed), "region", "value"
    ) == [("base", None), ("single", 48.0)]
    with pytest.raises(ValueError):
        t.anchor_single_targets(points, anchor="observed")
    line = t.target_trajectory(points, anchors, scale=10)
    got = {(e, y): v for e, y, v in rows(line, "region", "year", "target_mt")}
    # the entity whose only pledge year is the anchor year has no line
    assert {e for e, _ in got} == {"r", "single"}
    assert got[("r", 2010)] == 10.0 and got[("r", 2020)] == 8.0 and got[("r", 2040)] == 3.0
    assert len([1 for e, _ in got if e == "r"]) == 41
    assert {v for (e, _), v in got.items() if e == "single"} == {4.0}


def test_lowest_pledge_of_a_year_counts(frame, rows):
    points = frame(
        "region string, name string, country string, year int, value double",
        ("r", "R", "A", 2020, 9.0), ("r", "R", "A", 2020, 5.0), ("r", "R", "A", 2022, 1.0),
    )
    line = t.target_trajectory(points, points.limit(0), scale=1)
    assert rows(line, "year", "target_mt") == [(2020, 5.0), (2021, 3.0), (2022, 1.0)]


def test_national_pledges(frame, rows):
    raw = frame(
        "country string, category string, ambition string, year int, value_mt double",
        ("A", "Current", "low", 2030, 1.0), ("A", "Current", "high", 2030, 3.0),
        ("A", "Other", "low", 2030, 99.0), ("B", "Current", "low", 2030, None),
    )
    extra = frame("value double, country string, year int", (7.0, "L", 2025))
    assert rows(t.average_national_pledges(raw, extra)) == [("A", 2030, 2e6), ("L", 2025, 7.0)]


ALLOC = "scenario_id string, region string, year int, resp_mt double, capc_mt double"
GOAL = "region string, country string, year int, target_mt double"


def test_fairness_flags(frame, rows):
    alloc = frame(
        ALLOC,
        ("s", "both", 2030, 2.0, 3.0), ("s", "one", 2030, 2.0, 0.5), ("s", "none", 2030, 0.1, 0.2),
        ("s", "tie", 2030, 1.0, 2.0), ("t", "both", 2030, 0.0, 0.0),
    )
    goals = frame(
        GOAL, *[(e, "A", 2030, 1.0) for e in ("both", "one", "none", "tie", "unknown")], ("late", "A", 2031, 1.0)
    )
    scenarios = frame("scenario_id string", ("s",), ("t",))
    got = t.fairness_flags(alloc, goals, scenarios)
    assert rows(got.where("scenario_id = 's'"), "region", "resp_fair", "capc_fair", "fair_rules") == [
        ("both", 1, 1, "2"), ("none", 0, 0, "0"), ("one", 1, 0, "1"), ("tie", None, 1, None),
        ("unknown", None, None, None),
    ]
    assert got.where("scenario_id = 't'").count() == 5


def classes(frame, drop_null=True):
    alloc = frame(
        ALLOC,
        *[(s, e, 2030, v, v) for e, v15, v20 in (
            ("tight", 2.0, 3.0), ("wide", 0.5, 3.0), ("neither", 0.5, 0.6), ("tie", 0.5, 1.0), ("only20", None, 0.2),
        ) for s, v in (("15", v15), ("20", v20))],
        ("15", "only15", 2030, 9.0, 9.0),
    )
    paired = a.pair_scenarios(alloc, "20", "15", ["region", "year"])
    goals = frame(GOAL, *[(e, "A", 2030, 1.0) for e in ("tight", "wide", "neither", "tie", "only20", "only15")])
    return a.classify_alignment(paired, goals, drop_null=drop_null)


def test_alignment_classes(frame, rows):
    assert rows(classes(frame, False), "region", "alignment") == [
        ("neither", "> 2.0 °C"), ("only15", None), ("only20", "> 2.0 °C"), ("tie", None),
        ("tight", "1.5 °C"), ("wide", "2.0 °C"),
    ]
    assert classes(frame).count() == 4


def test_alignment_summary(frame, rows):
    few = frame("alignment string", ("1.5 °C",), ("1.5 °C",), ("> 2.0 °C",))
    got = a.alignment_summary(classes(frame, False), few, few.limit(0))
    assert rows(got, "entity_type", "alignment", "n", "percent") == [
        ("Country", "1.5 °C", 2, 66.67), ("Country", "> 2.0 °C", 1, 33.33),
        ("Region", "1.5 °C", 1, 16.67), ("Region", "2.0 °C", 1, 16.67), ("Region", "> 2.0 °C", 2, 33.33),
        ("Region", None, 2, 33.33),
    ]


CLASS = "country string, {0} string, year int, alignment string"


def test_relative_ambition(frame, rows):
    order = ("1.5 °C", "2.0 °C", "> 2.0 °C")
    country = frame("country string, year int, alignment string", *[(c, 2030, c) for c in order])
    cities = frame(
        CLASS.format("city"), *[(c, f"{own}|{c}", 2030, own) for own in order for c in (*order, "other")]
    )
    regions = frame(CLASS.format("region"), ("1.5 °C", "null", 2030, None))
    loose = a.relative_ambition(regions, cities, country)
    got = dict(rows(loose, "entity_id", "ambition"))
    assert got["1.5 °C|> 2.0 °C"] == got["2.0 °C|> 2.0 °C"] == "More Ambitious"
    assert got["1.5 °C|1.5 °C"] == got["> 2.0 °C|> 2.0 °C"] == "As Ambitious"
    assert got["1.5 °C|2.0 °C"] == got["2.0 °C|1.5 °C"] == got["1.5 °C|other"] == got["null"] == "Less Ambitious"
    strict = dict(rows(a.relative_ambition(regions, cities, country, strict=True), "entity_id", "ambition"))
    assert strict["1.5 °C|2.0 °C"] == "More Ambitious"
    assert strict["2.0 °C|1.5 °C"] == "Less Ambitious"
    assert strict["1.5 °C|other"] is None and strict["null"] is None
    summary = rows(a.ambition_summary(loose), "entity_type", "ambition", "n", "percent")
    assert summary == [
        ("City", "As Ambitious", 3, 25.0), ("City", "Less Ambitious", 7, 58.33),
        ("City", "More Ambitious", 2, 16.67), ("Region", "Less Ambitious", 1, 100.0),
    ]


def test_breaks(frame):
    df = frame("x double", (-6.0,), (3.0,), (None,), (12.0,))

    def values(**options):
        return [r["break"] for r in breaks.diverging_breaks(df, "x", **options).orderBy("position").collect()]

    assert values() == pytest.approx([-6, -4, -2, 0, 4, 8, 12])
    assert values(scale=2) == pytest.approx([-3, -2, -1, 0, 2, 4, 6])
    assert values(lo=-300, hi=300) == pytest.approx([-300, -200, -100, 0, 100, 200, 300])
    import numpy as np

    want = np.sinh([*(np.arcsinh(-6) * np.array([1, 2 / 3, 1 / 3])), 0, *(np.arcsinh(12) * np.array([1 / 3, 2 / 3, 1]))])
    assert values(method="asinh") == pytest.approx(list(want))
    with pytest.raises(ValueError):
        values(method="log")
