from carbonsplit.operators import enrich, gaps

SERIES = "scenario_id string, region string, year int, value_mt double"


def series(frame):
    return frame(
        SERIES,
        ("s", "AAA.1", 2022, 10.0), ("s", "AAA.1", 2030, 5.0), ("s", "AAA.1", 2025, 99.0),
        ("s", "AAA.2", 2022, 0.0), ("s", "AAA.2", 2030, 5.0),
        ("s", "BBB.1", 2030, 5.0),
        ("s", "CCC.1", 2022, 1.0), ("s", "CCC.1", 2030, -9.0),
        ("t", "AAA.1", 2022, 10.0), ("t", "AAA.1", 2030, 20.0),
    )


def test_year_gap_is_on_the_later_row(frame, rows):
    got = gaps.year_gap(series(frame), "region", 2022, 2030).where("scenario_id = 's'")
    assert rows(got, "region", "year", "gap_mt") == [
        ("AAA.1", 2022, None), ("AAA.1", 2030, -5.0), ("AAA.2", 2022, None), ("AAA.2", 2030, 5.0),
        ("BBB.1", 2030, None), ("CCC.1", 2022, None), ("CCC.1", 2030, -10.0),
    ]


def test_pct_gap_is_finite_and_clamped(frame, rows):
    gap = gaps.year_gap(series(frame), "region", 2022, 2030)
    got = gaps.pct_gap_clamped(gap, "region")
    assert rows(got, "scenario_id", "region", "gap_pct", "gap_pct_raw") == [
        ("s", "AAA.1", -50.0, -50.0), ("s", "CCC.1", -300.0, -1000.0), ("t", "AAA.1", 100.0, 100.0),
    ]


def test_rollup_counts_unknown_gaps_as_nothing(frame, rows):
    gap = gaps.year_gap(series(frame), "region", 2022, 2030).where("scenario_id = 's'")
    assert rows(gaps.rollup_gap(gap), "country", "year", "gap_mt", "value_mt") == [
        ("AAA", 2022, 0.0, 10.0), ("AAA", 2030, 0.0, 10.0), ("BBB", 2030, 0.0, 5.0),
        ("CCC", 2022, 0.0, 1.0), ("CCC", 2030, -10.0, -9.0),
    ]
    assert rows(gaps.rollup_pct_gap(gap), "country", "gap_pct") == [("AAA", 0.0), ("CCC", -300.0)]
    sovereigns = frame("country string, sovereign string", ("CCC", "AAA"))
    rolled = gaps.rollup_pct_gap(gap, sovereigns=sovereigns)
    assert rows(rolled, "country", "gap_pct_raw") == [("AAA", round(-1000 / 11, 9))]


def test_world_trend_is_strict(frame, rows):
    df = frame(SERIES, ("s", "a", 1, 1.0), ("s", "b", 1, 2.0), ("s", "a", 2, 1.0), ("s", "b", 2, None))
    assert rows(gaps.world_trend(df), "year", "value_mt") == [(1, 3.0), (2, None)]


def test_sovereign_remap_keeps_unmapped_as_null(frame, rows):
    df = frame("country string, region string", ("AAA", "a"), ("BBB", "b"), ("CCC", "c"), ("DDD", "d"))
    mapping = frame("country string, sovereign string", ("AAA", "AAA"), ("BBB", "AAA"), ("CCC", "XXX"))
    got = enrich.sovereign_remap(df, mapping, ["XXX"])
    assert rows(got, "region", "country") == [("a", "AAA"), ("b", "AAA"), ("d", None)]
    assert rows(enrich.drop_codes(got, ["AAA"]), "region") == [("d",)]


def test_layer_keeps_every_unit_and_its_bytes(frame, rows):
    layer = frame("country string, region string, geometry binary", ("A", "a", b"\x01\x02"), ("A", "b", b"\x03"))
    values = frame("region string, country string, gap_mt double", ("a", "Z", 1.0), ("x", "Z", 2.0))
    got = enrich.attach_to_layer(layer, values, ["region"])
    assert [(r.country, r.region, bytes(r.geometry), r.gap_mt) for r in got.orderBy("region").collect()] == [
        ("A", "a", b"\x01\x02", 1.0), ("A", "b", b"\x03", None),
    ]


def enriched(frame):
    resp = frame(
        SERIES,
        ("s", "AAA.1", 2022, 4.0), ("s", "AAA.1", 2030, 2.0), ("s", "AAA.2", 2022, 6.0),
        ("s", "BBB.1", 2022, 1.0), ("s", "BBB.1", 2030, None), ("s", "ZZZ.1", 2022, 3.0),
    )
    cap = frame(SERIES, ("s", "AAA.1", 2022, 4.0), ("s", "AAA.1", 2030, 1.0), ("s", "BBB.1", 2022, 2.0))
    people = frame(
        "region string, year int, population double",
        ("AAA.1", 2022, 2e6), ("AAA.1", 2030, 4e6), ("AAA.2", 2022, 0.0), ("ZZZ.1", 2022, 5e6),
    )
    classes = frame(
        "country string, class_region string, income_group string",
        ("AAA", "North", "High"), ("BBB", "South", None),
    )
    override = frame("country string, override_group string", ("BBB", "CLUB"))
    names = frame("region string, name string", ("AAA.1", "one"))
    rows = enrich.attribute_entities(resp, cap, people, classes, override, names=names)
    return enrich.with_group_mean(rows)


def test_enrichment(frame, rows):
    got = rows(
        enriched(frame), "region", "year", "name", "country", "class_region", "group",
        "resp_t_pc", "capc_t_pc", "group_mean_population",
    )
    assert got == [
        ("AAA.1", 2022, "one", "AAA", "North", "North", 2.0, 2.0, 2e6),
        ("AAA.1", 2030, "one", "AAA", "North", "North", 0.5, 0.25, 2e6),
        ("AAA.2", 2022, None, "AAA", "North", "North", None, None, 2e6),
        ("BBB.1", 2022, None, "BBB", "South", "CLUB", None, None, None),
        ("BBB.1", 2030, None, "BBB", "South", "CLUB", None, None, None),
        ("ZZZ.1", 2022, None, "ZZZ", None, None, 0.6, None, 5e6),
    ]


def test_rollups(frame, rows):
    df = enriched(frame)
    got = enrich.rollup_per_capita(df, ["country", "year"])
    assert rows(got, "country", "year", "resp_mt", "capc_mt", "population", "resp_t_pc") == [
        ("AAA", 2022, 10.0, 4.0, 2e6, 5.0), ("AAA", 2030, 2.0, 1.0, 4e6, 0.5),
        ("BBB", 2022, 1.0, 2.0, 0.0, None), ("BBB", 2030, 0.0, 0.0, 0.0, None),
        ("ZZZ", 2022, 3.0, 0.0, 5e6, 0.6),
    ]
    groups = enrich.rollup_per_capita(df, ["group", "year"])
    assert rows(enrich.year_slice(groups, 2022), "group") == [("CLUB",), ("North",)]
    assert rows(enrich.rollup_by_class(df), "year", "class_region", "resp_mt") == [
        (2022, "North", 10.0), (2022, "South", 1.0), (2030, "North", 2.0), (2030, "South", 0.0),
    ]


def test_index_to_base_year(frame, rows):
    got = enrich.index_to_base_year(enriched(frame), "region", 2022, ["ZZZ", "AAA"])
    assert rows(got, "region", "year", "display_rank", "resp_index", "capc_index") == [
        ("AAA.1", 2022, 2, 1.0, 1.0), ("AAA.1", 2030, 2, 0.25, 0.125),
        ("AAA.2", 2022, 2, None, None), ("ZZZ.1", 2022, 1, 1.0, None),
    ]
    without_base = enrich.index_to_base_year(enriched(frame).where("year = 2030"), "region", 2022)
    assert {r[0] for r in rows(without_base, "resp_index")} == {None}


def test_rollups_of_all_levels_from_one_pass(frame, rows):
    columns = "scenario_id string, country string, `group` string, class_region string, year int, resp_mt double, capc_mt double, population double"
    df = frame(
        columns,
        ("s", "A", "g", "X", 2020, 1.0, 2.0, 10.0), ("s", "A", "g", "X", 2020, 3.0, None, 10.0),
        ("s", "B", None, None, 2020, 5.0, 6.0, 0.0), ("s", "B", "g", "X", 2021, 7.0, 8.0, None), (None, None, "h", "Y", 2021, 1.0, 1.0, 1.0),
    )
    once = enrich.rollup_levels(df)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("Exchange hashpartitioning") == 1
    for level, by in (("country", "country"), ("group", "group")):
        want = enrich.rollup_per_capita(df, [by, "year"])
        assert rows(enrich.roll_up(once, level), *want.columns) == rows(want)
    by_class = enrich.roll_up(once, "class").where("class_region IS NOT NULL")
    want = enrich.rollup_by_class(df)
    assert rows(by_class, *want.columns) == rows(want)


def test_geometry_is_moved_once_per_unit(spark, frame, rows):
    layer = frame("region string, name string, geometry binary", ("a", "A", b"1"), ("b", "B", b"2"))
    values = frame("region string, scenario_id string, name string, x double", ("a", "s", "?", 1.0), ("a", "t", "?", 2.0), ("c", "s", "?", 3.0))
    got = enrich.attach_to_layer(layer, values, ["region"])
    assert got.columns == ["region", "name", "geometry", "scenario_id", "x"]
    assert rows(got, "region", "name", "scenario_id", "x") == [("a", "A", "s", 1.0), ("a", "A", "t", 2.0), ("b", "B", None, None)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = enrich.attach_to_layer(layer, values, ["region"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    explode = next(n for n, line in enumerate(lines) if "Generate" in line)
    # exchanges lie below the step that takes the values apart again
    assert all(n > explode for n, line in enumerate(lines) if "Exchange" in line)
