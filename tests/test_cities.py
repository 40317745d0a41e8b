from carbonsplit.operators import cities as c

PATH = "scenario_id string, year int, positive_mt double, removal_mt double"


def test_downscaling_branches(frame, rows):
    city_map = frame(
        "city string, region string",
        ("part", "r"), ("whole", "q"), ("too_big", "r"), ("gap", "r"), ("nowhere", "none"),
    )
    regions = frame(
        "country string, region string, year int, population double",
        ("A", "r", 2022, 100.0), ("A", "r", 2023, 100.0), ("A", "r", 2024, 200.0), ("A", "q", 2023, 50.0),
    )
    people = frame(
        "city string, year int, population double",
        ("part", 2022, 100.0), ("part", 2023, 10.0), ("part", 2024, 40.0),
        ("whole", 2023, 49.0), ("too_big", 2023, 105.0), ("too_big", 2024, 1.0), ("gap", 2023, 10.0),
    )
    allocation = frame(
        "scenario_id string, country string, region string, year int, allocation_mt double",
        ("s", "A", "r", 2023, 5.0), ("s", "A", "q", 2023, 7.0),
    )
    path = frame(PATH, ("s", 2023, 1.0, 1.0))
    got = c.downscale_by_population(city_map, regions, people, allocation, path, 2022)
    assert rows(got, "city", "year", "pop_ratio", "max_ratio", "allocation_mt") == [
        ("part", 2023, 0.1, 0.2, 0.5), ("part", 2024, 0.2, 0.2, None), ("whole", 2023, 1.0, 0.98, 7.0),
    ]
    emissions = frame("city string, year int, ghg_mt double", ("part", 2022, 3.0))
    series = c.city_capacity_total(emissions, got, path)
    assert rows(series, "city", "year", "value_mt") == [
        ("part", 2022, 3.0), ("part", 2023, 0.5), ("part", 2024, None), ("whole", 2023, 7.0),
    ]


def test_point_from_geojson(frame, rows):
    df = frame(
        "city string, centroid string",
        ("a", '{"type":"Point","coordinates":[-12.5,41]}'), ("b", "broken"), ("c", None),
    )
    assert rows(c.point_from_geojson(df, "centroid")) == [
        ("a", -12.5, 41.0), ("b", None, None), ("c", None, None),
    ]
