"""Keys that are not unique are reported and do not multiply rows."""

from carbonsplit.operators import enrich
from carbonsplit.operators.constraints import VIOLATION, Uniqueness, base_row_counts


def test_one_row_per_key(frame, rows):
    unique = Uniqueness()
    assert unique.violations() is None
    names = frame("region string, name string, n int", ("A.1", None, 1), ("A.1", "South", 2), ("A.1", "North", 3), ("B.1", "West", 4), (None, "x", 5), (None, "x", 5))
    got = unique.one_per_key("names", names, ["region"])
    assert got.columns == names.columns
    assert rows(got) == [("A.1", "North", 3), ("B.1", "West", 4), (None, "x", 5)]
    unique.report("names", names, ["region", "name"])
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}".replace("bigint", "long") for f in unique.violations().schema) == VIOLATION
    assert rows(unique.violations()) == [("names", "region", "A.1", 3), ("names", "region", "null", 2), ("names", "region,name", "null|x", 2)]
    assert rows(unique.one_per_key("ids", names.select("region"), ["region"])) == [("A.1",), ("B.1",), (None,)]


def test_two_names_do_not_double_rows(frame, rows):
    series = "scenario_id string, region string, year int, value_mt double"
    resp = frame(series, ("s", "AAA.1", 2020, 1.0), ("s", "BBB.1", 2020, 2.0))
    people = frame("region string, year int, population double", ("AAA.1", 2020, 5.0))
    classes = frame("country string, class_region string, income_group string", ("AAA", "X", "High"), ("AAA", "Y", "Low"))
    override = frame("country string, override_group string").limit(0)
    names = frame("region string, name string", ("AAA.1", "a"), ("AAA.1", "b"))
    unique = Uniqueness()
    got = enrich.attribute_entities(
        resp, resp, people, unique.one_per_key("classes", classes, ["country"]), override, names=unique.one_per_key("names", names, ["region"])
    )
    assert rows(got, "region", "name", "class_region") == [("AAA.1", "a", "X"), ("BBB.1", None, None)]
    assert rows(unique.violations(), "table", "value", "n_rows") == [("classes", "AAA", 2), ("names", "AAA.1", 2)]


def test_base_rows(frame, rows):
    df = frame("scenario_id string, region string, year int", ("s", "one", 2020), ("s", "one", 2021), ("s", "two", 2020), ("s", "two", 2020), ("s", "none", 2021))
    assert rows(base_row_counts(df, "region", 2020)) == [("s", "none", 0), ("s", "two", 2)]
