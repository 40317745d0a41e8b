"""Queries that need few rows or columns of a city table do not have it written first."""

import os

import pytest

from carbonsplit.plans.bindings import Star
from carbonsplit.plans.catalog import registered

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", ["d37_base_year_violations", "d45_alignment_summary"])
def test_attributed_cities_are_not_written_for_one_reader(spark, name):
    star = Star(spark, FOLDER)
    run = registered(star)[name]
    plain = sorted(map(str, run(spark, FOLDER).collect()))
    assert "city_attributed" not in star._stored
    star.stored("city_attributed")
    assert plain == sorted(map(str, run(spark, FOLDER).collect()))
    star.close()
