import os

import pytest
from pyspark.sql import functions as F, types as T

from carbonsplit.plans.inputs import Inputs, Results
from carbonsplit.sources import (
    SCHEMAS,
    passing_tables,
    read_csv,
    read_parquet,
    rename_to_domain,
    shared_folder,
    shared_table,
    wide_sheet,
    write_result,
    written_tables,
)


def test_csv_by_name_with_bom_quotes_and_empty_cells(spark, tmp_path, rows):
    path = tmp_path / "classes.csv"
    path.write_text(
        '﻿country,name,income_group,class_region,more\nAAA,"Land, of A",High,North,x\n'
        'BBB,"The ""B""",,South,y\n',
        encoding="utf-8",
    )
    got = read_csv(spark, str(path), SCHEMAS["classes"])
    assert rows(got) == [("Land, of A", "AAA", "North", "High"), ('The "B"', "BBB", "South", None)]


def test_csv_without_a_declared_column_fails(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text("country\nAAA\n")
    with pytest.raises(Exception, match="class_region|UNRESOLVED|name"):
        read_csv(spark, str(path), SCHEMAS["classes"]).collect()


def test_junk_numbers_are_null(spark, tmp_path, rows):
    path = tmp_path / "pledges.csv"
    path.write_text("country,year,value\nAAA,2030.0,1.5\nBBB,n/a,x\nCCC,2030.5,2\n")
    assert rows(read_csv(spark, str(path), SCHEMAS["extra_pledges"])) == [
        ("AAA", 2030, 1.5), ("BBB", None, None), ("CCC", None, 2.0),
    ]


def test_wide_sheet_keeps_ids_as_text(spark, tmp_path):
    path = tmp_path / "scenario_sheet.csv"
    path.write_text("model,scenario_id,2020,2025\nm,15,1.0,\n")
    got = wide_sheet(spark, str(path), ("model", "scenario_id"))
    assert [tuple(r) for r in got.collect()] == [("m", "15", 1.0, None)]


def test_parquet_with_declared_schema_prunes_and_pushes(spark, tmp_path):
    path = str(tmp_path / "gdp.parquet")
    spark.range(10).selectExpr(
        "'A' AS country", "'A.1' AS region", "CAST(id AS int) AS year", "CAST(id AS double) AS gdp", "id AS other"
    ).write.parquet(path)
    df = read_parquet(spark, path, SCHEMAS["region_gdp"])
    assert df.columns == ["country", "region", "year", "gdp"]
    plan = df.where("year > 4").select("gdp")._jdf.queryExecution().toString()
    assert "GreaterThan(year,4)" in plan and "ReadSchema: struct<year:int,gdp:double>" in plan


def test_rename_leaves_other_columns_out(frame, rows):
    df = frame("iso string, pop double, other int", ("A", 1.0, 2))
    got = rename_to_domain(df, {"iso": "country", "pop": "population"})
    assert got.columns == ["country", "population"] and rows(got) == [("A", 1.0)]


def test_results_keep_number_like_scenario_ids_as_text(spark, tmp_path, frame):
    df = frame("scenario_id string, year int, value_mt double", ("015", 1, 1.0), ("20", 1, 2.0))
    out = Results(spark, str(tmp_path))
    for _ in range(2):  # the second write replaces the first
        back = write_result(df, out.path("series"))
        for found in (back, out.read("series")):
            assert found.schema["scenario_id"].dataType == T.StringType()
            assert {r.scenario_id: r.value_mt for r in found.collect()} == {"015": 1.0, "20": 2.0}
    assert (tmp_path / "series" / "scenario_id=015").is_dir()
    plain = write_result(df.drop("scenario_id"), out.path("plain"))
    assert plain.count() == 2
    out.write("empty", df.limit(0))
    assert out.read("empty").count() == 0 and out.read("empty").columns[0] == "scenario_id"


def test_inputs_pick_format_and_era_schema(spark, tmp_path):
    inputs = Inputs(spark, str(tmp_path), {"region_gdp": "csv"})
    (tmp_path / "region_gdp.csv").write_text("country,region,year,gdp\nA,A.1,2020,5\n")
    assert inputs.table("region_gdp").collect()[0].gdp == 5.0
    spark.createDataFrame([("A", "A.1", 2020, 5.0)], SCHEMAS["region_population"]).write.parquet(
        str(tmp_path / "region_population_early.parquet")
    )
    assert inputs.table("region_population_early").count() == 1


def test_shared_table_lives_in_the_checkpoint_folder(spark):
    folder = shared_folder(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert folder == configured.rstrip("/")
    table = shared_table(spark.range(5), "numbers")
    assert table.count() == 5
    assert all(folder.split(":")[-1] in f for f in table.inputFiles())
    assert "Range" not in table._jdf.queryExecution().toString()

def test_bad_cells_are_counted_in_the_pass_that_reads(spark, tmp_path, rows):
    (tmp_path / "extra_pledges.csv").write_text("iso,when,value\nAAA,2030.0,1.5\nBBB,n/a,\nCCC,2031,x\nDDD,,2\n")
    inputs = Inputs(spark, str(tmp_path), columns={"extra_pledges": {"iso": "country", "when": "year"}})
    assert inputs.unparsed().count() == 0
    for _ in range(2):  # the second read starts from the parsed table
        assert rows(inputs.table("extra_pledges")) == [("AAA", 2030, 1.5), ("BBB", None, None), ("CCC", 2031, None), ("DDD", None, 2.0)]
    assert rows(inputs.unparsed()) == [("extra_pledges", "value", 4, 1), ("extra_pledges", "year", 4, 1)]


def test_bad_cells_of_a_sheet(spark, tmp_path, rows):
    (tmp_path / "scenario_sheet.csv").write_text("Model,scenario_id,2020,2025\nm,15,1.0,-\nm,20,,3\n")
    inputs = Inputs(spark, str(tmp_path), columns={"scenario_sheet": {"Model": "model"}})
    assert rows(inputs.sheet(("model", "scenario_id"))) == [("m", "15", 1.0, None), ("m", "20", None, 3.0)]
    assert rows(inputs.unparsed(), "column", "n_cells") == [("2020", 0), ("2025", 1)]


def test_parquet_with_names_of_its_own(spark, tmp_path, rows):
    spark.sql("SELECT 'A' AS iso, 'A.1' AS region, 2020L AS year, 5 AS gdp, 1 AS more").write.parquet(str(tmp_path / "region_gdp.parquet"))
    got = Inputs(spark, str(tmp_path), columns={"region_gdp": {"iso": "country"}}).table("region_gdp")
    assert got.schema == SCHEMAS["region_gdp"] and rows(got) == [("A", "A.1", 2020, 5.0)]


def test_a_failed_write_leaves_the_old_table(spark, tmp_path, rows):
    path = str(tmp_path / "series")
    write_result(spark.range(3).toDF("n"), path)
    broken = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("n"))
    with pytest.raises(Exception, match="no"):
        write_result(broken, path)
    assert rows(spark.read.parquet(path)) == [(0,), (1,), (2,)]
    write_result(spark.range(1).toDF("n"), path)
    assert rows(spark.read.parquet(path)) == [(0,)]
    assert not [f for f in os.listdir(tmp_path) if ".old-" in f]


def test_intermediate_tables_are_removed(spark):
    with pytest.raises(KeyError), passing_tables(spark):
        inside = shared_table(spark.range(2), "numbers")
        folder = written_tables(spark)[-1]
        assert inside.count() == 2 and os.path.isdir(folder.removeprefix("file:"))
        raise KeyError
    assert folder not in written_tables(spark) and not os.path.exists(folder.removeprefix("file:"))
