"""Run a level: ``spark-submit ... -m carbonsplit`` or ``python -m carbonsplit LEVEL ...``."""

from __future__ import annotations

import argparse
import dataclasses
import json
from pathlib import Path

from pyspark.sql import SparkSession

from carbonsplit.plans.analysis_run import analysis_run
from carbonsplit.plans.city_run import city_run
from carbonsplit.plans.inputs import Inputs, Results
from carbonsplit.plans.region_run import region_run
from carbonsplit.plans.settings import Settings
from carbonsplit.sources import passing_tables

LEVELS = {"region": region_run, "city": city_run, "analysis": analysis_run}


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="carbonsplit", description=__doc__)
    parser.add_argument("level", choices=[*LEVELS, "all"])
    parser.add_argument("--inputs", required=True, help="folder of input tables")
    parser.add_argument("--results", required=True, help="folder of result tables")
    parser.add_argument("--columns", help="JSON file: per table, names in the file to declared names")
    for field in dataclasses.fields(Settings):
        if isinstance(field.default, bool):
            parser.add_argument(f"--{field.name.replace('_', '-')}", action=argparse.BooleanOptionalAction, default=field.default)
            continue
        many = isinstance(field.default, tuple)
        kind = str if many or field.default is None else type(field.default)
        parser.add_argument(
            f"--{field.name.replace('_', '-')}",
            type=float if field.default is None else kind,
            nargs="*" if many else None,
            default=field.default,
        )
    return parser


def main(arguments: list[str] | None = None) -> None:
    options = vars(_parser().parse_args(arguments))
    level = options.pop("level")
    folders = options.pop("inputs"), options.pop("results")
    columns = options.pop("columns")
    names = json.loads(Path(columns).read_text()) if columns else {}
    settings = Settings(
        **{k: tuple(v) if isinstance(v, list) else v for k, v in options.items()}
    )
    spark = SparkSession.builder.appName(f"carbonsplit-{level}").getOrCreate()
    inputs, out = Inputs(spark, folders[0], columns=names), Results(spark, folders[1])
    with passing_tables(spark):
        for name in LEVELS if level == "all" else [level]:
            LEVELS[name](inputs, out, settings)
        out.write("input_unparsed", inputs.unparsed())


if __name__ == "__main__":
    main()
