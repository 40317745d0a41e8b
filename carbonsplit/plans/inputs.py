"""Input tables of a run, read by name from one folder with declared schemas."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from carbonsplit.operators.pathway import SCENARIO
from carbonsplit.sources import (
    SCHEMAS,
    counted_csv,
    counted_sheet,
    read_parquet,
    rename_to_domain,
    shared_table,
    write_result,
)

# Format per table unless told otherwise; everything else is parquet.
CSV_TABLES = frozenset(
    {
        "city_map",
        "landuse",
        "classes",
        "override",
        "sovereigns",
        "region_pledges",
        "city_pledges",
        "national_pledges",
        "extra_pledges",
        "city_points",
        "scenario_sheet",
    }
)
# Tables that share a schema.
_SAME = {
    f"{kind}_population_{era}": f"{kind}_population"
    for kind in ("region", "city")
    for era in ("early", "middle", "late")
}


@dataclass(frozen=True)
class Inputs:
    """``folder/<name>.parquet`` or ``folder/<name>.csv`` per table.

    ``columns`` maps, per table, the names of a file to the declared ones; names
    that are not mapped are taken as they are.  A CSV table is parsed once, into
    a shared table, and the cells that held no value are counted in that pass.
    """

    spark: SparkSession
    folder: str
    formats: Mapping[str, str] = field(default_factory=dict)
    columns: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    _parsed: dict[str, DataFrame] = field(default_factory=dict, compare=False, repr=False)
    _lost: dict[str, dict[str, int]] = field(default_factory=dict, compare=False, repr=False)

    def table(self, name: str) -> DataFrame:
        schema = SCHEMAS[_SAME.get(name, name)]
        path, kind = self._path(name)
        names = self.columns.get(name, {})
        if kind == "csv":
            return self._once(name, lambda: counted_csv(self.spark, path, schema, names))
        if not names:
            return read_parquet(self.spark, path, schema)
        own = {new: old for old, new in names.items()}
        found = rename_to_domain(read_parquet(self.spark, path), {own.get(c, c): c for c in schema.names})
        return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])

    def sheet(self, id_cols: tuple[str, ...]) -> DataFrame:
        """All scenarios' anchor sheets as one wide table."""
        path, kind = self._path("scenario_sheet")
        names = self.columns.get("scenario_sheet", {})
        own = {new: old for old, new in names.items()}
        if kind == "csv":
            ids = [own.get(c, c) for c in id_cols]
            found = self._once("scenario_sheet", lambda: counted_sheet(self.spark, path, ids))
        else:
            found = read_parquet(self.spark, path)
        return found.withColumnsRenamed(dict(names))

    def unparsed(self) -> DataFrame:
        """``table, column, n_rows, n_cells``: cells without a value, of the CSV tables read so far."""
        rows = [
            (table, column, counts["n_rows"], n)
            for table, counts in sorted(self._lost.items())
            for column, n in sorted(counts.items())
            if column != "n_rows"
        ]
        return self.spark.createDataFrame(rows, "table string, column string, n_rows long, n_cells long")

    def _once(self, name: str, scan: Callable[[], tuple[DataFrame, Observation]]) -> DataFrame:
        if name not in self._parsed:
            rows, seen = scan()
            self._parsed[name] = shared_table(rows, name)
            self._lost[name] = dict(seen.get)
        return self._parsed[name]

    def _path(self, name: str) -> tuple[str, str]:
        kind = self.formats.get(name, "csv" if name in CSV_TABLES else "parquet")
        return f"{self.folder.rstrip('/')}/{name}.{kind}", kind


@dataclass(frozen=True)
class Results:
    """Result tables under one folder; writing replaces, reading starts from the files."""

    spark: SparkSession
    folder: str
    _schemas: dict[str, T.StructType] = field(default_factory=dict, compare=False, repr=False)

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"

    def write(
        self, name: str, df: DataFrame, partition_by: Sequence[str] = (SCENARIO,)
    ) -> DataFrame:
        """Replace a table; the schema is kept, since an empty partitioned table has no file."""
        self._schemas[name] = df.schema
        return write_result(df, self.path(name), partition_by)

    def read(self, name: str) -> DataFrame:
        """A table of this or an earlier run; scenario ids are text even if they look like numbers."""
        declared = self._schemas.get(name)
        if declared is None:
            found = self.spark.read.parquet(self.path(name)).schema
            declared = T.StructType(
                [T.StructField(f.name, T.StringType()) if f.name == SCENARIO else f for f in found]
            )
        return self.spark.read.schema(declared).parquet(self.path(name))
