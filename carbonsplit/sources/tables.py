"""Declared schemas, readers and the result writer."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from carbonsplit.sources.shared import drop_folder, swap_folder

_KINDS = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "binary": T.BinaryType(),
}


def _schema(text: str) -> T.StructType:
    fields = (item.split(":") for item in text.split())
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in fields])


# Input contracts, in the library's own column names.  Workbook sheets and map
# layers come in as their parquet or CSV export.
SCHEMAS: Mapping[str, T.StructType] = {
    "region_population": _schema("country:string region:string year:int population:double"),
    "region_gdp": _schema("country:string region:string year:int gdp:double"),
    "region_emissions": _schema(
        "country:string region:string name:string sector:string gas:string year:int amount_t:double"
    ),
    "city_population": _schema("city:string year:int population:double"),
    "city_emissions": _schema("city:string sector:string gas:string year:int amount_t:double"),
    "city_map": _schema("city:string region:string"),
    "landuse": _schema("temperature:double year:int landuse_mt:double landuse_total_mt:double"),
    "classes": _schema("name:string country:string class_region:string income_group:string"),
    "override": _schema("country:string override_group:string"),
    "sovereigns": _schema("country:string sovereign:string"),
    "region_pledges": _schema(
        "region:string name:string country:string baseline_value:double baseline_year:int "
        "cut_pct:double target_year:int"
    ),
    "city_pledges": _schema(
        "city:string name:string country:string baseline_value:double baseline_year:int "
        "cut_pct:double target_year:int"
    ),
    "national_pledges": _schema(
        "country:string category:string ambition:string year:int value_mt:double"
    ),
    "extra_pledges": _schema("country:string year:int value:double"),
    "city_points": _schema("city:string area:double centroid:string"),
    "region_layer": _schema("country:string region:string name:string geometry:binary"),
    "country_layer": _schema("country:string geometry:binary"),
}


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet with a declared schema; filters and columns reach the scan."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def _raw_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').csv(path)


def _cells(schema: T.StructType, columns: Mapping[str, str] | None) -> list[tuple[T.StructField, Column]]:
    """Every declared field with its cell; ``columns`` gives the file's own names."""
    own = {new: old for old, new in (columns or {}).items()}
    return [(f, F.col(f"`{own.get(f.name, f.name)}`")) for f in schema.fields]


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, columns: Mapping[str, str] | None = None
) -> DataFrame:
    """CSV with a header; columns are found by name, in any order.

    Quoted commas, a byte-order mark and empty cells (null) are handled, and a
    column missing from the file fails the read.  ``columns`` maps names of the
    file to declared ones.
    """
    raw = _raw_csv(spark, path)
    return raw.select(*[_parsed(f, cell).alias(f.name) for f, cell in _cells(schema, columns)])


def counted_csv(
    spark: SparkSession, path: str, schema: T.StructType, columns: Mapping[str, str] | None = None
) -> tuple[DataFrame, Observation]:
    """``read_csv`` with the number of cells per column that hold text but no value.

    The counts (and ``n_rows``) are gathered by the first action on the frame,
    in the pass that it makes anyway; text columns have none.
    """
    raw = _raw_csv(spark, path)
    cells = _cells(schema, columns)
    return _counted(raw, [(f.name, cell, _parsed(f, cell), isinstance(f.dataType, T.StringType)) for f, cell in cells])


def _counted(raw: DataFrame, cells: Sequence[tuple[str, Column, Column, bool]]) -> tuple[DataFrame, Observation]:
    """Parsed cells ``(name, cell, value, is text)``, observed beside the text they came from."""
    place = {name: (f"_cell_{n}", f"_value_{n}") for n, (name, *_) in enumerate(cells)}
    both = raw.select(
        *[cell.alias(place[name][0]) for name, cell, _, _ in cells],
        *[value.alias(place[name][1]) for name, _, value, _ in cells],
    )
    lost = [
        F.count_if((F.trim(F.col(place[name][0])) != "") & F.col(place[name][1]).isNull()).alias(name)
        for name, _, _, is_text in cells
        if not is_text
    ]
    seen = Observation()
    watched = both.observe(seen, F.count(F.lit(1)).alias("n_rows"), *lost)
    return watched.select(*[F.col(place[name][1]).alias(name) for name, *_ in cells]), seen


def _parsed(field: T.StructField, text: Column) -> Column:
    """Cell text in the declared type; ``2030.0`` is a whole number, junk is null."""
    if not isinstance(field.dataType, T.IntegerType):
        return text.try_cast(field.dataType)
    number = text.try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("int"))


def wide_sheet(spark: SparkSession, path: str, id_cols: Sequence[str]) -> DataFrame:
    """A scenario sheet exported to CSV: id columns as text, every other column a number."""
    raw = _raw_csv(spark, path)
    return raw.select(*[value.alias(name) for name, _, value, _ in _sheet_cells(raw, id_cols)])


def counted_sheet(spark: SparkSession, path: str, id_cols: Sequence[str]) -> tuple[DataFrame, Observation]:
    """``wide_sheet`` with the number of cells per anchor column that hold text but no number."""
    raw = _raw_csv(spark, path)
    return _counted(raw, _sheet_cells(raw, id_cols))


def _sheet_cells(raw: DataFrame, id_cols: Sequence[str]) -> list[tuple[str, Column, Column, bool]]:
    anchors = [c for c in raw.columns if c not in id_cols]
    ids = [(c, F.col(f"`{c}`"), F.col(f"`{c}`"), True) for c in id_cols]
    return ids + [(c, F.col(f"`{c}`"), F.col(f"`{c}`").try_cast("double"), False) for c in anchors]


def rename_to_domain(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename source columns to the library's and leave the others out."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()])


def write_result(
    df: DataFrame, path: str, partition_by: Sequence[str] = ("scenario_id",)
) -> DataFrame:
    """Replace a result table and return it as read back, so lineage ends here.

    The table is written beside the old one and takes its place only when it is
    whole, so a failed write leaves the old one as it was.
    """
    parts = [c for c in partition_by if c in df.columns]
    beside = f"{path}.new-{uuid.uuid4().hex}"
    try:
        df.write.partitionBy(*parts).parquet(beside)
    except Exception:
        drop_folder(df.sparkSession, beside)
        raise
    swap_folder(df.sparkSession, beside, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
