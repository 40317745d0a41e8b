"""Attributes, per-capita views and base-year indices of allocation series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from carbonsplit.functions import grouped_by_level, per_capita, ratio, skipping_mean, skipping_sum
from carbonsplit.operators.gaps import COUNTRY_PREFIX
from carbonsplit.operators.joins import compact_join
from carbonsplit.operators.pathway import SCENARIO

MEASURES = ("resp_mt", "capc_mt")


def sovereign_remap(
    df: DataFrame,
    sovereigns: DataFrame,
    drop: Sequence[str] = (),
    column: str = "country",
) -> DataFrame:
    """Replace a territory code by its sovereign's and drop listed sovereigns.

    A code without a sovereign becomes null and stays.
    """
    mapping = sovereigns.select(F.col("country").alias(column), "sovereign")
    mapped = compact_join(df, mapping, [column], "left")
    return (
        mapped.withColumn(column, F.col("sovereign"))
        .drop("sovereign")
        .transform(lambda d: drop_codes(d, drop, column))
    )


def drop_codes(df: DataFrame, drop: Sequence[str], column: str = "country") -> DataFrame:
    """Drop rows of the listed codes; a null code is not listed."""
    if not drop:
        return df
    return df.where(~F.coalesce(F.col(column).isin(list(drop)), F.lit(False)))


def attach_to_layer(layer: DataFrame, values: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every map unit with its values; the geometry column passes through untouched.

    The values of a unit are nested first and taken apart after the join, so a
    geometry is moved and matched once per unit, not once per value row.  A unit
    has a row per scenario, so what is nested stays small.
    """
    own = [c for c in values.columns if c not in layer.columns]
    nested = values.groupBy(*on).agg(F.collect_list(F.struct(*own)).alias("_values"))
    columns = [c for c in layer.columns if c not in on]
    return (
        layer.join(nested, list(on), "left")
        .withColumn("_value", F.explode_outer("_values"))
        .select(*on, *columns, *[F.col(f"_value.{c}").alias(c) for c in own])
    )


def attribute_entities(
    responsibility: DataFrame,
    capacity: DataFrame,
    population: DataFrame,
    classes: DataFrame,
    override: DataFrame,
    entity: str = "region",
    names: DataFrame | None = None,
    country: Column | None = None,
    keys: Sequence[str] = (SCENARIO,),
) -> DataFrame:
    """Both allocations of an entity-year with its attributes.

    Adds the name, the country (given, or the start of the entity id), its class
    region and income group, the ``group`` (the override group if the country is
    a member, else the class region), population, and both per-capita values in
    tonnes.

    ``names`` (by entity), ``classes`` and ``override`` (by country) need unique
    keys (see ``key_violations``); a country may hold any share of the rows.
    """
    code = F.substring(entity, 1, COUNTRY_PREFIX) if country is None else country
    attributes = (
        classes.select("country", "class_region", "income_group")
        .join(override.select("country", "override_group"), "country", "full")
        .withColumn("group", F.coalesce("override_group", "class_region"))
    )
    rows = (
        responsibility.select(*keys, entity, "year", F.col("value_mt").alias("resp_mt"))
        .join(
            capacity.select(*keys, entity, "year", F.col("value_mt").alias("capc_mt")),
            [*keys, entity, "year"],
            "left",
        )
        .join(population.select(entity, "year", "population"), [entity, "year"], "left")
    )
    if names is not None:
        rows = rows.join(names.select(entity, "name"), entity, "left")
    rows = compact_join(rows.withColumn("country", code), attributes, ["country"], "left")
    return rows.withColumns(
        {
            "resp_t_pc": per_capita(F.col("resp_mt"), F.col("population")),
            "capc_t_pc": per_capita(F.col("capc_mt"), F.col("population")),
        }
    )


def with_group_mean(df: DataFrame, keys: Sequence[str] = (SCENARIO,)) -> DataFrame:
    """Add the mean population of all rows of the group (no group counts as one).

    Reads ``df`` twice, so give it a stored table rather than a long plan.  The
    mean is a grouped one joined back: a group is a large part of the rows.
    """
    means = df.groupBy(*keys, "group").agg(
        skipping_mean("population").alias("group_mean_population")
    )
    return compact_join(df, means, [*keys, "group"], "left", null_safe=True)


def rollup_per_capita(
    df: DataFrame, by: Sequence[str], keys: Sequence[str] = (SCENARIO,)
) -> DataFrame:
    """Sums of both allocations and population, and per-capita values of the sums."""
    return (
        df.groupBy(*keys, *by)
        .agg(
            *[skipping_sum(m).alias(m) for m in MEASURES],
            skipping_sum("population").alias("population"),
        )
        .withColumns(
            {
                "resp_t_pc": per_capita(F.col("resp_mt"), F.col("population")),
                "capc_t_pc": per_capita(F.col("capc_mt"), F.col("population")),
            }
        )
    )


# Names of the roll-ups that one pass makes, and what they are grouped by beside scenario and year.
ROLLUP_LEVELS: Mapping[str, Sequence[str]] = {"country": ("country",), "group": ("group",), "class": ("class_region",)}


def rollup_levels(
    df: DataFrame,
    levels: Mapping[str, Sequence[str]] = ROLLUP_LEVELS,
    keys: Sequence[str] = (SCENARIO,),
) -> DataFrame:
    """All roll-ups of a frame from one scan and one shuffle, by grouping sets.

    ``level`` names the roll-up of a row; the columns that it is not grouped by are
    null.  ``roll_up`` takes one of them out again.
    """
    sums = [skipping_sum(m).alias(m) for m in (*MEASURES, "population")]
    return grouped_by_level(df, [*keys, "year"], levels, sums).withColumns(
        {
            "resp_t_pc": per_capita(F.col("resp_mt"), F.col("population")),
            "capc_t_pc": per_capita(F.col("capc_mt"), F.col("population")),
        }
    )


def roll_up(rollups: DataFrame, level: str, levels: Mapping[str, Sequence[str]] = ROLLUP_LEVELS, keys: Sequence[str] = (SCENARIO,)) -> DataFrame:
    """One roll-up of ``rollup_levels``."""
    measures = [*MEASURES, "population", "resp_t_pc", "capc_t_pc"]
    return rollups.where(F.col("level") == level).select(*keys, *levels[level], "year", *measures)


def rollup_by_class(df: DataFrame, keys: Sequence[str] = (SCENARIO,)) -> DataFrame:
    """Sums of both allocations per year and class region; unclassed rows are left out."""
    return (
        df.where(F.col("class_region").isNotNull())
        .groupBy(*keys, "year", "class_region")
        .agg(*[skipping_sum(m).alias(m) for m in MEASURES])
    )


def year_slice(df: DataFrame, year: int, group: str = "group") -> DataFrame:
    """Rows of one year that belong to a group."""
    return df.where((F.col("year") == year) & F.col(group).isNotNull())


def index_to_base_year(
    df: DataFrame,
    entity: str,
    base: int = 2022,
    countries: Sequence[str] | None = None,
    keys: Sequence[str] = (SCENARIO,),
) -> DataFrame:
    """Per-capita values relative to the entity's own base-year values.

    Null without a base-year value.  ``countries`` keeps only those, numbered in
    the given display order; the filter precedes the shuffle.
    """
    rows = df
    if countries is not None:
        order = F.array(*[F.lit(c) for c in countries])
        rows = rows.where(F.col("country").isin(list(countries))).withColumn(
            "display_rank", F.array_position(order, F.col("country")).cast("int")
        )
    # One row per entity and calendar year, so the window stays small.
    entity_rows = Window.partitionBy(*keys, entity)
    at_base = F.col("year") == base

    def reference(column: str) -> Column:
        return F.max(F.when(at_base, F.col(column))).over(entity_rows)

    return rows.withColumns(
        {"capc_base_t_pc": reference("capc_t_pc"), "resp_base_t_pc": reference("resp_t_pc")}
    ).withColumns(
        {
            "capc_index": ratio(F.col("capc_t_pc"), F.col("capc_base_t_pc")),
            "resp_index": ratio(F.col("resp_t_pc"), F.col("resp_base_t_pc")),
        }
    )
