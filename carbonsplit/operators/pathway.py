"""Global scenario pathways: from a wide anchor sheet to one value per year."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from carbonsplit.functions import strict_sum

SCENARIO = "scenario_id"
# Columns of the sheet that tell its pathways apart.
SHEET_KEYS = ("model", SCENARIO, "region")

# Fixed values: (divisor to Mt, CO2e weight) per scenario variable; others count as they are.
VARIABLE_RULES: Mapping[str, tuple[float, float]] = {
    "Emissions|CH4": (1.0, 25.0),
    "Emissions|N2O": (1e3, 298.0),
}
# Fixed value: divisor of the removal series.
REMOVAL_DIVISOR = 10_000.0
# Names of the long-form series.
HISTORY_LABEL = "Historic Emissions"
COMPONENT_LABELS: Mapping[str, str] = {
    "net_mt": "Net Emissions with LULUCF",
    "removal_mt": "Negative Emissions",
    "landuse_mt": "LULUCF Emissions",
    "net_excl_landuse_mt": "Net Emissions without LULUCF",
    "positive_mt": "Positive Emissions",
}


def pathway_catalogue(
    wide: DataFrame,
    region: str,
    temperature: float = 2.0,
    levels: Mapping[str, float] | None = None,
    keys: Sequence[str] = SHEET_KEYS,
) -> DataFrame:
    """The pathways of one region of a sheet: ``scenario_id, model, scenario, region, temperature``.

    ``scenario_id`` is the pathway's own id: the scenario, or ``model|scenario`` if
    several models have it.  ``temperature`` is the warming level of the scenario in
    ``levels``, else the given one.  A sheet without a region or model column is taken
    as one region or model, named by an empty text; so is an unknown model.
    """
    model, scenario, place = keys
    rows = wide.where(F.col(place) == region) if place in wide.columns else wide
    owner = F.coalesce(F.col(model).cast("string"), F.lit("")) if model in wide.columns else F.lit("")
    name = F.col(scenario).cast("string")
    found = rows.select(owner.alias("model"), name.alias("scenario")).distinct()
    several = F.count(F.lit(1)).over(Window.partitionBy("scenario")) > 1
    level = F.lit(float(temperature))
    for of, value in (levels or {}).items():
        level = F.when(F.col("scenario") == of, F.lit(float(value))).otherwise(level)
    return found.select(
        F.when(several, F.concat_ws("|", "model", "scenario")).otherwise(F.col("scenario")).alias(SCENARIO),
        "model",
        "scenario",
        F.lit(region if place in wide.columns else "").alias("region"),
        level.alias("temperature"),
    )


def select_pathways(wide: DataFrame, catalogue: DataFrame, keys: Sequence[str] = SHEET_KEYS) -> DataFrame:
    """The sheet's rows that belong to a pathway of the catalogue, with the pathway's id as ``scenario_id``."""
    model, scenario, place = keys
    ids = catalogue.select(F.col(SCENARIO).alias("_id"), F.col("model").alias("_model"), F.col("scenario").alias("_scenario"), F.col("region").alias("_region"))
    match = F.col(scenario).cast("string") == F.col("_scenario")
    if model in wide.columns:
        match = match & (F.coalesce(F.col(model).cast("string"), F.lit("")) == F.col("_model"))
    if place in wide.columns:
        match = match & (F.col(place) == F.col("_region"))
    columns = [F.col("_id").alias(c) if c == scenario else F.col(f"`{c}`") for c in wide.columns]
    return wide.join(ids, match).select(*columns)


def melt_scenario(
    wide: DataFrame,
    id_cols: Sequence[str],
    since: int = 2020,
    like: str = "Emissions",
    keep: str = "nonzero",
) -> DataFrame:
    """Anchor columns to rows ``(ids, year, value)`` for the matching variables.

    ``keep='nonzero'`` drops zero anchors, ``keep='nonnegative'`` drops negative
    ones; null anchors go either way.
    """
    value = F.col("value")
    rule = {"nonzero": value != 0, "nonnegative": value >= 0}[keep]
    anchors = [c for c in wide.columns if c not in id_cols]
    return (
        wide.where(F.col("variable").contains(like))
        .unpivot(list(id_cols), anchors, "year", "value")
        .withColumn("year", F.expr("try_cast(year AS int)"))
        .where((F.col("year") >= since) & rule)
    )


def scenario_co2e(
    long: DataFrame,
    keys: Sequence[str] = (SCENARIO,),
    rules: Mapping[str, tuple[float, float]] = VARIABLE_RULES,
) -> DataFrame:
    """Anchor-year total in Mt CO2e per scenario; ``select_pathways`` makes scenarios unique."""
    value = F.col("value")
    converted = value
    for variable, (divisor, weight) in rules.items():
        converted = F.when(
            F.col("variable") == variable, value / F.lit(divisor) * F.lit(weight)
        ).otherwise(converted)
    return (
        long.withColumn("_co2e", converted)
        .groupBy(*keys, "year")
        .agg(strict_sum("_co2e").alias("value"))
    )


def interpolate_yearly(
    df: DataFrame,
    keys: Sequence[str],
    x: str = "year",
    y: str = "value",
    ties: str = "mean",
    max_span: int | None = None,
) -> DataFrame:
    """One row per key and whole year between the first and last, linear in between.

    Keys with fewer than two rows, or fewer than two known years, have no line
    and are left out.  Unknown values are bridged over; years outside the known
    ones are null (nothing is extrapolated).  Several values in one year count
    as their mean (``ties='mean'``) or their smallest (``ties='min'``).  With
    ``max_span`` a key whose neighbouring years lie further apart fails the job.

    The rows are first reduced to one per key and year (partial aggregation, so
    a key with any number of rows collapses before the shuffle); both windows
    and the expansion then reuse that one partitioning by key.
    """
    merge = {"mean": F.avg, "min": F.min}[ties]
    points = (
        df.groupBy(*keys, x)
        .agg(merge(y).alias("_y"), F.count(F.lit(1)).alias("_rows"))
        .where(F.col(x).isNotNull())
    )
    by_key = Window.partitionBy(*keys)
    known = (
        points.withColumns(
            {
                "_n": F.sum("_rows").over(by_key),
                "_first": F.min(x).over(by_key),
                "_last": F.max(x).over(by_key),
            }
        )
        .where((F.col("_n") >= 2) & F.col("_y").isNotNull())
    )
    in_order = by_key.orderBy(x)
    segments = known.withColumns(
        {
            "_known": F.count(F.lit(1)).over(by_key),
            "_prev_x": F.lag(x).over(in_order),
            "_next_x": F.lead(x).over(in_order),
            "_next_y": F.lead("_y").over(in_order),
        }
    ).where(F.col("_known") >= 2)
    start = F.when(F.col("_prev_x").isNull(), F.col("_first")).otherwise(F.col(x))
    stop = F.when(F.col("_next_x").isNull(), F.col("_last")).otherwise(F.col("_next_x") - 1)
    year = F.col("_year")
    line = (
        F.when(year == F.col(x), F.col("_y"))
        .when((year > F.col(x)) & F.col("_next_x").isNotNull(), _between(year, x))
    )
    return segments.withColumn("_year", F.explode(_years(start, stop, max_span))).select(
        *keys, F.col("_year").cast("int").alias(x), line.alias(y)
    )


def _between(year: Column, x: str) -> Column:
    step = (year - F.col(x)) / (F.col("_next_x") - F.col(x))
    return F.col("_y") + (F.col("_next_y") - F.col("_y")) * step


def _years(start: Column, stop: Column, max_span: int | None) -> Column:
    years = F.sequence(start, stop)
    if max_span is None:
        return years
    message = F.lit(f"year span above {max_span}")
    return F.when(stop - start > max_span, F.raise_error(message)).otherwise(years)


def net_pathway(
    wide: DataFrame, id_cols: Sequence[str], keys: Sequence[str] = (SCENARIO,), since: int = 2020
) -> DataFrame:
    """Yearly net pathway ``(keys, year, net_mt)`` from the wide sheet."""
    anchors = scenario_co2e(melt_scenario(wide, id_cols, since), keys)
    return interpolate_yearly(anchors, keys).withColumnRenamed("value", "net_mt")


def removal_pathway(
    wide: DataFrame,
    id_cols: Sequence[str],
    keys: Sequence[str] = (SCENARIO,),
    since: int = 2020,
    like: str = "Emissions",
    keep: str = "nonnegative",
    divisor: float = REMOVAL_DIVISOR,
) -> DataFrame:
    """Yearly removals ``(keys, year, removal_mt)``, at or below zero."""
    anchors = (
        melt_scenario(wide, id_cols, since, like, keep)
        .groupBy(*keys, "year")
        .agg((strict_sum("value") / F.lit(divisor)).alias("value"))
    )
    return interpolate_yearly(anchors, keys).select(
        *keys, "year", (-F.col("value")).alias("removal_mt")
    )


def pick_landuse(table: DataFrame, temperature: float = 2.0) -> DataFrame:
    """Land-use series of one warming level: ``(year, landuse_mt)``."""
    return table.where(F.col("temperature") == temperature).select("year", "landuse_mt")


def landuse_by_scenario(table: DataFrame, catalogue: DataFrame, keys: Sequence[str] = (SCENARIO,)) -> DataFrame:
    """Land-use series of every scenario: that of the table's level nearest to the scenario's own.

    ``catalogue`` has the keys and ``temperature``; of two levels equally near the lower
    one counts.  A scenario without a level has no series.  The levels of a table are a
    handful, so the nearest one is looked up in their list and the series join on it.
    """
    levels = table.agg(F.collect_set("temperature")).scalar()
    own = F.col("temperature")
    candidates = (
        catalogue.where(own.isNotNull())
        .select(*keys, "temperature", levels.alias("_levels"))
        .withColumn("_level", F.explode("_levels"))
    )
    apart = F.struct(F.abs(F.col("_level") - own), F.col("_level"))
    nearest = candidates.groupBy(*keys).agg(F.min_by("_level", apart).alias("_level"))
    series = table.select(F.col("temperature").alias("_level"), "year", "landuse_mt")
    return nearest.join(series, "_level").select(*keys, "year", "landuse_mt")


def decompose_pathway(
    net: DataFrame, removal: DataFrame, landuse: DataFrame, keys: Sequence[str] = (SCENARIO,)
) -> DataFrame:
    """Net, land use, removal and the positive rest, per scenario and year.

    ``landuse`` is one series for all, or has the keys and is each scenario's own.
    """
    own = [k for k in keys if k in landuse.columns]
    return (
        net.join(removal, [*keys, "year"], "left")
        .join(landuse, [*own, "year"], "left")
        .withColumn("net_excl_landuse_mt", F.col("net_mt") - F.col("landuse_mt"))
        .withColumn("positive_mt", F.col("net_excl_landuse_mt") - F.col("removal_mt"))
        .select(*keys, "year", *COMPONENT_LABELS)
    )


def world_history(emissions: DataFrame) -> DataFrame:
    """World total per year."""
    return emissions.groupBy("year").agg(strict_sum("ghg_mt").alias("value_mt"))


def history_and_pathway_long(
    emissions: DataFrame, pathway: DataFrame, keys: Sequence[str] = (SCENARIO,)
) -> DataFrame:
    """History and every pathway component as ``(keys, year, series, value_mt)``.

    History belongs to no scenario, so its keys are null.
    """
    components = (
        pathway.unpivot([*keys, "year"], list(COMPONENT_LABELS), "_component", "value_mt")
        .replace(dict(COMPONENT_LABELS), subset=["_component"])
        .withColumnRenamed("_component", "series")
    )
    history = world_history(emissions).withColumn("series", F.lit(HISTORY_LABEL))
    for key in keys:
        history = history.withColumn(key, F.lit(None).cast(pathway.schema[key].dataType))
    return history.unionByName(components)


def remaining_budget(
    pathway: DataFrame,
    after: int,
    part: str = "positive_mt",
    keys: Sequence[str] = (SCENARIO,),
) -> DataFrame:
    """Sum of one pathway part over the years after the cutoff, per scenario."""
    return (
        pathway.where(F.col("year") > after)
        .groupBy(*keys)
        .agg(strict_sum(part).alias("budget_mt"))
    )


def pathway_sanity(
    emissions: DataFrame, pathway: DataFrame, year: int, keys: Sequence[str] = (SCENARIO,)
) -> DataFrame:
    """Observed and projected world total of one year, in Gt."""
    observed = (
        emissions.where(F.col("year") == year)
        .agg((strict_sum("ghg_mt") / F.lit(1e3)).alias("gt"))
        .scalar()
    )
    return (
        pathway.where(F.col("year") == year)
        .groupBy(*keys)
        .agg((strict_sum("positive_mt") / F.lit(1e3)).alias("projected_gt"))
        .select(*keys, observed.alias("observed_gt"), "projected_gt")
    )
