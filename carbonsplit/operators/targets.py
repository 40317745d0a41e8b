"""Pledged targets: points, anchors, yearly trajectories and fairness flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from carbonsplit.functions import skipping_mean
from carbonsplit.operators.joins import repeat_for_each
from carbonsplit.operators.panel import TONNES_PER_MT
from carbonsplit.operators.pathway import SCENARIO, interpolate_yearly

FULL_CUT_PCT = 100.0


def target_points(
    pledges: DataFrame, entity: str = "region", scale: float = 1.0, with_cut: bool = False
) -> DataFrame:
    """Baseline and target point of every pledge: ``(entity, name, country, year, value)``.

    ``pledges`` has ``baseline_value, baseline_year, cut_pct, target_year``.  A
    full cut is exactly zero.  Points with anything unknown are dropped.
    ``with_cut`` carries the cut along (0 on the baseline point).
    """
    ids = [entity, "name", "country"]
    cut = F.col("cut_pct")
    baseline = F.col("baseline_value") / F.lit(float(scale))
    target = F.when(cut == FULL_CUT_PCT, F.lit(0.0)).otherwise(
        baseline - cut / F.lit(100.0) * baseline
    )
    extra = [F.lit(0.0).alias("cut_pct")] if with_cut else []
    first = pledges.select(*ids, F.col("baseline_year").alias("year"), baseline.alias("value"), *extra)
    extra = [cut.cast("double").alias("cut_pct")] if with_cut else []
    second = pledges.select(*ids, F.col("target_year").alias("year"), target.alias("value"), *extra)
    return first.unionByName(second).dropna("any").distinct()


def average_national_pledges(
    raw: DataFrame, extra: DataFrame | None = None, category: str = "Current"
) -> DataFrame:
    """Mean pledge over ambition variants per country and year, in tonnes.

    ``raw`` has ``country, category, ambition, year, value_mt``; ``extra``
    (``country, year, value``, tonnes) is appended as it is.
    """
    mean = (
        raw.where((F.col("category") == category) & F.col("value_mt").isNotNull())
        .groupBy("country", "year")
        .agg((skipping_mean("value_mt") * F.lit(TONNES_PER_MT)).alias("value"))
    )
    return mean if extra is None else mean.unionByName(extra.select(mean.columns))


def anchor_single_targets(
    points: DataFrame,
    entity: str = "region",
    year: int = 2022,
    anchor: str = "pledge",
    history: DataFrame | None = None,
) -> DataFrame:
    """A second point for entities that have just one.

    It repeats the pledged value in ``year``; with ``anchor='observed'`` it takes
    the observed value of that year from ``history`` (``entity, year, value``)
    instead.
    """
    ids = [entity, "name", "country"]
    single = (
        points.groupBy(*ids)
        .agg(F.count(F.lit(1)).alias("_n"), F.max("value").alias("value"))
        .where("_n = 1")
        .drop("_n")
        .withColumn("year", F.lit(year))
    )
    if anchor == "pledge":
        return single.select(*ids, "year", "value")
    if anchor != "observed" or history is None:
        raise ValueError("anchor is 'pledge', or 'observed' with a history frame")
    observed = history.where(F.col("year") == year).select(entity, "year", "value")
    return single.drop("value").join(observed, [entity, "year"], "left").select(
        *ids, "year", "value"
    )


def target_trajectory(
    points: DataFrame,
    anchors: DataFrame,
    entity: str = "region",
    scale: float = TONNES_PER_MT,
) -> DataFrame:
    """Yearly target line per entity, divided by ``scale`` (``target_mt``).

    Entities need two points (anchors included).  The lowest value of a year
    counts; years between the first and last are filled linearly.
    """
    ids = [entity, "name", "country"]
    columns = [*ids, "year", "value"]
    rows = points.select(columns).unionByName(anchors.select(columns))
    return interpolate_yearly(rows, ids, ties="min").select(
        *ids, "year", (F.col("value") / F.lit(float(scale))).alias("target_mt")
    )


def targets_for_scenarios(
    targets: DataFrame, scenario_list: DataFrame, entity: str, year: int
) -> DataFrame:
    """The pledges of one year, once per scenario."""
    return repeat_for_each(targets.where(F.col("year") == year), scenario_list, [entity])


def fairness_flags(
    allocations: DataFrame,
    targets: DataFrame,
    scenario_list: DataFrame,
    entity: str = "region",
    year: int = 2030,
    keys: Sequence[str] = (SCENARIO,),
) -> DataFrame:
    """Per rule 1 if the allocation exceeds the target, 0 if below, else null; and their sum.

    Every pledge of the year is kept, with null flags where there is no
    allocation.  ``allocations`` has ``resp_mt, capc_mt``, ``targets`` has
    ``target_mt``.
    """
    on = [*keys, entity, "year"]
    wanted = targets_for_scenarios(
        targets.select(entity, "year", "target_mt"), scenario_list, entity, year
    )
    known = allocations.where(F.col("year") == year).select(*on, "resp_mt", "capc_mt")
    resp, capc = F.col("resp_fair"), F.col("capc_fair")
    return (
        wanted.join(known, on, "left")
        .withColumns({"resp_fair": _exceeds("resp_mt"), "capc_fair": _exceeds("capc_mt")})
        .withColumn("fair_rules", (resp + capc).cast("string"))
    )


def _exceeds(measure: str) -> Column:
    return F.when(F.col(measure) > F.col("target_mt"), F.lit(1)).when(
        F.col(measure) < F.col("target_mt"), F.lit(0)
    )
