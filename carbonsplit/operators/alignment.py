"""Scenario pairs, temperature classes and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from carbonsplit.functions import ratio, round_half_even
from carbonsplit.operators.joins import compact_join, repeat_for_each
from carbonsplit.operators.pathway import SCENARIO

# Class and ambition names, most ambitious first.
ALIGNED_15 = "1.5 °C"
ALIGNED_20 = "2.0 °C"
NOT_ALIGNED = "> 2.0 °C"
ALIGNMENT_ORDER = (ALIGNED_15, ALIGNED_20, NOT_ALIGNED)
MORE, EQUAL, LESS = "More Ambitious", "As Ambitious", "Less Ambitious"


def pair_scenarios(
    df: DataFrame,
    wide_scenario: str,
    tight_scenario: str,
    on: Sequence[str],
    measures: Sequence[str] = ("resp_mt", "capc_mt"),
    suffixes: tuple[str, str] = ("_20", "_15"),
    scenario: str = SCENARIO,
) -> DataFrame:
    """Rows of one scenario with the same measures of another beside them.

    Joined on ``on`` only (entity and year, and the model if there are several); the
    row set is that of ``wide_scenario``.
    """

    def side(value: str, suffix: str) -> DataFrame:
        return df.where(F.col(scenario) == value).withColumnsRenamed(
            {m: f"{m}{suffix}" for m in measures}
        )

    left = side(wide_scenario, suffixes[0]).drop(scenario)
    right = side(tight_scenario, suffixes[1]).select(
        *on, *[f"{m}{suffixes[1]}" for m in measures]
    )
    return left.join(right, list(on), "left")


def classify_alignment(
    paired: DataFrame,
    targets: DataFrame,
    entity: str = "region",
    year: int = 2030,
    drop_null: bool = True,
    groups: DataFrame | None = None,
) -> DataFrame:
    """Temperature class of every pledge of the year (``alignment``).

    The mean of both rules is compared with the target: above it on the tighter
    pathway is 1.5 °C, else above it on the wider one is 2.0 °C, below it there
    is > 2.0 °C.  Ties and missing allocations have no class; ``drop_null``
    leaves them out.  ``groups`` lists the keys of ``paired`` beside entity and year
    (models): every pledge is classed once for each.
    """
    on = [entity, "year"]
    wanted = targets.where(F.col("year") == year)
    wanted = wanted.select(*on, "target_mt", *[c for c in ("country",) if c in targets.columns and c != entity])
    if groups is not None:
        wanted = repeat_for_each(wanted, groups, [entity])
        on = [*groups.columns, *on]
    known = paired.where(F.col("year") == year).select(
        *on, _mean_of_rules("_15").alias("mean_15_mt"), _mean_of_rules("_20").alias("mean_20_mt")
    )
    target = F.col("target_mt")
    classed = wanted.join(known, on, "left").withColumn(
        "alignment",
        F.when(F.col("mean_15_mt") > target, ALIGNED_15)
        .when(F.col("mean_20_mt") > target, ALIGNED_20)
        .when(F.col("mean_20_mt") < target, NOT_ALIGNED),
    )
    return classed.where(F.col("alignment").isNotNull()) if drop_null else classed


def _mean_of_rules(suffix: str) -> Column:
    return (F.col(f"resp_mt{suffix}") + F.col(f"capc_mt{suffix}")) / F.lit(2.0)


def alignment_summary(
    region: DataFrame, country: DataFrame, city: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Count per class and entity type, and percent within the type."""
    counts = None
    for entity_type, frame in (("Region", region), ("Country", country), ("City", city)):
        part = (
            frame.groupBy(*keys, "alignment")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(*keys, F.lit(entity_type).alias("entity_type"), "alignment", "n")
        )
        counts = part if counts is None else counts.unionByName(part)
    return _with_percent(counts, keys)


def _with_percent(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Percent of the type's total; the input has a handful of classes per type."""
    total = F.sum("n").over(Window.partitionBy(*keys, "entity_type"))
    share = ratio(F.col("n").cast("double"), total.cast("double")) * F.lit(100.0)
    return counts.withColumn("percent", round_half_even(share, 2))


def relative_ambition(
    region: DataFrame,
    city: DataFrame,
    country: DataFrame,
    strict: bool = False,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Region and city classes against the class of their country.

    By default everything not named More or As ambitious is Less, including a
    1.5 °C entity in a 2.0 °C country and a missing class on either side.
    ``strict`` ranks the classes instead and leaves missing ones null.
    """
    entities = region.select(
        *keys, "country", F.col("region").alias("entity_id"), "year",
        F.col("alignment").alias("entity_alignment"), F.lit("Region").alias("entity_type"),
    ).unionByName(
        city.select(
            *keys, "country", F.col("city").alias("entity_id"), "year",
            F.col("alignment").alias("entity_alignment"), F.lit("City").alias("entity_type"),
        )
    )
    national = country.select(*keys, "country", "year", F.col("alignment").alias("country_alignment"))
    rows = compact_join(entities, national, [*keys, "country", "year"], "left")
    own, nation = F.col("entity_alignment"), F.col("country_alignment")
    if strict:
        order = F.array(*[F.lit(a) for a in ALIGNMENT_ORDER])
        lead = F.array_position(order, own) - F.array_position(order, nation)
        verdict = F.when(lead < 0, MORE).when(lead == 0, EQUAL).when(lead > 0, LESS)
    else:
        verdict = (
            F.when((nation == NOT_ALIGNED) & own.isin(ALIGNED_15, ALIGNED_20), MORE)
            .when(own == nation, EQUAL)
            .otherwise(LESS)
        )
    return rows.withColumn("ambition", verdict)


def ambition_summary(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count and percent per entity type and relative ambition."""
    return _with_percent(
        df.groupBy(*keys, "entity_type", "ambition").agg(F.count(F.lit(1)).alias("n")), keys
    )
