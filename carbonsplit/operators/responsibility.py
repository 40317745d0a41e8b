"""Allocation by historical responsibility: equal cumulative emissions per person."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from carbonsplit.functions import ratio, strict_sum
from carbonsplit.operators.joins import repeat_for_each
from carbonsplit.operators.pathway import SCENARIO

POSITIVE = "positive_mt"
REMOVAL = "removal_mt"


def responsibility_positive(
    emissions: DataFrame,
    population: DataFrame,
    pathway: DataFrame,
    after: int,
    entity: str = "region",
    world_population: DataFrame | None = None,
    keys: Sequence[str] = (SCENARIO,),
) -> DataFrame:
    """Positive pathway split per entity and future year, with every intermediate.

    The entities are those with history.  Each gets its population share of
    everything emitted (past and future), less its own past; its yearly path
    follows the world's.  ``world_population`` replaces the denominator when the
    entities cover only part of the world.
    """
    rows = _entity_future_rows(
        emissions, population, pathway, after, entity, world_population, keys
    )
    part = _part(POSITIVE, F.col("entity_hist_mt"), F.col("world_hist_mt"))
    return _with_part(rows, part, keys, entity)


def responsibility_removal(
    emissions: DataFrame,
    population: DataFrame,
    pathway: DataFrame,
    after: int,
    entity: str = "region",
    world_population: DataFrame | None = None,
    keys: Sequence[str] = (SCENARIO,),
) -> DataFrame:
    """Removal pathway split per entity and future year: no history, population share only."""
    rows = _entity_future_rows(
        emissions, population, pathway, after, entity, world_population, keys
    ).withColumns({"entity_hist_mt": F.lit(0.0), "world_hist_mt": F.lit(0.0)})
    part = _part(REMOVAL, F.col("entity_hist_mt"), F.col("world_hist_mt"))
    return _with_part(rows, part, keys, entity)


def responsibility_wide(
    emissions: DataFrame,
    population: DataFrame,
    pathway: DataFrame,
    after: int,
    entity: str = "region",
    world_population: DataFrame | None = None,
    keys: Sequence[str] = (SCENARIO,),
) -> DataFrame:
    """Both parts in one pass: ``(keys, entity, year, positive, removal, allocation)``."""
    rows = _entity_future_rows(
        emissions, population, pathway, after, entity, world_population, keys
    )
    positive = _part(POSITIVE, F.col("entity_hist_mt"), F.col("world_hist_mt"))
    removal = _part(REMOVAL, F.lit(0.0), F.lit(0.0))
    return rows.select(
        *keys,
        entity,
        "year",
        positive["allocation_mt"].alias("positive_mt"),
        removal["allocation_mt"].alias("removal_mt"),
    ).withColumn("allocation_mt", F.col("positive_mt") + F.col("removal_mt"))


def responsibility_total(
    emissions: DataFrame,
    population: DataFrame,
    pathway: DataFrame,
    after: int,
    entity: str = "region",
    world_population: DataFrame | None = None,
    keys: Sequence[str] = (SCENARIO,),
) -> DataFrame:
    """History followed by the allocation: ``(keys, entity, year, value_mt)``."""
    wide = responsibility_wide(
        emissions, population, pathway, after, entity, world_population, keys
    )
    return stack_after_history(emissions, wide, pathway, entity, keys)


def stack_after_history(
    history: DataFrame,
    allocation: DataFrame,
    pathway: DataFrame,
    entity: str,
    keys: Sequence[str] = (SCENARIO,),
) -> DataFrame:
    """One series per scenario: the shared history, then the scenario's allocation."""
    past = repeat_for_each(
        history.select(entity, "year", F.col("ghg_mt").alias("value_mt")),
        scenarios(pathway, keys),
        [entity],
    )
    future = allocation.select(*keys, entity, "year", F.col("allocation_mt").alias("value_mt"))
    return past.select(future.columns).unionByName(future)


def scenarios(pathway: DataFrame, keys: Sequence[str] = (SCENARIO,)) -> DataFrame:
    return pathway.select(*keys).distinct()


def _history_by_entity(emissions: DataFrame, entity: str) -> DataFrame:
    return emissions.groupBy(entity).agg(strict_sum("ghg_mt").alias("entity_hist_mt"))


def _people_by_entity(population: DataFrame, entity: str) -> DataFrame:
    return population.groupBy(entity).agg(strict_sum("population").alias("entity_population"))


def _world_history(emissions: DataFrame, entity: str) -> Column:
    by_entity = _history_by_entity(emissions, entity)
    return by_entity.agg(strict_sum("entity_hist_mt").alias("mt")).scalar()


def _world_people(
    population: DataFrame, entity: str, world_population: DataFrame | None
) -> Column:
    if world_population is not None:
        return world_population.agg(strict_sum("population").alias("people")).scalar()
    by_entity = _people_by_entity(population, entity)
    return by_entity.agg(strict_sum("entity_population").alias("people")).scalar()


def _entity_future_rows(
    emissions: DataFrame,
    population: DataFrame,
    pathway: DataFrame,
    after: int,
    entity: str,
    world_population: DataFrame | None,
    keys: Sequence[str],
) -> DataFrame:
    """Entity totals beside every future year's world values, budgets and world totals.

    The world totals are one-row sub-queries over the per-entity sums, attached
    to the calendar-sized side, so they are evaluated once.
    """
    # One row per scenario and year: the window sees one calendar per scenario.
    whole = Window.partitionBy(*keys)

    def budget(part: str) -> Column:
        known = F.count(part).over(whole) == F.count(F.lit(1)).over(whole)
        return F.when(known, F.sum(part).over(whole))

    future = pathway.where(F.col("year") > after).select(
        *keys,
        "year",
        *[F.col(p).alias(f"_world_{p}") for p in (POSITIVE, REMOVAL)],
        *[budget(p).alias(f"_budget_{p}") for p in (POSITIVE, REMOVAL)],
        _world_history(emissions, entity).alias("world_hist_mt"),
        _world_people(population, entity, world_population).alias("world_population"),
    )
    entities = _history_by_entity(emissions, entity).join(
        _people_by_entity(population, entity), [entity], "left"
    )
    return repeat_for_each(entities, future, [entity])


def _part(part: str, entity_hist: Column, world_hist: Column) -> dict[str, Column]:
    """Intermediates and the allocation of one pathway part."""
    budget = F.col(f"_budget_{part}")
    cumulative = budget + world_hist
    share = ratio(F.col("entity_population"), F.col("world_population"))
    entity_cumulative = cumulative * share
    entity_budget = entity_cumulative - entity_hist
    return {
        "world_mt": F.col(f"_world_{part}"),
        "budget_mt": budget,
        "world_hist_mt": world_hist,
        "cumulative_mt": cumulative,
        "world_population": F.col("world_population"),
        "population_share": share,
        "entity_cumulative_mt": entity_cumulative,
        "entity_budget_mt": entity_budget,
        "allocation_mt": ratio(entity_budget, budget) * F.col(f"_world_{part}"),
    }


def _with_part(
    rows: DataFrame, part: dict[str, Column], keys: Sequence[str], entity: str
) -> DataFrame:
    return rows.select(
        *keys,
        entity,
        "year",
        "entity_hist_mt",
        "entity_population",
        *[column.alias(name) for name, column in part.items()],
    )
