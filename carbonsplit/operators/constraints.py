"""Uniqueness of keys: what breaks it, and tables reduced to one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from carbonsplit.operators.joins import key_violations
from carbonsplit.operators.pathway import SCENARIO
from carbonsplit.sources.shared import shared_table

VIOLATION = "table string, key string, value string, n_rows long"


def _listed(name: str, violations: DataFrame, keys: Sequence[str]) -> DataFrame:
    value = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    return violations.select(
        F.lit(name).alias("table"), F.lit(",".join(keys)).alias("key"), value.alias("value"), "n_rows"
    )


class Uniqueness:
    """Collects what breaks the keys of a run's tables."""

    def __init__(self) -> None:
        self._found: list[DataFrame] = []

    def one_per_key(self, name: str, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        """``df`` with one row per key, so that a join with it never multiplies rows.

        One grouped pass, written once, serves the result and the count of rows per
        key.  Of several rows the one with the fewest leading unknowns stays, then
        the least.
        """
        rest = [c for c in df.columns if c not in keys]
        aggregates = [F.count(F.lit(1)).alias("n_rows")]
        if rest:
            unknown = F.struct(*[F.col(c).isNull().alias(f"_{n}") for n, c in enumerate(rest)])
            aggregates.append(F.min(F.struct(unknown.alias("unknown"), F.struct(*rest).alias("row"))).alias("_one"))
        grouped = shared_table(df.groupBy(*keys).agg(*aggregates), f"unique-{name}")
        self._found.append(_listed(name, grouped.where("n_rows > 1"), keys))
        chosen = grouped.select(*keys, "_one.row.*") if rest else grouped.select(*keys)
        return chosen.select(df.columns)

    def report(self, name: str, df: DataFrame, keys: Sequence[str]) -> None:
        """Keys that occur more than once in a table that is used as it is."""
        self._found.append(_listed(name, key_violations(df, keys), keys))

    def report_base_rows(self, name: str, df: DataFrame, entity: str, base: int, keys: Sequence[str] = (SCENARIO,)) -> None:
        """Entities without exactly one row in the base year of an index."""
        self._found.append(_listed(name, base_row_counts(df, entity, base, keys), [*keys, entity]))

    def violations(self) -> DataFrame | None:
        """``table, key, value, n_rows`` of everything found; None if nothing was asked."""
        out = None
        for part in self._found:
            out = part if out is None else out.unionByName(part)
        return out


def base_row_counts(df: DataFrame, entity: str, base: int, keys: Sequence[str] = (SCENARIO,)) -> DataFrame:
    """Entities whose number of base-year rows is not one, with that number."""
    counts = df.groupBy(*keys, entity).agg(F.count_if(F.col("year") == base).alias("n_rows"))
    return counts.where("n_rows <> 1")
