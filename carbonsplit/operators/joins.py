"""Join helpers that stay even when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from carbonsplit.sources.shared import shared_table

_SLICE = "_slice"


def compact_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    null_safe: bool = False,
) -> DataFrame:
    """Equi-join of many left rows with a compact right side (totals, means, classes).

    The right side is written first, so Spark knows its real size: a small one
    is broadcast by Spark's own threshold and the left side stays where it is; a
    large one is joined by shuffle, where adaptive execution splits a hot left
    key.  With ``null_safe`` a null key matches a null key.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"compact_join keeps left rows whole, not how={how!r}")
    keys = list(on)
    if not keys:
        raise ValueError("compact_join needs a key; use repeat_for_each to pair all rows")
    right = shared_table(right, "side")
    if not null_safe:
        return left.join(right, keys, how)
    match = {c: f"_match_{c}" for c in keys}
    right = right.withColumnsRenamed(match)
    condition = [left[c].eqNullSafe(right[m]) for c, m in match.items()]
    return left.join(right, condition, how).drop(*match.values())


def repeat_for_each(rows: DataFrame, each: DataFrame, spread_by: Sequence[str]) -> DataFrame:
    """Pair every row with every row of a compact frame (years, scenarios).

    An equi-join on slices, as many as there are shuffle partitions: every row
    belongs to the slice that a hash of ``spread_by`` gives it (the same in a
    retried task), and every row of ``each`` is copied to all slices.  So there
    is no cartesian product, no constant key, and no bound on the slices.
    """
    slices = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    of_row = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(slices)).cast("int")
    copies = shared_table(each, "each").withColumn(_SLICE, F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return rows.withColumn(_SLICE, of_row).join(copies, _SLICE).drop(_SLICE)


def without_listed(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is not among ``listed``.

    A null key is kept unless null itself is listed; a null among the listed
    ids never empties the result (as ``NOT IN`` would).
    """
    ids = listed.select(key).distinct()
    return compact_join(rows, ids, [key], "left_anti", null_safe=True)


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count (lazy; empty means unique)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
