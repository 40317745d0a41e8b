"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carbonsplit.sources.shared import release_tables, shared_folder, shared_table, written_tables

__all__ = ["WORD", "cut", "is_small", "keep_last", "lower_ascii", "read_table", "settle", "shared_folder", "small", "word_count"]

#: Spark's own setting: the shuffle files of an execution go when it ends.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows of a written table that are broadcast at most (a few dozen bytes each); larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files: later steps restart there."""
    return shared_table(df, f"{name}-{uuid.uuid4().hex[:8]}")


def settle(df: DataFrame, name: str) -> DataFrame:
    """``cut``, and give back the disk of the exchanges that led up to the table: what follows starts from its files."""
    spark = df.sparkSession
    before = spark.conf.get(_SHUFFLE_CLEANUP, "false")
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        # a frame takes the setting when it is made
        return cut(df.select("*"), name)
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, before)


def keep_last(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, which is the last table it writes; the others that it writes are removed."""
    before = set(written_tables(spark))
    out = make()
    made = [path for path in written_tables(spark) if path not in before]
    release_tables(spark, made[:-1])
    return out


def is_small(df: DataFrame, values: Column | None = None) -> bool:
    """Whether ``df``, a written table, has few rows.

    ``values`` counts what a row carries beside its fixed columns, such as the size of an
    array; all of it counts as rows.
    """
    # files of a written table know their rows; a limit would send them through one task
    held = df.count()
    if values is not None and held <= BROADCAST_ROWS:
        held += df.agg(F.coalesce(F.sum(values), F.lit(0))).first()[0]
    return held <= BROADCAST_ROWS


def small(df: DataFrame, values: Column | None = None) -> DataFrame:
    """``df``, a written table, marked for broadcast if ``is_small``; any other is joined by shuffle."""
    return F.broadcast(df) if is_small(df, values) else df


def word_count(text: Column) -> Column:
    """Words of a text as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
