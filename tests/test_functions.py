from pyspark.sql import functions as F

from carbonsplit.functions import (
    clamp,
    is_finite,
    per_capita,
    ratio,
    round_half_even,
    skipping_mean,
    skipping_sum,
    strict_max,
    strict_min,
    strict_sum,
)


def test_strict_aggregates_turn_null_on_any_null(frame, rows):
    df = frame("k string, x double", ("a", 1.0), ("a", None), ("b", 1.0), ("b", 3.0))
    got = df.groupBy("k").agg(
        strict_sum("x").alias("s"), strict_min("x").alias("lo"), strict_max("x").alias("hi")
    )
    assert rows(got, "k", "s", "lo", "hi") == [("a", None, None, None), ("b", 4.0, 1.0, 3.0)]


def test_skipping_aggregates(frame, rows):
    df = frame("k string, x double", ("a", 1.0), ("a", None), ("b", None))
    got = df.groupBy("k").agg(skipping_sum("x").alias("s"), skipping_mean("x").alias("m"))
    assert rows(got, "k", "s", "m") == [("a", 1.0, 1.0), ("b", 0.0, None)]


def test_ratio_is_null_on_zero_and_null(frame, rows):
    df = frame("a double, b double", (1.0, 0.0), (0.0, 0.0), (1.0, None), (6.0, 4.0))
    got = rows(df.select(ratio(F.col("a"), F.col("b")).alias("r")), "r")
    assert got == [(1.5,), (None,), (None,), (None,)]


def test_per_capita_is_tonnes(frame, rows):
    df = frame("mt double, people double", (2.0, 4e6))
    assert rows(df.select(per_capita(F.col("mt"), F.col("people")).alias("t")), "t") == [(0.5,)]


def test_finite_drops_everything_odd(frame, rows):
    df = frame(
        "x double", (1.0,), (None,), (float("nan"),), (float("inf"),), (float("-inf"),), (-2.0,)
    )
    assert rows(df.where(is_finite(F.col("x"))), "x") == [(-2.0,), (1.0,)]


def test_clamp_keeps_null_and_inner_values(frame, rows):
    df = frame("x double", (301.0,), (-301.0,), (300.0,), (12.5,), (None,))
    got = rows(df.select(clamp(F.col("x"), 300).alias("c")), "c")
    assert got == [(-300.0,), (12.5,), (300.0,), (300.0,), (None,)]


def test_round_half_even(frame, rows):
    df = frame("x double", (0.5,), (1.5,), (2.5,), (-0.5,), (2.4,))
    got = df.select("x", round_half_even(F.col("x")).alias("r"))
    assert {x: r for x, r in rows(got)} == {0.5: 0.0, 1.5: 2.0, 2.5: 2.0, -0.5: 0.0, 2.4: 2.0}
