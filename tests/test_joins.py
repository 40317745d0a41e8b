import pytest

from carbonsplit.operators.joins import (
    compact_join,
    key_violations,
    repeat_for_each,
    without_listed,
)


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_compact_join_equals_plain_join_on_a_hot_key(spark, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        left = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 0, id % 50) AS k")
        right = spark.range(40).selectExpr("id AS k", "id * 10 AS v")
        for how in ("inner", "left", "left_semi", "left_anti"):
            got = compact_join(left, right, ["k"], how)
            want = left.join(right, ["k"], how)
            assert sorted(got.columns) == sorted(want.columns)
            assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(
                map(tuple, want.collect()), key=str
            )
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_pairing_uses_all_partitions_whatever_is_decided_later(spark, threshold):
    """Frames are built under the default threshold and run under another one."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        rows = spark.range(20_000).toDF("a").repartition(4)
        pairs = repeat_for_each(rows, spark.range(2).toDF("b"), ["a"])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        sizes = pairs.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
        assert sum(r["count"] for r in sizes) == 40_000
        if threshold == "-1":
            assert len(sizes) > 100 and max(r["count"] for r in sizes) < 2_000
    finally:
        for key in ("autoBroadcastJoinThreshold", "adaptive.enabled"):
            spark.conf.unset(f"spark.sql.{key}")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_aggregated_right_side_is_broadcast_by_its_real_size(spark):
    """Six totals of a large, unestimated input."""
    big = spark.range(3_000_000).selectExpr("id", "id % 6 AS k", "id % 1000 AS g")
    totals = big.join(spark.range(1000).toDF("g"), "g").groupBy("k").count()
    plan = compact_join(big, totals, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    pairs = repeat_for_each(big, spark.range(6).toDF("b"), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in pairs and "NestedLoop" not in pairs


def test_null_safe_compact_join(frame, rows):
    left = frame("id int, k string", (1, "a"), (2, None))
    right = frame("k string, v int", ("a", 10), (None, 20))
    got = compact_join(left, right, ["k"], "left", null_safe=True)
    assert rows(got, "id", "k", "v") == [(1, "a", 10), (2, None, 20)]
    plain = compact_join(left, right, ["k"], "left")
    assert rows(plain, "id", "v") == [(1, 10), (2, None)]


def test_compact_join_refuses_joins_that_would_copy_right_rows(frame):
    left = frame("k int", (1,))
    with pytest.raises(ValueError):
        compact_join(left, left, ["k"], "right")


def test_repeat_for_each_pairs_everything(spark):
    got = repeat_for_each(
        spark.range(20).toDF("a"), spark.range(7).toDF("b"), ["a"]
    )
    assert {tuple(r) for r in got.collect()} == {(a, b) for a in range(20) for b in range(7)}
    assert got.count() == 140


def test_without_listed_treats_null_like_any_value(frame, rows):
    df = frame("id int, k string", (1, "a"), (2, "b"), (3, None))
    assert rows(without_listed(df, frame("k string", ("a",)), "k"), "id") == [(2,), (3,)]
    with_null = frame("k string", ("a",), (None,))
    assert rows(without_listed(df, with_null, "k"), "id") == [(2,)]


def test_key_violations(frame, rows):
    df = frame("k string, y int", ("a", 1), ("a", 1), ("b", 1))
    assert rows(key_violations(df, ["k", "y"])) == [("a", 1, 2)]
