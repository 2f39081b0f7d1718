"""Joins to groups give the plain join's rows, and exact medians the plain median."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from evalweave.operators import joins, quantiles
from evalweave.operators.joins import group_join, lookup_groups, salted_join


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def hot(spark):
    """Two thirds of the rows have one key or none."""
    return spark.range(6000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 3 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 900).cast("string")))
        .alias("key"),
    )


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join(hot, how):
    groups = hot.select("key").distinct().filter("key is null or key < 'k5'")
    groups = groups if how in ("left_semi", "left_anti") else groups.withColumn("v", F.lit(1))
    got = salted_join(hot, groups, ["key"], ["id"], how)
    same = groups.withColumnRenamed("key", "other")
    plain = hot.join(same, F.col("key").eqNullSafe(F.col("other")), how).drop("other")
    assert result(got.select(*plain.columns)) == result(plain)


@pytest.mark.parametrize("limit", [10_000, 50])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_groups(hot, monkeypatch, how, limit):
    monkeypatch.setattr(joins, "MAX_BYTES", limit)
    monkeypatch.setattr(joins, "ROWS_PER_SALT", 100)
    groups = hot.select("key").distinct().filter("key is null or key < 'k5'")
    got = lookup_groups(hot, groups, ["key"], ["id"], how)
    assert result(got.select("id", "key")) == result(
        salted_join(hot, groups, ["key"], ["id"], how).select("id", "key")
    )


def test_salts_follow_the_measured_size_of_a_group(hot, monkeypatch):
    """A key with a third of all rows is dealt into parts of a bounded size; others are not."""
    salts = {r.key: r._salts for r in joins.group_salts(hot, ["key"], 250).collect()}
    assert salts == {"hot": 8, None: 8}
    rows = hot.withColumn("_salts", F.when(F.coalesce("key", F.lit("hot")) == "hot", 8).otherwise(1))
    dealt = rows.groupBy("key", joins._salt(["id"], F.col("_salts"))).count()
    assert dealt.agg(F.max("count")).first()[0] <= 1.3 * 250


def test_tables_are_broadcast_by_bytes_not_rows(spark):
    few = spark.createDataFrame([(1, "x" * 5000), (2, None)], "k int, v string")
    many = spark.range(5000)
    assert joins.fits(few, 10_000) and not joins.fits(few, 4000)
    assert not joins.fits(many, 4000) and joins.fits(many.limit(0), 0)


def test_few_groups_do_not_move_the_rows(spark, hot):
    groups = spark.createDataFrame([("hot", 1), (None, 2)], "key string, n int")
    plan = lookup_groups(hot, groups, ["key"], ["id"])._jdf.queryExecution().executedPlan()
    assert "Exchange hashpartitioning" not in plan.toString()


def test_group_join_matches_missing_keys(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 3), ("y", 4)], "k string, b int")
    assert result(group_join(a, b, ["k"], "inner")) == [(None, 1, 3)]


def median_of(df):
    got = quantiles.exact_median(df, ["g"], "x", ["id"], "m").collect()
    return {r.g: r.m for r in got}


@pytest.mark.parametrize(
    "bracket, groups, inside, grid",
    [
        ((0.3, 0.7), 200, 3, 30),
        ((0.4998, 0.5002), 10_000, 10**6, 1000),
        ((0.9, 0.95), 10_000, 10**6, 1000),
        ((0.01, 0.02), 2, 10**6, 1000),
        ((0.3, 0.7), 10_000, 3, 10),
    ],
)
def test_exact_median(spark, monkeypatch, bracket, groups, inside, grid):
    """Also when the sketch's bracket misses the middle or has to be narrowed."""
    monkeypatch.setattr(quantiles, "MAX_INSIDE", inside)
    monkeypatch.setattr(quantiles, "_GRID", grid)
    monkeypatch.setattr(quantiles, "_BRACKET", bracket)
    monkeypatch.setattr(joins, "MAX_BYTES", groups)
    monkeypatch.setattr(joins, "ROWS_PER_SALT", 100)
    rng = random.Random(6)
    groups = {
        "one": [3.5],
        "two": [1.0, 2.0],
        "same": [7.0] * 50,
        # Nearly all rows tie with a bound, which a grid cannot split.
        "ties": [5.0] * 500 + [5 + rng.random() for _ in range(520)],
        "hot": [1.0] * 300 + [rng.random() * 3 for _ in range(601)],
        "even": [rng.gauss(0, 1e6) for _ in range(400)],
        "odd": [rng.expovariate(1) for _ in range(401)],
        None: [1.0, 5.0, 2.0],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs]
    rows += [("odd", None), ("odd", float("nan")), ("nothing", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, g string, x double")
    assert median_of(df) == {g: statistics.median(xs) for g, xs in groups.items()}
