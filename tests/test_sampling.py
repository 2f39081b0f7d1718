"""Splits, samples and positions: exact, seeded, independent of the partitioning."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from evalweave.operators import sampling


def seeded_order(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


def ids_of(df, column="example_id"):
    return {r[0] for r in df.select(column).collect()}


@pytest.fixture
def rows(spark):
    return spark.range(2500).select(F.col("id").alias("example_id"), (F.col("id") % 7).alias("x"))


def test_split_sizes_of_the_published_data_set(spark):
    df = spark.range(33_955).withColumnRenamed("id", "example_id")
    sizes = dict(sampling.split_exact(df, 30_000).groupBy("split").count().collect())
    assert sizes == {"train": 30_000, "validation": 1_977, "test": 1_978}


def test_split_matches_the_seeded_order(rows):
    got = {r.example_id: r.split for r in sampling.split_exact(rows, 1000, seed=3).collect()}
    order = seeded_order(range(2500), 3)
    assert {got[i] for i in order[:1000]} == {"train"}
    assert {got[i] for i in order[1000:1750]} == {"validation"}
    assert {got[i] for i in order[1750:]} == {"test"}


@pytest.mark.parametrize("train", [0, 2500, 0.0, 1.0, 2499])
def test_split_extremes(rows, train):
    sizes = dict(sampling.split_exact(rows, train).groupBy("split").count().collect())
    n = int(2500 * train) if isinstance(train, float) else train
    expected = {"train": n, "validation": (2500 - n) // 2, "test": 2500 - n - (2500 - n) // 2}
    assert sizes == {name: size for name, size in expected.items() if size}


def test_too_many_training_rows_is_an_error(rows):
    with pytest.raises(Exception, match="smaller table"):
        sampling.split_exact(rows, 2501).collect()


@pytest.mark.parametrize("size", [0, 1, 137, 2500, 9999])
def test_sample(rows, size):
    expected = set(seeded_order(range(2500), 42)[:size])
    assert ids_of(sampling.seeded_sample(rows, size)) == expected


def test_sample_ignores_the_partitioning_and_depends_on_the_seed(rows):
    one = ids_of(sampling.seeded_sample(rows.coalesce(1), 300))
    assert one == ids_of(sampling.seeded_sample(rows.repartition(13), 300))
    assert one != ids_of(sampling.seeded_sample(rows, 300, seed=43))
    assert ids_of(sampling.seeded_sample(rows, None)) == set(range(2500))


def test_sample_of_nothing(rows):
    assert sampling.seeded_sample(rows.filter("false"), 5).count() == 0
    assert sampling.split_exact(rows.filter("false"), 0.5).count() == 0


def test_shuffle_is_the_seeded_order(rows):
    got = [r.example_id for r in sampling.seeded_shuffle(rows, 5).collect()]
    assert got == seeded_order(range(2500), 5)
    placed = sampling.seeded_shuffle(rows, 5, position="position").collect()
    assert [(r.example_id, r.position) for r in placed] == [(x, i) for i, x in enumerate(got)]


def test_caps(rows):
    split = rows.withColumn("split", F.when(F.col("x") == 0, "test").otherwise("train"))
    capped = sampling.split_caps(split, {"train": 100, "validation": 10, "test": None})
    sizes = dict(capped.groupBy("split").count().collect())
    assert sizes == {"train": 100, "test": 358}
    train = [i for i in range(2500) if i % 7]
    assert ids_of(capped.filter("split = 'train'")) == set(seeded_order(train, 42)[:100])
    assert sampling.split_caps(split, {}).count() == 2500
    unnamed = rows.withColumn("split", F.when(F.col("x") == 0, None).otherwise("train"))
    sizes = dict(sampling.split_caps(unnamed, {"train": 0, "test": 9}).groupBy("split").count().collect())
    assert sizes == {None: 358}


def test_check_split_sizes(rows):
    split = rows.withColumn("split", F.when(F.col("x") == 0, "test").otherwise("train"))
    checks = {
        r.split: (r.rows, r.ok)
        for r in sampling.check_split_sizes(split, {"train": 2142, "test": 1, "dev": 0}).collect()
    }
    assert checks == {"train": (2142, True), "test": (358, False), "dev": (0, True)}


def test_index_in_seeded_order(rows):
    got = {r.example_id: r.example_index for r in sampling.dense_index(rows, seed=9).collect()}
    assert got == {i: n for n, i in enumerate(seeded_order(range(2500), 9))}


def test_index_in_id_order_of_sparse_ids(spark):
    rng = random.Random(4)
    spread = [rng.randrange(-(2**62), 2**62) for _ in range(300)]
    dense = [2**40 + i for i in range(300)]
    ids = sorted({*spread, *dense, -1, 0, 1, 2**20, 2**20 - 1})
    df = spark.createDataFrame([(i,) for i in ids], "example_id long").repartition(5)
    got = {r.example_id: r.example_index for r in sampling.dense_index(df).collect()}
    assert got == {i: n for n, i in enumerate(ids)}


def test_index_per_group_keeps_rows_without_a_group(spark):
    df = spark.range(400).select(
        F.col("id").alias("example_id"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"),
    )
    for seed in (None, 1):
        got = sampling.dense_index(df, seed=seed, by=["g"]).collect()
        assert len(got) == 400
        for group in (None, 1, 2):
            positions = sorted(r.example_index for r in got if r.g == group)
            assert positions == list(range(len(positions)))


def test_batches(rows):
    sizes = [
        r["count"]
        for r in sampling.batches(sampling.dense_index(rows), 32)
        .groupBy("batch_id")
        .count()
        .orderBy("batch_id")
        .collect()
    ]
    assert sizes == [32] * 78 + [4]
