"""Configurations as tables against nested dictionaries."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from evalweave.operators import config

SCHEMA = "run_id long, key string, value string"


def nest(flat):
    root = {}
    for key, value in flat.items():
        *parents, leaf = key.split(".")
        node = root
        for part in parents:
            node = node.setdefault(part, {})
        node[leaf] = value
    return root


def flat(nested, prefix=""):
    for key, value in nested.items():
        if isinstance(value, dict):
            yield from flat(value, f"{prefix}{key}.")
        else:
            yield prefix + key, value


def merged(base, over):
    out = dict(base)
    for key, value in over.items():
        both = isinstance(value, dict) and isinstance(out.get(key), dict)
        out[key] = merged(out[key], value) if both else value
    return out


def table(spark, runs):
    rows = [(run, k, v) for run, entries in runs.items() for k, v in entries.items()]
    return spark.createDataFrame(rows, SCHEMA)


def as_dicts(df):
    out = {}
    for row in df.collect():
        assert row.key not in out.setdefault(row.run_id, {})
        out[row.run_id][row.key] = row.value
    return out


def test_flatten(spark):
    df = spark.range(1).select(
        F.struct(F.lit(1).alias("b"), F.struct(F.lit("x").alias("d")).alias("c")).alias("a"),
        F.lit(2).alias("e"),
        F.struct(F.struct().alias("nothing")).alias("empty"),
    )
    got = config.flatten_record(df)
    assert got.columns == ["a.b", "a.c.d", "e"] and tuple(got.first()) == (1, "x", 2)


def test_layered_merge_matches_nested_merge(spark):
    rng = random.Random(8)
    names = ["a", "a.x", "a.x.p", "a.y", "b", "b.z", "b.z.q", "c", "d.e.f"]

    def random_config():
        chosen = {}
        for key in rng.sample(names, rng.randrange(1, 6)):
            clash = any(k.startswith(f"{key}.") or key.startswith(f"{k}.") for k in chosen)
            if not clash:
                chosen[key] = rng.choice(["1", "2", None])
        return chosen

    base = {run: random_config() for run in range(200)}
    over = {run: random_config() for run in range(50, 250)}
    got = as_dicts(config.layered_merge(table(spark, base), table(spark, over)))
    expected = {
        run: dict(flat(merged(nest(base.get(run, {})), nest(over.get(run, {})))))
        for run in {*base, *over}
    }
    assert got == expected


def test_dotted_overrides(spark):
    base = {1: {"training.learning_rate": "0.001", "model.id": "m"}}
    over = {1: {"training.learning_rate": "0.0002", "model.id": None, "nodot": "x", "new.key": "y"}}
    got = as_dicts(config.dotted_overrides(table(spark, base), table(spark, over)))
    assert got == {1: {"training.learning_rate": "0.0002", "model.id": "m", "new.key": "y"}}


def test_changed_keys(spark):
    base = {1: {"a.b": "1", "a.c": None, "a.d": "3"}}
    over = {1: {"a.b": "1", "a.c": "2", "a.d": None, "a.e": "5"}}
    assert as_dicts(config.changed_keys(table(spark, base), table(spark, over))) == {
        1: {"a.c": "2", "a.d": None}
    }


def test_null_keys_and_runs(spark):
    """A NULL key replaces no other key, and a NULL run is a run like others."""
    base = spark.createDataFrame([(1, "a", "x"), (1, "b.c", "y"), (None, "a", "z"), (None, "d", "z")], SCHEMA)
    over = spark.createDataFrame([(1, None, "n"), (1, "a", "new"), (None, "a.b", "m")], SCHEMA)
    got = {tuple(r) for r in config.layered_merge(base, over).collect()}
    assert got == {(1, "a", "new"), (1, "b.c", "y"), (1, None, "n"), (None, "a.b", "m"), (None, "d", "z")}


def test_a_run_with_a_third_of_all_keys(spark, capsys):
    """A million entries, a third of them in one run; nothing gathers a run's entries."""
    n = 1_000_000
    ids = spark.range(n)
    run = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000 + 1).cast("long")
    section = F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))
    key = F.concat(section, F.lit(".k"), F.col("id").cast("string"))
    base = ids.select(run.alias("run_id"), key.alias("key"), F.lit("old").alias("value"))
    changed = base.filter(F.xxhash64("key") % 5 == 0).withColumn("value", F.lit("new"))
    whole = spark.createDataFrame([(0, "s3", "gone"), (1, "s2.k1.deep", "x")], SCHEMA)
    merged = config.layered_merge(base, changed.unionByName(whole))
    merged.explain()
    assert "collect_list" not in capsys.readouterr().out
    got = merged.groupBy((F.col("run_id") == 0).alias("hot")).agg(
        F.count("*").alias("n"), F.count_if(F.col("value") == "old").alias("old")
    )
    gone = (F.col("run_id") == 0) & (F.split("key", r"\.")[0] == "s3")
    kept = base.join(changed.select("run_id", "key"), ["run_id", "key"], "left_anti").filter(~gone)
    want = {
        bool(hot): (kept.filter((F.col("run_id") == 0) == hot).count(), changed.filter((F.col("run_id") == 0) == hot).count() + 1)
        for hot in (True, False)
    }
    assert {r.hot: (r.old, r.n - r.old) for r in got.collect()} == want


def test_a_task_of_a_merge_gets_a_bounded_number_of_rows(spark, monkeypatch):
    """Rows of a key that a third of all entries share are spread over many tasks too."""
    from evalweave.operators import joins

    monkeypatch.setattr(joins, "ROWS_PER_TASK", 2000)
    ids = spark.range(60_000)
    run = F.when(F.col("id") % 3 != 0, F.col("id"))
    key = F.when(F.col("id") % 3 == 0, F.lit("one")).otherwise(F.concat(F.lit("s.k"), F.col("id") % 7))
    base = ids.select(run.alias("run_id"), key.alias("key"), F.col("id").cast("string").alias("value"))
    over = spark.createDataFrame([(1, "s", "gone"), (2, "s.k2.deep", "x"), (None, "two", "y")], SCHEMA)
    merged = config.layered_merge(base, over)
    sizes = [r["count"] for r in merged.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 60_000 - 2 + 3 and max(sizes) < 12_000
    assert {r.value for r in merged.filter("run_id IN (1, 2)").collect()} == {"gone", "x"}
    section = spark.createDataFrame([(None, "one.more", "z")], SCHEMA)
    assert config.layered_merge(base, section).filter("run_id IS NULL").count() == 1


def test_replaced_keys_are_cut_by_rows(spark, monkeypatch):
    """Keys are made distinct in as many tasks as their rows ask for, not by their bytes."""
    from evalweave.operators import joins

    monkeypatch.setattr(joins, "ROWS_PER_TASK", 2000)
    ids = spark.range(40_000)
    key = F.when(F.col("id") % 3 == 0, "s.one").otherwise(F.concat(F.lit("s.k"), F.col("id").cast("string")))
    base = ids.select((F.col("id") % 50).alias("run_id"), key.alias("key"), F.lit("old").alias("value"))
    over = base.filter("run_id < 10").withColumn("value", F.lit("new"))
    merged = config.layered_merge(base, over)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "hashpartitioning(run_id" in line and "ENSURE" in line]
    assert merged.filter("value = 'old'").count() == base.filter("run_id >= 10").count()
    keys = joins.spread_distinct(base.repartition(5), 40_000, ["run_id", "key"])
    sizes = [r["count"] for r in keys.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == base.select("run_id", "key").distinct().count() and max(sizes) < 4000
