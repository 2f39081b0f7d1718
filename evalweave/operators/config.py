"""Run configurations as nested records and as long ``(run_id, key, value)`` tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from evalweave.operators.joins import ROWS_PER_TASK, spread_distinct, spread_join


def _leaves(schema: T.StructType, path: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    found = []
    for field in schema.fields:
        here = (*path, field.name)
        if isinstance(field.dataType, T.StructType):
            found += _leaves(field.dataType, here)
        else:
            found.append(here)
    return found


def flatten_record(df: DataFrame) -> DataFrame:
    """Nested structs to one column per leaf, named by its dotted path."""
    return df.select(
        *[
            F.col(".".join(f"`{part}`" for part in path)).alias(".".join(path))
            for path in _leaves(df.schema)
        ]
    )


def _parents(key: Column) -> Column:
    """``a.b.c`` gives ``[a, a.b]``."""
    parts = F.split(key, r"\.")
    return F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "."),
    )


def layered_merge(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """Merge two configurations; the override wins, also when its value is NULL.

    A section replaces a value and a value replaces a section: base entries at, above or
    below an overridden key are dropped. An override names itself and its parents, a base
    entry its parents, and what they share is found by joins on ``(run_id, key)``: no run's
    entries have to meet in one row or task, and a task gets a bounded number of rows, also
    those of a key that very many share. A run without an id is a run like any other; a NULL
    key replaces nothing. Both tables are counted first.
    """
    on = ["run_id", "key"]
    keyed = overrides.filter(F.col("key").isNotNull()).select(*on)
    n_parents = F.coalesce(F.sum(F.size(_parents(F.col("key")))), F.lit(0))
    n, n_above = keyed.agg(F.count("*"), n_parents).first()
    n_below = base.filter(F.col("key").isNotNull()).agg(n_parents).first()[0]
    named = keyed.repartition(n // ROWS_PER_TASK + 1, *on).distinct()
    with_parents = F.concat(_parents(F.col("key")), F.array("key"))
    at_or_above = named.select("run_id", F.explode(with_parents).alias("key"))
    parents = base.select("run_id", F.col("key").alias("entry"), F.explode(_parents(F.col("key"))).alias("key"))
    below = spread_join(parents, named, n, on, ["entry"], "left_semi")
    found = at_or_above.unionByName(below.select("run_id", F.col("entry").alias("key")))
    replaced = spread_distinct(found, n + n_above + n_below, on)
    kept = spread_join(base.select("run_id", "key", "value"), replaced, n, on, ["value"], "left_anti")
    return kept.unionByName(overrides.select("run_id", "key", "value"))


def dotted_overrides(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """Apply dotted overrides; NULL values and keys without a dot are ignored."""
    effective = overrides.filter(F.col("value").isNotNull() & F.col("key").contains("."))
    return layered_merge(base, effective)


def changed_keys(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides whose key exists in the base and whose value differs from it."""
    known = base.select("run_id", "key", F.col("value").alias("old"))
    return (
        overrides.join(known, ["run_id", "key"])
        .filter(~F.col("value").eqNullSafe(F.col("old")))
        .select("run_id", "key", "value")
    )
