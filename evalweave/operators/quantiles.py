"""Exact median per group without holding a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from evalweave.operators.joins import lookup_groups
from evalweave.storage import materialize

# A mergeable sketch brackets the middle: ranks 0.5 +- 0.0002 with an error of 0.0001.
_BRACKET = (0.4998, 0.5002)
_ACCURACY = 10_000
# Brackets holding more rows than this are narrowed again, on a grid of 1/1000ths.
MAX_INSIDE = 1_000_000
_GRID = 1000

# Per group: number of values, bounds of the bracket (NULL: open), rows below it, rows in it.
_STATE = ("_n", "_low", "_high", "_skipped", "_inside")
_FIRST = "floor((_n + 1) / 2)"
_SECOND = "floor((_n + 2) / 2)"


def _inside() -> Column:
    low, high = F.col("_low"), F.col("_high")
    return (low.isNull() | (F.col("_v") >= low)) & (high.isNull() | (F.col("_v") <= high))


def _tighten(
    values: DataFrame, proposed: DataFrame, keys: Sequence[str], salt_by: Sequence[str]
) -> DataFrame:
    """Count around the proposed bounds ``_a`` and ``_b`` and adopt those that hold."""
    v, a, b = F.col("_v"), F.col("_a"), F.col("_b")
    counted = (
        lookup_groups(values, proposed, keys, salt_by)
        .groupBy(*keys, *_STATE, "_a", "_b")
        .agg(F.count_if(v < a).alias("_below"), F.count_if(v <= b).alias("_up_to"))
    )
    from_a = F.expr(_FIRST) > F.col("_below")
    to_b = F.expr(_SECOND) <= F.col("_up_to")
    skipped = F.when(from_a, F.col("_below")).otherwise(F.col("_skipped"))
    end = F.when(to_b, F.col("_up_to")).otherwise(F.col("_skipped") + F.col("_inside"))
    return counted.select(
        *keys,
        "_n",
        F.when(from_a, a).otherwise(F.col("_low")).alias("_low"),
        F.when(to_b, b).otherwise(F.col("_high")).alias("_high"),
        skipped.alias("_skipped"),
        (end - skipped).alias("_inside"),
    )


def _narrower(
    values: DataFrame, state: DataFrame, keys: Sequence[str], salt_by: Sequence[str]
) -> DataFrame:
    """Propose the grid cells around the middle's position inside the present bracket."""
    grid = F.percentile_approx("_v", [i / _GRID for i in range(_GRID + 1)], _ACCURACY)
    cell = F.floor((F.expr(_FIRST) - F.col("_skipped")) * _GRID / F.col("_inside")).cast("int")
    cells = (
        lookup_groups(values, state, keys, salt_by)
        .filter(_inside())
        .groupBy(*keys, *_STATE)
        .agg(grid.alias("_grid"))
    )
    return cells.select(
        *keys,
        *_STATE,
        F.get("_grid", F.greatest(cell - 1, F.lit(0))).alias("_a"),
        F.get("_grid", F.least(cell + 2, F.lit(_GRID))).alias("_b"),
    )


def _inner(
    values: DataFrame, state: DataFrame, keys: Sequence[str], salt_by: Sequence[str]
) -> DataFrame:
    """Propose the next values inside the present bounds, which leaves out ties with these."""
    v, low, high = F.col("_v"), F.col("_low"), F.col("_high")
    above = F.min(F.when(low.isNull() | (v > low), v))
    below = F.max(F.when(high.isNull() | (v < high), v))
    return (
        lookup_groups(values, state, keys, salt_by)
        .filter(_inside())
        .groupBy(*keys, *_STATE)
        .agg(above.alias("_next"), below.alias("_last"))
        .select(
            *keys,
            *_STATE,
            F.coalesce("_next", "_low").alias("_a"),
            F.coalesce("_last", "_high").alias("_b"),
        )
    )


def exact_median(
    rows: DataFrame, keys: Sequence[str], value: str, salt_by: Sequence[str], name: str
) -> DataFrame:
    """``keys`` and the exact median of ``value`` (mean of the two middle values).

    The built-in exact median keeps every distinct value of a group in one task. Here
    a quantile sketch brackets the middle of each group, rows outside the bracket are
    only counted, and just the distinct values inside it are ordered; a bracket that
    still holds many rows is narrowed first. A bound counts only if exact counts show
    that the middle lies on its inner side, so the result never depends on a sketch's
    error. ``rows`` is read at least three times and should be a written table.
    """
    values = rows.select(*keys, F.col(value).alias("_v"), *[c for c in salt_by if c not in keys])
    values = values.filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    missing = F.lit(None).cast("double")
    proposed = (
        values.groupBy(*keys)
        .agg(
            F.count("*").alias("_n"),
            F.percentile_approx("_v", list(_BRACKET), _ACCURACY).alias("_p"),
        )
        .select(
            *keys,
            "_n",
            missing.alias("_low"),
            missing.alias("_high"),
            F.lit(0).cast("bigint").alias("_skipped"),
            F.col("_n").alias("_inside"),
            F.col("_p")[0].alias("_a"),
            F.col("_p")[1].alias("_b"),
        )
    )
    proposed = materialize(proposed, "median-brackets")
    state = materialize(_tighten(values, proposed, keys, salt_by), "median-brackets")
    open_ = F.col("_low").isNull() | F.col("_high").isNull() | (F.col("_low") < F.col("_high"))
    wide = open_ & (F.col("_inside") > MAX_INSIDE)
    def left_in(state: DataFrame) -> int:
        return state.agg(F.coalesce(F.sum(F.when(wide, F.col("_inside"))), F.lit(0))).first()[0]

    left = left_in(state)
    while left:
        before = left
        # A round shrinks wide brackets a few hundredfold. Where many rows tie with a bound, no
        # grid does, and the bound is moved past them.
        for propose in (_narrower, _inner):
            cells = materialize(propose(values, state, keys, salt_by), "median-brackets")
            state = materialize(_tighten(values, cells, keys, salt_by), "median-brackets")
            left = left_in(state)
            if 2 * left <= before:
                break
        if left == before:
            break
    middle = (
        lookup_groups(values, state, keys, salt_by)
        .filter(_inside())
        .groupBy(*keys, "_n", "_skipped", "_v")
        .agg(F.count("*").alias("_copies"))
    )
    order = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rank = F.col("_skipped") + F.sum("_copies").over(order)
    return (
        middle.withColumn("_rank", rank)
        .groupBy(*keys)
        .agg(
            F.min(F.when(F.col("_rank") >= F.expr(_FIRST), F.col("_v"))).alias("_a"),
            F.min(F.when(F.col("_rank") >= F.expr(_SECOND), F.col("_v"))).alias("_b"),
        )
        .select(*keys, ((F.col("_a") + F.col("_b")) / 2).alias(name))
    )
