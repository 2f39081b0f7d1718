"""Leaderboard rows: keep the newest per model, merge, sort and pick candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def keep_last(rows: DataFrame, key: str = "model_id", version: str = "version") -> DataFrame:
    """The row with the highest ``version`` per key.

    An aggregate instead of a window: partial maxima are formed before the shuffle, so
    a key with many versions never gathers in one task. Rows of equal version are
    resolved by the remaining columns, hence always the same way.
    """
    rest = [c for c in rows.columns if c not in (key, version)]
    newest = F.max(F.struct(version, *rest)).alias("_row")
    return rows.groupBy(key).agg(newest).select(key, "_row.*").select(*rows.columns)


def _best_first() -> list[Column]:
    return [
        F.desc_nulls_last("answer_similarity_mean"),
        F.desc_nulls_last("token_f1_mean"),
        F.asc("model_id"),
    ]


def sort_leaderboard(rows: DataFrame) -> DataFrame:
    """Best similarity first, then best token F1; missing last, ties by model id."""
    return rows.orderBy(*_best_first())


def ranked_leaderboard(rows: DataFrame, name: str = "rank") -> DataFrame:
    """The sorted board with each model's 1-based rank; a board has one row per model."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*_best_first()))).orderBy(name)


def concat(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both boards under the union of their columns."""
    return old.unionByName(new, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, version: str = "version") -> DataFrame:
    """``new`` rows replace those of the same model; both sides carry ``version``."""
    return sort_leaderboard(keep_last(concat(old, new), version=version))


def top_candidates(
    rows: DataFrame, group: str, score: str, k: int, lineage: DataFrame | None = None
) -> DataFrame:
    """The ``k`` best models per ``group``, e.g. a size class given by ``lineage``."""
    ranked = rows if lineage is None else rows.join(lineage.select("model_id", group), "model_id")
    best = Window.partitionBy(group).orderBy(F.desc_nulls_last(score), F.asc("model_id"))
    return ranked.withColumn("candidate_rank", F.row_number().over(best)).filter(
        F.col("candidate_rank") <= k
    )
