"""Choices made from training logs: best checkpoint, best trial, early stopping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evalweave.functions.arrays import not_nan


def _with_loss(log: DataFrame) -> DataFrame:
    return log.filter(F.col("eval_loss").isNotNull() & ~F.isnan("eval_loss"))


def best_checkpoint(log: DataFrame) -> DataFrame:
    """Step of lowest ``eval_loss`` per run; the earliest step wins a tie."""
    best = F.min(F.struct("eval_loss", "step")).alias("best")
    return (
        _with_loss(log)
        .groupBy("run_id")
        .agg(best)
        .select("run_id", "best.step", "best.eval_loss")
    )


def best_trial(log: DataFrame, group: str = "base_model") -> DataFrame:
    """Run of lowest ``eval_loss`` per base model; the lowest run id wins a tie."""
    best = F.min(F.struct("eval_loss", "run_id")).alias("best")
    return _with_loss(log).groupBy(group).agg(best).select(group, "best.run_id", "best.eval_loss")


def _block_summaries(log: DataFrame, patience: int) -> DataFrame:
    """What a block of consecutive evaluations of a run adds to a scan over its blocks.

    Positions count from 1 within the block. ``best`` is its lowest loss, ``last`` where it
    was first reached, ``stall`` the first new best of the block that no other follows within
    ``patience`` evaluations, with the step where these end, and ``head`` the first
    ``patience`` evaluations: an improvement on earlier blocks that comes in time is one of
    them, and so is the step where an earlier block's patience ends.
    """
    rows = log.select(
        F.struct("run_id").alias("run"), "step", not_nan(F.col("eval_loss")).alias("loss")
    )
    # Blocks are range partitions, so a run of any length is cut where the data is.
    ranged = rows.repartitionByRange("run", "step").withColumn("block", F.spark_partition_id())
    here = Window.partitionBy("run", "block").orderBy("step")
    so_far = here.rowsBetween(Window.unboundedPreceding, 0)
    scanned = ranged.withColumns(
        {
            "position": F.row_number().over(here),
            "lowest": F.min("loss").over(so_far),
            "end_step": F.lead("step", patience).over(here),
        }
    ).withColumns(
        {"before": F.lag("lowest").over(here), "later": F.lead("lowest", patience).over(here)}
    )
    new_best = F.col("loss").isNotNull() & (
        F.col("before").isNull() | (F.col("loss") < F.col("before"))
    )
    stalls = new_best & F.col("end_step").isNotNull() & (F.col("later") == F.col("loss"))
    return scanned.groupBy("run", "block").agg(
        F.count("*").alias("n"),
        F.min("loss").alias("best"),
        F.max(F.when(new_best, F.col("position"))).alias("last"),
        F.min(F.when(stalls, F.struct("position", "end_step"))).alias("stall"),
        F.sort_array(
            F.collect_list(
                F.when(F.col("position") <= patience, F.struct("position", "step", "loss"))
            )
        ).alias("head"),
    )


def _next_state(state: Column, block: Column, patience: int) -> Column:
    """The scan's state after one more block, unless the run has stopped before.

    Until a run has a loss, every evaluation counts as an improvement.
    """
    unknown = state.best.isNull()
    deadline = state.last + patience
    lower = F.filter(block.head, lambda e: e.loss < state.best)
    first = F.when(unknown, F.lit(1)).otherwise(F.get(lower, F.lit(0)).position)
    improved = F.coalesce(state.seen + first <= deadline, F.lit(False))
    stalled = improved & block.stall.isNotNull()
    waited = ~improved & (deadline <= state.seen + block.n)
    last = F.when(improved, state.seen + F.coalesce(block.last, block.n)).otherwise(state.last)
    stop = F.when(stalled, state.seen + block.stall.position + patience).when(waited, deadline)
    at_deadline = F.get(block.head, (deadline - state.seen - 1).cast("int")).step
    step = F.when(stalled, block.stall.end_step).when(waited, at_deadline)
    going_on = state.stop.isNull()
    return F.struct(
        (state.seen + block.n).alias("seen"),
        F.when(improved, F.coalesce(block.best, state.best)).otherwise(state.best).alias("best"),
        last.alias("last"),
        F.when(going_on, stop).otherwise(state.stop).alias("stop"),
        F.when(going_on, step).otherwise(state.step).alias("step"),
    )


def early_stop(log: DataFrame, patience: int = 5) -> DataFrame:
    """Where each run would stop: after ``patience`` evaluations in a row without a new best.

    Returns ``run_id, evaluations, stop_position, stop_step``; the last two are missing
    for runs that never stop. ``(run_id, step)`` is unique, steps are whole numbers. Only
    strict improvement counts, and the first evaluation always does; a missing loss is no
    improvement.

    A scan over blocks: rows are moved into ranges of ``(run, step)`` and once more to the
    task that summarizes their block; a summary has a bounded size, and a run's summaries, one
    per block, are folded in order. A run without an id is a run like any other.
    """
    blocks = F.sort_array(F.collect_list(F.struct("block", "n", "best", "last", "stall", "head")))
    start = F.struct(
        F.lit(0).cast("bigint").alias("seen"),
        F.lit(None).cast("double").alias("best"),
        F.lit(0).cast("bigint").alias("last"),
        F.lit(None).cast("bigint").alias("stop"),
        F.lit(None).cast(log.schema["step"].dataType).alias("step"),
    )
    scan = F.aggregate("blocks", start, lambda state, block: _next_state(state, block, patience))
    return (
        _block_summaries(log, patience)
        .groupBy("run")
        .agg(blocks.alias("blocks"))
        .select("run", scan.alias("end"))
        .select(
            "run.run_id",
            F.col("end.seen").alias("evaluations"),
            F.col("end.stop").alias("stop_position"),
            F.col("end.step").alias("stop_step"),
        )
    )
