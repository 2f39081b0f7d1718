"""One summary row per model, and the telemetry that goes with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalweave.functions.arrays import array_sum, finite, not_nan
from evalweave.operators.joins import group_join
from evalweave.operators.quantiles import exact_median

PERPLEXITY = "reference_answer_token_perplexity"


def _mean_and_std(column: str, prefix: str) -> list[Column]:
    value = not_nan(F.col(column).cast("double"))
    return [
        F.avg(value).alias(f"{prefix}_mean"),
        F.stddev_samp(value).alias(f"{prefix}_std"),
    ]


def summarize_predictions(
    predictions: DataFrame,
    salt_by: tuple[str, ...] = ("example_id",),
    median_accuracy: int | None = None,
) -> DataFrame:
    """Count, means and sample deviations per model; medians of perplexity.

    Similarity columns are always present (missing without the input column); the NLL,
    perplexity and token-count blocks appear only when their input does. Empty
    references count as 0 tokens but are missing in the NLL and perplexity blocks.
    The median reads ``predictions`` again, which should then be a written table. With
    ``median_accuracy`` it is approximate and costs no further pass: a value of the column
    whose rank is off by one part in ``median_accuracy`` of the rows at most.
    """
    columns = set(predictions.columns)
    aggregates = [F.count("*").alias("n"), *_mean_and_std("token_f1", "token_f1")]
    if "answer_similarity" in columns:
        aggregates += _mean_and_std("answer_similarity", "answer_similarity")
    if "reference_answer_nll_mean" in columns:
        aggregates += _mean_and_std("reference_answer_nll_mean", "reference_answer_nll")
    if PERPLEXITY in columns:
        aggregates += _mean_and_std(PERPLEXITY, PERPLEXITY)
        if median_accuracy:
            value = not_nan(F.col(PERPLEXITY).cast("double"))
            near = F.percentile_approx(value, 0.5, median_accuracy)
            aggregates.append(near.alias(f"{PERPLEXITY}_median"))
    if "reference_answer_tokens" in columns:
        aggregates += _mean_and_std("reference_answer_tokens", "reference_answer_tokens")
    summary = predictions.groupBy("model_id").agg(*aggregates)
    if "answer_similarity" not in columns:
        missing = F.lit(None).cast("double")
        summary = summary.withColumns(
            {"answer_similarity_mean": missing, "answer_similarity_std": missing}
        )
    if PERPLEXITY in columns and not median_accuracy:
        median = exact_median(
            predictions, ["model_id"], PERPLEXITY, salt_by, f"{PERPLEXITY}_median"
        )
        summary = group_join(summary, median, ["model_id"], "left")
    return summary


def batch_rates(batches: DataFrame) -> DataFrame:
    """Token sum and tokens per second of each batch from its per-example counts."""
    tokens, seconds = F.col("generated_tokens"), F.col("inference_seconds")
    return batches.withColumn(
        "generated_tokens", array_sum(F.col("generated_tokens_per_example"))
    ).withColumn("tokens_per_second", F.when(seconds > 0, tokens / seconds))


def run_telemetry(batches: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Per-model seconds, tokens and rates.

    ``batches`` has ``inference_seconds`` and ``generated_tokens`` per batch.
    ``reference`` has ``model_id, reference_seconds, examples`` (any number of rows per
    model); without it, or without seconds for a model, the reference columns are
    missing and the total is the generation time.
    """
    generation = batches.groupBy("model_id").agg(
        F.sum("inference_seconds").alias("generation_inference_seconds"),
        F.sum("generated_tokens").cast("bigint").alias("generation_tokens"),
    )
    if reference is None:
        joined = generation.withColumns(
            {
                "reference_logprob_inference_seconds": F.lit(None).cast("double"),
                "examples": F.lit(None).cast("bigint"),
            }
        )
    else:
        scoring = reference.groupBy("model_id").agg(
            F.sum(not_nan(F.col("reference_seconds"))).alias(
                "reference_logprob_inference_seconds"
            ),
            F.sum("examples").alias("examples"),
        )
        joined = generation.join(scoring, "model_id", "left")
    seconds = F.col("generation_inference_seconds")
    scoring_seconds = F.col("reference_logprob_inference_seconds")
    return joined.select(
        "model_id",
        (seconds + F.coalesce(finite(scoring_seconds), F.lit(0.0))).alias(
            "total_inference_seconds"
        ),
        "generation_inference_seconds",
        "generation_tokens",
        F.when(seconds > 0, F.col("generation_tokens") / seconds).alias(
            "generation_tokens_per_second"
        ),
        "reference_logprob_inference_seconds",
        F.when(scoring_seconds > 0, F.col("examples") / scoring_seconds).alias(
            "reference_logprob_examples_per_second"
        ),
    )


def peak_memory(samples: DataFrame) -> DataFrame:
    """Sum over devices of each device's peak, in MB, per model.

    ``samples`` has ``model_id, device, allocated_bytes, reserved_bytes``. Models
    without a sample have no row, so a left join leaves their columns missing.
    """
    peaks = samples.groupBy("model_id", "device").agg(
        F.max("allocated_bytes").alias("allocated"), F.max("reserved_bytes").alias("reserved")
    )
    return peaks.groupBy("model_id").agg(
        (F.sum("allocated") / 1024**2).alias("vram_peak_allocated_mb"),
        (F.sum("reserved") / 1024**2).alias("vram_peak_reserved_mb"),
    )


def attach_telemetry(summary: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Left join on the model; the telemetry's value wins on equal column names."""
    clashing = [c for c in telemetry.columns if c != "model_id" and c in summary.columns]
    return summary.drop(*clashing).join(telemetry, "model_id", "left")


def cross_model_means(leaderboard: DataFrame, *metrics: str) -> DataFrame:
    """Plain means of leaderboard columns over all models."""
    return leaderboard.agg(
        F.count("*").alias("models"), *[F.avg(m).alias(f"{m}_avg") for m in metrics]
    )
