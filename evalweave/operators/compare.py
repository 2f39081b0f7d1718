"""Comparisons between evaluated runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def sample_fingerprint(predictions: DataFrame, split: str) -> DataFrame:
    """Order-free fingerprint of the examples each model was evaluated on."""
    digest = F.md5(F.concat(F.lit(f"{split}:"), F.col("example_id").cast("string")))
    bits = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    return predictions.groupBy("model_id").agg(
        F.bit_xor(bits).alias("fingerprint"), F.count("*").alias("examples")
    )


def tuned_gain(
    base: DataFrame,
    tuned: DataFrame,
    lineage: DataFrame,
    fingerprints: DataFrame | None = None,
    metric: str = "token_f1_mean",
) -> DataFrame:
    """Gain of every tuned model over its base model.

    ``lineage`` has ``model_id, base_model, setup``. With ``fingerprints`` the result
    says whether both were evaluated on the same examples; otherwise that is unknown.
    """
    pairs = lineage.filter(F.col("setup") == "tuned").select("model_id", "base_model")
    tuned_side = tuned.select("model_id", F.col(metric).alias("tuned"))
    base_side = base.select(F.col("model_id").alias("base_model"), F.col(metric).alias("base"))
    gains = (
        pairs.join(tuned_side, "model_id")
        .join(base_side, "base_model")
        .withColumn("gain", F.col("tuned") - F.col("base"))
    )
    if fingerprints is None:
        return gains.withColumn("same_sample", F.lit(None).cast("boolean"))
    sample = F.struct("fingerprint", "examples")
    own = fingerprints.select("model_id", sample.alias("own"))
    other = fingerprints.select(F.col("model_id").alias("base_model"), sample.alias("other"))
    return (
        gains.join(own, "model_id", "left")
        .join(other, "base_model", "left")
        .withColumn("same_sample", F.col("own") == F.col("other"))
        .drop("own", "other")
    )


def compare_setups(left: DataFrame, right: DataFrame, *metrics: str) -> DataFrame:
    """Two boards side by side per model, e.g. full precision and 4-bit."""
    a = left.select("model_id", *[F.col(m).alias(f"{m}_left") for m in metrics])
    b = right.select("model_id", *[F.col(m).alias(f"{m}_right") for m in metrics])
    return a.join(b, "model_id", "full").withColumns(
        {f"{m}_change": F.col(f"{m}_right") - F.col(f"{m}_left") for m in metrics}
    )


def setup_means(comparison: DataFrame, *metrics: str) -> DataFrame:
    """All-model means of both sides and the relative change in percent."""
    sides = [
        F.avg(f"{m}_{side}").alias(f"{m}_{side}") for m in metrics for side in ("left", "right")
    ]
    means = comparison.agg(*sides)
    changes = {
        f"{m}_change_percent": F.when(
            F.col(f"{m}_left") != 0, 100 * (F.col(f"{m}_right") / F.col(f"{m}_left") - 1)
        )
        for m in metrics
    }
    return means.withColumns(changes)
