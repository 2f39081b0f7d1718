"""Per-example scores of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from evalweave.functions import arrays, text

KEY = ("model_id", "example_id")


def score_answers(predictions: DataFrame) -> DataFrame:
    """Clean both answers and add ``token_f1``, ``token_precision``, ``token_recall``.

    Reads ``raw_generation`` and ``reference_answer``; the generated answer and its
    scores are added to the row, no shuffle is involved.
    """
    cleaned = predictions.withColumns(
        {
            "generated_answer": text.clean_answer(F.col("raw_generation")),
            "reference_answer": text.clean_answer(F.col("reference_answer")),
        }
    )
    counts = cleaned.withColumn(
        "_counts", text.token_counts(F.col("generated_answer"), F.col("reference_answer"))
    )
    return counts.withColumns(
        {
            "n_prediction": F.col("_counts.n_prediction"),
            "n_reference": F.col("_counts.n_reference"),
            "overlap": F.col("_counts.overlap"),
            "token_precision": text.precision(F.col("_counts")),
            "token_recall": text.recall(F.col("_counts")),
            "token_f1": text.f1(F.col("_counts")),
        }
    ).drop("_counts")


def reference_scores(
    token_logprobs: DataFrame, examples: DataFrame, key: Sequence[str] = KEY
) -> DataFrame:
    """Sum, mean NLL, perplexity and token count per example from its tokens.

    ``token_logprobs`` has one row per token, or per distinct token with the number ``n`` of
    its occurrences. ``examples`` lists the keys to report; an example without tokens keeps
    0 tokens and missing scores. A non-finite mean leaves the perplexity missing.
    """
    n = F.col("n") if "n" in token_logprobs.columns else F.lit(1)
    sums = token_logprobs.groupBy(*key).agg(
        F.sum(F.col("logprob") * n).alias("s"), F.sum(n).alias("c")
    )
    return (
        examples.select(*key)
        .join(sums, list(key), "left")
        .select(
            *key,
            arrays.not_nan(F.col("s")).alias("reference_answer_logprob_sum"),
            arrays.not_nan(-F.col("s") / F.col("c")).alias("reference_answer_nll_mean"),
            arrays.perplexity(-F.col("s") / F.col("c")).alias("reference_answer_token_perplexity"),
            F.coalesce("c", F.lit(0)).cast("int").alias("reference_answer_tokens"),
        )
    )


def reference_scores_from_arrays(scored: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The same scores from one ``token_logprobs`` array per example; no shuffle."""
    score = arrays.reference_score(F.col("token_logprobs")).alias("score")
    return scored.select(*key, score).select(*key, "score.*")


def attach_reference_scores(
    predictions: DataFrame, scores: DataFrame, key: Sequence[str] = KEY
) -> DataFrame:
    """Left join of the scores of all models at once; the key is unique on both sides."""
    return predictions.join(scores, list(key), "left")


def similarity_where_valid(df: DataFrame, generated: str, reference: str) -> DataFrame:
    """Add ``answer_similarity`` of two vector columns; missing for an invalid pair."""
    return df.withColumn("answer_similarity", arrays.cosine(F.col(generated), F.col(reference)))


def disagreements(
    scored: DataFrame, min_f1: float, max_similarity: float, per_model: int
) -> DataFrame:
    """Answers with high token F1 but low similarity: the widest gaps of each model."""
    gap = F.col("token_f1") - F.col("answer_similarity")
    widest = Window.partitionBy("model_id").orderBy(F.desc("gap"), "example_id")
    return (
        scored.filter(
            (F.col("token_f1") >= min_f1) & (F.col("answer_similarity") <= max_similarity)
        )
        .withColumn("gap", gap)
        .withColumn("gap_rank", F.row_number().over(widest))
        .filter(F.col("gap_rank") <= per_model)
    )
