"""Column layouts of the tables the engine reads and writes.

Missing numbers are NULL; NaN is kept out of every table because aggregates would
spread it and descending sorts would put it first.
"""

from __future__ import annotations

from pyspark.sql import types as T

FLASHCARDS = T.StructType(
    [
        T.StructField("example_id", T.LongType()),
        T.StructField("instruction", T.StringType()),
        T.StructField("input", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField("split", T.StringType()),
    ]
)

MESSAGES = T.ArrayType(
    T.StructType(
        [T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]
    )
)

PREDICTIONS = T.StructType(
    [
        T.StructField("model_id", T.StringType()),
        T.StructField("example_id", T.LongType()),
        T.StructField("question", T.StringType()),
        T.StructField("reference_answer", T.StringType()),
        T.StructField("generated_answer", T.StringType()),
        T.StructField("raw_generation", T.StringType()),
        T.StructField("generated_tokens", T.IntegerType()),
        T.StructField("token_f1", T.DoubleType()),
    ]
)

# The published leaderboard's columns, in order.
LEADERBOARD_METRICS = (
    "token_f1_mean",
    "token_f1_std",
    "answer_similarity_mean",
    "answer_similarity_std",
    "reference_answer_nll_mean",
    "reference_answer_nll_std",
    "reference_answer_token_perplexity_mean",
    "reference_answer_token_perplexity_std",
    "reference_answer_token_perplexity_median",
    "reference_answer_tokens_mean",
    "reference_answer_tokens_std",
)
TELEMETRY = (
    "total_inference_seconds",
    "generation_inference_seconds",
    "generation_tokens",
    "generation_tokens_per_second",
    "reference_logprob_inference_seconds",
    "reference_logprob_examples_per_second",
    "vram_peak_allocated_mb",
    "vram_peak_reserved_mb",
)

LEADERBOARD = T.StructType(
    [T.StructField("model_id", T.StringType()), T.StructField("n", T.LongType())]
    + [
        T.StructField(name, T.LongType() if name == "generation_tokens" else T.DoubleType())
        for name in LEADERBOARD_METRICS + TELEMETRY
    ]
)
