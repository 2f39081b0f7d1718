"""Evaluate several models on one split and update predictions and leaderboard."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from evalweave import schemas
from evalweave.functions import chat
from evalweave.operators import hooks, reshape, sampling, scoring, summary
from evalweave.sources.evaluations import publish_evaluation
from evalweave.storage import materialize


@dataclass
class Evaluation:
    """The tables an evaluation leaves behind."""

    predictions: DataFrame
    summary: DataFrame
    errors: DataFrame


def eval_split(
    dataset: DataFrame,
    split: str,
    system_prompt: str,
    size: int | None = 128,
    seed: int = 42,
) -> DataFrame:
    """The sampled chat examples of one split."""
    rows = reshape.select_split(dataset, split)
    return reshape.to_chat(sampling.seeded_sample(rows, size, seed), system_prompt)


def evaluate(
    examples: DataFrame,
    model_ids: Sequence[str],
    make_generator: Callable,
    make_scorer: Callable | None = None,
    make_embedder: Callable | None = None,
    templates: DataFrame | None = None,
    memory_samples: DataFrame | None = None,
    batch_size: int = 32,
    on_error: str = "skip",
    journal: str | None = None,
) -> Evaluation:
    """Generate, score and summarize for all models in one pass.

    Model outputs are written to the shared folder before they are used, since several
    later steps read them. A model with any failed example is left out of predictions
    and summary and listed in ``errors``. With a ``journal`` folder that all executors reach,
    a run that is started again calls models only for what the earlier one did not answer.
    """
    requests = reshape.fan_out(examples, model_ids)
    if templates is None:
        requests = requests.withColumn(
            "rendered", F.array_join(F.transform("prompt", lambda m: m["content"]), "\n")
        )
    else:
        requests = reshape.render_prompts(requests, templates)
    requests = materialize(
        requests.select(
            "model_id",
            "example_id",
            chat.question_of(F.col("prompt")).alias("question"),
            chat.reference_of(F.col("completion")).alias("reference_answer"),
            F.col("rendered").alias("prompt"),
        ),
        "requests",
    )
    generations = materialize(
        hooks.generate(
            requests,
            make_generator,
            batch_size=batch_size,
            on_error=on_error,
            journal=journal and f"{journal}/generations",
        ),
        "generations",
    )
    errors = materialize(hooks.model_errors(generations), "errors")
    reference_stats = None
    scores = None
    if make_scorer is not None:
        # Models that failed to generate are not scored.
        answered = hooks.without_failed_models(requests, errors)
        scored = materialize(
            hooks.score_references(
                answered, make_scorer, on_error=on_error, journal=journal and f"{journal}/scores"
            ),
            "reference-scores",
        )
        errors = materialize(hooks.merge_errors(errors, hooks.model_errors(scored)), "errors")
        reference_stats = hooks.scoring_stats(scored)
        scores = scoring.reference_scores_from_arrays(scored)
    done = hooks.attach_generations(requests, hooks.without_failed_models(generations, errors))
    predictions = scoring.score_answers(done.drop("prompt")).select(
        *schemas.PREDICTIONS.fieldNames()
    )
    if scores is not None:
        predictions = scoring.attach_reference_scores(predictions, scores)
    if make_embedder is not None:
        predictions = materialize(predictions, "scored")
        vectors = materialize(
            hooks.embed(hooks.distinct_texts(predictions), make_embedder, on_error=on_error),
            "embeddings",
        )
        failed = hooks.embedding_errors(predictions, vectors)
        errors = materialize(hooks.merge_errors(errors, failed), "errors")
        predictions = hooks.attach_similarity(
            hooks.without_failed_models(predictions, errors), vectors
        )
    predictions = materialize(predictions, "predictions")
    telemetry = summary.run_telemetry(hooks.batch_stats(generations), reference_stats)
    if memory_samples is not None:
        telemetry = telemetry.join(summary.peak_memory(memory_samples), "model_id", "left")
    board = summary.attach_telemetry(summary.summarize_predictions(predictions), telemetry)
    return Evaluation(predictions, board, errors)


def save(evaluation: Evaluation, path: str) -> None:
    """Replace the evaluated models' predictions and board rows in one published version."""
    missing = [
        F.lit(None).cast(field.dataType).alias(field.name)
        for field in schemas.LEADERBOARD.fields
        if field.name not in evaluation.summary.columns
    ]
    publish_evaluation(evaluation.predictions, evaluation.summary.select("*", *missing), path)
