"""Rows to chat examples, prompts and fixed column sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from evalweave.functions import chat
from evalweave.operators.joins import lookup_groups

RAW_FIELDS = ("instruction", "input", "output")


def to_chat(
    df: DataFrame, system_prompt: str, keep: Sequence[str] = ("example_id", "split")
) -> DataFrame:
    """Raw rows to ``prompt`` and ``completion``; rows that have both pass unchanged.

    Source columns are dropped except the identity columns in ``keep``.
    """
    if {"prompt", "completion"} <= set(df.columns):
        return df
    identity = [name for name in keep if name in df.columns]
    return df.select(
        *identity,
        chat.chat_prompt(system_prompt, F.col("instruction"), F.col("input")).alias("prompt"),
        chat.chat_completion(F.col("output")).alias("completion"),
    )


def incomplete_rows(df: DataFrame) -> DataFrame:
    """Raw rows with a missing field, to be set aside before :func:`to_chat`."""
    missing = [F.col(name).isNull() for name in RAW_FIELDS]
    return df.filter(missing[0] | missing[1] | missing[2])


def complete_rows(df: DataFrame) -> DataFrame:
    """Raw rows with all fields present."""
    return df.dropna(subset=list(RAW_FIELDS))


def select_split(df: DataFrame, split: str) -> DataFrame:
    """One split; prunes partitions on a table partitioned by ``split``."""
    return df.filter(F.col("split") == split)


def questions_and_references(df: DataFrame, keep: Sequence[str] = ("example_id",)) -> DataFrame:
    """``question`` and cleaned ``reference_answer`` of chat examples."""
    return df.select(
        *keep,
        chat.question_of(F.col("prompt")).alias("question"),
        chat.reference_of(F.col("completion")).alias("reference_answer"),
    )


def fan_out(examples: DataFrame, model_ids: Sequence[str]) -> DataFrame:
    """One row per configured model and example, without a join."""
    ids = F.array(*[F.lit(m) for m in dict.fromkeys(model_ids)])
    return examples.select(F.explode(ids).alias("model_id"), "*")


def render_prompts(requests: DataFrame, templates: DataFrame) -> DataFrame:
    """Add ``rendered``: each prompt in its model's chat format.

    ``templates`` has one row per ``model_id`` with the pieces of :func:`chat.render`.
    """
    pieces = (
        "before_role",
        "after_role",
        "after_message",
        "generation_header",
        "no_think_suffix",
    )
    joined = lookup_groups(requests, templates, ["model_id"], ["example_id"], "left")
    return joined.withColumn(
        "rendered", chat.render(F.col("prompt"), *[F.col(p) for p in pieces])
    ).drop(*pieces)
