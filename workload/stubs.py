"""Deterministic stand-ins for models; their answers can be written in SQL too."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(__import__(__name__, fromlist=["stubs"]))

EMBEDDING_LETTERS = "entaiosr"


def make_generator(model_id: str):
    """Repeats the prompt with full stops for question marks, and signs it."""

    def generate(batch: pd.DataFrame) -> pd.DataFrame:
        texts = "Answer: " + batch["prompt"].str.replace("?", ".", regex=False) + f" [{model_id}]"
        return pd.DataFrame(
            {
                "example_id": batch["example_id"],
                "raw_generation": texts,
                "generated_tokens": texts.str.count(" ") + 1,
            }
        )

    return generate


def make_failing_generator(model_id: str):
    """Like :func:`make_generator`, but one model can not be loaded."""
    if model_id == "org/blank":
        raise RuntimeError("model not found")
    return make_generator(model_id)


def make_scorer(model_id: str):
    """Long words are unlikely: an eighth per character."""

    def score(batch: pd.DataFrame) -> pd.DataFrame:
        logprobs = [
            [-len(word) / 8.0 for word in answer.split(" ") if word]
            for answer in batch["reference_answer"]
        ]
        return pd.DataFrame({"example_id": batch["example_id"], "token_logprobs": logprobs})

    return score


def make_embedder():
    """Unit vectors of letter counts."""

    def encode(texts: list[str]) -> list[list[float]]:
        counts = np.array(
            [[t.count(c) for c in EMBEDDING_LETTERS] + [1] for t in texts], dtype="float64"
        )
        norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        return (counts / norms).astype("float32").tolist()

    return encode
