"""Build and publish a split data set."""

from __future__ import annotations

from pyspark.sql import DataFrame

from evalweave.operators.sampling import split_exact
from evalweave.sources.datasets import publish_dataset


def build_dataset(
    raw: DataFrame, path: str, revision: str, train: int | float, seed: int = 42
) -> None:
    """Split raw question/answer rows exactly and publish them as a revision."""
    publish_dataset(split_exact(raw, train, seed), path, revision)
