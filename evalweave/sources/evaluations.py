"""Predictions and leaderboard of evaluations, published together.

A version names the board's folder and, for every model, the folder with its predictions.
Readers resolve both through one version, so they never see new predictions beside an old
board or half of a model's files. Folders are written first, under names that no version
lists yet; a writer that is interrupted changes nothing.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from evalweave import schemas
from evalweave.functions.text import model_slug
from evalweave.operators.leaderboard import concat, keep_last, sort_leaderboard
from evalweave.storage import PROTECTED, attempt_name, children, newest_version, publish_version, vacuum


@dataclass
class Published:
    """What one version of an evaluation folder names; paths are relative to it."""

    version: int = 0
    board: str | None = None
    # Folder with each model's predictions, by the name of the model's folder in it.
    predictions: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def parse(version: int, content: str | None) -> Published:
        return Published(version, **json.loads(content)) if content else Published()

    def text(self) -> str:
        return json.dumps({"board": self.board, "predictions": self.predictions})

    def folders(self) -> set[str]:
        return {*self.predictions.values(), *([self.board] if self.board else [])}


def published(spark: SparkSession, path: str) -> Published:
    """The newest version."""
    return Published.parse(*newest_version(spark, path))


def read_board(
    spark: SparkSession, path: str, schema: T.StructType = schemas.LEADERBOARD, at: Published | None = None
) -> DataFrame:
    """The board of a version, the newest by default; empty before the first."""
    at = at or published(spark, path)
    if at.board is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv(f"{path}/{at.board}", header=True)


def read_predictions(
    spark: SparkSession, path: str, schema: T.StructType = schemas.PREDICTIONS, at: Published | None = None
) -> DataFrame:
    """Predictions of all models of a version, with the column ``model_slug``."""
    at = at or published(spark, path)
    full = T.StructType([*schema.fields, T.StructField("model_slug", T.StringType())])
    if not at.predictions:
        return spark.createDataFrame([], full)
    with_folder = T.StructType([*full.fields, T.StructField("data", T.StringType())])
    # Folders are data=<attempt>/model_slug=<model>, so one read covers all of them.
    paths = [f"{path}/{folder}/{model}" for model, folder in sorted(at.predictions.items())]
    return spark.read.schema(with_folder).option("basePath", path).parquet(*paths).drop("data")


def publish_evaluation(
    predictions: DataFrame,
    summary: DataFrame,
    path: str,
    schema: T.StructType = schemas.LEADERBOARD,
) -> int:
    """Replace the models' predictions and board rows in one step; returns the version.

    ``predictions`` and ``summary`` cover the same models; other models keep theirs. The
    predictions are written once. If another writer publishes first, the board is merged
    anew with that writer's, whose predictions stay as well. A model may have no predictions
    at all: then it has none in the new version.
    """
    spark = predictions.sparkSession
    base = published(spark, path).version
    rows = f"data={attempt_name(base)}"
    (
        predictions.withColumn("model_slug", model_slug(F.col("model_id")))
        .hint("rebalance", "model_slug")
        .write.partitionBy("model_slug")
        .parquet(f"{path}/{rows}")
    )
    written = children(spark, f"{path}/{rows}", "model_slug=")
    # One row per model of the board.
    slugs = summary.select(model_slug(F.col("model_id"))).distinct().collect()
    replaced = {f"model_slug={r[0]}" for r in slugs} | set(written)
    while True:
        before = published(spark, path)
        if before.version - base >= PROTECTED:
            raise RuntimeError(f"{path} changed {PROTECTED} times during an attempt to publish")
        old = read_board(spark, path, schema, before).withColumn("version", F.lit(0))
        merged = keep_last(concat(old, summary.withColumn("version", F.lit(1)))).drop("version")
        board = f"data={attempt_name(before.version)}-board"
        sort_leaderboard(merged.select(*schema.names)).write.csv(f"{path}/{board}", header=True)
        kept = {model: folder for model, folder in before.predictions.items() if model not in replaced}
        after = Published(before.version + 1, board, kept | dict.fromkeys(written, rows))
        if publish_version(spark, path, after.version, after.text()):
            return after.version


def vacuum_evaluations(spark: SparkSession, path: str, keep: int = 10) -> list[str]:
    """Delete the folders that the newest ``keep`` versions do not name; returns them."""
    return vacuum(spark, path, keep, "data=", lambda content: Published.parse(0, content).folders())
