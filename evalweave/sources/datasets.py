"""Question/answer data sets, stored as Parquet partitioned by split and by revision."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, types as T

from evalweave import schemas
from evalweave.operators.reshape import to_chat
from evalweave.operators.sampling import split_caps
from evalweave.storage import PROTECTED, attempt_name, newest_version, publish_version, vacuum, versions


def _folder(content: str, revision: str | None = None) -> str | None:
    """The folder that a version names, if it is of the wanted revision."""
    published = json.loads(content)
    return published["folder"] if revision in (None, published["revision"]) else None


def load_dataset(
    spark: SparkSession,
    path: str,
    revision: str | None = None,
    schema: T.StructType = schemas.FLASHCARDS,
) -> DataFrame:
    """One revision of a data set; without a revision the one published last."""
    newest = None if revision else 1
    folders = [_folder(c, revision or None) for _, c in versions(spark, path, newest)]
    found = next(filter(None, folders), None)
    if found is None:
        raise FileNotFoundError(f"no revision {revision or ''} under {path}")
    return spark.read.schema(schema).parquet(f"{path}/{found}")


def publish_dataset(
    df: DataFrame, path: str, revision: str, max_records_per_file: int = 0
) -> None:
    """Write a data set revision partitioned by split; a revision is never overwritten.

    It is written under a name of its own and then published as the next version, which names
    revision and folder: an attempt that fails halfway leaves nothing that is read, and
    copying the files does not change which revision is the newest.
    """
    spark = df.sparkSession
    while True:
        base = newest_version(spark, path)[0]
        folder = f"data-{attempt_name(base)}"
        _refuse(spark, path, revision)
        writer = df.write.partitionBy("split").option("maxRecordsPerFile", max_records_per_file)
        writer.parquet(f"{path}/{folder}")
        version, content = base, json.dumps({"revision": revision, "folder": folder})
        while version - base < PROTECTED:
            if publish_version(spark, path, version + 1, content):
                return
            version = newest_version(spark, path)[0]  # another writer was first
            _refuse(spark, path, revision)


def _refuse(spark: SparkSession, path: str, revision: str) -> None:
    if any(_folder(content, revision) for _, content in versions(spark, path)):
        raise FileExistsError(f"revision {revision} already exists under {path}")


def vacuum_dataset(spark: SparkSession, path: str, keep: int = 10) -> list[str]:
    """Delete the folders that the newest ``keep`` revisions do not name; returns them."""
    return vacuum(spark, path, keep, "data-", lambda content: {_folder(content)})


def load_prepared(
    spark: SparkSession,
    path: str,
    system_prompt: str,
    revision: str | None = None,
    seed: int = 42,
    caps: Mapping[str, int | None] | None = None,
    schema: T.StructType = schemas.FLASHCARDS,
) -> DataFrame:
    """Load, cap every split and reshape to chat examples. Rows are sampled first, so
    only the kept ones are reshaped."""
    raw = load_dataset(spark, path, revision, schema)
    return to_chat(split_caps(raw, caps or {}, seed), system_prompt)
