"""Tables written to the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from evalweave.storage import delete, fresh_path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts the lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Spark's setting for deleting a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def moved(df: DataFrame, name: str, used_up: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Like ``written``, for large steps: leaves no other copy of what it writes.

    The shuffle files of the step are deleted when it has ended, and so are the written tables
    ``used_up``, which nothing may read afterwards.
    """
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        found = written(df, name)
    finally:
        spark.conf.set(_CLEANUP, before)
    for table in used_up:
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            delete(spark, folder)
    return found
