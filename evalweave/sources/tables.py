"""Plain table reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, *spread_by: str) -> DataFrame:
    """A Parquet table; with ``spread_by`` a small one is spread over all cores.

    Row-wise text work on a few small files would run in a few tasks. A table with at
    least one split per core is returned as it was read, so large data is never
    shuffled by this.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if not spread_by or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *spread_by)
