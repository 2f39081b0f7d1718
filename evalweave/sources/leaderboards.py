"""Versioned leaderboards and the append-only run history.

Spark can not overwrite a table it is reading, and a reader must never see half a
board. Every board is therefore written to a folder of its own and then published as
the next version by creating a small file that names the folder. Creating fails if
the version exists, so of two writers that read the same board one has to start anew.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from evalweave import schemas
from evalweave.operators.leaderboard import concat, keep_last, sort_leaderboard
from evalweave.storage import PROTECTED, attempt_name, children, exists, newest_version, publish_version, vacuum

_ATTEMPTS = 50


def read_leaderboard(
    spark: SparkSession, path: str, schema: T.StructType = schemas.LEADERBOARD
) -> DataFrame:
    """The newest published board, or an empty one where none exists yet."""
    return _read(spark, path, schema, newest_version(spark, path)[1])


def _read(spark: SparkSession, path: str, schema: T.StructType, name: str | None) -> DataFrame:
    if name is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv(f"{path}/{name}", header=True)


def _write(board: DataFrame, path: str, version: int = 0) -> str:
    name = f"data-{attempt_name(version)}"
    sort_leaderboard(board).write.csv(f"{path}/{name}", header=True)
    return name


def write_leaderboard(board: DataFrame, path: str) -> str:
    """Publish a sorted board as the next version; returns its folder."""
    spark = board.sparkSession
    while True:
        version = base = newest_version(spark, path)[0]
        name = _write(board, path, base)
        # A folder begun so many versions ago may have been deleted.
        while version - base < PROTECTED:
            if publish_version(spark, path, version + 1, name):
                return f"{path}/{name}"
            version = newest_version(spark, path)[0]  # another writer was first


def update_leaderboard(
    new: DataFrame, path: str, schema: T.StructType = schemas.LEADERBOARD
) -> str:
    """Merge new rows into the stored board: new rows win, others are kept.

    The merged board is published only as the direct successor of the board it was
    merged with. If another writer was first, the merge is done again on its board.
    """
    spark = new.sparkSession
    for _ in range(_ATTEMPTS):
        version, parent = newest_version(spark, path)
        old = _read(spark, path, schema, parent).withColumn("version", F.lit(0))
        merged = keep_last(concat(old, new.withColumn("version", F.lit(1)))).drop("version")
        name = _write(merged.select(*[f.name for f in schema.fields]), path, version)
        if publish_version(spark, path, version + 1, name):
            return f"{path}/{name}"
    raise RuntimeError(f"{path} changed during each of {_ATTEMPTS} attempts to update it")


def vacuum_leaderboard(spark: SparkSession, path: str, keep: int = 10) -> list[str]:
    """Delete the folders that the newest ``keep`` boards do not name; returns them."""
    return vacuum(spark, path, keep, "data-", lambda content: {content})


# Wider types that hold every value of a narrower one.
_WIDER = {
    T.ByteType: (T.ShortType, T.IntegerType, T.LongType, T.DoubleType),
    T.ShortType: (T.IntegerType, T.LongType, T.DoubleType),
    T.IntegerType: (T.LongType, T.DoubleType),
    T.FloatType: (T.DoubleType,),
}


def _widened(name: str, old: T.DataType, new: T.DataType) -> T.DataType:
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        return _merged_schema(old, new, f"{name}.")
    if old == new or isinstance(new, T.NullType) or type(old) in _WIDER.get(type(new), ()):
        return old
    if type(new) in _WIDER.get(type(old), ()):
        return new
    raise ValueError(f"column {name} holds {old.simpleString()}, not {new.simpleString()}")


def _merged_schema(old: T.StructType, new: T.StructType, prefix: str = "") -> T.StructType:
    """The union of both schemas' columns; names match without regard to case."""
    fields = {f.name.lower(): T.StructField(f.name, f.dataType) for f in old.fields}
    for f in new.fields:
        known = fields.get(f.name.lower())
        if known is None:
            kind = T.StringType() if isinstance(f.dataType, T.NullType) else f.dataType
            fields[f.name.lower()] = T.StructField(f.name, kind)
        else:
            kind = _widened(prefix + known.name, known.dataType, f.dataType)
            fields[f.name.lower()] = T.StructField(known.name, kind)
    return T.StructType(list(fields.values()))


def _history_schema(spark: SparkSession, path: str) -> tuple[int, T.StructType | None]:
    """Version and columns of a history; files without a schema log are opened once."""
    version, content = newest_version(spark, f"{path}/_schema")
    if content is not None:
        return version, T.StructType.fromJson(json.loads(content))
    if not exists(spark, path) or not children(spark, path, "part-"):
        return version, None
    return version, spark.read.option("mergeSchema", True).parquet(path).schema


def append_history(runs: DataFrame, path: str) -> None:
    """Append run records; their columns may differ from those of earlier runs.

    The columns of all records are kept in a log of versions, which is widened before the
    records are written: a column may be new, or of a type that holds the old one's values or
    fits into it. Any other type raises ``ValueError`` and nothing is written.
    """
    spark = runs.sparkSession
    for _ in range(_ATTEMPTS):
        version, old = _history_schema(spark, path)
        schema = _merged_schema(old or T.StructType(), runs.schema)
        if version and schema == old or publish_version(spark, f"{path}/_schema", version + 1, schema.json()):
            break
    else:
        raise RuntimeError(f"{path} changed during each of {_ATTEMPTS} attempts to append")
    kinds = {f.name.lower(): f for f in schema.fields}
    columns = [F.col(f"`{c}`").cast(kinds[c.lower()].dataType).alias(kinds[c.lower()].name) for c in runs.columns]
    runs.select(*columns).write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame | None:
    """All run records under the union of their columns, or None before the first.

    The columns come from the log, so no file is opened to find them.
    """
    schema = _history_schema(spark, path)[1]
    return None if schema is None else spark.read.schema(schema).parquet(path)
