"""Per-model prediction tables, replaced one model at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from evalweave.functions.text import model_slug

# Answers contain line breaks, quotes and empty strings; these options keep them. A
# missing value is written as \\N, since an empty answer is a value of its own.
CSV = {
    "header": True,
    "multiLine": True,
    "quote": '"',
    "escape": '"',
    "nullValue": "\\N",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_predictions(predictions: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Write the models in ``predictions``; other models under ``path`` stay as they are.

    Rows are gathered per model before writing, or every task would write a small file
    for every model. Rebalancing splits a model with many rows over several tasks.
    """
    writer = (
        predictions.withColumn("model_slug", model_slug(F.col("model_id")))
        .hint("rebalance", "model_slug")
        .write.partitionBy("model_slug")
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
    )
    if file_format == "csv":
        writer = writer.options(**CSV)
    writer.format(file_format).save(path)


def read_predictions(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    file_format: str = "parquet",
) -> DataFrame:
    """Predictions of all models, with the partition column ``model_slug``."""
    with_slug = T.StructType([*schema.fields, T.StructField("model_slug", T.StringType())])
    reader = spark.read.schema(with_slug).format(file_format)
    if file_format == "csv":
        reader = reader.options(**CSV)
    return reader.load(path)
