"""Where models are called: generation, reference scoring and embedding.

A hook receives a factory. The factory runs inside the task, once per model and task,
and returns a callable on pandas batches that carries the row key through, so results
are matched by key and never by position. Everything before and after the call stays
in Spark expressions.

Model calls are costly and their output feeds several later steps, so callers should
pass the output through :func:`evalweave.storage.materialize`.

With a ``journal`` folder every answered batch is also written there by the task that called
the model, before anything else happens to it. A restarted job takes the answers of the same
``(model_id, example_id)`` and inputs from the journal and calls the model for the rest; a
retried task finds the batches of its earlier attempt and repeats at most the one that was
under way. The folder must be reachable by all executors through ``pyarrow.fs``: a path or URI
of a shared disk, or of a store that it knows. Failed batches are not kept.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evalweave.functions.arrays import both_answered, cosine
from evalweave.operators.joins import group_join, lookup_groups
from evalweave.storage import exists, qualified

# The functions below run on executors that need not have this package installed.
cloudpickle.register_pickle_by_value(__import__(__name__, fromlist=["hooks"]))

# pandas batch in (key and text columns), pandas batch out (key and result columns).
BatchFn = Callable[[pd.DataFrame], pd.DataFrame]

# Examples that one task passes through its models; bounds what it sorts and repeats.
ROWS_PER_TASK = 10_000

KEY = ["model_id", "example_id"]
_KEY_FIELDS = [T.StructField("model_id", T.StringType()), T.StructField("example_id", T.LongType())]
_CALL_FIELDS = [
    T.StructField("batch_id", T.StringType()),
    T.StructField("batch_rows", T.IntegerType()),
    T.StructField("batch_seconds", T.DoubleType()),
    T.StructField("error", T.StringType()),
]


def _lay_out(requests: DataFrame, text: str, partitions: int | None) -> DataFrame:
    """Even partitions that each hold few models, similar lengths next to each other.

    Range partitioning on (model, hash of the example) cuts a model with a third of all
    examples into as many partitions as it needs. Their number follows the counted rows:
    ``ROWS_PER_TASK`` each, and one per core at least. ``requests`` is read three times and
    should be a written table.
    """
    spread = F.md5(F.col("example_id").cast("string"))
    cores = requests.sparkSession.sparkContext.defaultParallelism
    n = partitions or max(cores, -(-requests.count() // ROWS_PER_TASK))
    return requests.repartitionByRange(n, "model_id", spread).sortWithinPartitions(
        "model_id", F.length(text), "example_id"
    )


class _Journal:
    """Answered batches as files, named by what was asked.

    A file appears under its name when it is complete. Two attempts of a task that run at the
    same time write the same answers or, if the model is not deterministic, either's.
    """

    def __init__(self, folder: str, schema: pa.Schema) -> None:
        self.schema = schema
        if "://" in folder:
            self.fs, self.folder = pyarrow.fs.FileSystem.from_uri(folder)
        else:
            self.fs, self.folder = pyarrow.fs.LocalFileSystem(), folder
        self.fs.create_dir(self.folder, recursive=True)

    def _file(self, batch: pd.DataFrame) -> str:
        asked = hashlib.sha256()
        for row in batch.itertuples(index=False):
            asked.update(repr(tuple(row)).encode())
        return f"{self.folder}/batch-{asked.hexdigest()}.parquet"

    def find(self, batch: pd.DataFrame) -> pd.DataFrame | None:
        file = self._file(batch)
        if self.fs.get_file_info(file).type == pyarrow.fs.FileType.NotFound:
            return None
        return pyarrow.parquet.read_table(file, filesystem=self.fs).to_pandas()

    def keep(self, batch: pd.DataFrame, result: pd.DataFrame) -> None:
        table = pa.Table.from_pandas(result, self.schema, preserve_index=False)
        # Names that begin with "_" are not read as data.
        draft = f"{self.folder}/_{uuid.uuid4().hex}"
        pyarrow.parquet.write_table(table, draft, filesystem=self.fs)
        self.fs.move(draft, self._file(batch))


def _call_per_model(
    make: Callable[[str], BatchFn],
    inputs: list[str],
    outputs: list[str],
    batch_size: int,
    on_error: str,
    journal: Callable[[], _Journal] | None = None,
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    columns = [*KEY, *outputs, "batch_id", "batch_rows", "batch_seconds", "error"]
    asked = [*KEY, *inputs]

    def call(function: BatchFn, batch: pd.DataFrame) -> pd.DataFrame:
        result = function(batch[["example_id", *inputs]])
        returned = pd.Index(result["example_id"])
        at = returned.get_indexer(batch["example_id"]) if returned.is_unique else None
        if at is None or len(result) != len(batch) or (at < 0).any():
            raise ValueError("the model did not return every example exactly once")
        matched = result.iloc[at]
        return batch[KEY].assign(**{name: matched[name].tolist() for name in outputs})

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        prefix = f"{task.partitionId() if task else 0}"
        kept = journal() if journal else None
        if kept:
            # Batches of several jobs meet in a journal.
            prefix = f"{uuid.uuid4().hex}-{prefix}"
        current, function, broken, serial = None, None, None, 0
        for chunk in chunks:
            for model_id, rows in chunk.groupby("model_id", sort=False, dropna=False):
                if model_id != current:
                    current, function, broken = model_id, None, None
                for at in range(0, len(rows), batch_size):
                    batch = rows.iloc[at : at + batch_size]
                    if kept and (known := kept.find(batch[asked])) is not None:
                        yield known[columns]
                        continue
                    started = time.perf_counter()
                    try:
                        if broken is not None:
                            raise broken
                        if function is None:
                            function = make(model_id)
                            started = time.perf_counter()
                        result = call(function, batch)
                        error = None
                    except Exception as problem:
                        if on_error == "fail":
                            raise
                        if function is None:
                            broken = problem
                        result = batch[KEY].assign(**{name: None for name in outputs})
                        error = repr(problem)
                    result = result.assign(
                        batch_id=f"{prefix}-{serial}",
                        batch_rows=len(batch),
                        batch_seconds=time.perf_counter() - started,
                        error=error,
                    )
                    if kept and error is None:
                        kept.keep(batch[asked], result.assign(**{i: batch[i].tolist() for i in inputs}))
                    yield result[columns]
                    serial += 1

    return run


def _answered(requests: DataFrame, journal: str, schema: T.StructType, inputs: list[str]) -> DataFrame:
    """What the journal holds for the same keys and inputs, once per key."""
    spark = requests.sparkSession
    texts = [T.StructField(i, T.StringType()) for i in inputs]
    kept = spark.read.schema(T.StructType([*schema.fields, *texts])).parquet(journal)
    asked = group_join(kept, requests.select(*KEY, *inputs), [*KEY, *inputs], "left_semi")
    rest = [c for c in schema.names if c not in KEY]
    one = F.min(F.struct("batch_id", *[c for c in rest if c != "batch_id"])).alias("row")
    return asked.groupBy(*KEY).agg(one).select(*KEY, "row.*").select(*schema.names)


def _map_models(
    requests: DataFrame,
    make: Callable[[str], BatchFn],
    inputs: list[str],
    outputs: dict[str, T.DataType],
    batch_size: int,
    on_error: str,
    partitions: int | None,
    journal: str | None,
) -> DataFrame:
    if on_error not in ("skip", "fail"):
        raise ValueError("on_error is 'skip' or 'fail'")
    schema = T.StructType(
        _KEY_FIELDS + [T.StructField(n, t) for n, t in outputs.items()] + _CALL_FIELDS
    )
    asked = requests.select(*KEY, *inputs)
    if journal is None:
        run = _call_per_model(make, inputs, list(outputs), batch_size, on_error)
        return _lay_out(asked, inputs[0], partitions).mapInPandas(run, schema)
    known = None
    if exists(asked.sparkSession, journal):
        known = _answered(asked, journal, schema, inputs)
        asked = group_join(asked, known.select(*KEY), KEY, "left_anti")
    texts = [T.StructField(i, T.StringType()) for i in inputs]
    layout = to_arrow_schema(T.StructType([*schema.fields, *texts]))
    folder = qualified(requests.sparkSession, journal)
    run = _call_per_model(
        make, inputs, list(outputs), batch_size, on_error, lambda: _Journal(folder, layout)
    )
    new = _lay_out(asked, inputs[0], partitions).mapInPandas(run, schema)
    return new if known is None else known.unionByName(new)


def generate(
    requests: DataFrame,
    make_generator: Callable[[str], BatchFn],
    *,
    batch_size: int = 32,
    on_error: str = "skip",
    partitions: int | None = None,
    journal: str | None = None,
) -> DataFrame:
    """Answers for ``(model_id, example_id, prompt)``.

    The generator maps ``(example_id, prompt)`` to ``(example_id, raw_generation,
    generated_tokens)``. Returns the key, both outputs and, for accounting, the batch,
    its size, its seconds and the error, if any. ``on_error='fail'`` lets the first
    exception end the job instead. With a ``journal`` folder, answers that it holds are not
    generated again; they keep the batch in which they were.
    """
    outputs = {"raw_generation": T.StringType(), "generated_tokens": T.IntegerType()}
    return _map_models(
        requests, make_generator, ["prompt"], outputs, batch_size, on_error, partitions, journal
    )


def score_references(
    requests: DataFrame,
    make_scorer: Callable[[str], BatchFn],
    *,
    batch_size: int = 32,
    on_error: str = "skip",
    partitions: int | None = None,
    journal: str | None = None,
) -> DataFrame:
    """Token log-probabilities of ``reference_answer`` after ``prompt``.

    The scorer maps ``(example_id, prompt, reference_answer)`` to ``(example_id,
    token_logprobs)``; sums, means and perplexities are computed by Spark afterwards. A
    ``journal`` of scores is a folder of its own, not that of the generator.
    """
    outputs = {"token_logprobs": T.ArrayType(T.DoubleType())}
    return _map_models(
        requests,
        make_scorer,
        ["prompt", "reference_answer"],
        outputs,
        batch_size,
        on_error,
        partitions,
        journal,
    )


def attach_generations(requests: DataFrame, generations: DataFrame) -> DataFrame:
    """Requests with their generations, matched by ``(model_id, example_id)``."""
    found = generations.select(*KEY, "raw_generation", "generated_tokens")
    return requests.join(found, KEY)


def batch_stats(generations: DataFrame) -> DataFrame:
    """Seconds, token sum and per-example token counts of each model batch."""
    return generations.groupBy("model_id", "batch_id").agg(
        F.max("batch_seconds").alias("inference_seconds"),
        F.sum("generated_tokens").alias("generated_tokens"),
        # A batch never exceeds the batch size, which bounds this list.
        F.collect_list("generated_tokens").alias("generated_tokens_per_example"),
    )


def scoring_stats(scored: DataFrame) -> DataFrame:
    """``model_id, reference_seconds, examples`` of the reference scorer's batches."""
    return scored.groupBy("model_id", "batch_id").agg(
        F.max("batch_seconds").alias("reference_seconds"), F.count("*").alias("examples")
    )


def model_errors(output: DataFrame) -> DataFrame:
    """One row per failed model: the number of failed examples and the first error."""
    return (
        output.filter(F.col("error").isNotNull())
        .groupBy("model_id")
        .agg(
            F.count("*").alias("failed_examples"),
            F.min(F.struct("example_id", "error"))["error"].alias("error"),
        )
    )


def merge_errors(errors: DataFrame, more: DataFrame) -> DataFrame:
    """One row per failed model from the errors of two steps; the first step's text stays."""
    both = errors.withColumn("step", F.lit(0)).unionByName(more.withColumn("step", F.lit(1)))
    return both.groupBy("model_id").agg(
        F.sum("failed_examples").alias("failed_examples"),
        F.min(F.struct("step", "error"))["error"].alias("error"),
    )


def embedding_errors(predictions: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row per model with an answer or reference that failed to embed."""
    failed = vectors.filter(F.col("error").isNotNull()).select("text_key", "error")
    texts = predictions.select(
        *KEY, F.explode(F.array("generated_answer", "reference_answer")).alias("text")
    )
    return model_errors(
        texts.withColumn("text_key", _text_key("text"))
        .join(failed, "text_key")
        .groupBy(*KEY)
        .agg(F.min("error").alias("error"))
    )


def without_failed_models(rows: DataFrame, errors: DataFrame) -> DataFrame:
    """Rows of the models that had no error at all."""
    failed = errors.select("model_id").distinct()
    return lookup_groups(rows, failed, ["model_id"], ["example_id"], "left_anti")


def _text_key(column: str):
    return F.sha2(F.col(column), 256)


def distinct_texts(predictions: DataFrame) -> DataFrame:
    """Every text of a valid pair once, as ``(text_key, text)``.

    References repeat for every model, so encoding distinct texts saves most calls.
    """
    valid = predictions.filter(both_answered(F.col("generated_answer"), F.col("reference_answer")))
    texts = valid.select(F.explode(F.array("generated_answer", "reference_answer")).alias("text"))
    return texts.select(_text_key("text").alias("text_key"), "text").dropDuplicates(["text_key"])


def embed(
    texts: DataFrame,
    make_embedder: Callable[[], Callable[[list[str]], list[list[float]]]],
    *,
    batch_size: int = 256,
    partitions: int | None = None,
    on_error: str = "fail",
) -> DataFrame:
    """``(text_key, embedding, error)`` of ``(text_key, text)``.

    The embedder is made once per task. With ``on_error='skip'`` the texts of a failing batch
    are tried one by one, and those that fail alone get no embedding but their error.
    """

    def encoded(encode: Callable, batch: pd.DataFrame) -> pd.DataFrame:
        vectors = [list(v) for v in encode(batch["text"].tolist())]
        return pd.DataFrame(
            {"text_key": batch["text_key"].tolist(), "embedding": vectors, "error": None}
        )

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = None
        for chunk in chunks:
            for at in range(0, len(chunk), batch_size):
                batch = chunk.iloc[at : at + batch_size]
                try:
                    encode = encode or make_embedder()
                    yield encoded(encode, batch)
                    continue
                except Exception:
                    if on_error == "fail":
                        raise
                for i in range(len(batch)):
                    one = batch.iloc[i : i + 1]
                    try:
                        encode = encode or make_embedder()
                        yield encoded(encode, one)
                    except Exception as error:
                        text = f"{type(error).__name__}: {error}"
                        yield pd.DataFrame(
                            {"text_key": one["text_key"].tolist(), "embedding": None, "error": text}
                        )

    # Distinct texts come out of a shuffle evenly spread; more tasks are for slow models.
    spread = texts.repartition(partitions, "text_key") if partitions else texts
    return spread.mapInPandas(run, "text_key string, embedding array<float>, error string")


def attach_similarity(predictions: DataFrame, vectors: DataFrame) -> DataFrame:
    """Add ``answer_similarity`` from ``(text_key, embedding)``; missing for invalid pairs.

    One common answer may stand in a third of all rows, and invalid pairs have no text to
    look up; both joins are followed by another shuffle, so adaptive execution splits such
    keys. Pairs with a text that failed to embed get no similarity.
    """
    valid = both_answered(F.col("generated_answer"), F.col("reference_answer"))
    pairs = predictions.select(
        *KEY,
        F.when(valid, _text_key("generated_answer")).alias("gen_key"),
        F.when(valid, _text_key("reference_answer")).alias("ref_key"),
    )
    gen = vectors.select(F.col("text_key").alias("gen_key"), F.col("embedding").alias("gen_vec"))
    ref = vectors.select(F.col("text_key").alias("ref_key"), F.col("embedding").alias("ref_vec"))
    similarity = pairs.join(gen, "gen_key", "left").join(ref, "ref_key", "left").select(
        *KEY, cosine(F.col("gen_vec"), F.col("ref_vec")).alias("answer_similarity")
    )
    return predictions.join(similarity, KEY)
