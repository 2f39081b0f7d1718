"""Keep a leaderboard current while prediction files arrive.

Every micro-batch becomes a run: its scored rows, a small state per model (counts, means and
squared deviations) and cells of neighbouring perplexities with their exact counts. A model's
summary is merged from the states of its runs; its exact median rereads only the cells that
may hold the middle. So a late batch of one model reads that model's states and a few cells,
not its rows.

An example that arrives again replaces itself: the batch adds the row it replaces with the
weight -1, and counts, means, deviations and medians are sums over weighted rows. Only runs
whose range of example ids overlaps the batch's are searched for such rows.

Rows are laid out by a hash of the model. A bucket's runs of one size class are merged as soon
as there are ``FANOUT`` of them, so a row is rewritten a logarithmic number of times. A
manifest, published version by version, lists the runs of every bucket and the last batch in
them; a batch counts once it is listed, and a replayed one is not written again. Files that no
version of the last ``GRACE`` lists are deleted.

An evaluation may arrive in any number of files and batches: rows carry ``evaluation``, a
number that grows when a model is evaluated anew, and only the rows of a model's newest
evaluation count.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from evalweave.functions.arrays import not_nan
from evalweave.operators.joins import group_join, lookup_groups
from evalweave.operators.scoring import score_answers
from evalweave.operators.summary import PERPLEXITY
from evalweave.sources.leaderboards import update_leaderboard
from evalweave.storage import children, delete, materialize, newest_version, publish_version

KEY = ["model_id", "evaluation", "example_id"]
GROUP = KEY[:2]
# Summarized columns, and what their summary's columns are called.
SUMMARIZED = {
    "token_f1": "token_f1",
    "answer_similarity": "answer_similarity",
    "reference_answer_nll_mean": "reference_answer_nll",
    PERPLEXITY: PERPLEXITY,
    "reference_answer_tokens": "reference_answer_tokens",
}
# Folders of a run, each with the models of one hash value.
BUCKETS = 32
# Runs of one size class that are merged into one of the next.
FANOUT = 4
# Neighbouring rows that share a cell.
CELL_ROWS = 10_000
# Versions of the manifest that readers may still be using.
GRACE = 8
_ATTEMPTS = 50
_PARTS = ("rows", "states", "cells")
_MOMENTS = "struct<n: double, mean: double, m2: double>"


@dataclass(frozen=True, order=True)
class Run:
    """One bucket's part of a batch or of a merge."""

    bucket: int
    name: str
    rows: int


@dataclass
class Manifest:
    """The runs of a store as of one version."""

    version: int = 0
    last_batch: int = -1
    runs: list[Run] = field(default_factory=list)
    # Runs that are not listed any more, with the version that dropped them.
    retired: list[tuple[int, Run]] = field(default_factory=list)

    def text(self) -> str:
        plain = lambda r: [r.bucket, r.name, r.rows]
        return json.dumps(
            {
                "last_batch": self.last_batch,
                "runs": [plain(r) for r in self.runs],
                "retired": [[version, *plain(r)] for version, r in self.retired],
            }
        )


def read_manifest(spark: SparkSession, store: str) -> Manifest:
    """The newest manifest; an empty one before the first batch."""
    version, content = newest_version(spark, f"{store}/manifest")
    if content is None:
        return Manifest()
    stored = json.loads(content)
    return Manifest(
        version,
        stored["last_batch"],
        [Run(*r) for r in stored["runs"]],
        [(version, Run(*r)) for version, *r in stored["retired"]],
    )


def _publish(spark: SparkSession, store: str, manifest: Manifest) -> bool:
    return publish_version(spark, f"{store}/manifest", manifest.version, manifest.text())


def _bucket(model_id: Column) -> Column:
    return F.pmod(F.xxhash64(model_id), F.lit(BUCKETS)).cast("int")


def _read(spark: SparkSession, store: str, part: str, runs: Sequence[Run], schema: T.StructType) -> DataFrame:
    """One part of the given runs, with the columns ``run`` and ``bucket``."""
    full = T.StructType([*schema.fields, T.StructField("run", T.StringType()), T.StructField("bucket", T.IntegerType())])
    if not runs:
        return spark.createDataFrame([], full)
    paths = [f"{store}/{part}/run={r.name}/bucket={r.bucket}" for r in runs]
    return spark.read.schema(full).option("basePath", f"{store}/{part}").parquet(*paths)


# Layouts of the three parts ---------------------------------------------------------------


def rows_schema(scored: T.StructType) -> T.StructType:
    """Scored rows, the batch that brought them, their weight and their cell."""
    schema = T.StructType(list(scored.fields)).add("batch_id", T.LongType())
    return schema.add("weight", T.IntegerType()).add("cell", T.LongType())


def _metrics(columns: Sequence[str]) -> list[str]:
    return [c for c in SUMMARIZED if c in columns]


def _group_fields(rows: T.StructType) -> list[T.StructField]:
    return [*(rows[c] for c in GROUP), T.StructField("weight", T.IntegerType())]


def _states_schema(rows: T.StructType) -> T.StructType:
    ids = rows["example_id"].dataType
    schema = T.StructType(_group_fields(rows)).add("n", T.LongType()).add("first_id", ids).add("last_id", ids)
    for metric in _metrics(rows.names):
        schema = schema.add(metric, T.DataType.fromDDL(_MOMENTS))
    return schema


def _cells_schema(rows: T.StructType) -> T.StructType:
    schema = T.StructType(_group_fields(rows)).add("cell", T.LongType())
    return schema.add("lowest", T.DoubleType()).add("highest", T.DoubleType()).add("rows", T.LongType())


def _median_value() -> Column:
    return not_nan(F.col(PERPLEXITY).cast("double"))


# Writing ------------------------------------------------------------------------------------


def _write_rows(rows: DataFrame, store: str, name: str) -> None:
    """Rows of a model next to each other, by perplexity where they have one."""
    order = ["bucket", *GROUP, "weight"]
    value = _median_value() if PERPLEXITY in rows.columns else F.col("example_id")
    (
        rows.withColumn("bucket", _bucket(F.col("model_id")))
        .hint("rebalance", "bucket")
        .sortWithinPartitions(*order, value)
        .withColumn("cell", F.floor(F.monotonically_increasing_id() / CELL_ROWS))
        .write.partitionBy("bucket")
        .mode("append")
        .parquet(f"{store}/rows/run={name}")
    )


def _write_summaries(spark: SparkSession, store: str, name: str, schema: T.StructType) -> list[Run]:
    """States and cells of a run whose rows are written; returns its parts."""
    buckets = [int(b.removeprefix("bucket=")) for b in children(spark, f"{store}/rows/run={name}", "bucket=")]
    rows = _read(spark, store, "rows", [Run(b, name, 0) for b in buckets], schema)
    weight = F.col("weight")

    def moments(metric: str) -> Column:
        value = not_nan(F.col(metric).cast("double"))
        n = F.count(value)
        mean, m2 = F.coalesce(F.avg(value), F.lit(0.0)), F.coalesce(F.var_pop(value) * n, F.lit(0.0))
        return F.struct(
            (n * weight).cast("double").alias("n"), mean.alias("mean"), (m2 * weight).alias("m2")
        ).alias(metric)

    states = rows.groupBy("bucket", *GROUP, "weight").agg(
        (F.count("*") * weight).alias("n"),
        F.min("example_id").alias("first_id"),
        F.max("example_id").alias("last_id"),
        *(moments(m) for m in _metrics(schema.names)),
    )
    states.write.partitionBy("bucket").parquet(f"{store}/states/run={name}")
    if PERPLEXITY in schema.names:
        # A cell without a value counts no row, but gives its bucket a folder.
        cells = (
            rows.withColumn("value", _median_value())
            .groupBy("bucket", *GROUP, "weight", "cell")
            .agg(
                F.min("value").alias("lowest"),
                F.max("value").alias("highest"),
                (F.count("value") * weight).alias("rows"),
            )
        )
        cells.write.partitionBy("bucket").parquet(f"{store}/cells/run={name}")
    parts = [Run(b, name, 0) for b in buckets]
    sizes = _read(spark, store, "states", parts, _states_schema(schema)).groupBy("bucket")
    # A row for each of the run's buckets.
    return sorted(Run(r["bucket"], name, r["n"]) for r in sizes.agg(F.sum(F.abs("n")).alias("n")).collect())


def _drop(spark: SparkSession, store: str, name: str) -> None:
    for part in _PARTS:
        delete(spark, f"{store}/{part}/run={name}")


def _once(scored: DataFrame) -> DataFrame:
    """One row per example of a batch: the greatest of equal keys."""
    rest = [c for c in scored.columns if c not in KEY]
    last = F.max(F.struct(*rest)).alias("row")
    return scored.groupBy(*KEY).agg(last).select(*KEY, "row.*").select(*scored.columns)


def _live(rows: DataFrame) -> DataFrame:
    """Rows whose weights do not cancel out, with the weight that is left."""
    rest = [c for c in rows.columns if c not in (*KEY, "batch_id", "weight", "cell", "run", "bucket")]
    return (
        rows.groupBy(*KEY, "batch_id")
        .agg(F.sum("weight").cast("int").alias("weight"), F.max(F.struct("weight", *rest)).alias("row"))
        .filter(F.col("weight") != 0)
        .select(*KEY, "batch_id", "weight", *(F.col("row")[c].alias(c) for c in rest))
    )


def _replaced(new: DataFrame, store: str, runs: Sequence[Run], schema: T.StructType) -> DataFrame | None:
    """Stored rows whose examples are in ``new``, or None if no run can hold one.

    Runs are compared by the range of a model's example ids, and only those that overlap are
    searched. Texts are not read.
    """
    spark = new.sparkSession
    ranges = new.groupBy(*GROUP).agg(F.min("example_id").alias("from_id"), F.max("example_id").alias("to_id"))
    states = _read(spark, store, "states", runs, _states_schema(schema))
    overlapping = group_join(states, ranges, GROUP, "inner").filter(
        (F.col("first_id") <= F.col("to_id")) & (F.col("last_id") >= F.col("from_id"))
    )
    # Runs of the manifest, and one range that covers what the batch may replace in them.
    found = overlapping.groupBy("run", "bucket").agg(F.min("from_id").alias("a"), F.max("to_id").alias("b")).collect()
    if not found:
        return None
    hit = {(r["run"], r["bucket"]) for r in found}
    columns = [*KEY, "batch_id", "weight", *_metrics(schema.names)]
    first, last = min(r["a"] for r in found), max(r["b"] for r in found)
    rows = _read(spark, store, "rows", [r for r in runs if (r.name, r.bucket) in hit], schema)
    rows = rows.filter(F.col("example_id").between(first, last)).select(*columns)
    same = group_join(rows, new.select(*KEY), KEY, "left_semi")
    return _live(same).filter(F.col("weight") == 1)


def store_batch(batch: DataFrame, batch_id: int, store: str) -> T.StructType:
    """Score a batch, write it as a run and list it; returns the layout of the rows.

    A batch that is listed already is not written again. Should another writer publish
    meanwhile, the run is written anew on top of that version.
    """
    spark = batch.sparkSession
    scored = score_answers(batch)
    schema = rows_schema(scored.schema)
    for _ in range(_ATTEMPTS):
        manifest = read_manifest(spark, store)
        if batch_id <= manifest.last_batch:
            return schema
        name = f"{manifest.version}-{uuid.uuid4().hex}"
        tagged = {"batch_id": F.lit(batch_id).cast("bigint"), "weight": F.lit(1)}
        _write_rows(_once(scored).withColumns(tagged), store, name)
        buckets = children(spark, f"{store}/rows/run={name}", "bucket=")
        parts = [Run(int(b.removeprefix("bucket=")), name, 0) for b in buckets]
        touched = [r for r in manifest.runs if r.bucket in {p.bucket for p in parts}]
        old = _replaced(_read(spark, store, "rows", parts, schema), store, touched, schema) if touched else None
        if old is not None:
            missing = [f for f in schema.fields if f.name not in (*old.columns, "cell")]
            blank = {f.name: F.lit(None).cast(f.dataType) for f in missing}
            _write_rows(old.withColumns({**blank, "weight": F.lit(-1)}), store, name)
        runs = _write_summaries(spark, store, name, schema) if parts else []
        after = Manifest(manifest.version + 1, batch_id, [*manifest.runs, *runs], manifest.retired)
        if _publish(spark, store, after):
            return schema
        _drop(spark, store, name)
    raise RuntimeError(f"{store} changed during each of {_ATTEMPTS} attempts to add a batch")


# Merging runs -------------------------------------------------------------------------------


def size_class(rows: int) -> int:
    """0 below ``FANOUT`` rows, 1 below ``FANOUT`` squared, and so on."""
    found = 0
    while rows >= FANOUT:
        rows, found = rows // FANOUT, found + 1
    return found


def due(runs: Sequence[Run]) -> list[Run]:
    """Runs to merge: of each bucket, the smallest class that has ``FANOUT`` of them, with
    what is smaller."""
    out: list[Run] = []
    for bucket in sorted({r.bucket for r in runs}):
        own = [r for r in runs if r.bucket == bucket]
        classes = [size_class(r.rows) for r in own]
        full = [c for c in set(classes) if classes.count(c) >= FANOUT]
        if full:
            out += [r for r, c in zip(own, classes) if c <= min(full)]
    return out


def newest_evaluation(rows: DataFrame) -> DataFrame:
    """Rows of each model's newest evaluation among them."""
    newest = rows.groupBy("model_id").agg(F.max("evaluation").alias("newest"))
    return lookup_groups(rows, newest, ["model_id"], ["example_id"]).filter(
        F.col("evaluation") == F.col("newest")
    ).drop("newest")


def compact(spark: SparkSession, store: str, schema: T.StructType) -> bool:
    """Merge the runs that are due; True if a new version lists the result.

    Rows of older evaluations and rows that cancel out are left behind. If another writer
    publishes first, the merge is given up and its files are deleted. What it replaces is
    retired and deleted by a later merge, when ``GRACE`` versions have passed.
    """
    manifest = read_manifest(spark, store)
    old = due(manifest.runs)
    if not old:
        return False
    name = f"{manifest.version}-{uuid.uuid4().hex}"
    rows = newest_evaluation(_read(spark, store, "rows", old, schema))
    _write_rows(_live(rows).select(*[c for c in schema.names if c != "cell"]), store, name)
    merged = _write_summaries(spark, store, name, schema)
    version = manifest.version + 1
    expired = [(v, r) for v, r in manifest.retired if v <= version - GRACE]
    after = Manifest(
        version,
        manifest.last_batch,
        [*(r for r in manifest.runs if r not in old), *merged],
        [*(x for x in manifest.retired if x not in expired), *((version, r) for r in old)],
    )
    if not _publish(spark, store, after):
        _drop(spark, store, name)
        return False
    for _, run in expired:
        for part in _PARTS:
            delete(spark, f"{store}/{part}/run={run.name}/bucket={run.bucket}")
    sweep(spark, store)
    return True


def sweep(spark: SparkSession, store: str) -> None:
    """Delete the runs of attempts that never were published.

    A run's name begins with the version that it was written on. Once ``GRACE`` later ones
    exist its writer has long failed to publish it, so what no version lists can go.
    """
    manifest = read_manifest(spark, store)
    listed = {r.name for r in manifest.runs} | {r.name for _, r in manifest.retired}
    for part in _PARTS:
        for folder in children(spark, f"{store}/{part}", "run="):
            name = folder.removeprefix("run=")
            if name not in listed and int(name.partition("-")[0]) < manifest.version - GRACE:
                delete(spark, f"{store}/{part}/{folder}")


# Reading ------------------------------------------------------------------------------------


def read_store(spark: SparkSession, store: str, schema: T.StructType) -> DataFrame:
    """The rows that count: one per example of each model's newest evaluation."""
    rows = _read(spark, store, "rows", read_manifest(spark, store).runs, schema)
    return _live(newest_evaluation(rows)).drop("weight")


def _plus(acc: Column, x: Column) -> Column:
    """Moments of both; retracted rows have negative counts and deviations."""
    n = acc.n + x.n
    gap = x.mean - acc.mean
    some = n != 0
    return F.struct(
        n.alias("n"),
        F.when(some, acc.mean + gap * x.n / n).otherwise(0.0).alias("mean"),
        F.when(some, acc.m2 + x.m2 + gap * gap * acc.n * x.n / n).otherwise(0.0).alias("m2"),
    )


def _merged(states: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per model and evaluation from its runs' states, of which there are few."""
    # Rows are added before any are retracted, so counts never pass through 0 on the way.
    parts = F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("last"), "run", *metrics)))
    zero = F.lit(0.0)
    start = F.struct(zero.alias("n"), zero.alias("mean"), zero.alias("m2"))
    sums = states.groupBy(*GROUP).agg(F.sum("n").alias("n"), parts.alias("parts"))

    def total(metric: str) -> Column:
        return F.aggregate("parts", start, lambda acc, part: _plus(acc, part[metric])).alias(metric)

    merged = sums.filter(F.col("n") > 0).select(*GROUP, "n", *map(total, metrics))
    out: list[Column | str] = [*GROUP, "n"]
    for metric, name in SUMMARIZED.items():
        if metric in metrics:
            m = F.col(metric)
            deviation = F.sqrt(F.greatest(m.m2, zero) / (m.n - 1))
            out += [F.when(m.n > 0, m.mean).alias(f"{name}_mean"), F.when(m.n > 1, deviation).alias(f"{name}_std")]
        elif metric == "answer_similarity":
            out += [F.lit(None).cast("double").alias(f"{name}_{part}") for part in ("mean", "std")]
    return merged.select(*out)


def _brackets(cells: DataFrame) -> DataFrame:
    """Per model, bounds of the two middle values from exact counts of cells.

    Rows up to a value are at most those of the cells that begin there or before, and at
    least those of the cells that end there or before; for retracted rows the reverse.
    """
    begins, rows = F.col("weight") > 0, F.col("rows")
    ends = F.array(
        F.struct(F.col("lowest").alias("v"), F.when(begins, rows).alias("most"), F.when(~begins, rows).alias("least")),
        F.struct(F.col("highest").alias("v"), F.when(~begins, rows).alias("most"), F.when(begins, rows).alias("least")),
    )
    steps = (
        cells.select("model_id", F.explode(ends).alias("end"))
        .groupBy("model_id", "end.v")
        .agg(*(F.sum(F.coalesce(f"end.{c}", F.lit(0))).alias(c) for c in ("most", "least")))
    )
    # A row per cell at most, not per example.
    upto = Window.partitionBy("model_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy("model_id")
    counted = steps.select(
        "model_id",
        "v",
        F.sum("most").over(upto).alias("most"),
        F.sum("least").over(upto).alias("least"),
        F.sum("least").over(total).alias("n"),
    )
    return counted.groupBy("model_id").agg(
        F.max("n").alias("n"),
        F.min(F.when(F.col("most") >= F.expr(_FIRST), F.col("v"))).alias("low"),
        F.min(F.when(F.col("least") >= F.expr(_SECOND), F.col("v"))).alias("high"),
    )


_FIRST = "floor((n + 1) / 2)"
_SECOND = "floor((n + 2) / 2)"


def middle_cells(cells: DataFrame) -> DataFrame:
    """The cells that may hold a model's middle values, with its bracket and the number
    ``skipped`` of rows in the cells below it."""
    brackets = _brackets(cells)
    placed = group_join(cells, brackets, ["model_id"], "inner")
    below = placed.groupBy("model_id").agg(
        F.sum(F.when(F.col("highest") < F.col("low"), F.col("rows")).otherwise(0)).alias("skipped")
    )
    inside = (F.col("highest") >= F.col("low")) & (F.col("lowest") <= F.col("high"))
    return group_join(placed.filter(inside), below, ["model_id"], "inner")


def _medians(spark: SparkSession, store: str, runs: Sequence[Run], schema: T.StructType, groups: DataFrame) -> DataFrame:
    """Exact median per model of ``groups``: only the cells around the middle are reread."""
    cells = _read(spark, store, "cells", runs, _cells_schema(schema)).filter("rows <> 0")
    place = ["run", "bucket", *GROUP, "weight", "cell"]
    wanted = middle_cells(group_join(cells, groups, GROUP, "left_semi"))
    wanted = materialize(wanted.select(*place, "n", "low", "high", "skipped", "lowest", "highest"), "middle-cells")
    ends = wanted.groupBy("run", "bucket").agg(F.min("lowest").alias("a"), F.max("highest").alias("b")).collect()
    name = f"{PERPLEXITY}_median"
    if not ends:
        return groups.select("model_id", F.lit(None).cast("double").alias(name)).limit(0)
    hit = {(r["run"], r["bucket"]) for r in ends}
    rows = _read(spark, store, "rows", [r for r in runs if (r.name, r.bucket) in hit], schema)
    # Bounds of all brackets let the reader skip whole row groups.
    value = F.col(PERPLEXITY).cast("double")
    rows = rows.filter(value.between(min(r["a"] for r in ends), max(r["b"] for r in ends)))
    rows = rows.select(*place, "example_id", value.alias("v"))
    own = wanted.drop("lowest", "highest")
    copies = lookup_groups(rows, own, place, ["example_id"]).filter(F.col("v") <= F.col("high"))
    copies = copies.groupBy("model_id", "n", "low", "skipped", "v").agg(F.sum("weight").alias("copies"))
    upto = Window.partitionBy("model_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    rank = F.col("skipped") + F.sum("copies").over(upto)
    ranked = copies.withColumn("rank", rank).filter(F.col("v") >= F.col("low"))
    middle = ranked.groupBy("model_id").agg(
        F.min(F.when(F.col("rank") >= F.expr(_FIRST), F.col("v"))).alias("a"),
        F.min(F.when(F.col("rank") >= F.expr(_SECOND), F.col("v"))).alias("b"),
    )
    return middle.select("model_id", ((F.col("a") + F.col("b")) / 2).alias(name))


def summarize_store(
    spark: SparkSession, store: str, schema: T.StructType, models: DataFrame | None = None
) -> DataFrame:
    """Summary rows of the store's models, or of those in ``models`` (column ``model_id``).

    The same columns as ``summarize_predictions`` over ``read_store``, merged from states.
    """
    runs = read_manifest(spark, store).runs
    if models is not None:
        # The models' buckets, of which there are ``BUCKETS`` at most.
        hashed = models.select(_bucket(F.col("model_id")).alias("bucket")).distinct()
        buckets = {r["bucket"] for r in hashed.collect()}
        runs = [r for r in runs if r.bucket in buckets]
    states = _read(spark, store, "states", runs, _states_schema(schema))
    if models is not None:
        states = group_join(states, models.select("model_id").distinct(), ["model_id"], "left_semi")
    newest = states.groupBy("model_id").agg(F.max("evaluation").alias("newest"))
    states = group_join(states, newest, ["model_id"], "inner").filter(F.col("evaluation") == F.col("newest"))
    summary = _merged(states.drop("newest"), _metrics(schema.names))
    if PERPLEXITY in schema.names:
        medians = _medians(spark, store, runs, schema, summary.select(*GROUP))
        summary = group_join(summary, medians, ["model_id"], "left")
    return summary.drop("evaluation")


# The stream ---------------------------------------------------------------------------------


def apply_batch(batch: DataFrame, batch_id: int, store: str, board: str, schema: T.StructType) -> None:
    """Store a batch and bring its models' leaderboard rows up to date.

    Every step may be interrupted and repeated: the batch is listed once, and the board is
    updated from the store each time.
    """
    spark = batch.sparkSession
    rows = store_batch(batch, batch_id, store)
    update_leaderboard(summarize_store(spark, store, rows, batch.select("model_id")), board, schema)
    while compact(spark, store, rows):
        pass


def start_leaderboard_stream(
    spark: SparkSession,
    source: str,
    source_schema: T.StructType,
    store: str,
    board: str,
    board_schema: T.StructType,
    checkpoint: str,
    max_files_per_batch: int = 1000,
) -> StreamingQuery:
    """Process the files that are there and stop; run again for later ones."""
    arriving = (
        spark.readStream.schema(source_schema)
        .option("maxFilesPerTrigger", max_files_per_batch)
        .parquet(source)
    )

    def apply(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch, batch_id, store, board, board_schema)

    return (
        arriving.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
