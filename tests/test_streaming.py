"""The incremental leaderboard equals the batch one, also after replays and crashes."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F, types as T

from evalweave.operators.scoring import score_answers
from evalweave.operators.summary import PERPLEXITY, summarize_predictions
from evalweave.sources.leaderboards import read_leaderboard
from evalweave.streaming import leaderboard as stream

ROWS = "model_id string, evaluation long, example_id long, reference_answer string, raw_generation string"
WITH_PERPLEXITY = f"{ROWS}, reference_answer_token_perplexity double"
BOARD = T.StructType(
    [T.StructField("model_id", T.StringType()), T.StructField("n", T.LongType())]
    + [
        T.StructField(f"{name}_{part}", T.DoubleType())
        for name in ("token_f1", "answer_similarity")
        for part in ("mean", "std")
    ]
)
PERPLEXITY_BOARD = T.StructType(
    BOARD.fields + [T.StructField(f"{PERPLEXITY}_{p}", T.DoubleType()) for p in ("mean", "std", "median")]
)


def delivery(spark, model, evaluation, ids, answer):
    rows = [(model, evaluation, i, f"word{i} x y", answer.format(i=i)) for i in ids]
    return spark.createDataFrame(rows, ROWS)


def board_of(df):
    return {r.model_id: (r.n, round(r.token_f1_mean, 9)) for r in df.collect()}


@pytest.fixture
def folders(tmp_path):
    return {n: str(tmp_path / n) for n in ("source", "store", "board", "checkpoint")}


def run(spark, folders, files=1):
    stream.start_leaderboard_stream(
        spark, folders["source"], T._parse_datatype_string(ROWS), folders["store"],
        folders["board"], BOARD, folders["checkpoint"], files,
    ).awaitTermination()
    return board_of(read_leaderboard(spark, folders["board"], BOARD))


def expected(*deliveries):
    rows = deliveries[0]
    for other in deliveries[1:]:
        rows = rows.union(other)
    return board_of(summarize_predictions(score_answers(rows)))


@pytest.mark.parametrize("fanout", [4, 2])
def test_stream_equals_batch(spark, folders, monkeypatch, fanout):
    monkeypatch.setattr(stream, "FANOUT", fanout)
    a = delivery(spark, "org/a", 1, range(10), "word{i} x")
    a_rest = delivery(spark, "org/a", 1, range(10, 15), "other")
    b = delivery(spark, "org/b", 1, range(15), "word{i}")
    for part in (a, a_rest, b):
        part.coalesce(1).write.mode("append").parquet(folders["source"])
    # One file per micro-batch: an evaluation arrives in parts.
    assert run(spark, folders) == expected(a, a_rest, b)
    a_again = delivery(spark, "org/a", 2, range(12), "word{i} x y")
    a_again.coalesce(1).write.mode("append").parquet(folders["source"])
    assert run(spark, folders) == expected(a_again, b)


def test_replayed_and_redelivered_batches_change_nothing(spark, folders):
    a = delivery(spark, "org/a", 1, range(10), "word{i} x")
    store, board = folders["store"], folders["board"]
    for batch_id in (0, 0, 1, 0):
        stream.apply_batch(a, batch_id, store, board, BOARD)
    assert board_of(read_leaderboard(spark, board, BOARD)) == expected(a)
    corrected = delivery(spark, "org/a", 1, [3], "nothing in common")
    stream.apply_batch(corrected, 2, store, board, BOARD)
    rest = a.filter(F.col("example_id") != 3)
    assert board_of(read_leaderboard(spark, board, BOARD)) == expected(rest, corrected)


# Runs, states and medians -------------------------------------------------------------------


class Deliveries:
    """Random batches, and what a dictionary of them holds at the end."""

    def __init__(self, seed):
        self.rng = random.Random(seed)
        self.rows = {}

    def batch(self, spark, size=12):
        rng, rows = self.rng, {}
        for _ in range(rng.randrange(size)):
            model = rng.choice(["org/a", "org/b", "org/c", None])
            evaluation, example = rng.choice([1, 1, 2, 3] if model == "org/c" else [1]), rng.randrange(60)
            answer = rng.choice([f"word{example}", "x", "x y", "", None])
            value = rng.choice([None, float("nan"), 1.0, 2.0, rng.random() * 5, rng.random() * 5])
            rows[model, evaluation, example] = (f"word{example} x y", answer, value)
        self.rows |= rows
        return spark.createDataFrame([(*k, *v) for k, v in rows.items()], WITH_PERPLEXITY)

    def expected(self, spark):
        newest = {}
        for model, evaluation, _ in self.rows:
            newest[model] = max(evaluation, newest.get(model, 0))
        kept = [(*k, *v) for k, v in self.rows.items() if newest[k[0]] == k[1]]
        return summarize_predictions(score_answers(spark.createDataFrame(kept, WITH_PERPLEXITY)))


def figures(df):
    names = PERPLEXITY_BOARD.names[1:]
    near = lambda x: round(x, 7) if isinstance(x, float) else x
    return {r["model_id"]: tuple(near(r[c]) for c in names) for r in df.collect()}


@pytest.mark.parametrize("seed, fanout, cell", [(1, 2, 3), (2, 3, 1)])
def test_merged_summaries_equal_the_batch_summary(spark, folders, monkeypatch, seed, fanout, cell):
    """Also with redelivered rows, new evaluations, ties, missing values and nameless models."""
    monkeypatch.setattr(stream, "FANOUT", fanout)
    monkeypatch.setattr(stream, "CELL_ROWS", cell)
    monkeypatch.setattr(stream, "BUCKETS", 2)
    made, store, board = Deliveries(seed), folders["store"], folders["board"]
    schema = None
    for batch_id in range(6):
        batch = made.batch(spark)
        stream.apply_batch(batch, batch_id, store, board, PERPLEXITY_BOARD)
        schema = stream.rows_schema(score_answers(batch).schema)
    want = figures(made.expected(spark))
    assert figures(read_leaderboard(spark, board, PERPLEXITY_BOARD)) == want
    assert figures(stream.summarize_store(spark, store, schema)) == want
    stored = {tuple(r) for r in stream.read_store(spark, store, schema).select(*stream.KEY).collect()}
    newest = {m: max(e for n, e, _ in made.rows if n == m) for m, _, _ in made.rows}
    assert stored == {k for k in made.rows if newest[k[0]] == k[1]}


# What fails, at which call, and whether its work is done by then.
STEPS = [
    ("_write_rows", 2, True), ("_replaced", 1, False), ("_write_summaries", 2, True), ("_publish", 2, False),
    ("_publish", 2, True), ("_publish", 3, True), ("update_leaderboard", 2, False), ("_live", 2, False),
]


@pytest.mark.parametrize("step, call, after", STEPS)
def test_a_crash_at_any_step_is_repaired_by_a_replay(spark, folders, monkeypatch, step, call, after):
    monkeypatch.setattr(stream, "FANOUT", 2)
    monkeypatch.setattr(stream, "BUCKETS", 1)
    made, store, board = Deliveries(7), folders["store"], folders["board"]
    batches = [made.batch(spark, 30) for _ in range(2)]
    original, calls = getattr(stream, step), []

    def failing(*args, **kwargs):
        calls.append(1)
        if len(calls) != call:
            return original(*args, **kwargs)
        if after:
            original(*args, **kwargs)
        raise RuntimeError("crash")

    monkeypatch.setattr(stream, step, failing)
    failures = 0
    for batch_id, batch in enumerate(batches):
        try:
            stream.apply_batch(batch, batch_id, store, board, PERPLEXITY_BOARD)
        except RuntimeError:
            failures += 1
            stream.apply_batch(batch, batch_id, store, board, PERPLEXITY_BOARD)
    assert failures == 1
    assert figures(read_leaderboard(spark, board, PERPLEXITY_BOARD)) == figures(made.expected(spark))


def test_a_merge_that_comes_second_leaves_the_winner_alone(spark, folders, monkeypatch):
    monkeypatch.setattr(stream, "FANOUT", 2)
    store = folders["store"]
    for batch_id in range(2):
        rows = delivery(spark, "org/a", 1, range(batch_id * 5, batch_id * 5 + 5), "word{i} x")
        schema = stream.store_batch(rows, batch_id, store)
    publish = stream._publish
    rival = []

    def beaten(spark_, store_, manifest):
        if not rival:
            rival.append(1)
            assert stream.compact(spark, store, schema)  # another writer is first
        return publish(spark_, store_, manifest)

    monkeypatch.setattr(stream, "_publish", beaten)
    assert not stream.compact(spark, store, schema)
    assert stream.read_store(spark, store, schema).count() == 10
    assert [r.rows for r in stream.read_manifest(spark, store).runs] == [10]


def test_rows_are_rewritten_a_logarithmic_number_of_times():
    """200 batches of one bucket; a merge moves every row at least one size class up."""
    rng = random.Random(3)
    for sizes in ([1] * 200, [rng.randrange(1, 50) for _ in range(200)]):
        runs, rewritten, most_runs = [], {}, 0
        held = {}
        for number, size in enumerate(sizes):
            name = f"b{number}"
            runs.append(stream.Run(0, name, size))
            held[name], rewritten[number] = [number], 0
            while old := stream.due(runs):
                merged = stream.Run(0, f"m{number}-{len(old)}-{old[0].name}", sum(r.rows for r in old))
                held[merged.name] = [b for r in old for b in held[r.name]]
                for b in held[merged.name]:
                    rewritten[b] += 1
                runs = [r for r in runs if r not in old] + [merged]
            most_runs = max(most_runs, len(runs))
        classes = stream.size_class(sum(sizes)) + 1
        assert max(rewritten.values()) <= classes
        assert most_runs <= (stream.FANOUT - 1) * classes
        assert sum(r.rows for r in runs) == sum(sizes)


def test_a_late_batch_reads_states_and_a_few_cells(spark, folders, monkeypatch):
    monkeypatch.setattr(stream, "CELL_ROWS", 100)
    monkeypatch.setattr(stream, "BUCKETS", 1)
    ids = spark.range(0, 20_000, numPartitions=1)
    rows = ids.select(
        F.lit("org/a").alias("model_id"), F.lit(1).cast("long").alias("evaluation"), F.col("id").alias("example_id"),
        F.lit("x y").alias("reference_answer"), F.lit("x").alias("raw_generation"),
        (F.pmod(F.xxhash64("id"), F.lit(9973)) / 7.0).alias(PERPLEXITY),
    )
    store = folders["store"]
    schema = stream.store_batch(rows, 0, store)
    late = rows.limit(50).withColumn("example_id", F.col("example_id") + 50_000)
    stream.store_batch(late, 1, store)
    runs = stream.read_manifest(spark, store).runs
    assert len(runs) == 2
    # No example of the late batch can be in the first run: nothing is searched there.
    scored = score_answers(late).withColumn("batch_id", F.lit(1))
    assert stream._replaced(scored, store, runs[:1] if runs[0].rows > 50 else runs[1:], schema) is None
    cells = stream._read(spark, store, "cells", runs, stream._cells_schema(schema))
    read = stream.middle_cells(cells).agg(F.sum("rows")).first()[0]
    assert 0 < read <= 600
    got = stream.summarize_store(spark, store, schema).collect()[0]
    want = rows.unionByName(late).agg(F.median(PERPLEXITY)).first()[0]
    assert got[f"{PERPLEXITY}_median"] == pytest.approx(want, abs=1e-12) and got.n == 20_050


def test_files_no_reader_needs_are_deleted(spark, folders, monkeypatch):
    monkeypatch.setattr(stream, "FANOUT", 2)
    monkeypatch.setattr(stream, "GRACE", 2)
    monkeypatch.setattr(stream, "BUCKETS", 1)
    store = folders["store"]
    lost = Path(store) / "rows" / "run=0-lost" / "bucket=0"
    lost.mkdir(parents=True)
    for batch_id in range(6):
        rows = delivery(spark, "org/a", 1, range(batch_id * 5, batch_id * 5 + 5), "word{i} x")
        schema = stream.store_batch(rows, batch_id, store)
        while stream.compact(spark, store, schema):
            pass
    manifest = stream.read_manifest(spark, store)
    listed = {r.name for r in manifest.runs} | {r.name for _, r in manifest.retired}
    there = {p.parent.name.removeprefix("run=") for p in (Path(store) / "rows").glob("run=*/bucket=*")}
    assert there <= listed and not lost.exists()
    assert stream.read_store(spark, store, schema).count() == 30
