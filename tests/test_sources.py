"""Reading and writing: revisions, predictions, leaderboards, history."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F, types as T

from evalweave import schemas, storage
from evalweave.operators import reshape
from evalweave.sources import datasets, evaluations, leaderboards, predictions

CARDS = "example_id long, instruction string, input string, output string, split string"


@pytest.fixture
def cards(spark):
    rows = [(i, "do it", f"q{i}", f"a{i}", ["train", "test"][i % 2]) for i in range(40)]
    return spark.createDataFrame(rows, CARDS)


def test_revisions(spark, cards, tmp_path):
    path = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        datasets.load_dataset(spark, path)
    datasets.publish_dataset(cards, path, "v9")
    datasets.publish_dataset(cards.limit(3), path, "v10")
    assert datasets.load_dataset(spark, path).count() == 3
    assert datasets.load_dataset(spark, path, "v9").count() == 40
    with pytest.raises(Exception, match="already exists"):
        datasets.publish_dataset(cards, path, "v9")
    # An unfinished revision is not the newest one, whatever the files' times.
    cards.limit(1).write.partitionBy("split").parquet(f"{path}/data-2-lost")
    os.utime(f"{path}/version-0000000001")
    assert datasets.load_dataset(spark, path).count() == 3
    with pytest.raises(FileNotFoundError):
        datasets.load_dataset(spark, path, "v11")


def test_a_split_reads_only_its_partition(spark, cards, tmp_path):
    datasets.publish_dataset(cards, str(tmp_path), "r")
    test = reshape.select_split(datasets.load_dataset(spark, str(tmp_path)), "test")
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    assert test.count() == 20


def test_load_prepared(spark, cards, tmp_path):
    datasets.publish_dataset(cards, str(tmp_path), "r")
    df = datasets.load_prepared(spark, str(tmp_path), "System.\n", caps={"train": 5})
    assert df.columns == ["example_id", "split", "prompt", "completion"]
    rows = df.collect()
    assert sum(r.split == "train" for r in rows) == 5 and len(rows) == 25
    first = rows[0]
    assert first.prompt[0].content == "System.\ndo it"
    assert first.prompt[1].content == f"q{first.example_id}"
    assert reshape.to_chat(df.withColumn("extra", F.lit(1)), "x").columns[-1] == "extra"


def test_incomplete_rows(spark):
    df = spark.createDataFrame([(1, "i", "q", None, "t"), (2, "i", "q", "a", "t")], CARDS)
    assert [r.example_id for r in reshape.incomplete_rows(df).collect()] == [1]
    assert [r.example_id for r in reshape.complete_rows(df).collect()] == [2]


TRICKY = [
    "", None, "a\nb", "a\r\nb", "a\rb", "  x ", '"q"', 'say ""', "\\", '\\"', "a,b", '"', "'", "\n",
    "　x", "#c", 'x\\"y,\n"z"', "\t", "null", "NaN",
]


@pytest.mark.parametrize("file_format", ["parquet", "csv"])
def test_predictions_survive_and_are_replaced_per_model(spark, tmp_path, file_format):
    schema = "model_id string, example_id long, text string, last string"
    rows = [(m, i, t, "end") for m in ("org/a", "org/b") for i, t in enumerate(TRICKY)]
    df = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "p")
    predictions.write_predictions(df, path, file_format)
    again = spark.createDataFrame([("org/b", 0, "new", "end")], schema)
    predictions.write_predictions(again, path, file_format)
    got = predictions.read_predictions(spark, path, df.schema, file_format).collect()
    kept = {r.example_id: r.text for r in got if r.model_id == "org/a"}
    assert kept == dict(enumerate(TRICKY))
    assert [r.text for r in got if r.model_id == "org/b"] == ["new"]
    assert {r.model_slug for r in got} == {"org__a", "org__b"}


BOARD = T.StructType(
    [
        T.StructField("model_id", T.StringType()),
        T.StructField("answer_similarity_mean", T.DoubleType()),
        T.StructField("token_f1_mean", T.DoubleType()),
    ]
)


def test_leaderboard_versions(spark, tmp_path):
    path = str(tmp_path / "board")
    assert leaderboards.read_leaderboard(spark, path).schema == schemas.LEADERBOARD
    first = spark.createDataFrame([("a", 0.1, 1 / 3), ("b", None, 0.2)], BOARD)
    leaderboards.update_leaderboard(first, path, BOARD)
    leaderboards.update_leaderboard(spark.createDataFrame([("b", 0.5, 0.4)], BOARD), path, BOARD)
    got = leaderboards.read_leaderboard(spark, path, BOARD)
    assert [tuple(r) for r in got.collect()] == [("b", 0.5, 0.4), ("a", 0.1, 1 / 3)]
    # A board that was never published is not read.
    leaderboards._write(first.limit(1), path)
    assert leaderboards.read_leaderboard(spark, path, BOARD).count() == 2
    leaderboards.update_leaderboard(spark.createDataFrame([("c", 0.9, 0.9)], BOARD), path, BOARD)
    assert leaderboards.read_leaderboard(spark, path, BOARD).count() == 3
    leaderboards.write_leaderboard(first, path)
    assert leaderboards.read_leaderboard(spark, path, BOARD).count() == 2


def test_a_late_writer_merges_again(spark, tmp_path, monkeypatch):
    """A version taken by another writer between reading and publishing is merged again."""
    path = str(tmp_path / "board")
    row = lambda name: spark.createDataFrame([(name, 0.5, 0.5)], BOARD)
    leaderboards.update_leaderboard(row("a"), path, BOARD)
    original, late = leaderboards._write, []

    def write_while_the_other_writer_publishes(*args, **kwargs):
        name = original(*args)
        if not late:
            late.append(True)
            leaderboards.update_leaderboard(row("b"), path, BOARD)
        return name

    monkeypatch.setattr(leaderboards, "_write", write_while_the_other_writer_publishes)
    leaderboards.update_leaderboard(row("c"), path, BOARD)
    got = leaderboards.read_leaderboard(spark, path, BOARD).collect()
    assert sorted(r.model_id for r in got) == ["a", "b", "c"]


def test_overlapping_writers_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "board")
    names = [f"m{i}" for i in range(6)]

    def write(name):
        leaderboards.update_leaderboard(spark.createDataFrame([(name, 0.5, 0.5)], BOARD), path, BOARD)

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(write, names))
    got = leaderboards.read_leaderboard(spark, path, BOARD).collect()
    assert sorted(r.model_id for r in got) == names


def test_a_version_is_published_once(spark, tmp_path):
    path = str(tmp_path / "versions")
    assert storage.newest_version(spark, path) == (0, None)
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: storage.publish_version(spark, path, 1, f"w{i}"), range(8)))
    assert sum(won) == 1
    assert storage.newest_version(spark, path) == (1, f"w{won.index(True)}")


def test_history_keeps_all_columns(spark, tmp_path):
    path = str(tmp_path / "history")
    assert leaderboards.read_history(spark, path) is None
    leaderboards.append_history(spark.createDataFrame([("r1", 1)], "run string, a int"), path)
    leaderboards.append_history(spark.createDataFrame([("r2", 2.5)], "run string, b double"), path)
    got = {r.run: (r.a, r.b) for r in leaderboards.read_history(spark, path).collect()}
    assert got == {"r1": (1, None), "r2": (None, 2.5)}


def test_history_schema_is_checked_and_widened(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "history")
    append = lambda row, schema: leaderboards.append_history(spark.createDataFrame([row], schema), path)
    append(("r1", 1, (1,)), "run string, a int, c struct<x: int>")
    append(("r2", 2**40, (2, 0.5)), "run string, A bigint, c struct<x: int, y: float>")
    append(("r3", 3, None), "run string, a int, d void")
    with pytest.raises(ValueError, match="column a holds bigint, not string"):
        append(("r4", "four"), "run string, a string")
    with pytest.raises(ValueError, match="c.x"):
        append(("r4", ("five",)), "run string, c struct<x: string>")

    assert leaderboards._history_schema(spark, path)[1].names == ["run", "a", "c", "d"]

    # Reading opens no file to find the columns: that would need an option of the reader.
    logged = storage.newest_version(spark, f"{path}/_schema")
    monkeypatch.setattr(leaderboards, "newest_version", lambda *args: logged)
    monkeypatch.delattr(type(spark.read), "option")
    got = {r.run: (r.a, r.c and tuple(r.c), r.d) for r in leaderboards.read_history(spark, path).collect()}
    assert got == {"r1": (1, (1, None), None), "r2": (2**40, (2, 0.5), None), "r3": (3, None, None)}


def test_a_history_without_a_log_is_taken_over(spark, tmp_path):
    path = str(tmp_path / "history")
    spark.createDataFrame([("r0", 0)], "run string, a int").write.parquet(path)
    leaderboards.append_history(spark.createDataFrame([("r1", 1.5)], "run string, a double"), path)
    got = {r.run: r.a for r in leaderboards.read_history(spark, path).collect()}
    assert got == {"r0": 0.0, "r1": 1.5}


# Predictions and board published together ---------------------------------------------------

PREDICTED = T.StructType([T.StructField("model_id", T.StringType()), T.StructField("example_id", T.LongType())])


def evaluation(spark, models, n, score):
    rows = [(m, i) for m in models for i in range(n)]
    board = [(m, score, score) for m in models]
    return spark.createDataFrame(rows, PREDICTED), spark.createDataFrame(board, BOARD)


def seen(spark, path):
    at = evaluations.published(spark, path)
    rows = evaluations.read_predictions(spark, path, PREDICTED, at).groupBy("model_id").count().collect()
    board = evaluations.read_board(spark, path, BOARD, at).collect()
    return {r["model_id"]: r["count"] for r in rows}, {r.model_id: r.token_f1_mean for r in board}


def test_predictions_and_board_change_together(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "evaluations")
    assert seen(spark, path) == ({}, {})
    evaluations.publish_evaluation(*evaluation(spark, ["org/a", "org/b", "x=1:%"], 3, 0.1), path, BOARD)
    evaluations.publish_evaluation(*evaluation(spark, ["org/b", None], 5, 0.2), path, BOARD)
    before = ({"org/a": 3, "x=1:%": 3, "org/b": 5, None: 5}, {"org/a": 0.1, "x=1:%": 0.1, "org/b": 0.2, None: 0.2})
    assert seen(spark, path) == before
    steps = [(evaluations, "sort_leaderboard"), (evaluations, "publish_version")]
    for module, step in steps:
        def crash(*args):
            raise RuntimeError("crash")

        with monkeypatch.context() as patch:
            patch.setattr(module, step, crash)
            with pytest.raises(RuntimeError, match="crash"):
                evaluations.publish_evaluation(*evaluation(spark, ["org/a"], 9, 0.9), path, BOARD)
        # Its predictions are written, but nobody reads them with the old board.
        assert seen(spark, path) == before
    evaluations.publish_evaluation(*evaluation(spark, ["org/a"], 9, 0.9), path, BOARD)
    assert seen(spark, path)[0]["org/a"] == 9 and seen(spark, path)[1]["org/a"] == 0.9


def test_overlapping_evaluations_keep_both(spark, tmp_path):
    path = str(tmp_path / "evaluations")

    def publish(i):
        evaluations.publish_evaluation(*evaluation(spark, [f"m{i}"], i + 1, i / 10), path, BOARD)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(publish, range(4)))
    assert seen(spark, path) == ({f"m{i}": i + 1 for i in range(4)}, {f"m{i}": i / 10 for i in range(4)})


# Retention ----------------------------------------------------------------------------------


def test_vacuum_keeps_what_readers_and_writers_need(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "PROTECTED", 2)
    path = str(tmp_path / "board")
    row = lambda i: spark.createDataFrame([(f"m{i}", 0.5, 0.5)], BOARD)
    for i in range(6):
        leaderboards.update_leaderboard(row(i), path, BOARD)
    lost = leaderboards._write(row(9), path, 1)
    reader = leaderboards._read(spark, path, BOARD, storage.versions(spark, path)[2][1])
    original = leaderboards._write
    deleted = []

    def write_while_others_sweep(*args):
        name = original(*args)
        deleted.extend(leaderboards.vacuum_leaderboard(spark, path, keep=3))
        assert os.path.exists(f"{path}/{name}")
        return name

    monkeypatch.setattr(leaderboards, "_write", write_while_others_sweep)
    leaderboards.update_leaderboard(row(7), path, BOARD)
    assert lost in deleted and len(deleted) == 4
    assert reader.count() == 4
    got = {r.model_id for r in leaderboards.read_leaderboard(spark, path, BOARD).collect()}
    assert got == {"m0", "m1", "m2", "m3", "m4", "m5", "m7"}
    # Versions whose folders are gone are gone as well; the rest can be read.
    for _, name in storage.versions(spark, path):
        leaderboards._read(spark, path, BOARD, name).count()


def test_vacuum_of_revisions_and_evaluations(spark, cards, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "PROTECTED", 0)
    path = str(tmp_path / "cards")
    for i in range(4):
        datasets.publish_dataset(cards.limit(i + 1), path, f"r{i}")
    assert len(datasets.vacuum_dataset(spark, path, keep=2)) == 2
    assert [datasets.load_dataset(spark, path, f"r{i}").count() for i in (2, 3)] == [3, 4]
    with pytest.raises(FileNotFoundError):
        datasets.load_dataset(spark, path, "r0")
    path = str(tmp_path / "evaluations")
    for i, models in enumerate((["a", "b"], ["a"], ["a"])):
        evaluations.publish_evaluation(*evaluation(spark, models, i + 1, i / 10), path, BOARD)
    # The first folder still holds the newest predictions of one model.
    assert len(evaluations.vacuum_evaluations(spark, path, keep=1)) == 3
    assert seen(spark, path) == ({"a": 3, "b": 1}, {"a": 0.2, "b": 0.0})


def test_intermediate_tables_go_to_the_configured_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert storage.shared_dir(spark) == folder
    df = storage.materialize(spark.range(5), "five")
    assert df.count() == 5 and all(f.startswith(f"file://{folder}") for f in df.inputFiles())
    files = df.inputFiles()
    storage.discard(spark)
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
