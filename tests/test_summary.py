"""Summaries, telemetry, leaderboards and comparisons."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from evalweave.operators import compare, leaderboard, scoring, summary

NAN = float("nan")


def test_single_row_has_no_deviation(spark):
    df = spark.createDataFrame([("m", 1, 0.5)], "model_id string, example_id long, token_f1 double")
    row = summary.summarize_predictions(df).first()
    assert (row.n, row.token_f1_mean, row.token_f1_std) == (1, 0.5, None)
    assert row.answer_similarity_mean is None and row.answer_similarity_std is None


def test_optional_blocks_and_missing_values(spark):
    df = spark.createDataFrame(
        [
            ("m", 1, 0.0, None, 1.0, 2.0, 4),
            ("m", 2, 1.0, 0.5, NAN, None, 0),
            ("m", 3, 0.5, 0.7, 3.0, 8.0, 2),
        ],
        "model_id string, example_id long, token_f1 double, answer_similarity double, "
        "reference_answer_nll_mean double, reference_answer_token_perplexity double, "
        "reference_answer_tokens int",
    )
    row = summary.summarize_predictions(df).first().asDict()
    assert row["n"] == 3 and row["token_f1_std"] == pytest.approx(0.5)
    assert row["answer_similarity_mean"] == pytest.approx(0.6)
    assert row["reference_answer_nll_mean"] == pytest.approx(2.0)
    assert row["reference_answer_nll_std"] == pytest.approx(math.sqrt(2))
    assert row["reference_answer_token_perplexity_median"] == 5.0
    assert row["reference_answer_tokens_mean"] == 2.0
    minimal = summary.summarize_predictions(df.select("model_id", "example_id", "token_f1"))
    assert minimal.columns == [
        "model_id", "n", "token_f1_mean", "token_f1_std",
        "answer_similarity_mean", "answer_similarity_std",
    ]


def test_published_telemetry(spark):
    batches = spark.createDataFrame(
        [("m", 425.667, 23920), ("none", 2.0, 10), ("zero", 0.0, 5)],
        "model_id string, inference_seconds double, generated_tokens long",
    )
    reference = spark.createDataFrame(
        [("m", 27.877, 128), ("none", NAN, 128)],
        "model_id string, reference_seconds double, examples long",
    )
    got = {r.model_id: r for r in summary.run_telemetry(batches, reference).collect()}
    assert got["m"].total_inference_seconds == pytest.approx(453.544)
    assert got["m"].generation_tokens_per_second == pytest.approx(56.194, abs=1e-3)
    assert got["m"].reference_logprob_examples_per_second == pytest.approx(4.5916, abs=1e-4)
    assert got["none"].total_inference_seconds == 2.0
    assert got["none"].reference_logprob_examples_per_second is None
    assert got["zero"].generation_tokens_per_second is None


def test_peak_memory_sums_device_peaks(spark):
    mb = 1024**2
    df = spark.createDataFrame(
        [("m", "0", 1 * mb, 2 * mb), ("m", "0", 3 * mb, 4 * mb), ("m", "1", 5 * mb, 6 * mb)],
        "model_id string, device string, allocated_bytes long, reserved_bytes long",
    )
    row = summary.peak_memory(df).first()
    assert (row.vram_peak_allocated_mb, row.vram_peak_reserved_mb) == (8.0, 10.0)


def test_telemetry_wins_on_equal_names(spark):
    own = spark.createDataFrame([("m", 1, 9), ("k", 2, 9)], "model_id string, n long, t long")
    telemetry = spark.createDataFrame([("m", 7, 0.5)], "model_id string, t long, s double")
    got = {r.model_id: (r.n, r.t, r.s) for r in summary.attach_telemetry(own, telemetry).collect()}
    assert got == {"m": (1, 7, 0.5), "k": (2, None, None)}


def test_reference_scores_keep_examples_without_tokens(spark):
    tokens = spark.createDataFrame(
        [("m", 1, -1.0), ("m", 1, -3.0), ("m", 3, float("-inf"))],
        "model_id string, example_id long, logprob double",
    )
    examples = spark.createDataFrame([("m", 1), ("m", 2), ("m", 3)], "model_id string, example_id long")
    got = {r.example_id: tuple(r)[2:] for r in scoring.reference_scores(tokens, examples).collect()}
    assert got[1] == (-4.0, 2.0, pytest.approx(math.exp(2)), 2)
    assert got[2] == (None, None, None, 0)
    assert got[3][2:] == (None, 1)


def test_attach_reference_scores_keeps_all_predictions(spark):
    predictions = spark.createDataFrame([("m", 1), ("m", 2)], "model_id string, example_id long")
    scores = spark.createDataFrame([("m", 1, 0.5), ("k", 2, 0.1)], "model_id string, example_id long, s double")
    got = scoring.attach_reference_scores(predictions, scores).collect()
    assert sorted((r.example_id, r.s) for r in got) == [(1, 0.5), (2, None)]


def board(spark, rows, version):
    schema = "model_id string, answer_similarity_mean double, token_f1_mean double"
    return spark.createDataFrame(rows, schema).withColumn("version", F.lit(version))


def test_upsert_replaces_sorts_and_is_idempotent(spark):
    old = board(spark, [("a", 0.5, 0.1), ("b", None, 0.9), ("c", 0.5, 0.2)], 1)
    new = board(spark, [("a", 0.7, 0.3), ("d", 0.5, 0.2)], 2).withColumn("extra", F.lit("x"))
    once = leaderboard.upsert(old, new)
    rows = [(r.model_id, r.version, r.extra) for r in once.collect()]
    assert rows == [("a", 2, "x"), ("c", 1, None), ("d", 2, "x"), ("b", 1, None)]
    assert [tuple(r) for r in leaderboard.upsert(once, new).collect()] == [tuple(r) for r in once.collect()]


def test_keep_last_settles_equal_versions_the_same_way(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("b", 0, None)], "model_id string, version int, v string")
    for order in (df, df.orderBy(F.desc("v"))):
        assert sorted(map(tuple, leaderboard.keep_last(order).collect())) == [("a", 1, "y"), ("b", 0, None)]


def test_published_gains(spark):
    scores = "model_id string, token_f1_mean double"
    base = spark.createDataFrame([("s", 0.291853), ("l", 0.235372)], scores)
    tuned = spark.createDataFrame([("st", 0.453545), ("lt", 0.441057)], scores)
    lineage = spark.createDataFrame(
        [("st", "s", "tuned"), ("lt", "l", "tuned"), ("s", "s", "base")],
        "model_id string, base_model string, setup string",
    )
    got = {r.model_id: r for r in compare.tuned_gain(base, tuned, lineage).collect()}
    assert round(got["st"].gain, 3) == 0.162 and round(got["lt"].gain, 3) == 0.206
    assert got["st"].same_sample is None


def test_setup_comparison(spark):
    schema = "model_id string, vram double"
    left = spark.createDataFrame([("a", 10.0), ("b", 30.0)], schema)
    right = spark.createDataFrame([("a", 5.0), ("b", 15.0), ("c", 10.0)], schema)
    both = compare.compare_setups(left, right, "vram")
    assert both.count() == 3
    means = compare.setup_means(both.filter("model_id <> 'c'"), "vram").first()
    assert tuple(means) == (20.0, 10.0, -50.0)


# Published peak reserved memory in MB of eleven models, full and 4-bit.
FULL = [11860, 29492, 21176, 20140, 25450, 15382, 11208, 10792, 16422, 15058, 6926]
SMALL = [7078, 15242, 9094, 5762, 6346, 4728, 6844, 9144, 5964, 8058, 2818]


def test_published_memory(spark):
    """Means of 16,718.7 and 7,370.7 MB, a change of -55.9 percent."""
    boards = [
        spark.createDataFrame(
            [(f"m{i}", float(v)) for i, v in enumerate(values)], "model_id string, vram double"
        )
        for values in (FULL, SMALL)
    ]
    means = compare.setup_means(compare.compare_setups(*boards, "vram"), "vram").first()
    assert (round(means.vram_left, 1), round(means.vram_right, 1)) == (16718.7, 7370.7)
    assert round(means.vram_change_percent, 1) == -55.9
    averages = [summary.cross_model_means(b, "vram").first() for b in boards]
    assert [round(a.vram_avg, 1) for a in averages] == [16718.7, 7370.7]


def test_fingerprint_ignores_order_and_sees_changes(spark):
    a = spark.range(50).select(F.lit("m").alias("model_id"), F.col("id").alias("example_id"))
    first = compare.sample_fingerprint(a, "test").first()
    assert compare.sample_fingerprint(a.orderBy(F.desc("example_id")), "test").first() == first
    assert compare.sample_fingerprint(a, "validation").first() != first
    assert compare.sample_fingerprint(a.filter("example_id > 0"), "test").first() != first


def test_candidates_and_means(spark):
    rows = [("a", "s", 0.5), ("b", "s", 0.5), ("c", "s", None), ("d", "l", None)]
    df = spark.createDataFrame(rows, "model_id string, size string, f double")
    best = leaderboard.top_candidates(df, "size", "f", 2).collect()
    assert sorted((r.size, r.model_id, r.candidate_rank) for r in best) == [
        ("l", "d", 1), ("s", "a", 1), ("s", "b", 2)
    ]
    assert tuple(summary.cross_model_means(df, "f").first()) == (4, 0.5)


def test_disagreements(spark):
    rows = [("m", 1, 0.8, 0.577), ("m", 2, 0.9, 0.1), ("m", 3, 0.9, 0.9), ("m", 4, 0.1, 0.0)]
    df = spark.createDataFrame(rows, "model_id string, example_id long, token_f1 double, answer_similarity double")
    got = scoring.disagreements(df, 0.8, 0.6, 5).collect()
    assert [(r.example_id, r.gap_rank) for r in got] == [(2, 1), (1, 2)]
    assert scoring.disagreements(df, 0.8, 0.6, 1).count() == 1


def test_an_approximate_median_on_request(spark):
    rows = [(m, i, 0.5, float(v)) for m in ("a", None) for i, v in enumerate([*range(1, 2002), float("nan")])]
    schema = "model_id string, example_id long, token_f1 double, reference_answer_token_perplexity double"
    df = spark.createDataFrame(rows, schema)
    exact = {r.model_id: r for r in summary.summarize_predictions(df).collect()}
    near = {r.model_id: r for r in summary.summarize_predictions(df, median_accuracy=1000).collect()}
    assert set(near["a"].asDict()) == set(exact["a"].asDict())
    for model in ("a", None):
        name = "reference_answer_token_perplexity_median"
        assert exact[model][name] == 1001.0 and abs(near[model][name] - 1001) <= 3
