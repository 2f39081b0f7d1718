"""Model hooks: keys, batches, errors, embeddings."""

from __future__ import annotations

import os
import uuid
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalweave.operators import hooks, scoring


@pytest.fixture
def requests(spark):
    ids = spark.range(100).withColumnRenamed("id", "example_id")
    models = F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model_id")
    return ids.select(
        models,
        "example_id",
        F.concat(F.lit("q"), F.col("example_id").cast("string")).alias("prompt"),
        F.when(F.col("example_id") > 0, F.lit("x y")).otherwise("").alias("reference_answer"),
    )


def make_backwards(model_id):
    """Answers in reverse order: only the key tells which is which."""

    def generate(batch):
        return pd.DataFrame(
            {
                "example_id": batch["example_id"],
                "raw_generation": model_id + batch["prompt"],
                "generated_tokens": 2,
            }
        ).iloc[::-1]

    return generate


def make_forgetful(model_id):
    return lambda batch: make_backwards(model_id)(batch).iloc[1:]


def make_sometimes_broken(model_id):
    def generate(batch):
        if model_id == "b" and (batch["example_id"] == 17).any():
            raise ValueError("bad example")
        return make_backwards(model_id)(batch)

    return generate


def make_unloadable(model_id):
    if model_id == "b":
        raise RuntimeError("no such model")
    return make_backwards(model_id)


def test_generations_follow_their_key(requests):
    out = hooks.generate(requests, make_backwards, batch_size=7, partitions=3)
    rows = hooks.attach_generations(requests, out).collect()
    assert len(rows) == 200
    assert all(r.raw_generation == r.model_id + r.prompt and r.generated_tokens == 2 for r in rows)


def test_batches_are_bounded_and_accounted(requests):
    out = hooks.generate(requests, make_backwards, batch_size=7, partitions=3)
    stats = hooks.batch_stats(out).collect()
    assert sum(s.generated_tokens for s in stats) == 400
    assert max(len(s.generated_tokens_per_example) for s in stats) == 7
    assert all(s.inference_seconds >= 0 for s in stats)


def test_missing_answers_are_errors(requests):
    out = hooks.generate(requests, make_forgetful, batch_size=50)
    assert out.filter(F.col("error").contains("exactly once")).count() == 200


def test_one_bad_batch_excludes_the_model(requests, spark):
    out = spark.createDataFrame(
        hooks.generate(requests, make_sometimes_broken, batch_size=10).collect()
    )
    errors = hooks.model_errors(out).collect()
    assert [e.model_id for e in errors] == ["b"] and "bad example" in errors[0].error
    assert 0 < errors[0].failed_examples <= 10
    kept = hooks.without_failed_models(out, hooks.model_errors(out))
    assert {r.model_id: r["count"] for r in kept.groupBy("model_id").count().collect()} == {"a": 100}


def test_unloadable_model(requests):
    out = hooks.generate(requests, make_unloadable, batch_size=10)
    failed = out.filter("error is not null").select("model_id").distinct().collect()
    assert [r.model_id for r in failed] == ["b"]
    assert out.filter("error is not null").count() == 100


def test_fail_ends_the_run(requests):
    with pytest.raises(Exception, match="no such model"):
        hooks.generate(requests, make_unloadable, on_error="fail").collect()
    with pytest.raises(ValueError):
        hooks.generate(requests, make_unloadable, on_error="ignore")


def make_scorer(model_id):
    return lambda batch: pd.DataFrame(
        {
            "example_id": batch["example_id"],
            "token_logprobs": [[-1.0] * len(r.split()) for r in batch["reference_answer"]],
        }
    )


def test_scorer(requests):
    scored = hooks.score_references(requests, make_scorer)
    rows = scoring.reference_scores_from_arrays(scored).collect()
    assert len(rows) == 200
    for row in rows:
        if row.example_id == 0:
            assert (row.reference_answer_nll_mean, row.reference_answer_tokens) == (None, 0)
        else:
            assert (row.reference_answer_nll_mean, row.reference_answer_tokens) == (1.0, 2)
    stats = hooks.scoring_stats(scored).groupBy("model_id").agg(F.sum("examples").alias("n"))
    assert {r.model_id: r.n for r in stats.collect()} == {"a": 100, "b": 100}


def make_embedder():
    return lambda texts: [[float(len(t)), 1.0] for t in texts]


def test_similarity_encodes_each_text_once(spark):
    rows = [
        ("a", 1, "xx", "xx"), ("a", 2, "", "xx"), ("a", 3, "xxx", None), ("b", 1, "xxxx", "xx"),
    ] + [("c", i, "common answer", "xx") for i in range(200)]
    df = spark.createDataFrame(
        rows, "model_id string, example_id long, generated_answer string, reference_answer string"
    )
    texts = hooks.distinct_texts(df)
    assert sorted(r.text for r in texts.collect()) == ["common answer", "xx", "xxxx"]
    got = hooks.attach_similarity(df, hooks.embed(texts, make_embedder)).collect()
    assert len(got) == len(rows)
    by_key = {(r.model_id, r.example_id): r.answer_similarity for r in got}
    assert by_key["a", 1] == pytest.approx(1.0)
    assert by_key["a", 2] is None and by_key["a", 3] is None
    assert by_key["b", 1] == pytest.approx(9 / (17**0.5 * 5**0.5))
    assert by_key["c", 7] == pytest.approx(27 / (170**0.5 * 5**0.5))


def make_picky_embedder():
    def encode(texts):
        if any("bad" in t for t in texts):
            raise ValueError("cannot embed this")
        return [[float(len(t)), 1.0] for t in texts]

    return encode


def test_failing_embeddings_are_isolated(spark):
    rows = [("a", 1, "good one", "fine"), ("a", 2, "good", "fine"), ("b", 1, "bad", "fine")]
    scored = spark.createDataFrame(
        rows, "model_id string, example_id long, generated_answer string, reference_answer string"
    )
    texts = hooks.distinct_texts(scored)
    with pytest.raises(Exception, match="cannot embed this"):
        hooks.embed(texts, make_picky_embedder).collect()
    vectors = hooks.embed(texts, make_picky_embedder, on_error="skip").cache()
    assert vectors.filter("embedding is null").count() == 1
    errors = hooks.embedding_errors(scored, vectors).collect()
    assert [(e.model_id, e.failed_examples) for e in errors] == [("b", 1)]
    similar = hooks.attach_similarity(scored, vectors).collect()
    assert {(r.model_id, r.example_id) for r in similar if r.answer_similarity is not None} == {
        ("a", 1), ("a", 2),
    }


def test_a_model_that_fails_twice_has_one_row(spark):
    first = spark.createDataFrame([("a", 2, "one")], "model_id string, failed_examples long, error string")
    more = spark.createDataFrame([("a", 3, "a two"), ("b", 1, "x")], first.schema)
    got = {r.model_id: (r.failed_examples, r.error) for r in hooks.merge_errors(first, more).collect()}
    assert got == {"a": (5, "one"), "b": (1, "x")}


# The journal ---------------------------------------------------------------------------------


def counting(calls, dies_at=None):
    """A generator that notes its calls in files, and ends its process at one of them."""

    def make(model_id):
        generate = make_backwards(model_id)

        def noted(batch):
            (calls / uuid.uuid4().hex).write_text("\n".join(f"{model_id} {i}" for i in batch["example_id"]))
            if dies_at is not None and len(list(calls.iterdir())) >= dies_at:
                os._exit(1)
            return generate(batch)

        return noted

    return make


def asked(calls):
    return Counter(line for file in calls.iterdir() for line in file.read_text().split("\n"))


def answers(df):
    return sorted((r.model_id, r.example_id, r.raw_generation, r.generated_tokens) for r in df.collect())


def test_a_killed_task_repeats_one_batch_at_most(requests, tmp_path):
    calls, journal = tmp_path / "calls", str(tmp_path / "journal")
    calls.mkdir()
    with pytest.raises(Exception):
        hooks.generate(requests, counting(calls, 6), batch_size=10, partitions=1, journal=journal).collect()
    assert len(list(calls.iterdir())) == 6
    again = hooks.generate(requests, counting(calls), batch_size=10, partitions=1, journal=journal)
    assert answers(again) == answers(hooks.generate(requests, make_backwards))
    assert sorted(asked(calls).values()) == [1] * 190 + [2] * 10
    # Batches keep their time and size; other layouts and further readings ask for nothing.
    assert hooks.batch_stats(again).agg(F.sum("generated_tokens")).first()[0] == 400
    other = hooks.generate(requests, counting(calls), batch_size=7, partitions=5, journal=journal)
    assert answers(other) == answers(again) and sum(asked(calls).values()) == 210


def test_a_retried_task_finds_its_own_batches(requests, tmp_path):
    """The journal is looked into for every batch, not only when the job is planned."""
    calls, journal = tmp_path / "calls", str(tmp_path / "journal")
    calls.mkdir()
    planned = hooks.generate(requests, counting(calls), batch_size=10, partitions=3, journal=journal)
    first = answers(planned)
    assert answers(planned) == first and set(asked(calls).values()) == {1}


def test_changed_prompts_and_failures_are_asked_again(requests, tmp_path):
    calls, journal = tmp_path / "calls", str(tmp_path / "journal")
    calls.mkdir()
    failed = hooks.generate(requests, make_sometimes_broken, batch_size=10, journal=journal)
    n_failed = failed.filter("error is not null").count()
    changed = requests.withColumn(
        "prompt", F.when(F.col("example_id") < 5, F.lit("new")).otherwise(F.col("prompt"))
    )
    got = answers(hooks.generate(changed, counting(calls), batch_size=10, journal=journal))
    assert got == answers(hooks.generate(changed, make_backwards))
    lost = {f"b {r.example_id}" for r in failed.filter("error is not null").collect()} if n_failed else set()
    assert {f"{m} {i}" for m in "ab" for i in range(5)} <= set(asked(calls))
    assert len(asked(calls)) <= 10 + max(n_failed, len(lost))


def test_scores_are_kept_as_well(requests, tmp_path):
    journal = str(tmp_path / "journal")
    first = hooks.score_references(requests, make_scorer, journal=journal).collect()
    again = hooks.score_references(requests, make_unloadable, journal=journal, on_error="fail").collect()
    pick = lambda rows: sorted((r.model_id, r.example_id, r.token_logprobs) for r in rows)
    assert pick(again) == pick(first)
