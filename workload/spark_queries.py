"""The registered Spark queries. Each takes ``(spark, sf_dir)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from evalweave import schemas
from evalweave.functions import arrays, chat, scalars, text
from evalweave.operators import (
    compare,
    config,
    hooks,
    leaderboard,
    quantiles,
    reshape,
    runs,
    sampling,
    scoring,
    summary,
)
from evalweave.plans import benchmark, dataset
from evalweave.sources import datasets, evaluations, leaderboards, predictions as prediction_files
from evalweave.storage import fresh_path, materialize
from evalweave.streaming import leaderboard as stream
from workload import inputs, stubs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits; perplexities, being exponentials, to four."""
    return df.select(
        *[
            F.round(f.name, 4 if "perplexity" in f.name else digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# Text metrics -------------------------------------------------------------------------


@query
def leaderboard_flagship(spark, sf):
    board = leaderboard.ranked_leaderboard(summary.summarize_predictions(inputs.scored(spark, sf)))
    rank = F.col("rank").cast("bigint").alias("rank")
    return rounded(board.select("model_id", rank, "n", "token_f1_mean", "token_f1_std"))


@query
def clean_answer(spark, sf):
    raw = F.concat(F.lit(" \n"), F.col("raw_generation"), F.lit(" \t　"))
    return inputs.predictions(spark, sf).select(
        "model_id", "example_id", text.clean_answer(raw).alias("cleaned")
    )


@query
def answer_tokens(spark, sf):
    tokens = text.answer_tokens(F.col("text")).alias("tokens")
    return (
        inputs.texts(spark, sf, "documents")
        .select("doc_id", tokens)
        .select(
            "doc_id",
            F.size("tokens").cast("bigint").alias("n_tokens"),
            F.md5(F.array_join("tokens", "|")).alias("tokens_md5"),
        )
    )


@query
def normalize_answer(spark, sf):
    return inputs.predictions(spark, sf).select(
        "model_id", "example_id", text.normalize_answer(F.col("raw_generation")).alias("normalized")
    )


@query
def token_f1_pairs(spark, sf):
    return rounded(
        inputs.scored(spark, sf).select(
            "model_id",
            "example_id",
            F.col("overlap").cast("bigint").alias("overlap"),
            "token_precision",
            "token_recall",
            "token_f1",
        )
    )


@query
def token_f1_documents(spark, sf):
    docs = inputs.texts(spark, sf, "documents")
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("following"))
    pairs = docs.select("doc_id", "text").join(following, "doc_id")
    f1 = text.token_f1(F.col("text"), F.col("following"))
    return rounded(pairs.select("doc_id", f1.alias("token_f1")))


@query
def multiset_overlap(spark, sf):
    shared = text.multiset_overlap(
        text.answer_tokens(F.col("question")), text.answer_tokens(F.col("raw_generation"))
    )
    return inputs.predictions(spark, sf).select(
        "model_id", "example_id", shared.cast("bigint").alias("shared_tokens")
    )


# Splits, samples, positions -----------------------------------------------------------


@query
def seeded_sample(spark, sf):
    docs = inputs.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return sampling.seeded_sample(docs, 500, seed=42, row_id="doc_id")


@query
def seeded_sample_large(spark, sf):
    items = inputs.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return sampling.seeded_sample(items, 12_000, seed=7, row_id="o_orderkey")


@query
def seeded_shuffle(spark, sf):
    docs = inputs.table(spark, sf, "documents").select("doc_id", "lang")
    return sampling.seeded_shuffle(docs, seed=7, row_id="doc_id", position="position")


@query
def split_exact(spark, sf):
    return inputs.split_documents(spark, sf).select("doc_id", "split")


@query
def split_sizes(spark, sf):
    sizes = inputs.split_documents(spark, sf).withColumn("split", F.concat("lang", F.lit(":"), "split"))
    expected = {"en:train": 1, "en:dev": 0}
    return sampling.check_split_sizes(sizes, expected)


@query
def split_caps(spark, sf):
    split = inputs.split_documents(spark, sf)
    unnamed = F.when((F.col("split") == "test") & (F.col("lang") == "fr"), None)
    split = split.withColumn("split", unnamed.otherwise(F.col("split")))
    caps = {"train": 300, "validation": 50, "test": None}
    return sampling.split_caps(split, caps, seed=42, row_id="doc_id").select("doc_id", "split")


@query
def dense_index(spark, sf):
    docs = inputs.table(spark, sf, "documents").select("doc_id", "lang")
    return sampling.dense_index(docs, "doc_id", seed=42, by=["lang"])


@query
def positional_index(spark, sf):
    events = inputs.table(spark, sf, "events").select("event_type", "event_id")
    return sampling.dense_index(events, "event_id", by=["event_type"])


@query
def batches(spark, sf):
    docs = inputs.table(spark, sf, "documents").select("doc_id")
    return sampling.batches(sampling.dense_index(docs, "doc_id", seed=42), 32)


# Chat examples ------------------------------------------------------------------------


def _chat(spark, sf):
    return reshape.to_chat(inputs.flashcards(spark, sf), inputs.SYSTEM_PROMPT)


@query
def chat_examples(spark, sf):
    return _chat(spark, sf).select(
        "example_id",
        F.array_join(F.transform("prompt", lambda m: m["role"]), ",").alias("roles"),
        F.get("prompt", F.lit(0))["content"].alias("system_text"),
        F.get("prompt", F.lit(1))["content"].alias("user_text"),
        F.get("completion", F.lit(0))["content"].alias("assistant_text"),
    )


@query
def chat_passthrough(spark, sf):
    ready = _chat(spark, sf).withColumn("extra", F.length(F.get("prompt", F.lit(1))["content"]))
    kept = reshape.to_chat(ready, "unused")
    return kept.select(
        "example_id",
        F.col("extra").cast("bigint").alias("extra"),
        F.get("prompt", F.lit(0))["content"].alias("system_text"),
    )


@query
def incomplete_rows(spark, sf):
    cards = inputs.flashcards(spark, sf)
    gaps = cards.withColumn("output", F.when(F.length("output") > 0, F.col("output")))
    kept = reshape.to_chat(reshape.complete_rows(gaps), inputs.SYSTEM_PROMPT)
    return (
        reshape.incomplete_rows(gaps)
        .select("example_id", F.lit(False).alias("kept"))
        .unionByName(kept.select("example_id", F.lit(True).alias("kept")))
    )


@query
def question_reference(spark, sf):
    return reshape.questions_and_references(_chat(spark, sf))


@query
def render_prompt(spark, sf):
    requests = reshape.fan_out(_chat(spark, sf), inputs.MODELS)
    rendered = reshape.render_prompts(requests, inputs.templates(spark))
    return rendered.select("model_id", "example_id", "rendered")


@query
def split_filter(spark, sf):
    return reshape.select_split(inputs.split_flashcards(spark, sf), "validation")


# Data set sources ---------------------------------------------------------------------


def _published(spark, sf):
    path = fresh_path(spark, "dataset")
    dataset.build_dataset(inputs.flashcards(spark, sf), path, "r1", 0.6)
    return path


@query
def publish_splits(spark, sf):
    return datasets.load_dataset(spark, _published(spark, sf), "r1")


@query
def source_revision(spark, sf):
    path = _published(spark, sf)
    changed = inputs.split_flashcards(spark, sf).withColumn("output", F.upper("split"))
    datasets.publish_dataset(changed, path, "r0")
    newest = datasets.load_dataset(spark, path).groupBy("split", "output")
    first = datasets.load_dataset(spark, path, "r1").groupBy("split")
    return newest.agg(F.count("*").alias("newest_rows")).join(
        first.agg(F.sum(F.length("output")).alias("first_chars")), "split"
    )


@query
def prepared_dataset(spark, sf):
    prepared = datasets.load_prepared(
        spark,
        _published(spark, sf),
        inputs.SYSTEM_PROMPT,
        caps={"train": 100, "validation": 20},
    )
    return prepared.select(
        "split",
        "example_id",
        chat.question_of(F.col("prompt")).alias("question"),
        chat.reference_of(F.col("completion")).alias("reference_answer"),
    )


# Scores -------------------------------------------------------------------------------


@query
def embedding_cosine(spark, sf):
    pairs = scoring.similarity_where_valid(inputs.vec_pairs(spark, sf), "gen_vec", "ref_vec")
    return rounded(pairs.select("example_id", "answer_similarity"))


@query
def valid_pairs(spark, sf):
    scored = inputs.scored(spark, sf)
    valid = arrays.both_answered(F.col("generated_answer"), F.col("reference_answer"))
    return scored.select("model_id", "example_id", valid.alias("valid"))


@query
def reference_scores(spark, sf):
    scores = inputs.reference_scores(spark, sf)
    tokens = F.col("reference_answer_tokens").cast("bigint")
    return rounded(scores.withColumn("reference_answer_tokens", tokens))


@query
def scored_predictions(spark, sf):
    scores = inputs.reference_scores(spark, sf).select(
        "model_id", "example_id", "reference_answer_nll_mean"
    )
    left = inputs.scored(spark, sf).select("model_id", "example_id", "generated_answer", "token_f1")
    return rounded(scoring.attach_reference_scores(left, scores))


@query
def summary_full(spark, sf):
    scored = materialize(inputs.fully_scored(spark, sf), "scored")
    return rounded(summary.summarize_predictions(scored))


@query
def summary_minimal(spark, sf):
    return rounded(summary.summarize_predictions(inputs.scored(spark, sf)))


@query
def exact_median(spark, sf):
    events = inputs.table(spark, sf, "events")
    return rounded(
        quantiles.exact_median(events, ["event_type"], "value", ["event_id"], "value_median")
    )


# Token arrays -------------------------------------------------------------------------


@query
def token_count(spark, sf):
    count = arrays.generated_token_count(F.col("ids"), F.col("eos_id"), F.col("pad_id"))
    return inputs.token_arrays(spark, sf).select(
        "user_id", "chunk", count.cast("bigint").alias("generated_tokens")
    )


@query
def span_slice(spark, sf):
    rows = inputs.token_arrays(spark, sf)
    prompt_length = (F.col("user_id") % 3 + 1).cast("int")
    logprobs = F.transform("ids", lambda t: -t / 4)
    target = arrays.target_logprobs(logprobs, prompt_length, F.lit(2))
    return rows.select(
        "user_id",
        "chunk",
        F.array_join(arrays.new_tokens(F.col("ids"), prompt_length).cast("array<string>"), ",").alias(
            "new_ids"
        ),
        F.aggregate(target, F.lit(0.0), lambda s, x: s + x).alias("target_sum"),
    )


@query
def pad_default(spark, sf):
    return inputs.token_arrays(spark, sf).select(
        "user_id",
        "chunk",
        arrays.pad_or_eos(F.col("pad_id"), F.col("eos_id")).cast("bigint").alias("pad_id"),
    )


# Telemetry ----------------------------------------------------------------------------


@query
def batch_rates(spark, sf):
    rates = summary.batch_rates(inputs.batch_stats(spark, sf))
    return rounded(rates.drop("generated_tokens_per_example"))


def _telemetry(spark, sf):
    batches = summary.batch_rates(inputs.batch_stats(spark, sf))
    reference = inputs.batch_rows(spark, sf).select(
        "model_id", "reference_seconds", F.lit(1).cast("bigint").alias("examples")
    )
    return summary.run_telemetry(batches, reference)


def _memory(spark, sf):
    samples = inputs.batch_rows(spark, sf).select(
        "model_id",
        "device",
        F.col("memory_bytes").alias("allocated_bytes"),
        (F.col("memory_bytes") * 2).alias("reserved_bytes"),
    )
    return summary.peak_memory(samples)


@query
def run_telemetry(spark, sf):
    return rounded(_telemetry(spark, sf))


@query
def run_telemetry_without_reference(spark, sf):
    return rounded(summary.run_telemetry(summary.batch_rates(inputs.batch_stats(spark, sf))))


@query
def peak_memory(spark, sf):
    return rounded(_memory(spark, sf))


@query
def summary_telemetry(spark, sf):
    events = inputs.table(spark, sf, "events").select(
        F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("model_id"),
        (F.col("value") / 1000).alias("token_f1"),
    )
    own = summary.summarize_predictions(events).withColumn("generation_tokens", F.lit(-1))
    telemetry = _telemetry(spark, sf).join(_memory(spark, sf), "model_id", "left")
    joined = summary.attach_telemetry(own, telemetry)
    return rounded(
        joined.select(
            "model_id", "n", "token_f1_mean", "generation_tokens", "total_inference_seconds",
            "vram_peak_reserved_mb",
        )
    )


# Leaderboards -------------------------------------------------------------------------


def _board(predictions: DataFrame) -> DataFrame:
    return summary.summarize_predictions(scoring.score_answers(predictions))


def _versions(spark, sf):
    old = _board(inputs.predictions(spark, sf)).withColumn("version", F.lit(1))
    new = _board(inputs.reevaluated(spark, sf)).withColumns(
        {"version": F.lit(2), "note": F.lit("again")}
    )
    return old, new


def _plain(board: DataFrame, *extra: str) -> DataFrame:
    return rounded(board.select("model_id", "n", "token_f1_mean", "token_f1_std", *extra))


@query
def leaderboard_upsert(spark, sf):
    old, new = _versions(spark, sf)
    merged = leaderboard.upsert(old, new)
    return _plain(merged.withColumn("version", F.col("version").cast("bigint")), "version", "note")


@query
def keep_last(spark, sf):
    log = inputs.eval_log(spark, sf)
    return leaderboard.keep_last(log, key="run_id", version="step")


@query
def leaderboard_rebuild(spark, sf):
    path = fresh_path(spark, "board")
    old, new = _versions(spark, sf)
    schema = T.StructType(old.drop("version").schema.fields)
    leaderboards.write_leaderboard(old.drop("version"), path)
    leaderboards.write_leaderboard(new.select(*schema.fieldNames()), path)
    return _plain(leaderboards.read_leaderboard(spark, path, schema))


@query
def schema_union(spark, sf):
    path = fresh_path(spark, "history")
    old, new = _versions(spark, sf)
    leaderboards.append_history(old.withColumn("run", F.lit("first")), path)
    leaderboards.append_history(
        new.drop("answer_similarity_mean").withColumn("run", F.lit("second")), path
    )
    return _plain(leaderboards.read_history(spark, path), "run", "note")


@query
def leaderboard_concat(spark, sf):
    old, new = _versions(spark, sf)
    return _plain(leaderboard.concat(old, new), "note")


@query
def model_slug(spark, sf):
    model_id = F.col("model_id")
    return (
        inputs.predictions(spark, sf)
        .groupBy("model_id")
        .agg(F.count("*").alias("n"))
        .select(
            text.model_slug(model_id).alias("file_slug"),
            text.model_slug(model_id, "_").alias("run_slug"),
            "n",
        )
    )


def _files(spark, sf, file_format):
    path = fresh_path(spark, "predictions")
    rows = inputs.predictions(spark, sf)
    prediction_files.write_predictions(rows, path, file_format)
    prediction_files.write_predictions(inputs.reevaluated(spark, sf), path, file_format)
    return prediction_files.read_predictions(spark, path, rows.schema, file_format)


@query
def write_read_predictions(spark, sf):
    return _files(spark, sf, "parquet")


@query
def write_read_predictions_csv(spark, sf):
    return _files(spark, sf, "csv")


@query
def write_read_leaderboard(spark, sf):
    path = fresh_path(spark, "board")
    old, new = (side.drop("version", "note") for side in _versions(spark, sf))
    schema = T.StructType(old.schema.fields)
    absent = leaderboards.read_leaderboard(spark, path, schema)
    leaderboards.update_leaderboard(leaderboard.concat(absent, old), path, schema)
    leaderboards.update_leaderboard(new, path, schema)
    return _plain(leaderboards.read_leaderboard(spark, path, schema))


# Comparisons --------------------------------------------------------------------------


@query
def sample_fingerprint(spark, sf):
    return compare.sample_fingerprint(inputs.predictions(spark, sf), "test")


@query
def tuned_gain(spark, sf):
    predictions = inputs.predictions(spark, sf)
    board = _board(predictions)
    fingerprints = compare.sample_fingerprint(predictions, "test")
    return rounded(compare.tuned_gain(board, board, inputs.lineage(spark), fingerprints))


def _setups(spark, sf):
    return compare.compare_setups(
        _board(inputs.predictions(spark, sf)),
        _board(inputs.low_precision(spark, sf)),
        "token_f1_mean",
    )


@query
def quant_compare(spark, sf):
    return rounded(_setups(spark, sf))


@query
def quant_means(spark, sf):
    return rounded(compare.setup_means(_setups(spark, sf), "token_f1_mean"))


def _memory_setups(spark, sf):
    full = _memory(spark, sf)
    small = full.withColumn("vram_peak_reserved_mb", F.col("vram_peak_reserved_mb") * 0.44)
    # A model that was measured in one setup only.
    small = small.filter(F.col("model_id") != "m4")
    return compare.compare_setups(full, small, "vram_peak_reserved_mb")


@query
def quant_memory(spark, sf):
    return rounded(_memory_setups(spark, sf))


@query
def quant_memory_means(spark, sf):
    return rounded(compare.setup_means(_memory_setups(spark, sf), "vram_peak_reserved_mb"))


@query
def cross_model_telemetry(spark, sf):
    board = _memory(spark, sf).join(_telemetry(spark, sf), "model_id")
    metrics = ("vram_peak_reserved_mb", "vram_peak_allocated_mb", "generation_tokens_per_second")
    return rounded(summary.cross_model_means(board, *metrics))


@query
def quant_similarity(spark, sf):
    boards = []
    for source in (inputs.predictions, inputs.low_precision):
        scored = scoring.score_answers(source(spark, sf)).select("model_id", "example_id", "token_f1")
        boards.append(summary.summarize_predictions(inputs.with_similarity(spark, sf, scored)))
    metrics = ("token_f1_mean", "answer_similarity_mean")
    return rounded(compare.setup_means(compare.compare_setups(*boards, *metrics), *metrics))


@query
def top_candidates(spark, sf):
    best = leaderboard.top_candidates(
        _board(inputs.predictions(spark, sf)), "size_class", "token_f1_mean", 1, inputs.lineage(spark)
    )
    return rounded(best.select("size_class", "model_id", "token_f1_mean"))


@query
def cross_model_means(spark, sf):
    board = _board(inputs.predictions(spark, sf))
    return rounded(summary.cross_model_means(board, "token_f1_mean", "token_f1_std"))


@query
def disagreement_report(spark, sf):
    scored = inputs.scored(spark, sf).select("model_id", "example_id", "token_f1")
    report = scoring.disagreements(inputs.with_similarity(spark, sf, scored), 0.8, 0.0, 20)
    return rounded(report.withColumn("gap_rank", F.col("gap_rank").cast("bigint")))


# Training logs ------------------------------------------------------------------------


@query
def best_checkpoint(spark, sf):
    return runs.best_checkpoint(inputs.eval_log(spark, sf))


@query
def best_trial(spark, sf):
    return runs.best_trial(inputs.eval_log(spark, sf))


@query
def early_stop(spark, sf):
    return runs.early_stop(inputs.eval_log(spark, sf), patience=5)


# Model hooks --------------------------------------------------------------------------


def _requests(spark, sf):
    cards = inputs.flashcards(spark, sf)
    return reshape.fan_out(cards, inputs.MODELS).select(
        "model_id",
        "example_id",
        F.col("input").alias("prompt"),
        text.clean_answer(F.col("output")).alias("reference_answer"),
    )


@query
def generate_hook(spark, sf):
    requests = _requests(spark, sf)
    generations = materialize(hooks.generate(requests, stubs.make_generator), "generations")
    answered = hooks.attach_generations(requests, generations)
    return answered.select(
        "model_id",
        "example_id",
        "raw_generation",
        F.col("generated_tokens").cast("bigint").alias("generated_tokens"),
    )


@query
def generate_resumed(spark, sf):
    """A run that was interrupted after some models and is started again for all of them."""
    requests = _requests(spark, sf)
    journal = fresh_path(spark, "journal")
    first = requests.filter(F.col("model_id") == inputs.MODELS[0])
    materialize(hooks.generate(first, stubs.make_generator, journal=journal), "generations")
    resumed = hooks.generate(requests, stubs.make_generator, journal=journal)
    answered = hooks.attach_generations(requests, materialize(resumed, "generations"))
    return answered.select(
        "model_id",
        "example_id",
        "raw_generation",
        F.col("generated_tokens").cast("bigint").alias("generated_tokens"),
    )


@query
def generation_accounting(spark, sf):
    generations = materialize(
        hooks.generate(_requests(spark, sf), stubs.make_generator, batch_size=16), "generations"
    )
    rates = summary.batch_rates(hooks.batch_stats(generations))
    telemetry = summary.run_telemetry(rates)
    largest = generations.groupBy("model_id").agg(F.max("batch_rows").alias("largest"))
    return telemetry.join(largest, "model_id").select(
        "model_id",
        "generation_tokens",
        (F.col("generation_inference_seconds") > 0).alias("timed"),
        (F.col("largest") <= 16).alias("batched"),
    )


@query
def scorer_hook(spark, sf):
    scored = materialize(
        hooks.score_references(_requests(spark, sf), stubs.make_scorer), "reference-scores"
    )
    scores = scoring.reference_scores_from_arrays(scored)
    tokens = F.col("reference_answer_tokens").cast("bigint")
    return rounded(scores.withColumn("reference_answer_tokens", tokens))


@query
def embed_hook(spark, sf):
    scored = materialize(
        inputs.scored(spark, sf).select(
            "model_id", "example_id", "generated_answer", "reference_answer"
        ),
        "scored",
    )
    vectors = materialize(hooks.embed(hooks.distinct_texts(scored), stubs.make_embedder), "vectors")
    with_similarity = hooks.attach_similarity(scored, vectors)
    return rounded(with_similarity.select("model_id", "example_id", "answer_similarity"))


@query
def error_isolation(spark, sf):
    generations = materialize(
        hooks.generate(_requests(spark, sf), stubs.make_failing_generator), "generations"
    )
    errors = hooks.model_errors(generations)
    kept = hooks.without_failed_models(generations, errors).groupBy("model_id")
    return (
        kept.agg(F.count("*").alias("kept_examples"))
        .join(errors, "model_id", "full")
        .select("model_id", "kept_examples", "failed_examples", "error")
    )


@query
def benchmark_run(spark, sf):
    split = inputs.split_flashcards(spark, sf)
    examples = benchmark.eval_split(split, "validation", inputs.SYSTEM_PROMPT, size=None)
    result = benchmark.evaluate(
        examples,
        inputs.MODELS,
        stubs.make_failing_generator,
        stubs.make_scorer,
        stubs.make_embedder,
        inputs.templates(spark),
    )
    path = fresh_path(spark, "benchmark")
    benchmark.save(result, path)
    board = evaluations.read_board(spark, path)
    measured = [c for c in schemas.LEADERBOARD_METRICS if c != "reference_answer_nll_std"]
    return rounded(board.select("model_id", "n", *measured, "generation_tokens"), 5)


# Streaming ----------------------------------------------------------------------------


@query
def stream_leaderboard(spark, sf):
    source, store, board, checkpoint = (
        fresh_path(spark, name) for name in ("arriving", "store", "board", "progress")
    )
    first = inputs.predictions(spark, sf).withColumn("evaluation", F.lit(1).cast("bigint"))
    again = inputs.reevaluated(spark, sf).withColumn("evaluation", F.lit(2).cast("bigint"))
    board_schema = T.StructType(
        [f for f in schemas.LEADERBOARD.fields if f.name in ("model_id", "n")]
        + [
            T.StructField(f"{name}_{part}", T.DoubleType())
            for name in ("token_f1", "answer_similarity")
            for part in ("mean", "std")
        ]
    )
    for delivery in (first, again):
        delivery.write.mode("append").parquet(source)
        stream.start_leaderboard_stream(
            spark, source, first.schema, store, board, board_schema, checkpoint
        ).awaitTermination()
    return _plain(leaderboards.read_leaderboard(spark, board, board_schema))


# Run configurations -------------------------------------------------------------------


@query
def flatten_record(spark, sf):
    orders = inputs.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.struct(
            F.col("o_orderstatus").alias("status"),
            F.struct(F.col("o_orderpriority").alias("level")).alias("priority"),
        ).alias("training"),
        F.struct(F.col("o_custkey").alias("r")).alias("lora"),
    )
    return config.flatten_record(orders)


@query
def override_merge(spark, sf):
    return config.dotted_overrides(inputs.base_kv(spark, sf), inputs.override_kv(spark, sf))


@query
def layered_merge(spark, sf):
    return config.layered_merge(inputs.base_kv(spark, sf), inputs.override_kv(spark, sf))


@query
def section_merge(spark, sf):
    return config.layered_merge(inputs.base_kv(spark, sf), inputs.section_kv(spark, sf))


@query
def changed_keys(spark, sf):
    return config.changed_keys(inputs.base_kv(spark, sf), inputs.override_kv(spark, sf))


_IDS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query
def parse_override(spark, sf):
    parsed = scalars.parse_override(F.col("raw")).alias("p")
    return inputs.override_strings(spark, sf).select(*_IDS, parsed).select(*_IDS, "p.*")


@query
def parse_scalar(spark, sf):
    rows = inputs.override_strings(spark, sf)
    value = scalars.parse_override(F.col("raw"))["value"].alias("value")
    parsed = scalars.parse_scalar(F.col("value")).alias("v")
    return rows.select(*_IDS, value).select(*_IDS, parsed).select(*_IDS, "v.*")
