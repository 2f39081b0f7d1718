"""Inputs of the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evalweave.functions import text
from evalweave.operators import sampling, scoring
from evalweave.operators.reshape import fan_out
from evalweave.sources.tables import read_table

MODELS = ("org/echo", "org/lead", "org/parrot", "org/blank")
SYSTEM_PROMPT = "You are an expert on every subject.\n"


# Tables whose rows are texts, with a key that tells rows apart.
_TEXT_KEYS = {"documents": ("doc_id",), "conversations": ("conv_id", "turn")}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of texts, on all cores however few files it has."""
    return read_table(spark, f"{sf}/{name}.parquet", *_TEXT_KEYS[name])


def flashcards(spark: SparkSession, sf: str) -> DataFrame:
    """Every user turn with the assistant turn that follows it."""
    turns = texts(spark, sf, "conversations")
    example_id = F.col("conv_id") * 1_000_000_000 + F.col("turn")
    asked = turns.filter(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("input"),
        example_id.alias("example_id"),
    )
    answered = turns.filter(F.col("role") == "assistant").select(
        "conv_id", "turn", F.col("text").alias("answer")
    )
    empty = F.col("example_id") % 97 == 0
    return asked.join(answered, ["conv_id", "turn"]).select(
        "example_id",
        F.lit("Answer the question.").alias("instruction"),
        "input",
        F.when(empty, "").otherwise(F.col("answer")).alias("output"),
    )


def _per_model(cases: dict[str, Column]) -> Column:
    chosen = None
    for model_id, value in cases.items():
        matches = F.col("model_id") == model_id
        chosen = F.when(matches, value) if chosen is None else chosen.when(matches, value)
    return chosen


def _predict(cards: DataFrame, cases: dict[str, Column]) -> DataFrame:
    return fan_out(cards, list(cases)).select(
        "model_id",
        "example_id",
        F.col("input").alias("question"),
        F.col("output").alias("reference_answer"),
        _per_model(cases).alias("raw_generation"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Four synthetic models over every example."""
    output, question = F.col("output"), F.col("input")
    return _predict(
        flashcards(spark, sf),
        {
            "org/echo": F.concat(F.lit("Answer: "), output),
            "org/lead": F.concat(question, F.lit(" "), output),
            "org/parrot": question,
            "org/blank": F.when(F.col("example_id") % 2 == 0, "").otherwise(
                F.concat(F.lit("assistant :  The "), output)
            ),
        },
    )


def reevaluated(spark: SparkSession, sf: str) -> DataFrame:
    """A later evaluation of two of the models, with other answers."""
    output, question = F.col("output"), F.col("input")
    return _predict(
        flashcards(spark, sf),
        {
            "org/lead": F.concat(output, F.lit(" "), output),
            "org/blank": F.concat(F.lit("Assistant: "), question),
        },
    )


def low_precision(spark: SparkSession, sf: str) -> DataFrame:
    """The same models in another setup: every answer also repeats the question."""
    return predictions(spark, sf).withColumn(
        "raw_generation", F.concat("raw_generation", F.lit(" "), "question")
    )


def vec_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector with the next one; every 50th generated vector is missing."""
    vectors = table(spark, sf, "embeddings")
    gen = vectors.select(
        F.col("vec_id").alias("example_id"),
        F.when(F.col("vec_id") % 50 != 0, F.col("embedding")).alias("gen_vec"),
    )
    ref = vectors.select((F.col("vec_id") - 1).alias("example_id"), F.col("embedding").alias("ref_vec"))
    return gen.join(ref, "example_id")


def _spread(example_id: Column) -> Column:
    """A number that differs between the first turns of neighbouring conversations."""
    return F.floor(example_id / 1_000_000_000) * 31 + example_id % 1_000_000_000


def with_similarity(spark: SparkSession, sf: str, scored: DataFrame) -> DataFrame:
    """Predictions with the similarity of a vector pair; examples are spread over all pairs."""
    pairs = scoring.similarity_where_valid(vec_pairs(spark, sf), "gen_vec", "ref_vec")
    similarity = pairs.select(F.col("example_id").alias("pair_id"), "answer_similarity")
    n = table(spark, sf, "embeddings").agg(F.count("*")).scalar()
    return (
        scored.withColumn("pair_id", _spread(F.col("example_id")) % n)
        .join(similarity, "pair_id", "left")
        .drop("pair_id")
    )


def token_logprobs(spark: SparkSession, sf: str) -> DataFrame:
    """Reference tokens scored by a smoothed unigram model of all documents.

    One row per model, example and distinct token, with the number of its occurrences:
    ``model_id, example_id, logprob, n``. References are the same for every model, so
    tokens are counted and looked up once and then scored per model.
    """
    words = texts(spark, sf, "documents").select(
        F.explode(text.answer_tokens(F.col("text"))).alias("tok")
    )
    unigram = words.groupBy("tok").agg(F.count("*").alias("c"))
    counted = (
        flashcards(spark, sf)
        .select(
            "example_id",
            F.explode(text.answer_tokens(text.clean_answer(F.col("output")))).alias("tok"),
        )
        .groupBy("example_id", "tok")
        .agg(F.count("*").alias("n"))
        .join(unigram, "tok", "left")
    )
    alpha = F.when(F.col("model_id").isin("org/echo", "org/lead"), 1.0).otherwise(0.5)
    total = unigram.agg(F.struct(F.sum("c").alias("n"), F.count("*").alias("v"))).scalar()
    smoothed = (F.coalesce("c", F.lit(0)) + alpha) / (total["n"] + alpha * (total["v"] + 1))
    return fan_out(counted, MODELS).select(
        "model_id", "example_id", F.ln(smoothed).alias("logprob"), "n"
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score_answers(predictions(spark, sf))


def reference_scores(spark: SparkSession, sf: str) -> DataFrame:
    examples = fan_out(flashcards(spark, sf).select("example_id"), MODELS)
    return scoring.reference_scores(token_logprobs(spark, sf), examples)


def fully_scored(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions with token F1, similarity and reference scores."""
    with_sim = with_similarity(
        spark, sf, scored(spark, sf).select("model_id", "example_id", "token_f1")
    )
    return scoring.attach_reference_scores(with_sim, reference_scores(spark, sf))


def token_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids per user and thousand events (0 padding, 2 EOS, 1 other); a chunk
    holds at most a thousand ids. EOS and padding are not set for some users."""
    user = F.col("user_id")
    code = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "view", 0)
    rows = table(spark, sf, "events").select(
        "user_id",
        F.floor(F.col("event_id") / 1000).cast("int").alias("chunk"),
        F.struct("event_id", code.otherwise(1).alias("token_id")).alias("token"),
    )
    return rows.groupBy("user_id", "chunk").agg(
        F.transform(F.sort_array(F.collect_list("token")), lambda t: t["token_id"]).alias("ids")
    ).select(
        "user_id",
        "chunk",
        F.when(user % 5 != 0, F.lit(2)).alias("eos_id"),
        F.when(user % 10 != 0, F.lit(0)).alias("pad_id"),
        "ids",
    )


def batch_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One generated example per event, in batches of 32 events, for five models."""
    user, value = F.col("user_id"), F.col("value")
    return table(spark, sf, "events").select(
        F.concat(F.lit("m"), (user % 5).cast("string")).alias("model_id"),
        F.floor(F.col("event_id") / 32).alias("batch_id"),
        F.col("event_type").alias("device"),
        F.when(user % 5 == 4, 0.0).otherwise(value / 100).alias("inference_seconds"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("generated_tokens"),
        F.when(user % 5 != 3, value / 1000).alias("reference_seconds"),
        (F.floor(value) * 1048576).alias("memory_bytes"),
    )


def batch_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Per batch: seconds and the token counts of its (at most 32) examples."""
    return (
        batch_rows(spark, sf)
        .groupBy("model_id", "batch_id")
        .agg(
            F.sum("inference_seconds").alias("inference_seconds"),
            F.sort_array(F.collect_list("generated_tokens")).alias("generated_tokens_per_example"),
        )
    )


def eval_log(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation losses: one run per user, steps in event order."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"),
        F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string")).alias("base_model"),
        F.col("event_id").alias("step"),
        F.col("value").alias("eval_loss"),
    )


def _entries(*pairs: tuple[str, Column]) -> Column:
    return F.explode(
        F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])
    )


def base_kv(spark: SparkSession, sf: str) -> DataFrame:
    """Configuration of one run per order."""
    entry = _entries(
        ("training.status", F.col("o_orderstatus")),
        ("training.priority", F.col("o_orderpriority")),
        ("lora.r", (F.col("o_custkey") % 4).cast("string")),
    )
    orders = table(spark, sf, "orders")
    return orders.select(F.col("o_orderkey").alias("run_id"), entry.alias("e")).select(
        "run_id", "e.*"
    )


def override_kv(spark: SparkSession, sf: str) -> DataFrame:
    """Overrides of the urgent runs: some values are NULL, one key is new, one has no dot."""
    status = F.when(F.col("o_orderstatus") != "F", "O")
    entry = _entries(
        ("training.status", status), ("new.key", F.lit("O")), ("nodot", F.lit("O"))
    )
    orders = table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    return orders.select(F.col("o_orderkey").alias("run_id"), entry.alias("e")).select(
        "run_id", "e.*"
    )


def section_kv(spark: SparkSession, sf: str) -> DataFrame:
    """Overrides of the low-priority runs that swap a value for a section and back."""
    entry = _entries(("lora.r.init", F.lit("zero")), ("training", F.col("o_orderstatus")))
    orders = table(spark, sf, "orders").filter(F.col("o_orderpriority") == "5-LOW")
    return orders.select(F.col("o_orderkey").alias("run_id"), entry.alias("e")).select(
        "run_id", "e.*"
    )


def override_strings(spark: SparkSession, sf: str) -> DataFrame:
    """``key=value`` texts of every kind."""
    kind = F.col("l_linenumber") % 6
    value = (
        F.when(kind == 0, F.col("l_returnflag"))
        .when(kind == 1, "TRUE")
        .when(kind == 2, F.col("l_partkey").cast("string"))
        .when(kind == 3, "1e-4")
        .when(kind == 4, "5d")
        .otherwise("a=b")
    )
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.concat(F.lit("training.k="), value).alias("raw"),
    )


def lineage(spark: SparkSession) -> DataFrame:
    """Which model was tuned from which."""
    return spark.createDataFrame(
        [
            ("org/parrot", "org/parrot", "base", "small"),
            ("org/lead", "org/parrot", "tuned", "small"),
            ("org/echo", "org/echo", "base", "large"),
            ("org/blank", "org/echo", "tuned", "large"),
        ],
        "model_id string, base_model string, setup string, size_class string",
    )


def templates(spark: SparkSession) -> DataFrame:
    """Chat formats of the models; only two of them know the no-thinking option."""
    return spark.createDataFrame(
        [
            ("org/echo", "<|", "|>\n", "<|end|>\n", "<|assistant|>\n", None),
            ("org/lead", "[", "] ", "\n", "[assistant] ", "<think></think>"),
            ("org/parrot", "", ": ", "\n\n", "assistant: ", None),
            ("org/blank", "## ", "\n", "\n", "## assistant\n", "/no_think\n"),
        ],
        "model_id string, before_role string, after_role string, after_message string, "
        "generation_header string, no_think_suffix string",
    )


def split_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Document ids with an exact 60 / 20 / 20 split."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return sampling.split_exact(docs, 0.6, seed=42, row_id="doc_id")


def split_flashcards(spark: SparkSession, sf: str) -> DataFrame:
    """Flashcards with an exact 60 / 20 / 20 split."""
    return sampling.split_exact(flashcards(spark, sf), 0.6, seed=42)
