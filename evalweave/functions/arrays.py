"""Token-id, log-probability and embedding arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from evalweave.functions.binding import bind


def finite(value: Column) -> Column:
    """NULL instead of NaN or an infinity, so that aggregates skip the value."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def not_nan(value: Column) -> Column:
    """NULL instead of NaN."""
    return F.when(~F.isnan(value), value)


def _dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two vectors in double precision; NULL for a missing or zero vector."""
    norms = F.sqrt(_dot(left, left)) * F.sqrt(_dot(right, right))
    return bind(norms, lambda n: F.when(n > 0, _dot(left, right) / n))


def both_answered(generated: Column, reference: Column) -> Column:
    """True when both texts exist and are non-empty (raw length, nothing trimmed)."""
    return F.coalesce((F.length(generated) > 0) & (F.length(reference) > 0), F.lit(False))


def generated_token_count(ids: Column, eos_id: Column, pad_id: Column) -> Column:
    """Tokens up to and including the first EOS, else the tokens that are not padding."""
    return (
        F.when(F.array_position(ids, eos_id) > 0, F.array_position(ids, eos_id))
        .when(pad_id.isNotNull(), F.size(F.filter(ids, lambda t: t != pad_id)))
        .otherwise(F.size(ids))
        .cast("int")
    )


def pad_or_eos(pad_id: Column, eos_id: Column) -> Column:
    """The padding id, falling back to the EOS id."""
    return F.coalesce(pad_id, eos_id)


def new_tokens(ids: Column, prompt_length: Column) -> Column:
    """The ids that follow the prompt."""
    return F.slice(ids, prompt_length + 1, F.greatest(F.size(ids) - prompt_length, F.lit(0)))


def target_logprobs(logprobs: Column, prompt_length: Column, n_target: Column) -> Column:
    """Scores of the answer tokens in a next-token array: token ``i`` is scored at ``i - 1``."""
    return F.slice(logprobs, prompt_length, n_target)


def array_sum(values: Column) -> Column:
    """Sum of a numeric array as BIGINT; an empty array gives 0."""
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda total, v: total + v)


def perplexity(nll_mean: Column) -> Column:
    """``exp`` of a finite mean negative log-likelihood, else NULL."""
    return F.exp(finite(nll_mean))


def reference_score(logprobs: Column) -> Column:
    """``struct(logprob_sum, nll_mean, perplexity, tokens)`` of one answer's token scores."""
    total = F.aggregate(logprobs, F.lit(0.0), lambda s, lp: s + lp)
    return bind(
        F.struct(total.alias("total"), F.coalesce(F.size(logprobs), F.lit(0)).alias("n")),
        lambda s: F.struct(
            F.when(s["n"] > 0, not_nan(s["total"])).alias("reference_answer_logprob_sum"),
            F.when(s["n"] > 0, not_nan(-s["total"] / s["n"])).alias("reference_answer_nll_mean"),
            F.when(s["n"] > 0, perplexity(-s["total"] / s["n"])).alias(
                "reference_answer_token_perplexity"
            ),
            F.greatest(s["n"], F.lit(0)).alias("reference_answer_tokens"),
        ),
    )
