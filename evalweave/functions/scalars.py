"""Typed values and ``key=value`` overrides given as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from evalweave.functions.text import strip

# Literal forms of integers and floats. Single underscores may
# separate digits; infinities and NaN are spelled out in any case.
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
INTEGER = rf"\A[+-]?{_DIGITS}\z"
FLOAT = (
    rf"(?i)\A[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?"
    r"|inf(?:inity)?|nan)\z"
)


def parse_scalar(text: Column) -> Column:
    """``struct(kind, b, i, d, s)``: the value as boolean, integer, float or string.

    Spark's and other casts accept different spellings, so the kind is decided by the
    literal's form first. An integer beyond BIGINT keeps its kind and its text; a
    spelled-out NaN is a float without a value.
    """
    trimmed = strip(text)
    plain = F.replace(trimmed, F.lit("_"), F.lit(""))
    lowered = F.lower(text)
    kind = (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(lowered.isin("true", "false"), F.lit("bool"))
        .when(trimmed.rlike(INTEGER), F.lit("int"))
        .when(trimmed.rlike(FLOAT), F.lit("float"))
        .otherwise(F.lit("string"))
    )
    integer = F.when(trimmed.rlike(INTEGER), plain.try_cast("bigint"))
    number = F.when(trimmed.rlike(FLOAT), plain.try_cast("double"))
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "bool", lowered == "true").alias("b"),
        F.when(kind == "int", integer).alias("i"),
        F.when((kind == "float") & ~F.isnan(number), number).alias("d"),
        F.when((kind == "string") | ((kind == "int") & integer.isNull()), text).alias("s"),
    )


def parse_override(raw: Column) -> Column:
    """``struct(key, value, error)`` of ``key=value``, split at the first ``=``."""
    at = F.instr(raw, "=")
    return F.struct(
        F.when(at > 0, F.substring(raw, F.lit(1), at - 1)).alias("key"),
        F.when(at > 0, F.substring(raw, at + 1, F.length(raw))).alias("value"),
        F.when(at > 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("no '=' in override: "), F.coalesce(raw, F.lit("NULL"))))
        .alias("error"),
    )
