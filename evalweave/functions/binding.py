"""Evaluate an expensive column once and use it several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed a single time per row.

    Higher-order functions are left out of Spark's common-subexpression
    elimination, so repeating one in an expression repeats its work. Passing the
    value through a one-element array turns it into a lambda variable instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
