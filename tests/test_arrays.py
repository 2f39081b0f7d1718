"""Token ids, log-probabilities, vectors and typed values."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from evalweave.functions import arrays, chat, scalars



def test_generated_token_count_matches_a_loop(spark):
    rng = random.Random(5)
    cases = [
        (
            [rng.choice([0, 1, 2, 3]) for _ in range(rng.randrange(8))],
            rng.choice([2, None]),
            rng.choice([0, None]),
        )
        for _ in range(500)
    ]

    def expected(ids, eos, pad):
        for position, token in enumerate(ids, 1):
            if token == eos:
                return position
        return sum(token != pad for token in ids)

    df = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(cases)], "i int, ids array<int>, eos int, pad int"
    )
    count = arrays.generated_token_count(F.col("ids"), F.col("eos"), F.col("pad"))
    got = [r[0] for r in df.orderBy("i").select(count).collect()]
    assert got == [expected(*c) for c in cases]


def test_slices(spark):
    df = spark.createDataFrame(
        [([9, 8, 1, 2, 3], 2, [0.1, 0.2, 0.3, 0.4, 0.5])], "ids array<int>, p int, lp array<double>"
    )
    row = df.select(
        arrays.new_tokens(F.col("ids"), F.col("p")).alias("new"),
        arrays.new_tokens(F.col("ids"), F.lit(9)).alias("none"),
        arrays.target_logprobs(F.col("lp"), F.col("p"), F.lit(3)).alias("target"),
    ).first()
    assert row.new == [1, 2, 3] and row.none == []
    # The token after a prompt of two is scored at index 1.
    assert row.target == [0.2, 0.3, 0.4]


def test_reference_score(values):
    score = arrays.reference_score
    got = values(score, [[-1.0, -3.0], [], None, [float("-inf")], [-2000.0]], "array<double>")
    assert got[0][:2] == (-4.0, 2.0) and got[0][2] == pytest.approx(math.exp(2.0)) and got[0][3] == 2
    assert tuple(got[1]) == (None, None, None, 0)
    assert tuple(got[2]) == (None, None, None, 0)
    assert got[3][2] is None and got[3][3] == 1
    assert got[4][2] == math.inf or got[4][2] is None


def test_cosine(spark):
    df = spark.createDataFrame(
        [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])],
        "a array<float>, b array<float>",
    )
    got = [r[0] for r in df.select(arrays.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(0.96) and got[1:] == [None, None]


def test_guards(values):
    nan, inf = float("nan"), float("inf")
    assert values(lambda x: arrays.finite(x), [1.0, nan, inf, -inf, None], "double") == [1.0] + [None] * 4
    assert values(lambda x: arrays.not_nan(x), [1.0, nan, inf, None], "double") == [1.0, None, inf, None]
    assert values(lambda x: arrays.perplexity(x), [0.0, nan, inf], "double") == [1.0, None, None]
    assert values(lambda x: arrays.array_sum(x), [[1, 2, 3], []], "array<int>") == [6, 0]


def test_validity(spark):
    df = spark.createDataFrame(
        [("x", "y"), ("", "y"), ("x", None), (" ", "y")], "g string, r string"
    )
    got = [r[0] for r in df.select(arrays.both_answered(F.col("g"), F.col("r"))).collect()]
    assert got == [True, False, False, True]


SCALARS = {
    "true": ("bool", True),
    "FALSE": ("bool", False),
    "12": ("int", 12),
    "-7": ("int", -7),
    " 1_000 ": ("int", 1000),
    "1e-4": ("float", 1e-4),
    ".5": ("float", 0.5),
    "5.": ("float", 5.0),
    "1_0.2_5": ("float", 10.25),
    "Infinity": ("float", math.inf),
    "-inf": ("float", -math.inf),
    "5d": ("string", "5d"),
    "1__0": ("string", "1__0"),
    "_1": ("string", "_1"),
    "0x10": ("string", "0x10"),
    "": ("string", ""),
    "linear all": ("string", "linear all"),
    "1,5": ("string", "1,5"),
}


@pytest.mark.parametrize("raw", SCALARS)
def test_parse_scalar(values, raw):
    kind, expected = SCALARS[raw]
    got = values(lambda x: scalars.parse_scalar(x), [raw])[0]
    field = {"bool": "b", "int": "i", "float": "d", "string": "s"}[kind]
    assert got.kind == kind and got[field] == expected
    assert [got[f] for f in "bids" if f != field] == [None] * 3


def test_parse_scalar_extremes(values):
    big, nan, missing = values(lambda x: scalars.parse_scalar(x), [str(10**30), "nan", None])
    assert (big.kind, big.i, big.s) == ("int", None, str(10**30))
    assert (nan.kind, nan.d) == ("float", None)
    assert missing.kind is None


def test_parse_override(values):
    got = values(lambda x: scalars.parse_override(x), ["a.b=1=2", "a=", "=v", "no dots", None])
    assert [(g.key, g.value) for g in got] == [
        ("a.b", "1=2"), ("a", ""), ("", "v"), (None, None), (None, None)
    ]
    assert [g.error is None for g in got] == [True, True, True, False, False]


def test_chat_columns(spark):
    schema = "prompt array<struct<role:string,content:string>>, completion array<struct<role:string,content:string>>"
    df = spark.createDataFrame(
        [
            ([("system", "s"), ("user", "q1"), ("user", "q2")], [("assistant", " Answer: yes ")]),
            ([("system", "s")], []),
            ([("user", None)], [("assistant", None)]),
        ],
        schema,
    )
    rows = df.select(
        chat.question_of(F.col("prompt")).alias("q"),
        chat.reference_of(F.col("completion")).alias("r"),
        chat.render(
            F.col("prompt"), F.lit("<"), F.lit(">"), F.lit(";"), F.lit("!"), F.lit(None).cast("string")
        ).alias("t"),
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("q1", "yes", "<system>s;<user>q1;<user>q2;!"),
        ("", None, "<system>s;!"),
        ("", "", None),
    ]
