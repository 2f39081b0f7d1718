"""Cleaning, tokens and F1 against literal cases and plain-Python brute force."""

from __future__ import annotations

import random
import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from evalweave.functions import text



def brute_tokens(value):
    words = regex.findall(r"[\p{L}\p{N}_]+", (value or "").lower())
    return [w for w in words if w not in {"a", "an", "the"}]


def brute_overlap(left, right):
    rest = list(right)
    shared = 0
    for token in left:
        if token in rest:
            rest.remove(token)
            shared += 1
    return shared


def brute_f1(prediction, reference):
    p, r = brute_tokens(prediction), brute_tokens(reference)
    return 2 * brute_overlap(p, r) / (len(p) + len(r)) if p or r else 1.0


def random_texts(seed, n, words=12):
    rng = random.Random(seed)
    pieces = ["the", "a", "An", "kidney", "Kidney", "b", "b", "café", "½", "a_b", "x1", "Ärzte", "中文"]
    gaps = [" ", ", ", "-", "\n", "　", ".", "'", "\x1f", "  "]
    return [
        "".join(rng.choice(pieces) + rng.choice(gaps) for _ in range(rng.randrange(words)))
        for _ in range(n)
    ]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("Answer: hypertension", "hypertension"),
        ("assistant: beta blocker", "beta blocker"),
        (" \n Answer : Assistant: hi \t", "Assistant: hi"),
        (None, ""),
        ("", ""),
        ("　\x1c ANSWER :\x85ok ", "ok"),
        ("answers: no", "answers: no"),
        ("the answer: no", "the answer: no"),
        ("answer", "answer"),
        ("Answer:", ""),
        ("a" * 9 + " " * 5000 + "b ", "a" * 9 + " " * 5000 + "b"),
    ],
)
def test_clean_answer(values, raw, expected):
    assert values(lambda x: text.clean_answer(x), [raw]) == [expected]


def test_whitespace_is_what_python_strips():
    assert set(text.WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_normalize_answer(values):
    cases = {
        "The left-sided, chest pain.": "left sided chest pain",
        "The left-sided, café ½ a_b chest pain.": "left sided café ½ a_b chest pain",
        "a an the": "",
        "then another": "then another",
    }
    assert values(lambda x: text.normalize_answer(x), list(cases)) == list(cases.values())
    assert values(lambda x: text.answer_tokens(x), [None, "", " . "]) == [[], [], []]


def test_tokens_match_brute_force(values):
    texts = random_texts(1, 400)
    assert values(lambda x: text.answer_tokens(x), texts) == [brute_tokens(t) for t in texts]


def test_word_characters_match_python(values):
    """Every assigned character splits words as in Python, but for newer Unicode versions."""
    chars = [
        chr(c)
        for c in range(1, 0x110000)
        if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"
    ]
    is_word = values(lambda x: ~x.rlike(text.WORD_SEPARATOR), chars)
    different = [
        c for c, word in zip(chars, is_word) if word != (c.isalnum() or c == "_")
    ]
    # Java may not know letters assigned in a later Unicode version than its own.
    assert all(c.isalnum() for c in different)
    assert len(different) < 0.05 * len(chars)
    assert all(ord(c) > 0x500 for c in different)


def test_token_f1_literals(spark):
    sentence = "The early sea-green ferry for quiet harbours is {}painted wood."
    cases = [
        ("acute kidney injury", "acute renal injury", 2 / 3),
        ("", "", 1.0),
        ("", "aspirin", 0.0),
        ("aspirin", None, 0.0),
        (None, None, 1.0),
        ("x", "y", 0.0),
        ("a b b", "b b b", 0.8),
        (sentence.format(""), sentence.format("daily "), 20 / 21),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, p string, r string, f double")
    for row in df.select("f", text.token_f1(F.col("p"), F.col("r")).alias("got")).collect():
        assert row.got == pytest.approx(row.f, abs=1e-12)


def test_token_f1_and_overlap_match_brute_force(spark):
    pairs = list(zip(random_texts(2, 600, 40), random_texts(3, 600, 40)))
    df = spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(pairs)], "i int, p string, r string")
    p, r = F.col("p"), F.col("r")
    got = (
        df.select(
            "i",
            text.token_f1(p, r).alias("f1"),
            text.token_f1(r, p).alias("back"),
            text.multiset_overlap(text.answer_tokens(p), text.answer_tokens(r)).alias("o"),
        )
        .orderBy("i")
        .collect()
    )
    for row, (left, right) in zip(got, pairs):
        assert row.o == brute_overlap(brute_tokens(left), brute_tokens(right))
        assert row.f1 == pytest.approx(brute_f1(left, right), abs=1e-12)
        assert row.f1 == row.back and 0 <= row.f1 <= 1


def test_precision_and_recall(spark):
    df = spark.createDataFrame([("x y z w", "x y"), ("", "x"), ("x", "")], "p string, r string")
    counts = text.token_counts(F.col("p"), F.col("r"))
    rows = df.select(text.precision(counts), text.recall(counts)).collect()
    assert [tuple(r) for r in rows] == [(0.5, 1.0), (None, 0.0), (0.0, None)]


def test_model_slug(values):
    assert values(lambda x: text.model_slug(x), ["org/a/b", "plain"]) == ["org__a__b", "plain"]
    assert values(lambda x: text.model_slug(x, "_"), ["org/a"]) == ["org_a"]
