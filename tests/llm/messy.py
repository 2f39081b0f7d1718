"""Awkward documents: NULLs, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id string, row int, "
    "text_hash long, score double, n_tokens int, class string, key string, found int, words int"
)
LONG = "alpha beta gamma. " * 4000 + "\n" + "x" * 70_000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog."),
    (2, "The quick brown fox jumps over the lazy dog."),
    (2, "The quick brown fox jumps over the lazy dog."),
    (3, None),
    (4, ""),
    (None, "no id here, but some words all the same"),
    (None, None),
    (5, "\n\n \t\n"),
    (6, LONG),
    (7, "é ß 漢字 \U0001f600 <|endoftext|> <s> one\r\ntwo  three four"),
]


def docs(spark, texts=TEXTS):
    rest = ("xx", None, None, "clash", 7, 1, 0.5, 3, "c", "k", 9, 2)
    return spark.createDataFrame([(*t, *rest) for t in texts], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(value):
    """A sort key that takes None."""
    return (value is not None, value)
