"""Quality rules: a table of thresholds compiled into one projection.

Everything is an expression on the row; nothing is exploded, shuffled or passed to Python.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPACES = r"[\x20\x09-\x0D]+"
# Symbols and frequent words.
NO_SYMBOL = r"[^#*$%&|<>]+"
STOP_WORDS = {
    "en": "the of and to in a is that it for was with are this be as on by from or an at not have",
    "de": "der die das und ist nicht ein eine zu den von mit dem des im auf als auch sich in es",
    "fr": "le la les de des et un une du en est que qui dans pour pas au par sur il ne ce",
    "es": "el la los las de y en que es un una por con no para se del al lo como su",
}


@dataclass(frozen=True)
class Rule:
    """Bounds of one measure; a missing bound does not limit. ``least_words`` exempts short texts."""

    measure: str
    low: float | None = None
    high: float | None = None
    least_words: int = 0


# The production table. Shares are of words, lines or characters of words.
RULES = (
    Rule("n_words", high=1_000_000),
    Rule("mean_word_chars", low=2, high=14),
    Rule("symbol_share", high=0.1),
    Rule("stop_share", low=0.02),
    Rule("upper_share", high=0.6),
    Rule("dup_line_share", high=0.5),
    Rule("repeat_share", high=0.5),
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def verdict(rules: Sequence[Rule]) -> Column:
    """One boolean: every measure lies within its bounds."""
    kept = F.lit(True)
    for rule in rules:
        value, within = F.col(rule.measure), F.lit(True)
        if rule.low is not None:
            within = within & (value >= rule.low)
        if rule.high is not None:
            within = within & (value <= rule.high)
        kept = kept & ((F.col("n_words") < rule.least_words) | within)
    return kept


def measures(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3
) -> DataFrame:
    """The id and the measures that rules refer to, one row per row of ``docs``.

    Words are runs without U+0020 and U+0009 to U+000D. A word is repeated if a window of
    ``window`` words that holds it occurs twice or more in the text. Windows are compared
    by 64-bit hash, sorted within the row, so that a text of n words takes n log n steps.
    """
    stops = sorted({word for words in STOP_WORDS.values() for word in words.split()})
    words, lines, hashes = F.col("_words"), F.col("_lines"), F.col("_hashes")
    sorted_hashes, pairs, spots = F.col("_sorted"), F.col("_pairs"), F.col("_spots")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = (
        docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
        .withColumn("_words", F.filter(F.split("_text", SPACES), lambda w: w != ""))
        .withColumn(
            "_lines", F.filter(F.split("_text", "\n"), lambda x: F.trim(x, F.lit(" \t\x0b\x0c\r")) != "")
        )
        .select(
            "_id",
            "_words",
            F.size(words).cast("long").alias("n_words"),
            F.length(F.regexp_replace("_text", SPACES, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace("_text", NO_SYMBOL, "")).cast("long").alias("n_symbols"),
            F.length(F.regexp_replace("_text", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(stops))).cast("long").alias("n_stops"),
        )
        .withColumn(
            "_hashes",
            F.slice(
                F.transform(
                    words, lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, window)))
                ),
                F.lit(1),
                F.greatest(F.size(words) - (window - 1), F.lit(0)),
            ),
        )
        .drop("_words")
        .withColumn("_sorted", F.sort_array("_hashes"))
        .withColumn(
            "_again",
            F.exists(
                F.transform(sorted_hashes, lambda h, i: h == F.get(sorted_hashes, i + 1)),
                lambda same: same,
            ),
        )
        .drop("_sorted")
        .withColumn(
            "_pairs",
            F.when(
                F.col("_again"),
                F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            ),
        )
        .drop("_hashes")
        .withColumn(
            "_spots",
            F.sort_array(
                F.transform(
                    F.filter(
                        pairs,
                        lambda p, k: F.coalesce(p.h == F.get(pairs, k - 1).h, F.lit(False))
                        | F.coalesce(p.h == F.get(pairs, k + 1).h, F.lit(False)),
                    ),
                    lambda p: p.i,
                )
            ),
        )
        .drop("_pairs")
        .withColumn(
            "n_repeat_words",
            F.coalesce(
                F.aggregate(
                    F.transform(
                        spots,
                        lambda s, k: F.least(F.lit(window), F.coalesce(F.get(spots, k + 1) - s, F.lit(window))),
                    ),
                    F.lit(0).cast("long"),
                    lambda total, n: total + n,
                ),
                F.lit(0).cast("long"),
            ),
        )
    )
    chars, n = F.col("word_chars"), F.col("n_words")
    return rows.select(
        F.col("_id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        _ratio(chars, n).alias("mean_word_chars"),
        _ratio(F.col("n_symbols"), chars).alias("symbol_share"),
        _ratio(F.col("n_stops"), n).alias("stop_share"),
        _ratio(F.col("n_upper"), chars).alias("upper_share"),
        _ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_share"),
        _ratio(F.col("n_repeat_words"), n).alias("repeat_share"),
    )


def judge(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Measures of every row with ``base_failed`` and ``kept``.

    A text fails the base rule with fewer than 50 words or with more than half of its words
    repeated; it is kept if it passes that and all ``rules``. A NULL or empty text has no
    words and fails. A NULL id stays NULL, repeated rows give a row each, an empty table
    gives none, and other columns are ignored whatever their names.
    """
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    measured = measures(docs, id_col, text_col)
    return measured.withColumn("base_failed", (n < 50) | (100 * repeated > 50 * n)).withColumn(
        "kept", ~F.col("base_failed") & verdict(rules)
    )


def rules_sql(rules: Sequence[Rule] = RULES) -> str:
    """The rules as a SQL condition over the measures."""
    parts = []
    for rule in rules:
        bounds = [f"{rule.measure} >= {rule.low!r}"] if rule.low is not None else []
        bounds += [f"{rule.measure} <= {rule.high!r}"] if rule.high is not None else []
        parts.append(f"(n_words < {rule.least_words} OR ({' AND '.join(bounds) or 'true'}))")
    return " AND ".join(parts)


def oracle_sql(rules: Sequence[Rule] = RULES) -> str:
    """The same result in SQL for DuckDB over ``documents``."""
    stops = ", ".join(f"'{w}'" for w in sorted({w for x in STOP_WORDS.values() for w in x.split()}))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), s AS (
  SELECT *, list_filter(regexp_split_to_array(t, '{SPACES}'), lambda w: w <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), w AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM s)
), p AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM w
), c AS (
  SELECT r, sum(CASE WHEN nxt IS NULL OR nxt - i > 3 THEN 3 ELSE nxt - i END) AS n_repeat_words
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM p WHERE n > 1)
  GROUP BY r
), m AS (
  SELECT doc_id, len(ws) AS n_words,
    length(regexp_replace(t, '{SPACES}', '', 'g')) AS word_chars,
    length(regexp_replace(t, '{NO_SYMBOL}', '', 'g')) AS n_symbols,
    length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS n_upper,
    len(ls) AS n_lines,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    len(list_filter(ws, lambda x: lower(x) IN ({stops}))) AS n_stops,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM s LEFT JOIN c USING (r)
), v AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
    CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_share,
    CASE WHEN n_words > 0 THEN n_stops / n_words ELSE 0 END AS stop_share,
    CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END AS upper_share,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share,
    CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_share,
    (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed
  FROM m
)
SELECT *, (NOT base_failed AND {rules_sql(rules)}) AS kept FROM v
"""
