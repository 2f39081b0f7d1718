"""Phrases against counting all of them."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from evalweave.llm import phrase_mining
from evalweave.llm.phrase_mining import Settings
from tests.llm import messy


def pieces(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
        yield re.findall(r"[^\x20\x09]+", piece)


def plain(rows, settings):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        counts = f.setdefault(lang, Counter())
        for words in pieces(text):
            n[lang] += len(words)
            for k in range(1, 5):
                counts.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, counts in f.items():
        phrases = [p for p, a in counts.items() if len(p) > 1 and a >= settings.least]
        longest = Counter()
        for p in phrases:
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longest[p[i : i + size]] = max(longest[p[i : i + size]], counts[p])
        scored = []
        for p in phrases:
            a = counts[p]
            if 100 * longest[p] >= settings.covered * a:
                continue
            cuts = []
            for k in range(1, len(p)):
                l, r = counts[p[:k]], counts[p[k:]]
                cuts.append((2_000_000 * a // (l + r), k, l, r))
            score, _, l, r = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), a, l, r))
        for rank, (score, _, p, a, l, r) in enumerate(sorted(scored)[: settings.most], 1):
            out.add((lang, rank, p.decode(), a, l, r, n[lang], -score))
    return out


def corpus():
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefgh") * min(3, int(rng.paretovariate(1)))
    rows = []
    for i in range(250):
        text = "".join(word() + rng.choice([" ", " ", " ", "\t", ", ", "\n", " "]) for _ in range(rng.randrange(60)))
        rows.append((rng.choice(["en", "de", None, "und", ""]), text))
    # One phrase and one pair of words make up a third of all rows.
    rows += [("en", "hot Pair of words again. hot pair")] * 120
    rows += [("de", f"hot pair {word()} {word()}") for _ in range(200)]
    rows += [(None, None), ("en", None), (None, ""), ("en", "é é é é é é é é É")]
    return rows + [("fr", t) for _, t in messy.TEXTS]


def table(spark, rows):
    made = [(i, t, lang, "x", 1, "k", 2) for i, (lang, t) in enumerate(rows)]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, chunk string, n int, word string, k1 int")


@pytest.mark.parametrize(
    "settings, words, route, suffixes",
    [
        (Settings(least=5), 1_000_000, 1 << 16, 1 << 20),
        (Settings(least=3, covered=60, most=40), 100, 8, 500),
        (Settings(least=2, covered=100, most=7), 1000, 0, 100),
        (Settings(least=30), 300, 100, 50),
    ],
)
def test_mine(spark, monkeypatch, settings, words, route, suffixes):
    """Any chunks, routes and tasks: with a limit of 0 every word is a very frequent one."""
    monkeypatch.setattr(phrase_mining, "WORDS_AT_ONCE", words)
    monkeypatch.setattr(phrase_mining, "LARGEST_ROUTE", route)
    monkeypatch.setattr(phrase_mining, "SUFFIXES_AT_ONCE", suffixes)
    rows = corpus()
    got = phrase_mining.mine(table(spark, rows).repartition(3), settings)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == plain(rows, settings)


def test_no_rows_and_no_phrases(spark):
    assert phrase_mining.mine(table(spark, []).limit(0)).count() == 0
    assert phrase_mining.mine(messy.empty(spark)).count() == 0
    assert phrase_mining.mine(table(spark, [("en", "a b c")])).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_quicksort_counts_prefixes(seed):
    """Phrases of very frequent words alone are suffixes of their own, as a chunk makes them."""
    rng = np.random.default_rng(seed)
    least, hot = int(rng.integers(1, 8)), set(range(1, int(rng.integers(1, 5))))
    counts, rows = Counter(), []
    for _ in range(int(rng.integers(1, 300))):
        words, n = rng.integers(1, 5, int(rng.integers(2, 5))).tolist(), int(rng.integers(1, 4))
        for length in range(2, len(words) + 1):
            counts[tuple(words[:length])] += n
        lead = next((i for i, w in enumerate(words) if w not in hot), len(words))
        rows += [(words[:m], n, m - 1) for m in range(2, lead + 1)]
        rows += [(words, n, lead)] if lead < len(words) else []
    w = [np.array([(words + [0] * 4)[d] for words, _, _ in rows], np.int32) for d in range(4)]
    n, lead = (np.array([r[i] for r in rows]) for i in (1, 2))
    at, length, weight = phrase_mining.frequent_prefixes(w, n, lead, least)
    got = {tuple(int(x[i]) for x in w[:k]): int(c) for i, k, c in zip(at, length, weight)}
    assert got == {p: c for p, c in counts.items() if c >= least} and len(got) == len(at)


def test_scores_pass_64_bits(spark):
    """Counts of 10^13: twice a million times that is beyond 64 bits."""
    big = 10**13
    phrases = spark.createDataFrame([(1 << 32 | 2, 0, big)], "k1 long, k2 long, a long")
    frequent = spark.createDataFrame([(1, big + 1), (2, 3 * big)], "id int, c long")
    row = phrase_mining._scored(phrases, frequent).collect()[0]
    assert (row.l, row.r, row.score) == (big + 1, 3 * big, 2_000_000 * big // (4 * big + 1))
