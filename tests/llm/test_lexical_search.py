"""NRA search against scoring every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from evalweave.llm import lexical_search
from tests.llm import messy

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    """Rows of ``(item, rank, id, score)`` by scoring all documents."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(bool(b) for _, b in bags)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in sorted({x for x in items if x[1]}, key=repr):
        scored = []
        for doc, bag in bags:
            m = 10 + 90 * sum(bag.values()) * n_docs // max(total, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m))
                for t in set(terms(text))
                if t in bag
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


ITEMS = [
    (1, "The quick FOX, é 漢字"), (2, "lazy lazy dog"), (2, "lazy lazy dog"), (3, None), (4, ""), (5, "?!"),
    (6, "nowhere"), (None, "alpha beta"), (7, "a b c d e f g h the"),
]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") * min(3, int(rng.paretovariate(1)))
    made = [(100 + i, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(300)]
    return messy.TEXTS + made + [(500 + i, "the same text of copies") for i in range(40)]


def items_of(spark, rows=ITEMS):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "item_id long, text string, id string, rank int")


@pytest.mark.parametrize("k, docs, first, block", [(10, 16384, 64, 10_000), (3, 7, 1, 2), (1, 50, 3, 1)])
def test_search(spark, corpus, monkeypatch, k, docs, first, block):
    """Any shards, reads and blocks; ties, NULLs, repeated rows and long texts among the documents."""
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", docs)
    monkeypatch.setattr(lexical_search, "FIRST_READ", first)
    monkeypatch.setattr(lexical_search, "BLOCK_QUERIES", block)
    found = lexical_search.search(messy.docs(spark, corpus).repartition(3), items_of(spark), k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in found.collect()) == plain(corpus, ITEMS, k)


def test_empty_tables(spark):
    items = items_of(spark)
    assert lexical_search.search(messy.empty(spark), items).count() == 0
    assert lexical_search.search(messy.docs(spark), items.limit(0)).count() == 0
    assert lexical_search.search(messy.docs(spark), items_of(spark, [(1, "?"), (2, None)])).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_best_reads_until_all_is_resolved(monkeypatch, seed):
    """Small integers, so that ties at the edge are frequent."""
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(lexical_search, "FIRST_READ", int(rng.integers(1, 5)))
    n, k = int(rng.integers(1, 60)), int(rng.integers(1, 12))
    lists, total = [], np.zeros(n, np.int64)
    for _ in range(int(rng.integers(0, 6))):
        docs = rng.permutation(n)[: int(rng.integers(0, n + 1))]
        impact = np.sort(rng.integers(1, 5, len(docs)))[::-1].astype(np.int64)
        total[docs] += impact
        lists.append((docs, impact))
    found, score = lexical_search.best(lists, n, k)
    least = max(1, np.sort(total)[::-1][min(k, n) - 1] if n > k else 1)
    assert dict(zip(found.tolist(), score.tolist())) == {d: int(s) for d, s in enumerate(total) if s >= least}


def test_best_need_not_read_everything(monkeypatch):
    monkeypatch.setattr(lexical_search, "FIRST_READ", 4)
    read = []

    class Noted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice) and key.stop:
                read.append(key.stop)
            return super().__getitem__(key)

    docs = np.arange(10_000)
    impact = np.arange(10_000, 0, -1)
    lists = [(docs.view(Noted), impact), (docs.view(Noted), impact)]
    found, score = lexical_search.best(lists, 10_000, 3)
    assert found.tolist() == [0, 1, 2] and score.tolist() == [20_000, 19_998, 19_996]
    assert max(read) < 100
