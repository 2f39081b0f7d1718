"""The Katz model against a plain version."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from evalweave.llm import katz
from tests.llm import messy


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [None]


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefgh") * min(9, int(rng.paretovariate(0.6)))
    made = [(50 + i, " ".join(word() for _ in range(rng.randrange(120)))) for i in range(150)]
    return messy.TEXTS + made


def plain(texts, order):
    """Rows of ``score``, and the chances of all words after every context."""
    docs = [(i, tokens(t)) for i, t in texts]
    train = [ts for i, ts in docs if not held_out(i)]
    c = Counter(t for ts in train for t in ts)
    n = sum(c.values())
    uni = katz.discounts(Counter(c.values()), n)
    vocabulary = [*c, "unknown"]
    one = {w: float(uni.share(np.array([c[w]]))[0]) / n if w in c else uni.left for w in vocabulary}
    grams = lambda ts, size: list(zip(*(["start", *ts][k:] for k in range(size))))
    tables = [{(): one}]
    for size in range(2, order + 1):
        counts = Counter(g for ts in train for g in grams(ts, size))
        of = katz.discounts(Counter(counts.values()), sum(counts.values()))
        table = {}
        for g in counts:
            table.setdefault(g[:-1], {})[g[-1]] = counts[g]
        for h, seen in table.items():
            lower = tables[-1].get(h[1:], None) if size > 2 else one
            lower = lower or one
            total = sum(seen.values())
            kept = {w: float(of.share(np.array([k]))[0]) for w, k in seen.items()}
            mass, unseen = sum(kept.values()) / total, 1 - sum(lower[w] for w in seen)
            scale = min(1, total / (total + 1) / mass) if unseen > 1e-12 else 1 / mass
            alpha = (1 - scale * mass) / unseen if unseen > 1e-12 else 0
            table[h] = {w: scale * kept[w] / total if w in kept else alpha * lower[w] for w in vocabulary}
        tables.append(table)

    def chance(before, w):
        """Of the longest context that training rows follow."""
        while before not in tables[len(before)]:
            before = before[1:]
        return tables[len(before)][before][w if w in c else "unknown"]

    rows = Counter()
    for i, ts in docs:
        base = sum(math.log10((c[t] + 0.5) / (n + 0.5 * (len(c) + 1))) for t in ts)
        words = ["start", *ts]
        value = sum(
            math.log10(chance(tuple(words[max(0, k - order + 1) : k]), words[k])) for k in range(1, len(words))
        )
        known = sum(t in c for t in ts)
        rows[i, held_out(i), len(ts), known, n, round(base, 6), round(value, 6)] += 1
    return rows, tables


@pytest.mark.parametrize(
    "order, chunk, bucket", [(2, 2_000_000, 1_000_000), (3, 2_000_000, 500), (3, 300, 100), (2, 10, 1000), (4, 50, 3000)]
)
def test_scores(spark, texts, monkeypatch, order, chunk, bucket):
    monkeypatch.setattr(katz, "TOKENS_AT_ONCE", chunk)
    monkeypatch.setattr(katz, "TOKENS_PER_BUCKET", bucket)
    df = messy.docs(spark, texts).repartition(3)
    got = katz.score(df, katz.Settings(order)).collect()
    want, tables = plain(texts, order)
    assert Counter((*r[:5], round(r[5], 6), round(r[6], 6)) for r in got) == want
    for table in tables:
        for shares in table.values():
            assert sum(shares.values()) == pytest.approx(1)


def test_all_occurrences_in_held_out_rows_or_one_chunk(spark, monkeypatch):
    """Contexts that only some of the chunks were trained on get the same weights everywhere."""
    monkeypatch.setattr(katz, "TOKENS_AT_ONCE", 4)
    ids = range(2000, 2040)
    made = [(i, ["a b c d", "a b c e", "b c d", "x y", ""][k % 5]) for k, i in enumerate(ids)]
    got = katz.score(messy.docs(spark, made).repartition(2)).collect()
    want, _ = plain(made, 3)
    assert Counter((*r[:5], round(r[5], 6), round(r[6], 6)) for r in got) == want


def test_pairs_at_least(spark):
    with pytest.raises(ValueError):
        katz.score(messy.empty(spark), katz.Settings(1))


def test_no_rows_and_no_training(spark):
    assert katz.score(messy.empty(spark)).count() == 0
    only = next(i for i in range(100) if held_out(i))
    row = katz.score(messy.docs(spark, [(only, "a b")])).collect()[0]
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (3, 0, 0, 0.0)


def test_discounts():
    few = katz.discounts({1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 6}, 1000)
    counts = sum((1 - few.ratios[r]) * r * n for r, n in {1: 100, 2: 40, 3: 20, 4: 12, 5: 8}.items())
    assert few.left == pytest.approx(0.1) == pytest.approx(counts / 1000)
    assert katz.discounts({}, 0).left == 1
    assert 0 < katz.discounts({7: 2}, 14).left < 0.1


def test_packed_integers():
    values = np.array([0, 1, 70_000, 2**31 - 1, 5], np.int32)
    assert katz._unpacked(katz._packed(values)).tolist() == values.tolist()
    assert katz._unpacked(katz._packed(np.zeros(0, int))).tolist() == []


def test_packed_hashes():
    names = np.array([0, 1, 5, 2**63, 2**64 - 1], np.uint64)
    assert katz._unpacked_names(katz._packed_names(names)).tolist() == names.tolist()
    floats = np.array([0.5, 2, 0.5, 0, 2**-40])
    assert katz._unpacked_floats(katz._packed_floats(floats)).tolist() == floats.tolist()
    assert katz._unpacked_floats(katz._packed_floats(floats[:0])).tolist() == []
    assert katz._cuts(names, 0).tolist() == [0, 5]
    assert katz._cuts(names, 1).tolist() == [0, 3, 5]


def test_every_word_is_a_predecessor(spark, texts):
    filler = (next(i for i in range(1000, 1100) if not held_out(i)), "aa bb cc " * 40_000)
    made = texts + [filler]
    got = katz.score(messy.docs(spark, made).repartition(3)).collect()
    want, tables = plain(made, 3)
    assert Counter((*r[:5], round(r[5], 6), round(r[6], 6)) for r in got) == want
    learnt = {(t,) for i, text in made if not held_out(i) for t in tokens(text)[:-1]}
    assert learnt | {("start",)} == set(tables[1])


def test_known_contexts_are_sent_as_places():
    """Chunks name what they share by its place in the bucket, in about a byte instead of a hash."""
    rng = np.random.default_rng(3)
    every = np.unique(rng.integers(0, 1 << 63, 60_000).astype(np.uint64))
    held = [np.sort(rng.choice(every, 30_000, replace=False)) for _ in range(3)]
    rows = [r for c, names in enumerate(held) for r in katz._bucket_rows(c, 2, names, {"n": np.ones(len(names), int)}, 0)]
    answers = katz._count(katz.pa.Table.from_pylist(rows, katz._REQUEST), True).to_pylist()
    name_of: dict[int, int] = {}
    for names, answer in zip(held, answers):
        shared = (katz._unpacked(answer["data"], "<i8") & 1).astype(bool)
        places = katz._unpacked_places(answer["more"])
        assert all(name_of.setdefault(p, x) == x for p, x in zip(places.tolist(), names[shared].tolist()))
        sums = {"kept": np.ones(len(places))}
        parts = katz._bucket_rows(0, 1002, names[shared], sums, 0, places)
        by_name = katz._bucket_rows(0, 1002, names[shared], sums, 0)
        assert len(parts[0]["places"]) < 2 * len(places) < 0.5 * len(by_name[0]["names"])
    assert len(set(name_of.values())) == len(name_of) > 20_000


def test_rare_words_of_a_chunk_take_fewer_bytes_than_their_hashes(spark):
    text = " ".join(f"word{k}" for k in range(40_000))
    (row,) = katz._chunks(messy.docs(spark, [(1, text)]).coalesce(1), katz.Settings(), "doc_id", "text").collect()
    chunk = katz.Chunk(row.asDict(), 2)
    assert len(chunk.levels[0].names) == 40_002 and len(row.kinds) < 7 * 40_000
