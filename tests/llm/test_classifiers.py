"""Line quality and toxicity: exact inference, held-out accuracy, awkward rows."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalweave.llm import labelled, line_quality, toxicity
from evalweave.llm.words import LETTERS, NOT_SPACE, text_bytes, words
from tests.llm import messy

LABELS = "doc_id long, quality int, toxic int, text string, label int"


@pytest.fixture(scope="module")
def corpus(spark):
    """Prose with junk lines in some documents and insults in others."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeiourstn") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    insults = ["zork", "blarg", "fnurd", "klotz"]
    texts, labels = [], []
    for i in range(700):
        lines = [
            [rng.choice(vocabulary) for _ in range(rng.randrange(4, 25))]
            for _ in range(rng.randrange(1, 9))
        ]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                lines[0].insert(rng.randrange(len(lines[0])), rng.choice(insults) + rng.choice([".", "", "!"]))
        rows = [" ".join(line).capitalize() + "." for line in lines]
        if bad:
            rows = [rows[0][:40]] + [
                " | ".join(r.split()) if i % 2 else r.upper().replace(" ", "!! ") for r in rows
            ]
        texts.append((i, "\n".join(rows)))
        labels.append((i, int(not bad), int(toxic), "x", 9))
    labels += [(0, None, None, "x", 9), (10**6, 1, 1, "x", 9), (None, 0, 0, "x", 9)]
    docs = messy.docs(spark, texts + messy.TEXTS[3:]).repartition(4)
    return docs, spark.createDataFrame(labels, LABELS)


def test_words():
    texts = ["", "The END. the\tx", "ñandú ÑANDÚ", "a" * 200 + " " + "A" * 200]
    found = words(*text_bytes(pa.array(texts)), NOT_SPACE)
    split = [t.split() for t in texts]
    assert np.diff(found.first).tolist() == [len(s) for s in split]
    flat = ["".join(c.lower() if c.isascii() else c for c in w) for s in split for w in s]
    for (a, x), (b, y) in itertools.combinations(zip(flat, found.hashes), 2):
        assert (a == b) == (x == y)
        assert (a.encode()[:5] == b.encode()[:5]) or len(set(found.prefixes)) > 1
    assert words(*text_bytes(pa.array(["a.b,c"])), LETTERS).first.tolist() == [0, 3]


def test_marginals_are_exact():
    """Against the sum over all labelings of each text."""
    rng = np.random.default_rng(6)
    field = line_quality.Field(np.zeros(1), rng.normal(size=2), rng.normal(size=(2, 2)))
    sizes = [3, 0, 1, 5]
    first = np.concatenate(([0], np.cumsum(sizes)))
    scores = rng.normal(0, 3, first[-1])
    good, moved, began = line_quality.marginals(scores, first, field)
    total_moves, total_first = np.zeros((2, 2)), np.zeros(2)
    for a, b in zip(first[:-1], first[1:]):
        weights = {}
        for y in itertools.product((0, 1), repeat=int(b - a)):
            if y:
                w = field.first[y[0]] + sum(s * k for s, k in zip(scores[a:b], y))
                w += sum(field.moves[u, v] for u, v in zip(y, y[1:]))
                weights[y] = np.exp(w)
        z = sum(weights.values())
        for t in range(b - a):
            assert good[a + t] == pytest.approx(sum(w for y, w in weights.items() if y[t]) / z)
        for y, w in weights.items():
            total_first[y[0]] += w / z
            for u, v in zip(y, y[1:]):
                total_moves[u, v] += w / z
    assert moved == pytest.approx(total_moves) and began == pytest.approx(total_first)


def _check(rows, texts, labels, cut, least):
    n = len(texts)
    assert len(rows) == n
    right = seen = 0
    for r in rows:
        text = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (zlib.crc32(text.encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
        if r.held_out and r.doc_id in labels and r.doc_id >= 8:
            seen += 1
            right += r.predicted == labels[r.doc_id]
    assert seen > 80 and right / seen >= least


def test_line_quality(spark, corpus):
    docs, labels = corpus
    field = line_quality.fit(docs, labels, line_quality.Settings(steps=60, rounds=2))
    known = {r.doc_id: r.quality for r in labels.collect() if r.doc_id and r.quality is not None}
    rows = line_quality.score(docs, field).collect()
    _check(rows, docs.collect(), known, 0.3, 0.97)
    kept = line_quality.keep_good(docs, field)
    assert kept.schema == docs.schema
    wanted = sorted((r.doc_id for r in rows if r.score >= 0.3), key=messy.key)
    assert sorted((r.doc_id for r in kept.collect()), key=messy.key) == wanted
    assert line_quality.score(messy.empty(spark), field).count() == 0
    untrained = line_quality.fit(messy.empty(spark), labels)
    assert line_quality.score(docs, untrained).count() == docs.count()


def test_toxicity(spark, corpus):
    docs, labels = corpus
    settings = toxicity.Settings(epochs=4, buckets=1 << 12, prefix_buckets=1 << 10)
    net = toxicity.fit(docs, labels, settings)
    known = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id and r.toxic is not None}
    rows = toxicity.score(docs, net).collect()
    _check(rows, docs.collect(), known, 0.5, 0.97)
    again = toxicity.score(docs.repartition(7), toxicity.fit(docs.repartition(2), labels, settings))
    pairs = {(r.doc_id, round(r.score, 6)) for r in again.collect()}
    assert pairs == {(r.doc_id, round(r.score, 6)) for r in rows}
    untrained = toxicity.fit(docs, labels.limit(0), settings)
    assert toxicity.score(docs, untrained).count() == docs.count()
    assert toxicity.score(messy.empty(spark), net).count() == 0


def test_windows_end_with_their_text():
    """The network sees each text alone."""
    settings = toxicity.Settings(buckets=64, prefix_buckets=16, size=3, filters=2)
    rng = np.random.default_rng(8)
    rows = [(i % 2, rng.integers(0, 64, n), rng.integers(0, 16, n)) for i, n in enumerate([4, 1, 7, 2])]
    net = toxicity.train(rows * 3, settings)
    first = np.concatenate(([0], np.cumsum([len(r[1]) for r in rows])))
    w, p = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
    docs = np.repeat(np.arange(4), np.diff(first))
    together = net.logits(w, p, docs, first)
    for i, (_, a, b) in enumerate(rows):
        alone = net.logits(a, b, np.zeros(len(a), int), np.array([0, len(a)]))
        assert together[i] == pytest.approx(alone[0], abs=1e-5)


def test_sample_is_bounded_and_excludes_the_held_out_fold(spark, corpus):
    docs, labels = corpus
    many = labels.unionAll(labels)
    sample = labelled.labelled_sample(docs.withColumn("label", F.lit(3)), many, "toxic", 20)
    rows = sample.collect()
    assert {r.label for r in rows} == {0, 1} and len(rows) == 40
    texts = {r.text for r in rows}
    ids = [r.doc_id for r in docs.filter(F.col("text").isin(*texts)).collect()]
    assert all(zlib.crc32(str(i).encode()) % 5 for i in ids)


def test_best_cut():
    scores, labels = np.array([0.1, 0.2, 0.8, 0.9]), np.array([0, 0, 1, 1])
    assert labelled.best_cut(scores, labels) == pytest.approx(0.5)
    slope, offset = labelled.platt(scores, labels)
    assert slope > 0 and labelled.sigmoid(slope * 0.9 + offset) > 0.5


def test_the_sample_is_bounded_by_bytes_not_by_a_text_s_size(spark, monkeypatch):
    long = "long line of words\n" * 5000  # over 64 KB
    texts = [(i, long if i == 3 else f"text {i}") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0, "x", 9) for i in range(40)], LABELS)
    docs = messy.docs(spark, texts + [(3, None), (3, long)])
    take = lambda: labelled.labelled_sample(docs, labels, "quality", 100).collect()
    assert long in {r.text for r in take()}
    kept = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    assert len(take()) == len(kept)
    monkeypatch.setattr(labelled, "SAMPLE_BYTES", 1)
    few = take()
    assert len(few) == 2 and {r.label for r in few} == {0, 1}


def test_without_both_labels(spark, corpus):
    docs, labels = corpus
    for known in (labels.limit(0), labels.filter("toxic = 0 AND quality = 1")):
        assert toxicity.score(docs, toxicity.fit(docs, known)).filter("predicted = 1").isEmpty()
        scores = line_quality.score(docs, line_quality.fit(docs, known))
        assert scores.filter("score BETWEEN 0 AND 1").count() == docs.count()


def test_toxicity_learns_from_every_labelled_document(spark, corpus, monkeypatch):
    """All labelled documents are dealt into shards; their partitions and copies change nothing."""
    docs, labels = corpus
    seen = []
    real = toxicity.shards

    def counted(rows, most_rows):
        packed, n = real(rows, most_rows)
        seen.append((n, sum(len(r.labels) for r in packed.collect())))
        return packed, n

    monkeypatch.setattr(toxicity, "shards", counted)
    settings = toxicity.Settings(shard_rows=150, buckets=1 << 12, prefix_buckets=1 << 10)
    nets = [toxicity.fit(d, labels, settings) for d in (docs, docs.unionAll(docs).repartition(3))]
    texts = {r.doc_id for r in docs.collect() if r.text}
    known = {r.doc_id for r in labels.collect() if r.toxic is not None and r.doc_id is not None}
    n, rows = seen[0]
    assert n > 3 and rows == sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in known & texts)
    assert seen[1] == seen[0] and nets[0].thresholds == nets[1].thresholds
    assert np.array_equal(nets[0].word_vectors, nets[1].word_vectors)
    by_id = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id and r.toxic is not None}
    _check(toxicity.score(docs, nets[0]).collect(), docs.collect(), by_id, 0.5, 0.95)


def test_counted_cut_equals_the_plain_one():
    rng = np.random.default_rng(9)
    scores, labels = rng.integers(0, 30, 300) / 7, rng.integers(0, 2, 300)
    best = max(
        (2 * labels[scores >= c].sum() / ((scores >= c).sum() + labels.sum()), c) for c in set(scores)
    )[0]
    cut = labelled.best_cut(scores, labels)
    assert 2 * labels[scores >= cut].sum() / ((scores >= cut).sum() + labels.sum()) == pytest.approx(best)
    twice = labelled.platt(np.repeat(scores, 2), np.repeat(labels, 2))
    assert labelled.platt(scores, labels, counts=np.full(300, 2)) == pytest.approx(twice)
