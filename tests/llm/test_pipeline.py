"""The pipeline's stages against plain versions, each on its predecessor's rows."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from evalweave.llm import line_quality
from evalweave.llm.shared import written
from tests.llm import messy
from tests.llm.test_contamination import shingles as item_shingles
from tests.llm.test_duplicates import shingles, union
from tests.llm.test_tokens import check_packing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(3, 9)))
    line = lambda n: (" ".join(word() for _ in range(n)) + ".").capitalize()
    shared = [line(12) for _ in range(5)]
    items = [(i, " ".join(word() for _ in range(30))) for i in range(6)]
    docs, labels = [], []
    for i in range(260):
        lines = [line(rng.randrange(6, 30)) for _ in range(rng.randrange(2, 7))]
        if i % 4 == 0:
            lines.insert(0, rng.choice(shared))
        if i % 13 == 0:
            lines.append(rng.choice(items)[1])
        if i % 5 == 1:
            lines = [" | ".join(x.split()) for x in lines]
        docs.append((i, "\n".join(lines)))
        labels.append((i, int(i % 5 != 1), 0))
    for i in range(0, 60, 5):  # the same words on other lines, and a changed one
        words = docs[i][1].split()
        words[rng.randrange(len(words))] = word()
        docs.append((1000 + i, "\n".join(" ".join(words[k : k + 4]) for k in range(0, len(words), 4))))
    docs += [(2000 + i, docs[2 * i][1]) for i in range(10)] + [(3000, ""), (3001, None)]
    rows = [(i, t, "xx", "s", None if t is None else len(t)) for i, t in docs]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet"
    )
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def plain_quality(spark, sf_dir, docs, before):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = line_quality.score(before, line_quality.fit(before, labels)).collect()
    kept = {r.doc_id for r in scores if r.score >= 0.3}
    assert kept >= {i for i, t in docs.items() if i < 1000 and i % 5 != 1}
    assert not kept & {i for i in docs if i < 1000 and i % 5 == 1}
    return {i: t for i, t in docs.items() if i in kept}


def plain_lines(spark, sf_dir, docs, before):
    seen, out = set(), {}
    for i, t in sorted(docs.items()):
        kept = []
        for x in (t or "").split("\n"):
            if not x.strip() or x.strip().lower() not in seen:
                kept.append(x)
            seen.add(x.strip().lower())
        out[i] = None if t is None else "\n".join(kept)
    return out


def plain_groups(spark, sf_dir, docs, before):
    ids = sorted(docs)
    sets = [shingles(docs[i]) for i in ids]
    pairs = [
        (a, b)
        for a in range(len(ids))
        for b in range(a)
        if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    ]
    assert pairs
    roots = union(len(ids), pairs)
    return {i: docs[i] for k, i in enumerate(ids) if roots[k] == k}


def plain_leaks(spark, sf_dir, docs, before):
    items = [item_shingles(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = lambda t: not any(len(s & item_shingles(t)) >= 0.8 * len(s) for s in items)
    return {i: t for i, t in docs.items() if clean(t)}


def test_every_stage(spark, sf_dir):
    plain = [plain_quality, plain_lines, plain_groups, plain_leaks]
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = {r.doc_id: r.text for r in table.collect()}
    for (name, stage), version in zip(corpus_pipeline.STAGES, plain):
        result = written(stage(spark, table, sf_dir), name)
        assert result.schema.simpleString() == table.schema.simpleString()
        want = version(spark, sf_dir, docs, table)
        rows = result.collect()
        assert {r.doc_id: r.text for r in rows} == want and len(rows) == len(want)
        assert all(r.text is None or r.n_chars == len(r.text) for r in rows)
        assert name == "line_dedup" or len(want) < len(docs)
        table, docs = result, want
    pieces = corpus_pipeline.STAGES[-1][1](spark, table, sf_dir).collect()
    assert check_packing(pieces, list(docs.items()), 1024) == 0


def test_run_applies_all_stages(spark, sf_dir):
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert pieces.columns[:3] == ["doc_id", "start", "length"] and pieces.count() > 50


def test_stages_take_awkward_rows(spark, sf_dir):
    """NULL ids and texts, empty and very long texts, repeated rows, clashing columns."""
    docs = written(messy.docs(spark), "messy")
    rows = Counter((r.doc_id, r.text) for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        result = stage(spark, docs, sf_dir)
        assert result.schema.simpleString() == docs.schema.simpleString()
        got = Counter((r.doc_id, r.text) for r in result.collect())
        assert stage(spark, messy.empty(spark), sf_dir).count() == 0
        if name == "quality_classifier":
            assert got <= rows
        elif name == "line_dedup":
            assert Counter(i for i, _ in got.elements()) == Counter(i for i, _ in rows.elements())
            assert {i for i, t in got if t is None} == {i for i, t in rows if t is None}
            assert sum("quick brown fox" in (t or "") for _, t in got.elements()) == 1
        elif name == "near_duplicates":
            assert set(got) == set(rows) - {(2, messy.TEXTS[1][1])} and max(got.values()) == 1
        else:
            assert got == rows
    packing = corpus_pipeline.STAGES[-1][1]
    assert check_packing(packing(spark, docs, sf_dir).collect(), list(rows.elements()), 1024) == 0
    assert packing(spark, messy.empty(spark), sf_dir).count() == 0
