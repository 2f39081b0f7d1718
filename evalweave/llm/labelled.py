"""Labelled documents, all or a bounded sample of them, and what classifiers share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from evalweave.llm.shared import written
from evalweave.llm.words import slices

FOLDS = 5
# Labelled ids that are sent to every executor; more are joined by shuffle.
MOST_BROADCAST = 1_000_000
# Bytes of text after which a label's sample takes no further document.
SAMPLE_BYTES = 16 << 20


def fold(id_col: str = "doc_id", folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo ``folds``; a NULL id counts as an empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(folds))


def _known(labels: DataFrame, label_col: str, held_out: int, id_col: str) -> DataFrame:
    """``(id, label, other)`` of ids outside the held-out fold that have one label, 0 or 1."""
    label = F.col(label_col).cast("int")
    return (
        labels.filter(label.isin(0, 1) & F.col(id_col).isNotNull() & (fold(id_col) != held_out))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label).alias("label"), F.max(label).alias("other"))
        .filter(F.col("label") == F.col("other"))
    )


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.filter("text <> ''")


def labelled_rows(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    features,
    held_out: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(label, part, hash, data)`` of all labelled documents outside the held-out fold, written.

    ``features`` makes one bytes value per text of a column of some MB. An id with both
    labels, without one or with a NULL or empty text is left out; an id with several texts
    counts with the smallest, repeated rows count once, and other columns are ignored.
    ``part`` (0 to 9) splits the documents at random.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 3, 1 << 20):
                found = pa.array(features(some[3]), pa.binary())
                names = ["label", "part", "hash", "data"]
                yield pa.RecordBatch.from_arrays([*some.columns[:3], found], names)

    known = written(_known(labels, label_col, held_out, id_col).select("id", "label"), "labelled-ids")
    if known.count() <= MOST_BROADCAST:
        known = F.broadcast(known)
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.lit(10)).cast("int").alias("part")
    rows = (
        _texts(docs, id_col, text_col)
        .join(known, "id")
        .groupBy("id", "label")
        .agg(F.min("text").alias("text"))
        .select("label", part, F.xxhash64("id", F.lit("shard")).alias("hash"), "text")
        .mapInArrow(run, "label int, part int, hash long, data binary")
    )
    return written(rows, "labelled")


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    per_class: int,
    held_out: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(label, part, text)`` of at most ``per_class`` documents for either label.

    Only ids outside the held-out fold are used, those of the smallest hashes first, until
    their texts hold ``SAMPLE_BYTES``; the text that passes this bound is the last one, whole,
    so no text is left out for its size. An id with both labels, without one or with a NULL or
    empty text is left out; an id with several texts counts with the smallest, repeated rows
    count once, and other columns are ignored. ``part`` (0 to 9) splits the sample at random.
    """
    known = _known(labels, label_col, held_out, id_col)
    order = F.xxhash64("id")
    chosen = known.filter("label = 0").orderBy(order, "id").limit(per_class)
    chosen = chosen.union(known.filter("label = 1").orderBy(order, "id").limit(per_class))
    # At most two ids and labels per sampled row: small whatever the tables' sizes.
    found = written(
        _texts(docs, id_col, text_col)
        .join(F.broadcast(chosen.select("id", "label")), "id")
        .groupBy("id", "label")
        .agg(F.min("text").alias("text")),
        "sample",
    )
    # One short row per sampled document.
    before = Window.partitionBy("label").orderBy(order, "id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.select("id", "label", F.octet_length("text").cast("long").alias("size"))
    kept = sizes.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    kept = kept.filter(F.col("before") < SAMPLE_BYTES).select("id")
    return found.join(F.broadcast(kept), "id").select(
        "label", F.pmod(F.xxhash64("id", F.lit("part")), F.lit(10)).alias("part"), "text"
    )


def sampled_features(sample: DataFrame, features) -> list[tuple[int, int, bytes]]:
    """Apply ``features`` (column of texts to one bytes value per text) in tasks and fetch.

    Rows come in a fixed order, so that training does not depend on the partitioning.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(features(batch[2]), pa.binary())
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], found], ["label", "part", "found"])

    rows = sample.select(F.col("label"), F.col("part").cast("int"), "text").mapInArrow(
        run, "label int, part int, found binary"
    )
    return sorted((r.label, r.part, bytes(r.found)) for r in rows.collect())


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def best_cut(scores: np.ndarray, labels: np.ndarray) -> float:
    """The threshold with the best F1 for label 1, in the middle of the gap it lies in."""
    values, place = np.unique(scores, return_inverse=True)
    counts = np.zeros((len(values), 2))
    np.add.at(counts, (place, labels.astype(int)), 1)
    return best_counted_cut(values, counts)


def best_counted_cut(values: np.ndarray, counts: np.ndarray) -> float:
    """``best_cut`` of rising values from their counts with label 0 and label 1."""
    some = np.flatnonzero(counts.any(1))[::-1]
    s, (n0, n1) = values[some], counts[some].T
    hits = np.cumsum(n1)
    f1 = 2 * hits / (np.cumsum(n0 + n1) + max(1, n1.sum()))
    k = int(f1.argmax())
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k]) - 1e-3


def platt(
    scores: np.ndarray, labels: np.ndarray, steps: int = 60, counts: np.ndarray | None = None
) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by damped Newton steps on smoothed targets.

    ``counts`` tells how many rows each score and label stands for.
    """
    counts = np.ones(len(scores)) if counts is None else counts
    n1, n0 = (labels * counts).sum(), ((1 - labels) * counts).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([scores, np.ones_like(scores)], 1)
    w = np.zeros(2)
    for _ in range(steps):
        p = sigmoid(x @ w)
        slope = x.T @ ((target - p) * counts) - 1e-3 * w
        curve = (x * (p * (1 - p) * counts)[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w + np.clip(np.linalg.solve(curve, slope), -2, 2)
    return float(w[0]), float(w[1])
