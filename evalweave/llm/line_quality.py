"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's score uses its own measures and those of the lines
before and after it; neighbouring labels are tied by transition weights. The marginal
probabilities of the lines, weighted by their length, make up the share of good text, and a
logistic curve turns that share into the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evalweave.llm.labelled import fold, labelled_sample, platt, sampled_features, sigmoid
from evalweave.llm.words import NOT_SPACE, byte_class, slices, text_bytes, words

_KINDS = {
    "upper": byte_class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "lower": byte_class(b"abcdefghijklmnopqrstuvwxyz"),
    "digit": byte_class(b"0123456789"),
    "symbol": byte_class(b"#*$%&<>"),
    "bar": byte_class(b"|"),
    "shout": byte_class(b"!"),
    "other": byte_class(b".,;:?-'\"()[]{}/\\@_=+~`^"),
}
_END = byte_class(b".!?")
N_OWN = 17


@dataclass(frozen=True)
class Settings:
    """Size of the training sample and of the fit."""

    per_class: int = 2000
    steps: int = 120
    rounds: int = 3
    rate: float = 0.15
    penalty: float = 1e-3


@dataclass
class Field:
    """Weights: measures of a line and its neighbours, first label, transitions, curve."""

    weights: np.ndarray
    first: np.ndarray
    moves: np.ndarray
    slope: float = 6.0
    offset: float = -3.0


def lines(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of lines that hold anything, and each text's first line."""
    feeds = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate((bounds[:-1], feeds + 1)))
    starts = starts[starts < len(data)]
    next_feed = np.append(feeds, len(data))[np.searchsorted(feeds, starts, "left")]
    next_text = np.append(bounds, len(data))[np.searchsorted(bounds, starts, "right")]
    ends = np.minimum(next_feed, next_text)
    held = ends > starts
    starts, ends = starts[held], ends[held]
    return starts, ends, np.searchsorted(starts, bounds, "left")


def measures(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of each line and its neighbours, the lines' lengths, each text's first line."""
    starts, ends, first = lines(data, bounds)
    n = len(starts)
    length = (ends - starts).astype(float)
    if not n:
        return np.zeros((0, 3 * N_OWN)), length, first
    counts = {}
    for name, kind in _KINDS.items():
        total = np.concatenate(([0], np.cumsum(kind[data], dtype=np.int64)))
        counts[name] = (total[ends] - total[starts]).astype(float)
    found = words(data, bounds, NOT_SPACE)
    line = np.searchsorted(starts, found.starts, "right") - 1
    n_words = np.bincount(line, minlength=n).astype(float)
    again = np.zeros(len(line), bool)
    if len(line) > 1:
        again[1:] = (found.hashes[1:] == found.hashes[:-1]) & (line[1:] == line[:-1])
    repeats = np.bincount(line, again, minlength=n)
    some = np.maximum(n_words, 1)
    letters = np.maximum(counts["upper"] + counts["lower"], 1)
    upper, symbol = counts["upper"] / letters, counts["symbol"] / some
    bar, shout, repeat = counts["bar"] / some, counts["shout"] / some, repeats / some
    own = np.stack(
        [
            np.ones(n),
            np.log1p(length) / 6,
            np.log1p(n_words) / 4,
            length / some / 10,
            upper,
            np.minimum(symbol, 4),
            bar,
            np.minimum(shout, 2),
            repeat,
            counts["digit"] / length,
            counts["other"] / some,
            upper > 0.5,
            symbol > 0.3,
            bar > 0.2,
            shout > 0.3,
            repeat > 0.3,
            _END[data[ends - 1]],
        ],
        1,
    ).astype(float)
    opens = np.zeros(n, bool)
    opens[first[:-1][np.diff(first) > 0]] = True
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[opens] = 0
    after[np.roll(opens, -1)] = 0
    return np.concatenate((own, before, after), 1), length, first


def marginals(
    scores: np.ndarray, first: np.ndarray, field: Field
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of every line, expected transitions, and expected first labels.

    Forward and backward over all texts at once, one step per line number. ``scores`` are
    log-odds of good from the measures.
    """
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    sizes = sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(longest), "left")  # texts with line t
    at = first[:-1][order]
    top = np.maximum(scores, 0)
    own = np.stack([np.exp(-top), np.exp(scores - top)], 1)
    move, start = np.exp(field.moves), np.exp(field.first)
    ahead, back = np.zeros_like(own), np.ones_like(own)
    state = np.zeros((0, 2))
    for t in range(longest):
        spot = at[: live[t]] + t
        state = (start if t == 0 else state[: live[t]] @ move) * own[spot]
        state = state / state.sum(1, keepdims=True)
        ahead[spot] = state
    moved = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        spot = at[: live[t + 1]] + t
        later = own[spot + 1] * back[spot + 1]
        value = later @ move.T
        joint = ahead[spot][:, :, None] * move[None] * later[:, None, :]
        moved += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        back[spot] = value / value.sum(1, keepdims=True)
    both = ahead * back
    good = both[:, 1] / both.sum(1) if len(both) else np.zeros(0)
    opening = good[at] if len(at) else np.zeros(0)
    return good, moved, np.array([(1 - opening).sum(), opening.sum()])


def good_share(x: np.ndarray, length: np.ndarray, first: np.ndarray, field: Field) -> np.ndarray:
    """Share of each text's bytes on good lines; 0 for a text without lines."""
    good, _, _ = marginals(x @ field.weights, first, field)
    total = np.concatenate(([0.0], np.cumsum(length)))
    part = np.concatenate(([0.0], np.cumsum(length * good)))
    size = total[first[1:]] - total[first[:-1]]
    return np.where(size > 0, (part[first[1:]] - part[first[:-1]]) / np.maximum(size, 1), 0.0)


def train(
    texts: list[tuple[int, np.ndarray, np.ndarray]], settings: Settings = Settings()
) -> Field:
    """Fit to ``(label, measures, lengths)`` of texts.

    Only texts are labelled. Lines start with the label of their text; then lines of bad
    texts that surely look good are relabelled, except each text's worst, and the fit goes on.
    """
    texts = [t for t in texts if len(t[2])]
    field = Field(np.zeros(3 * N_OWN), np.zeros(2), np.zeros((2, 2)))
    if not texts:
        return field
    x = np.concatenate([t[1] for t in texts])
    first = np.concatenate(([0], np.cumsum([len(t[2]) for t in texts])))
    label = np.repeat([t[0] for t in texts], np.diff(first)).astype(float)
    weight = np.where(label == 1, 0.5 / max(label.mean(), 1e-6), 0.5 / max(1 - label.mean(), 1e-6))
    weight /= weight.mean()
    y = label.copy()
    inner = np.ones(len(y), bool)
    inner[first[1:] - 1] = False
    inner = np.flatnonzero(inner)
    opens = first[:-1]
    sums = [np.zeros_like(field.weights), np.zeros((2, 2)), np.zeros(2)]
    for turn in range(settings.rounds):
        if turn:
            good, _, _ = marginals(x @ field.weights, first, field)
            y = np.where((label == 0) & (good > 0.9), 1.0, label)
            for a, b in zip(first[:-1], first[1:]):
                if label[a] == 0:
                    y[a + int(good[a:b].argmin())] = 0.0
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[inner].astype(int), y[inner + 1].astype(int)), 1)
        opening = np.array([(1 - y[opens]).sum(), y[opens].sum()])
        for turn_step in range(settings.steps):
            # Shrinking steps settle; steps of one size would swing around the optimum.
            rate = settings.rate * (1 - turn_step / settings.steps)
            good, moved, began = marginals(x @ field.weights, first, field)
            steps = [
                x.T @ ((y - good) * weight) / len(y) - settings.penalty * field.weights,
                (seen - moved) / len(y) - settings.penalty * field.moves,
                (opening - began) / len(y) - settings.penalty * field.first,
            ]
            for k, (value, step) in enumerate(
                zip((field.weights, field.moves, field.first), steps)
            ):
                sums[k] = 0.9 * sums[k] + 0.1 * step**2
                value += rate * step / (np.sqrt(sums[k]) + 1e-3)
    return field


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Field:
    """Train on a bounded sample of labelled documents; a fifth of it sets the curve.

    Of ``docs``, ids with a label 0 or 1 and a text are used, see ``labelled_sample`` for NULLs,
    empty texts, repeated rows and ties; texts of any size count, columns besides ids and texts
    do not. Without documents of both labels no curve is fitted, and a score only says what
    share of a text's lines the field takes for good (half without any label).
    """

    def features(column: pa.Array) -> list[bytes]:
        x, length, first = measures(*text_bytes(column))
        rows = np.concatenate((length[:, None], x[:, :N_OWN]), 1).astype(np.float32)
        return [rows[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]

    found = sampled_features(labelled_sample(docs, labels, "quality", settings.per_class), features)
    texts, held = [], []
    for label, part, data in found:
        row = np.frombuffer(data, np.float32).reshape(-1, N_OWN + 1).astype(float)
        own, zero = row[:, 1:], np.zeros((1, N_OWN))
        before, after = np.concatenate((zero, own))[:-1], np.concatenate((own, zero))[1:]
        text = (label, np.concatenate((own, before, after), 1), row[:, 0])
        (held if part < 2 else texts).append(text)
    field = train(texts, settings)
    held = [t for t in held if len(t[2])] or [t for t in texts if len(t[2])]
    if len({t[0] for t in held}) == 2:
        first = np.concatenate(([0], np.cumsum([len(t[2]) for t in held])))
        x, length = np.concatenate([t[1] for t in held]), np.concatenate([t[2] for t in held])
        share = good_share(x, length, first, field)
        field.slope, field.offset = platt(share, np.array([t[0] for t in held], float))
    return field


def score(
    docs: DataFrame,
    field: Field,
    cut: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row.

    A NULL or empty text has no good line and takes the curve's lowest value; a NULL id
    stays NULL and counts as held out; repeated rows give a row each, an empty table gives
    none, and other columns are ignored whatever their names. Memory is bounded by a few MB
    of text at a time, or one text.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                share = good_share(*measures(*text_bytes(part[2])), field)
                value = sigmoid(field.slope * share + field.offset)
                yield pa.RecordBatch.from_arrays(
                    [part[0], part[1], pa.array(value)], ["id", "held_out", "score"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"),
        (fold(id_col) == 0).alias("held_out"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    found = rows.mapInArrow(scored, f"id {kind}, held_out boolean, score double")
    return found.select(
        F.col("id").alias(id_col),
        "held_out",
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )


def keep_good(
    docs: DataFrame,
    field: Field,
    cut: float = 0.3,
    text_col: str = "text",
) -> DataFrame:
    """Rows of ``docs``, all columns unchanged, whose text scores at least ``cut``.

    Texts pass through the task that scores them, so nothing is joined and a repeated or
    NULL id does no harm. NULL and empty texts are dropped if the curve's lowest value is.
    """
    names = docs.columns
    at = names.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(names)):
                share = good_share(*measures(*text_bytes(part[len(names)])), field)
                good = sigmoid(field.slope * share + field.offset) >= cut
                yield part.filter(pa.array(good)).select(range(len(names)))

    own = [F.col(f"`{name}`") for name in names]
    spare = "_scored" + "_" * max(map(len, names))  # longer than any name, so not one of them
    text = F.coalesce(own[at].cast("string"), F.lit("")).alias(spare)
    return docs.select(*own, text).mapInArrow(kept, docs.schema)
