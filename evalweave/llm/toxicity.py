"""Toxicity: a convolutional text classifier over hashed word embeddings.

Every word is embedded as the sum of two hashed vectors, of the word and of its first
characters. Filters of several widths run over the words; the maximum of each over the
text feeds a logistic output. All labelled documents train it: shards of them learn side by
side and their weights are averaged after every epoch. Texts are scored in tasks. Thresholds
are calibrated by language, which is guessed from the text itself, on held-back documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evalweave.llm.labelled import best_counted_cut, fold, labelled_rows, sigmoid
from evalweave.llm.quality_rules import STOP_WORDS
from evalweave.llm.rounds import GRID, STEPS, Shard, averaged, grid_values, on_grid, shards, summed
from evalweave.llm.words import LETTERS, per_text, slices, text_bytes, word_hash, words

LANGUAGES = (*sorted(STOP_WORDS), "other")


@dataclass(frozen=True)
class Settings:
    """Sizes of the network and of the shards that train it."""

    shard_rows: int = 2000
    buckets: int = 1 << 16
    prefix_buckets: int = 1 << 14
    size: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    epochs: int = 6
    batch: int = 32
    rate: float = 0.05
    least_texts: int = 3  # with a bucket, for a vector of its own
    least_positives: int = 8  # of a language, for a threshold of its own


@dataclass
class Network:
    """Weights: word and prefix vectors, filters per width and offset, output."""

    settings: Settings
    word_vectors: np.ndarray
    prefix_vectors: np.ndarray
    filters: list[np.ndarray]  # per width: (width, size, filters)
    bias: np.ndarray  # per filter
    out: np.ndarray
    out_bias: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    slope: float = 1.0

    def responses(self, w: np.ndarray, p: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Response of every filter at every word, windows ending with their text."""
        x = self.word_vectors[w] + self.prefix_vectors[p]
        found = []
        for bank in self.filters:
            total = x @ bank[0]
            for k in range(1, len(bank)):
                if k < len(x):
                    same = docs[k:] == docs[:-k]
                    total[:-k] += (x[k:] @ bank[k]) * same[:, None]
            found.append(total)
        return np.concatenate(found, 1) + self.bias

    def logits(self, w: np.ndarray, p: np.ndarray, docs: np.ndarray, first: np.ndarray) -> np.ndarray:
        pooled = per_text(np.maximum(self.responses(w, p, docs), 0), first, np.maximum)
        return pooled @ self.out + self.out_bias


def buckets(found, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of their first characters."""
    w = (found.hashes % np.uint64(settings.buckets)).astype(np.int32)
    p = (found.prefixes % np.uint64(settings.prefix_buckets)).astype(np.int32)
    return w, p


def _stop_table() -> tuple[np.ndarray, np.ndarray]:
    pairs = sorted(
        (word_hash(word), k) for k, lang in enumerate(LANGUAGES[:-1]) for word in STOP_WORDS[lang].split()
    )
    shared = {h for h, _ in pairs if sum(h == x for x, _ in pairs) > 1}
    pairs = [x for x in pairs if x[0] not in shared]
    return np.array([h for h, _ in pairs], np.uint64), np.array([k for _, k in pairs])


def languages(found, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Index into ``LANGUAGES``: whose frequent words a text holds most of."""
    known, lang = table
    at = np.minimum(np.searchsorted(known, found.hashes), len(known) - 1)
    hit = np.flatnonzero(known[at] == found.hashes)
    counts = np.zeros((len(found.first) - 1, len(LANGUAGES)))
    np.add.at(counts, (found.docs[hit], lang[at[hit]]), 1)
    counts[:, -1] = 0.5
    return counts.argmax(1)


Text = tuple[int, np.ndarray, np.ndarray]  # label, word buckets, prefix buckets


def count_texts(total: np.ndarray, rows: list[Text], settings: Settings) -> None:
    """Add how many texts of either label hold each bucket, and in the last row how many are."""
    for label, w, p in rows:
        total[np.unique(w), label] += 1
        total[settings.buckets + np.unique(p), label] += 1
        total[-1, label] += 1


def _log_odds(counts: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    """How much more often a bucket occurs in texts of label 1, NaN if in too few texts."""
    n = n + 2.0
    odds = np.log(counts[:, 1] + 1) - np.log(n[1]) - np.log(counts[:, 0] + 1) + np.log(n[0])
    odds -= np.log(1 / n[1]) - np.log(1 / n[0])
    return np.where(counts.sum(1) >= least, odds, np.nan)


@dataclass
class Training:
    """A network and Adagrad's sums, which are packed as one table between epochs.

    Buckets of fewer than ``least_texts`` texts keep zero vectors: rare words would only let
    the network learn its texts by heart.
    """

    net: Network
    live_words: np.ndarray
    live_prefixes: np.ndarray
    share: float  # of texts of label 1
    sums: list[np.ndarray]  # of word and prefix vectors, banks, bias, output and its bias

    @classmethod
    def started(cls, counts: np.ndarray, settings: Settings, seed: int = 0) -> Training:
        """Vectors start from the log-odds of ``count_texts``."""
        rng = np.random.default_rng(seed)
        d, f, n = settings.size, settings.filters, counts[-1]
        parts = counts[: settings.buckets], counts[settings.buckets : -1]
        odds = [_log_odds(c, n, settings.least_texts) for c in parts]
        vectors = [np.zeros((len(o), d), np.float32) for o in odds]
        for vector, o in zip(vectors, odds):
            vector[:, 0] = np.nan_to_num(o)
        banks = [
            rng.normal(0, 0.3 / width, (width, d, f)).astype(np.float32)
            for width in settings.widths
        ]
        for width, bank in zip(settings.widths, banks):
            bank[:, 0, : f // 2] = 1 / width  # half of the filters start as averages of log-odds
        n_out = f * len(settings.widths)
        out = np.full(n_out, 1 / n_out, np.float32)
        net = Network(settings, *vectors, banks, np.zeros(n_out, np.float32), out)
        sums = [np.zeros(len(o)) for o in odds] + [np.zeros(b.shape) for b in banks]
        sums += [np.zeros(n_out), np.zeros(n_out), np.zeros(1)]
        share = n[1] / max(1, n.sum())
        return cls(net, *(~np.isnan(o) for o in odds), float(share), sums)

    def _dense(self) -> list[np.ndarray]:
        net = self.net
        return [*net.filters, net.bias, net.out, np.array([net.out_bias]), *self.sums[2:]]

    def packed(self) -> np.ndarray:
        """Vectors with their sums, a bucket a row; then all other weights and sums."""
        dense = np.concatenate([x.ravel() for x in self._dense()])
        width = self.net.settings.size + 1
        dense = np.pad(dense, (0, -len(dense) % width)).reshape(-1, width)
        vectors = np.concatenate([self.net.word_vectors, self.net.prefix_vectors])
        return np.concatenate([np.column_stack([vectors, np.concatenate(self.sums[:2])]), dense])

    def restored(self, table: np.ndarray) -> Training:
        """The state that ``packed`` gave as a table."""
        net, n = self.net, self.net.settings.buckets
        m = n + self.net.settings.prefix_buckets
        flat, parts = table[m:].ravel(), []
        for x in self._dense():
            parts.append(flat[: x.size].reshape(x.shape))
            flat = flat[x.size :]
        k = len(net.filters)
        moved = Network(
            net.settings,
            table[:n, :-1].astype(np.float32),
            table[n:m, :-1].astype(np.float32),
            [x.astype(np.float32) for x in parts[:k]],
            parts[k].astype(np.float32),
            parts[k + 1].astype(np.float32),
            float(parts[k + 2][0]),
        )
        sums = [table[:n, -1], table[n:m, -1], *parts[k + 3 :]]
        sums = [x.astype(float) for x in sums]
        return Training(moved, self.live_words, self.live_prefixes, self.share, sums)

    def epoch(self, rows: list[Text], seed: int | list[int]) -> None:
        """One pass over the texts, in an order of its own."""
        net, settings, share = self.net, self.net.settings, self.share
        d, f, n_out = settings.size, settings.filters, len(net.out)
        labels = np.array([r[0] for r in rows], int)
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        word_sums, prefix_sums, *bank_sums, bias_sums, out_sums, ob_sums = self.sums
        rate, eps = settings.rate, 1e-8
        order = np.random.default_rng(seed).permutation(len(rows))
        for at in range(0, len(order), settings.batch):
            part = order[at : at + settings.batch]
            w = np.concatenate([rows[i][1] for i in part])
            p = np.concatenate([rows[i][2] for i in part])
            sizes = np.array([len(rows[i][1]) for i in part])
            first = np.concatenate(([0], np.cumsum(sizes)))
            docs = np.repeat(np.arange(len(part)), sizes)
            z = net.responses(w, p, docs)
            peak = np.stack([z[a:b].argmax(0) + a for a, b in zip(first[:-1], first[1:])])
            pooled = np.maximum(z[peak, np.arange(n_out)], 0)
            error = (sigmoid(pooled @ net.out + net.out_bias) - labels[part]) * weight[part]
            error /= len(part)
            back = error[:, None] * net.out * (pooled > 0)
            step = pooled.T @ error + 1e-4 * net.out
            out_sums += step**2
            net.out = net.out - (rate * step / np.sqrt(out_sums + eps)).astype(np.float32)
            ob_sums += error.sum() ** 2
            net.out_bias -= float(rate * error.sum() / np.sqrt(ob_sums[0] + eps))
            step = back.sum(0)
            bias_sums += step**2
            net.bias = net.bias - (rate * step / np.sqrt(bias_sums + eps)).astype(np.float32)
            at_words, at_prefixes, moves = [], [], []
            for b, width in enumerate(settings.widths):
                cols = slice(b * f, b * f + f)
                g, top = back[:, cols], peak[:, cols]
                step = np.zeros_like(net.filters[b])
                for k in range(width):
                    spot = np.minimum(top + k, len(w) - 1)
                    live = g * (top + k < first[1:, None])
                    x = net.word_vectors[w[spot]] + net.prefix_vectors[p[spot]]
                    step[k] = np.einsum("if,ifd->df", live, x)
                    at_words.append(w[spot].ravel())
                    at_prefixes.append(p[spot].ravel())
                    moves.append((live[:, :, None] * net.filters[b][k].T[None]).reshape(-1, d))
                bank_sums[b] += step**2
                net.filters[b] -= (rate * step / np.sqrt(bank_sums[b] + eps)).astype(np.float32)
            moves = np.concatenate(moves)
            for vectors, total, known, spots in (
                (net.word_vectors, word_sums, self.live_words, np.concatenate(at_words)),
                (net.prefix_vectors, prefix_sums, self.live_prefixes, np.concatenate(at_prefixes)),
            ):
                kept = known[spots]
                touched, where = np.unique(spots[kept], return_inverse=True)
                step = np.zeros((len(touched), d))
                np.add.at(step, where, moves[kept])
                total[touched] += (step**2).mean(1)
                vectors[touched] -= rate * step / np.sqrt(total[touched] + eps)[:, None]


def train(rows: list[Text], settings: Settings, seed: int = 0) -> Network:
    """Fit to texts in memory."""
    rows = [r for r in rows if len(r[1])]
    counts = np.zeros((settings.buckets + settings.prefix_buckets + 1, 2), np.int64)
    count_texts(counts, rows, settings)
    training = Training.started(counts, settings, seed)
    if counts[-1].all():
        for turn in range(settings.epochs):
            training.epoch(rows, [seed, turn])
    return training.net


def calibrate(net: Network, counts: np.ndarray) -> None:
    """Threshold per language from ``(language, place on the grid, label)`` counts.

    One with few positives takes the threshold of all.
    """
    values, overall = grid_values() + 0.5 / STEPS, counts.sum(0)
    both = overall.any(0).all()
    shared = best_counted_cut(values, overall) if both else 0.0
    net.thresholds = dict.fromkeys(LANGUAGES, shared)
    for name, own in zip(LANGUAGES, counts):
        if own[:, 1].sum() >= net.settings.least_positives and own[:, 0].any():
            net.thresholds[name] = best_counted_cut(values, own)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Network:
    """Train on all labelled documents; a fifth of them sets the thresholds.

    Of ``docs``, ids with a label 0 or 1 and a text are used, see ``labelled_rows`` for NULLs,
    empty texts, repeated rows and ties; texts of any size count, columns besides ids and texts
    do not. Buckets' log-odds and outputs are counted over all of them; an output counts in
    steps of 1/1024. Without documents of both labels the network finds nothing toxic.
    """
    table = _stop_table()
    # Two bytes a bucket, if they do.
    kind = np.uint16 if max(settings.buckets, settings.prefix_buckets) <= 1 << 16 else np.int32

    def features(column: pa.Array) -> list[bytes]:
        found = words(*text_bytes(column), LETTERS)
        w, p = buckets(found, settings)
        lang = languages(found, table)
        return [
            np.concatenate((lang[i : i + 1], w[a:b], p[a:b])).astype(kind).tobytes()
            for i, (a, b) in enumerate(zip(found.first[:-1], found.first[1:]))
        ]

    def parsed(shard: Shard, held: bool) -> tuple[list[Text], list[int]]:
        texts, langs = [], []
        for label, part, data in zip(shard.labels.tolist(), shard.parts, shard.rows):
            if (part < 2) == held:
                row = np.frombuffer(data, kind).astype(np.int32)
                n = (len(row) - 1) // 2
                texts.append((label, row[1 : 1 + n], row[1 + n :]))
                langs.append(int(row[0]))
        return texts, langs

    def training_texts(shard: Shard) -> list[Text]:
        return [r for r in parsed(shard, False)[0] if len(r[1])]

    rows = labelled_rows(docs, labels, "toxic", features)
    both = {r.label for r in rows.select("label").distinct().collect()} == {0, 1}
    shape = (settings.buckets + settings.prefix_buckets + 1, 2)
    if not both:
        net = Training.started(np.zeros(shape, np.int64), settings).net
        net.thresholds = dict.fromkeys(LANGUAGES, 1e3)
        return net
    packed, n_shards = shards(rows, settings.shard_rows)
    counts = summed(packed, shape, lambda total, s: count_texts(total, training_texts(s), settings))
    training = Training.started(counts, settings)

    def learn(state: np.ndarray, shard: Shard, turn: int) -> np.ndarray:
        texts = training_texts(shard)
        own = training.restored(state)
        if texts:
            own.epoch(texts, [shard.number, turn])
        return own.packed()

    if counts[-1].all():
        state = averaged(packed, n_shards, training.packed(), learn, settings.epochs)
        training = training.restored(state)
    net = training.net
    for held in (True, False):

        def outputs(total: np.ndarray, shard: Shard, held: bool = held) -> None:
            texts, langs = parsed(shard, held)
            for at in range(0, len(texts), 256):
                some = texts[at : at + 256]
                first = np.concatenate(([0], np.cumsum([len(r[1]) for r in some])))
                w, p = np.concatenate([r[1] for r in some]), np.concatenate([r[2] for r in some])
                logits = net.logits(w, p, np.repeat(np.arange(len(some)), np.diff(first)), first)
                places = np.array(langs[at : at + 256]) * GRID + on_grid(logits)
                np.add.at(total, (places, [r[0] for r in some]), 1)

        found = summed(packed, (len(LANGUAGES) * GRID, 2), outputs)
        if found.any():
            break
    calibrate(net, found.reshape(len(LANGUAGES), GRID, 2))
    return net


def score(
    docs: DataFrame,
    net: Network,
    cut: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row.

    A NULL or empty text has no words and scores what the output's bias gives; a NULL id
    stays NULL and counts as held out; repeated rows give a row each, an empty table gives
    none, and other columns are ignored whatever their names. Memory is bounded by a few MB
    of text at a time, or one text.
    """
    table = _stop_table()
    cuts = np.array([net.thresholds.get(name, 0.0) for name in LANGUAGES])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 1 << 20):
                found = words(*text_bytes(part[2]), LETTERS)
                w, p = buckets(found, net.settings)
                logits = net.logits(w, p, found.docs, found.first)
                value = sigmoid(net.slope * (logits - cuts[languages(found, table)]))
                yield pa.RecordBatch.from_arrays(
                    [part[0], part[1], pa.array(value.astype(float))], ["id", "held_out", "score"]
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
