"""LM scoring by a Katz backoff model of any order with Good-Turing discounts.

An n-gram's chance is its discounted share of its context's followers if it was seen in
training, else the context's backoff weight times the chance of its suffix, and so on down to
single words; probabilities sum to exactly one over all known words and one unknown one.

Texts are cut into chunks of some million tokens. A chunk sends the hashes of its distinct
n-grams of every order with their counts, ascending and as differences, one row per bucket of
hashes; a bucket adds up the counts of all chunks and answers each. From then on a chunk knows
what the corpus says of its n-grams. A context's discounted followers and their chances at
the order below are summed where they lie: each n-gram is summed by the one chunk that owns it,
and contexts that several chunks hold are added up in buckets again, order after order. Nothing
that grows with the number of words or n-grams reaches the driver.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from evalweave.llm.labelled import fold
from evalweave.llm.shared import moved
from evalweave.llm.words import NOT_SPACE, mixed, slices, text_bytes, words

# Counts up to this one are discounted.
LARGEST_DISCOUNTED = 5
TOKENS_AT_ONCE = 1_000_000
# Tokens of the corpus per bucket of n-gram hashes: a bucket holds at most as many n-grams.
TOKENS_PER_BUCKET = 500_000
# Hashes of a text's end and of what comes before its first word.
_END, _START = np.uint64(0), np.uint64(1)
# Added to an order, this is the number of the step that sums up its contexts.
_SUMS = 1000


@dataclass(frozen=True)
class Settings:
    order: int = 3  # words of the longest n-grams, at least 2
    training_fold: int = 1  # documents of this fold are not learnt from


@dataclass(frozen=True)
class Discounts:
    """Katz's discounted counts of one order, and the mass that they leave."""

    total: int
    ratios: np.ndarray  # by count; the last holds for all larger counts
    left: float

    def share(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return counts * self.ratios[np.minimum(counts, len(self.ratios) - 1)]


def discounts(counts_of_counts: dict[int, int], total: int) -> Discounts:
    """Good-Turing ratios for counts 1 to ``LARGEST_DISCOUNTED``.

    A ratio outside 0 to 1, as sparse counts of counts give, is replaced by 1. If nothing is
    discounted, every count is scaled so that one token's mass is left.
    """
    k = LARGEST_DISCOUNTED
    n = np.array([0] + [counts_of_counts.get(r, 0) for r in range(1, k + 2)], float)
    ratios = np.ones(k + 2)
    if n[1]:
        beyond = (k + 1) * n[k + 1] / n[1]
        for r in range(1, k + 1):
            if n[r] and beyond < 1:
                ratio = ((r + 1) * n[r + 1] / (r * n[r]) - beyond) / (1 - beyond)
                ratios[r] = ratio if 0 < ratio < 1 else 1
    left = sum((1 - ratios[r]) * r * n[r] for r in range(1, k + 1)) / max(total, 1)
    if left <= 0:
        ratios[:] = total / (total + 1)
        left = 1 / (total + 1)
    return Discounts(total, ratios, left)


def backoffs(
    total: np.ndarray, kept: np.ndarray, lower: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Scales of discounted counts and backoff weights of predecessors.

    From their followers' counts, discounted counts and unigram shares. Discounts leave at
    least the mass of one token, or none if every class follows; the weight spreads exactly
    what is left over the classes that do not follow.
    """
    mass, unseen = kept / total, 1 - lower
    open_ = unseen > 1e-12
    scale = np.where(open_, np.minimum(1.0, total / (total + 1) / mass), 1 / mass)
    return scale, np.where(open_, (1 - scale * mass) / np.where(open_, unseen, 1), 0.0)


@cache
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """Made once per process: a new one costs more than packing a bucket's numbers."""
    return zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()


def _packed(values: np.ndarray, kind: str = "<i4") -> bytes:
    """Small numbers as bytes, compressed plane by plane."""
    flat = np.ascontiguousarray(values, kind)
    planes = flat.view(np.uint8).reshape(-1, flat.itemsize).T
    return _codec()[0].compress(np.ascontiguousarray(planes))


def _unpacked(data: bytes, kind: str = "<i4") -> np.ndarray:
    raw = np.frombuffer(_codec()[1].decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _packed_floats(values: np.ndarray) -> bytes:
    """Numbers of which many are equal, as places among the distinct ones."""
    distinct, place = np.unique(values, return_inverse=True)
    head = _packed(distinct, "<f8")
    return len(head).to_bytes(4, "little") + head + _packed(place)


def _unpacked_floats(data: bytes) -> np.ndarray:
    size = 4 + int.from_bytes(data[:4], "little")
    return _unpacked(data[4:size], "<f8")[_unpacked(data[size:])]


def _packed_names(names: np.ndarray) -> bytes:
    """Hashes as differences, which are short where they ascend."""
    return _packed(np.diff(names, prepend=np.uint64(0)), "<u8")


def _packed_places(places: np.ndarray) -> bytes:
    """Ascending numbers, as differences."""
    return _packed(np.diff(places, prepend=0))


def _unpacked_places(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data), dtype=np.int32)


def _unpacked_names(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, "<u8"), dtype=np.uint64)


def _chunks(docs: DataFrame, settings: Settings, id_col: str, text_col: str) -> DataFrame:
    """Tokens of some documents per row: numbers into a dictionary of distinct tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n_chunks = TaskContext.get().partitionId(), 0
        held: list = []
        size = 0

        def done() -> pa.RecordBatch:
            nonlocal held, size, n_chunks
            tokens = np.concatenate([h[2] for h in held])
            lengths = np.concatenate([h[3] for h in held])
            out = np.concatenate([np.asarray(h[1].to_pylist(), bool) for h in held])
            ids = pa.concat_arrays([h[0] for h in held])
            kinds, number, counts = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            one = np.array([0, len(ids)], np.int32)
            row = [
                pa.array([task << 20 | n_chunks], pa.int64()),
                pa.ListArray.from_arrays(pa.array(one), ids),
                pa.ListArray.from_arrays(pa.array(one), pa.array(out)),
                pa.array([_packed(lengths)], pa.binary()),
                pa.array([_packed(rank[number])], pa.binary()),
                # Those that occur equally often ascend.
                pa.array([_packed_names(kinds[order])], pa.binary()),
                pa.array([len(tokens)], pa.int64()),
            ]
            held, size, n_chunks = [], 0, n_chunks + 1
            return pa.RecordBatch.from_arrays(row, names)

        for batch in batches:
            for part in slices(batch, 2):
                found = words(*text_bytes(part[2]), NOT_SPACE)
                lengths = np.diff(found.first) + 1
                tokens = np.full(len(found.hashes) + len(lengths), _END)
                tokens[np.arange(len(found.hashes)) + found.docs] = found.hashes
                held.append((part[0], part[1], tokens, lengths))
                size += len(tokens)
                if size >= TOKENS_AT_ONCE:
                    yield done()
        if held:
            yield done()

    names = ["chunk", "ids", "held_out", "lengths", "tokens", "kinds", "n_tokens"]
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"),
        (fold(id_col) == settings.training_fold).alias("held_out"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(
        run,
        f"chunk long, ids array<{kind}>, held_out array<boolean>, lengths binary, "
        "tokens binary, kinds binary, n_tokens long",
    )


@dataclass
class Level:
    """A chunk's distinct n-grams of one order, by ascending hash.

    An n-gram is known by the numbers of its context (all but its last word) and of its suffix
    (all but its first) among the n-grams one order lower.
    """

    names: np.ndarray
    at: np.ndarray  # tokens with enough words before them
    number: np.ndarray  # of each of these tokens: its n-gram
    context: np.ndarray
    suffix: np.ndarray


class Chunk:
    """The n-grams of a chunk up to an order, and what the corpus says of them."""

    def __init__(self, row: dict, order: int, counting: bool = False):
        """To be counted, n-grams of the highest order need no numbers of lower ones."""
        self.lengths = _unpacked(row["lengths"]).astype(np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.learnt = np.repeat(~np.asarray(row["held_out"], bool), self.lengths)
        kinds = np.append(_unpacked_names(row["kinds"]), _START)
        by_name = np.argsort(kinds)
        rank = np.empty(len(kinds), np.int32)
        rank[by_name] = np.arange(len(kinds), dtype=np.int32)
        tokens = rank[_unpacked(row["tokens"])]
        names = kinds[by_name]
        self.start, self.end = rank[-1], int(np.searchsorted(names, _END))
        none = np.zeros(0, np.int32)
        self.levels = [Level(names, np.arange(len(tokens), dtype=np.int32), tokens, none, none)]
        depth = np.arange(len(tokens), dtype=np.int32) - np.repeat(self.first.astype(np.int32), self.lengths)
        # Hash and number of each token's n-gram of the order before.
        word, gram, number = names[tokens], names[tokens], tokens
        for n in range(2, order + 1):
            context, context_name = np.empty_like(number), np.empty_like(gram)
            context[1:], context_name[1:] = number[:-1], gram[:-1]
            if n == 2:
                context[self.first], context_name[self.first] = self.start, _START
            at = np.flatnonzero(depth >= n - 2).astype(np.int32)
            own = mixed(context_name[at] * np.uint64(0x9E3779B97F4A7C15) + word[at])
            del context_name
            if counting and n < order:
                gram = np.zeros_like(gram)
                gram[at] = own
                continue
            sort = np.argsort(own)
            ranked = own[sort]
            new = np.ones(len(at), bool)
            new[1:] = ranked[1:] != ranked[:-1]
            one = at[sort[new]]
            of_token = np.empty(len(at), np.int32)
            of_token[sort] = np.cumsum(new, dtype=np.int32) - 1
            self.levels.append(Level(ranked[new], at, of_token, context[one], number[one]))
            if n < order:
                gram, number = np.zeros_like(gram), np.zeros_like(number)
                gram[at], number[at] = own, of_token

    def counts(self, level: Level) -> np.ndarray:
        """Occurrences of the level's n-grams in the chunk's training rows."""
        return np.bincount(level.number[self.learnt[level.at]], minlength=len(level.names))


    def told(self, answers: pa.Table, found: list[Discounts], order: int) -> None:
        """Take the corpus counts that came back; chances up to ``order`` follow from them."""
        parts: dict[int, list] = defaultdict(list)
        for row in sorted(answers.to_pylist(), key=lambda r: (r["step"], r["bucket"])):
            parts[row["step"]].append(row)

        def joined(step: int, column: str, unpacked=_unpacked_floats, kind: type = float) -> np.ndarray:
            return np.concatenate([np.zeros(0, kind), *(unpacked(r[column]) for r in parts[step])])

        whole = lambda data: _unpacked(data, "<i8")
        states = [joined(n, "data", whole, np.int64) for n in range(1, len(self.levels) + 1)]
        self.corpus = [s >> 2 for s in states]
        self.owned = [s & 2 > 0 for s in states]
        self.shared = [s & 1 > 0 for s in states]
        # Unpacked for one order of contexts only, where their sums are sent.
        self.places = [[r["more"] for r in parts[n]] for n in range(1, len(states))]
        self.found = found
        seen = found[0].share(self.corpus[0]) / max(found[0].total, 1)
        self.chances = [np.where(self.corpus[0] > 0, seen, found[0].left)]
        for n in range(2, order + 1):
            level, totals, asked = self.levels[n - 1], self.totals(n), self.asked(n)
            kept, lower = self.sums(n)
            # A context that training rows do not follow leaves all to its suffix.
            scales, weights = np.ones(len(totals)), np.ones(len(totals))
            own = (kept > 0) & ~asked
            scales[own], weights[own] = backoffs(totals[own], kept[own], lower[own])
            scales[asked] = joined(_SUMS + n, "data")
            weights[self.wanted(n)] = joined(_SUMS + n, "more")
            counts, context = self.corpus[n - 1], level.context
            chances = found[n - 1].share(counts) * scales[context] / np.maximum(totals[context], 1)
            unseen = np.flatnonzero(counts == 0)
            chances[unseen] = weights[context[unseen]] * self.chances[n - 2][level.suffix[unseen]]
            self.chances.append(chances)

    def totals(self, n: int) -> np.ndarray:
        """How often anything follows the contexts of n-grams of the order in training rows."""
        totals = self.corpus[n - 2].copy()
        if n == 2:
            totals[self.start] = totals[self.end]
        return totals

    def asked(self, n: int) -> np.ndarray:
        """Contexts of which other chunks hold a part."""
        return self.shared[n - 2] & (self.totals(n) > 0)

    def asked_places(self, n: int) -> np.ndarray:
        """Their places among all n-grams of their bucket that chunks share."""
        places = [np.zeros(0, np.int32), *map(_unpacked_places, self.places[n - 2])]
        return np.concatenate(places)[self.asked(n)[self.shared[n - 2]]]

    def wanted(self, n: int) -> np.ndarray:
        """Those of them whose backoff weight the chunk will use: something new follows."""
        new = np.zeros(len(self.levels[n - 2].names), bool)
        new[self.levels[n - 1].context[self.corpus[n - 1] == 0]] = True
        return new & self.asked(n)

    def sums(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """By context: discounted counts of its followers, and their chances one order lower.

        Only n-grams that the chunk owns are summed.
        """
        level, own = self.levels[n - 1], self.owned[n - 1]
        context, size = level.context[own], len(self.levels[n - 2].names)
        kept = self.found[n - 1].share(self.corpus[n - 1][own])
        lower = self.chances[n - 2][level.suffix[own]]
        # Without any n-gram, bincount returns integers.
        return tuple(np.bincount(context, w, size).astype(float) for w in (kept, lower))


_REPLY = "chunk long, step int, bucket int, data binary, more binary, few array<long>"


def _cuts(names: np.ndarray, bits: int) -> np.ndarray:
    """Bounds of the buckets, which are ranges of the hashes' first bits."""
    starts = np.arange(1 << bits, dtype=np.uint64)
    if bits:
        starts <<= np.uint64(64 - bits)
    return np.append(np.searchsorted(names, starts), len(names))


def _bucket_rows(
    chunk: int, step: int, names: np.ndarray, columns: dict, bits: int, places: np.ndarray | None = None
) -> list[dict]:
    """One row per bucket that holds any of the ascending ``names``; columns are whole numbers
    or floats. If the bucket knows the names, their ``places`` there are sent instead.
    """
    bounds = _cuts(names, bits)
    own = lambda a, b: (
        {"names": _packed_names(names[a:b])} if places is None else {"places": _packed_places(places[a:b])}
    )
    return [
        {"chunk": chunk, "step": step, "bucket": k}
        | own(a, b)
        | {c: (_packed_floats if v.dtype == float else _packed)(v[a:b]) for c, v in columns.items()}
        for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
        if b > a
    ]


_REQUEST = pa.schema(
    [("chunk", pa.int64()), ("step", pa.int32()), ("bucket", pa.int32()), ("names", pa.binary()), ("n", pa.binary())]
)
_PART = pa.schema(
    [*list(_REQUEST)[:3], *((c, pa.binary()) for c in ("places", "total", "wanted", "kept", "lower"))]
)
_ANSWER = pa.schema(
    [*list(_REQUEST)[:3], ("data", pa.binary()), ("more", pa.binary()), ("few", pa.list_(pa.int64()))]
)


def _gathered(table: pa.Table, column: str, unpacked) -> tuple[list[dict], np.ndarray, np.ndarray]:
    """A bucket's rows by chunk, where each one's n-grams begin, and the column of all n-grams."""
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    values = [unpacked(r[column]) for r in rows]
    return rows, np.cumsum([0, *(len(x) for x in values)]), np.concatenate(values)


def _count(table: pa.Table, placed: bool) -> pa.Table:
    """Add up a bucket's n-grams: each request gets the corpus count, whether the chunk owns the
    n-gram, and whether other chunks ask for it too; if ``placed``, also the places of those
    among all n-grams of the bucket that chunks share, by which their sums are known later.

    The first chunk that holds a training occurrence owns an n-gram.
    """
    rows, bounds, names = _gathered(table, "names", _unpacked_names)
    distinct, number = np.unique(names, return_inverse=True)
    n = np.concatenate([_unpacked(r["n"]) for r in rows]).astype(np.int64)
    holders = np.bincount(number, minlength=len(distinct))
    total = np.bincount(number, weights=n, minlength=len(distinct)).astype(np.int64)
    trained = np.flatnonzero(n)[::-1]
    owner = np.full(len(distinct), -1)
    owner[number[trained]] = trained
    owned = owner[number] == np.arange(len(number))
    shared = holders[number] > 1
    state = total[number] << 2 | owned.astype(np.int64) << 1 | shared
    place = np.cumsum(holders > 1)[number] - 1
    known = total[total > 0]
    few = [int((known == r).sum()) for r in range(1, LARGEST_DISCOUNTED + 2)]
    few += [int(known.sum()), len(known)]
    return pa.Table.from_pylist(
        [
            {k: r[k] for k in ("chunk", "step", "bucket")}
            | {"data": _packed(state[a:b], "<i8"), "few": None if i else few}
            | ({"more": _packed_places(place[a:b][shared[a:b]])} if placed else {})
            for i, (r, a, b) in enumerate(zip(rows, bounds[:-1], bounds[1:]))
        ],
        _ANSWER,
    )


def _add(table: pa.Table) -> pa.Table:
    """Add up the sums of a bucket's contexts over all chunks.

    Each chunk gets the scales of its contexts, and the weights of those it wants.
    """
    rows, bounds, number = _gathered(table, "places", _unpacked_places)
    sums = []
    for column in ("kept", "lower"):
        values = np.concatenate([_unpacked_floats(r[column]) for r in rows])
        sums.append(np.bincount(number, values).astype(float))
    totals = np.ones(len(sums[0]))
    totals[number] = np.concatenate([_unpacked_floats(r["total"]) for r in rows])
    # A text's end is asked for like any word, but nothing follows it.
    some = sums[0] > 0
    scales, weights = np.ones(len(totals)), np.ones(len(totals))
    scales[some], weights[some] = backoffs(totals[some], sums[0][some], sums[1][some])
    out = []
    for r, a, b in zip(rows, bounds[:-1], bounds[1:]):
        own = number[a:b]
        wanted = own[_unpacked(r["wanted"]) > 0]
        answer = {"data": _packed_floats(scales[own]), "more": _packed_floats(weights[wanted])}
        out.append({k: r[k] for k in ("chunk", "step", "bucket")} | answer)
    return pa.Table.from_pylist(out, _ANSWER)


def score(
    docs: DataFrame,
    settings: Settings = Settings(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Score every row by a model of the rows outside the held-out fold.

    ``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)``; scores are log10
    probabilities. A text's first words have the contexts that there are. A NULL or empty text
    is its end token alone; a NULL id stays NULL and falls in fold 0; repeated rows are learnt
    from and scored each; an empty table gives no row; without training rows all tokens are
    unknown; other columns are ignored whatever their names. A task holds one chunk of
    ``TOKENS_AT_ONCE`` tokens, or one text, or the n-grams of one order in one bucket.
    """
    order = settings.order
    if order < 2:
        raise ValueError("the model needs pairs at least")
    id_kind = docs.schema[id_col].dataType.simpleString()
    chunks = moved(_chunks(docs, settings, id_col, text_col), "lm-chunks")
    n_tokens = chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    bits = max(0, int(np.ceil(np.log2(max(n_tokens, 1) / TOKENS_PER_BUCKET))))

    def requests(orders: tuple[int, ...]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    chunk, rows = Chunk(row, orders[-1], counting=True), []
                    for n, level in zip(orders, chunk.levels[-len(orders):]):
                        counts = {"n": chunk.counts(level)}
                        rows += _bucket_rows(row["chunk"], n, level.names, counts, bits)
                    # Else this chunk would stay in memory beside the next one.
                    del chunk, level, counts
                    yield from pa.Table.from_pylist(rows, _REQUEST).to_batches()

        return run

    def count(table: pa.Table) -> pa.Table:
        # N-grams of the highest order are no contexts.
        return _count(table, table["step"][0].as_py() < order)

    counted = []
    # Order by order, as the requests are the largest tables that are shuffled; those of words
    # and pairs together are about as large as those of the next order.
    for orders in [(1, 2), *((n,) for n in range(3, order + 1))]:
        asked = chunks.select("chunk", "held_out", "lengths", "tokens", "kinds").mapInArrow(
            requests(orders), "chunk long, step int, bucket int, names binary, n binary"
        )
        counts = asked.groupBy("step", "bucket").applyInArrow(count, _REPLY)
        counted.append(moved(counts, f"lm-counts-{orders[-1]}"))
    answers = reduce(DataFrame.unionByName, counted)
    kinds_of = range(LARGEST_DISCOUNTED + 3)
    stated = {
        r[0]: list(r)[1:]
        for r in answers.filter("few IS NOT NULL")
        .groupBy("step")
        .agg(*(F.sum(F.col("few")[k]).alias(f"few_{k}") for k in kinds_of))
        .collect()
    }
    found = []
    for n in range(1, order + 1):
        *few, total, kinds = stated.get(n, [0] * len(kinds_of))
        found.append(discounts({r: c for r, c in enumerate(few, 1)}, total))
    total, n_kinds = found[0].total, stated[1][-1] if stated else 0
    floor = np.log10(total + 0.5 * (n_kinds + 1))

    def together(table: DataFrame):
        return table.groupBy("chunk").cogroup(answers.drop("few").groupBy("chunk"))

    def context_sums(n: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = []
            for row in left.to_pylist():
                chunk = Chunk(row, n)
                chunk.told(right, found, n - 1)
                mask = chunk.asked(n)
                kept, lower = chunk.sums(n)
                columns = {
                    "total": chunk.totals(n)[mask].astype(float),
                    "wanted": chunk.wanted(n)[mask].astype(int),
                    "kept": kept[mask],
                    "lower": lower[mask],
                }
                names = chunk.levels[n - 2].names[mask]
                rows += _bucket_rows(row["chunk"], _SUMS + n, names, columns, bits, chunk.asked_places(n))
            return pa.Table.from_pylist(rows, _PART)

        return run

    for n in range(2, order + 1):
        parts = moved(
            together(chunks.select("chunk", "held_out", "lengths", "tokens", "kinds")).applyInArrow(
                context_sums(n),
                "chunk long, step int, bucket int, places binary, total binary, wanted binary, "
                "kept binary, lower binary",
            ),
            f"lm-parts-{n}",
        )
        added = parts.groupBy("step", "bucket").applyInArrow(_add, _REPLY)
        sums = moved(added, f"lm-sums-{n}", used_up=(parts,))
        answers = answers.unionByName(sums)

    def evaluate(left: pa.Table, right: pa.Table) -> pa.Table:
        """Score a chunk's documents."""
        columns: dict[str, list] = {k: [] for k in ("id", "held_out", "n_tokens", "n_known", "base_score", "score")}
        for row in left.to_pylist():
            chunk = Chunk(row, order)
            chunk.told(right, found, order)
            counts = chunk.corpus[0][chunk.levels[0].number]
            chance = np.ones(len(counts))
            for level, chances in zip(chunk.levels[1:], chunk.chances[1:]):
                chance[level.at] = chances[level.number]
            columns["id"] += row["ids"]
            columns["held_out"] += row["held_out"]
            columns["n_tokens"] += chunk.lengths.tolist()
            for name, values in (
                ("n_known", (counts > 0).astype(np.int64)),
                ("base_score", np.log10(counts + 0.5) - floor),
                ("score", np.log10(chance)),
            ):
                columns[name] += np.add.reduceat(values, chunk.first).tolist()
        kinds = (left.schema.field("ids").type.value_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(columns.items(), kinds)})

    scored = together(chunks.drop("n_tokens")).applyInArrow(
        evaluate,
        f"id {id_kind}, held_out boolean, n_tokens long, n_known long, "
        "base_score double, score double",
    )
    return scored.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
