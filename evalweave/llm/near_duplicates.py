"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

Texts with the same set of five-word shingles are one class. Classes that share a band of
their MinHash signature are candidates: each is linked to the smallest class of its band,
and within every connected set of candidates all sets are compared, block against block,
so that no pair of a band goes unchecked and no list of pairs is ever written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evalweave.llm.components import components
from evalweave.llm.shared import written
from evalweave.llm.words import LETTERS, Words, mixed, slices, text_bytes, words

WORDS = 5
# Rows of at most 40 bytes that are sent to every executor; more are joined by shuffle.
MOST_BROADCAST = 1_000_000
# Sets compared with each other at once, and columns of their incidence held at once.
BLOCK = 512
_COLUMNS = 4096


@dataclass(frozen=True)
class Banding:
    """Bands of rows: a pair of similarity s shares a band with chance 1 - (1 - s^rows)^bands."""

    bands: int
    rows: int


def choose_banding(least: float = 0.8, recall: float = 0.999, hashes: int = 240) -> Banding:
    """The longest bands that recall a pair of similarity ``least`` with chance ``recall``."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1 - (1 - least**rows) ** bands >= recall:
            return Banding(bands, rows)
    raise ValueError("too few hashes for this recall")


def shingle_sets(found: Words) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's five-word runs; a shorter text is one run."""
    prime = np.uint64(0x9E3779B97F4A7C15)
    n = len(found.hashes)
    rolled = np.zeros(max(n - WORDS + 1, 0), np.uint64)
    for k in range(WORDS):
        rolled = rolled * prime + found.hashes[k : n - WORDS + 1 + k] if n >= WORDS else rolled
    rolled = mixed(rolled)
    for a, b in zip(found.first[:-1], found.first[1:]):
        if b - a >= WORDS:
            yield np.unique(rolled[a : b - WORDS + 1])
        elif b > a:
            total = np.uint64(b - a)
            for h in found.hashes[a:b]:
                total = np.uint64(int(total) * int(prime) + int(h) & 0xFFFFFFFFFFFFFFFF)
            yield mixed(np.array([total]))
        else:
            yield np.zeros(0, np.uint64)


def _constants(banding: Banding) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    n = banding.bands * banding.rows
    odd = rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return odd, rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(1, 1 << 62, banding.rows).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, banding: Banding, constants) -> np.ndarray:
    """One 64-bit hash per band of a set's MinHash signature."""
    times, plus, mix = constants
    low = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    best = np.full(len(times), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(best, (low[at : at + 1024] * times + plus).min(0), out=best)
    rows = best.reshape(banding.bands, banding.rows).astype(np.uint64)
    number = np.arange(banding.bands, dtype=np.uint64)
    return mixed((rows * mix).sum(1, dtype=np.uint64) * np.uint64(64) + number)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash")).alias("row"),
        text.alias("text"),
    )


def signatures(
    docs: DataFrame, banding: Banding, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(row, class, bands)``; ``class`` hashes the set of shingles, NULL without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        constants = _constants(banding)
        for batch in batches:
            for part in slices(batch, 1):
                classes, bands = [], []
                for shingles in shingle_sets(words(*text_bytes(part[1]), LETTERS)):
                    if len(shingles):
                        digest = hashlib.blake2b(shingles.tobytes(), digest_size=8).digest()
                        classes.append(int.from_bytes(digest, "little", signed=True))
                        bands.append(signature(shingles, banding, constants).view(np.int64))
                    else:
                        classes.append(None)
                        bands.append(np.zeros(0, np.int64))
                offsets = np.concatenate(([0], np.cumsum([len(b) for b in bands]))).astype(np.int32)
                values = np.concatenate(bands) if bands else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part[0],
                        pa.array(classes, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                    ],
                    ["row", "class", "bands"],
                )

    rows = _rows(docs, id_col, text_col)
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, class long, bands array<long>")


def _shared_counts(sets: list[np.ndarray], n_left: int) -> np.ndarray:
    """Sizes of the intersections of the first ``n_left`` sets with all sets."""
    sizes = [len(s) for s in sets]
    values = np.concatenate(sets)
    owners = np.repeat(np.arange(len(sets)), sizes)
    _, column, counts = np.unique(values, return_inverse=True, return_counts=True)
    kept = counts[column] > 1  # a shingle of one set is shared by none
    renumbered = np.cumsum(counts > 1) - 1
    column, owners = renumbered[column[kept]], owners[kept]
    order = np.argsort(column, kind="stable")
    column, owners = column[order], owners[order]
    total = np.zeros((n_left, len(sets)), np.float32)
    n = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, n, _COLUMNS):
        a, b = np.searchsorted(column, [at, at + _COLUMNS])
        held = np.zeros((len(sets), min(_COLUMNS, n - at)), np.float32)
        held[owners[a:b], column[a:b] - at] = 1
        total += held[:n_left] @ held.T
    return total.round().astype(np.int64)


def _smallest_linked(linked: np.ndarray) -> np.ndarray:
    """The first place that each place is connected to by a symmetric table of links."""
    labels = np.arange(len(linked))
    while True:
        near = np.where(linked, labels, len(labels)).min(1, initial=len(labels))
        lower = np.minimum(labels, near)
        lower = lower[lower]
        if (lower == labels).all():
            return labels
        labels = lower


def compare_block(
    nodes: np.ndarray, sets: list[np.ndarray], n_left: int, least: float, within: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Links of the first ``n_left`` sets with the others, or with each other if ``within``.

    Returns each node's number of links and a node that it is connected to. Nodes of each side
    stand in rising order. Two blocks are contracted by their own links first, which each
    block's comparison with itself reports: only a block's smallest node of a connected part
    is connected to the other block's, so that alike sets add few connections.
    """
    shared = _shared_counts(sets, n_left if within else len(sets))
    sizes = np.array([len(s) for s in sets])
    linked = shared >= least * (sizes[: len(shared), None] + sizes - shared) - 1e-9
    np.fill_diagonal(linked, False)
    if within:
        return linked.sum(1), nodes[_smallest_linked(linked)]
    own = linked.copy()
    own[:n_left, n_left:] = own[n_left:, :n_left] = False
    across = linked & ~own
    part = _smallest_linked(own)
    heads, place = np.unique(part, return_inverse=True)
    between = np.zeros((len(heads), len(heads)), bool)
    x, y = np.nonzero(across)
    between[place[x], place[y]] = True
    joined = _smallest_linked(between)
    # The smallest node of every connected set of parts, which may be of either block.
    smallest = np.full(len(heads), np.iinfo(np.int64).max)
    np.minimum.at(smallest, joined, nodes[heads])
    root = nodes.copy()
    root[heads] = smallest[joined]
    return across.sum(1), root


def _verify(candidates: DataFrame, n_sets: int, least: float) -> DataFrame:
    """``(class, links, root)`` from ``(class, shingles, group, block, blocks)`` of ``n_sets``.

    A group of one block is compared with other small groups in one task; a larger one is
    dealt out as pairs of blocks, each its own task.
    """
    n_tasks = max(1, n_sets // 1000)
    small = candidates.filter("blocks = 1").select(
        F.pmod(F.xxhash64("group"), F.lit(n_tasks)).alias("task"),
        F.lit(0).alias("other"),
        "group",
        F.lit(0).alias("side"),
        "class",
        "shingles",
    )
    pairs = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("partner")
    large = candidates.filter("blocks > 1").select("*", pairs)
    low, high = F.least("block", "partner"), F.greatest("block", "partner")
    large = large.select(
        # Each pair of blocks is one key; a block meets itself once.
        F.xxhash64("group", low, high).alias("task"),
        F.lit(1).alias("other"),
        "group",
        F.when(F.col("block") == F.col("partner"), 0).otherwise(F.when(F.col("block") == low, 1).otherwise(2)).alias("side"),
        "class",
        "shingles",
    )

    def run(table: pa.Table) -> pa.Table:
        groups = np.array(table["group"].to_pylist(), np.int64)
        sides = np.array(table["side"].to_pylist(), np.int64)
        nodes = np.array(table["class"].to_pylist(), np.int64)
        sets = [np.frombuffer(s, np.uint64) for s in table["shingles"].to_pylist()]
        order = np.lexsort((nodes, sides, groups))
        out_nodes, out_links, out_roots = [], [], []
        for part in np.split(order, np.flatnonzero(np.diff(groups[order])) + 1):
            within = sides[part[0]] == 0
            n_left = len(part) if within else int((sides[part] == 1).sum())
            links, root = compare_block(nodes[part], [sets[i] for i in part], n_left, least, within)
            out_nodes.append(nodes[part])
            out_links.append(links)
            out_roots.append(root)
        return pa.table(
            {
                "class": pa.array(np.concatenate(out_nodes), pa.int64()),
                "links": pa.array(np.concatenate(out_links), pa.int64()),
                "root": pa.array(np.concatenate(out_roots), pa.int64()),
            }
        )

    return (
        small.unionByName(large)
        .groupBy("task", "other")
        .applyInArrow(run, "class long, links long, root long")
    )


def star_links(stars: DataFrame) -> DataFrame:
    """Links ``(class, hub)`` that connect the same classes as ``(class, hub)`` of all bands.

    A class is linked to the smallest of its hubs only, and that one to the class's others,
    once for all classes that share them: a group of near copies has about one link per class,
    not one per class and band.
    """
    own = stars.groupBy("class").agg(F.collect_set("hub").alias("hubs"))
    least = F.array_min("hubs")

    def link(a, b):
        return F.struct(a.alias("class"), b.alias("hub"))

    others = F.transform(F.array_remove("hubs", least), lambda h: link(least, h))
    links = F.explode(F.concat(F.array(link(F.col("class"), least)), others)).alias("link")
    return own.select(links).select("link.*").distinct()


def join(
    docs: DataFrame,
    least: float = 0.8,
    recall: float = 0.999,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every document's class, links and group at Jaccard similarity ``least`` or more.

    One row per row of ``docs``: the id, ``text_hash``, ``class_id`` (smallest id of texts
    with the same shingles), ``n_copies`` (rows of the class), ``n_links`` (other classes it
    is similar to) and ``group_id``/``group_hash`` (the smallest row connected to it by
    links). Words are runs of letters, digits and characters beyond ASCII in lower case.
    A text below five words is one shingle; NULL texts and texts without words are alone.
    NULL ids sort first and are kept, repeated rows share a class, an empty table gives no
    row, other columns are ignored whatever their names. Classes are told apart by 64-bit
    hashes. A pair of similarity ``least`` shares a band with chance ``recall``, a closer
    one with a higher chance; pairs that do are compared exactly.
    """
    banding = choose_banding(least, recall)
    signed = written(signatures(docs, banding, id_col, text_col), "signatures")
    classes = written(
        signed.filter("class IS NOT NULL")
        .groupBy("class")
        .agg(F.min("row").alias("first_row"), F.count("*").alias("n_copies"), F.first("bands").alias("bands")),
        "classes",
    )
    banded = classes.select("class", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("class").alias("hub"), F.max("class").alias("last"))
    shared = banded.join(hubs.filter("hub <> last").select("band", "hub"), "band")
    stars = star_links(shared.filter(F.col("class") != F.col("hub")))
    near = components(stars, "class", "hub")
    sizes = near.groupBy("root").agg(F.count("*").alias("size"))
    members = written(
        near.withColumnRenamed("node", "class")
        .join(sizes, "root")
        .join(classes.select("class", "first_row"), "class")
        .select(
            F.col("first_row").alias("row"),
            "class",
            F.col("root").alias("group"),
            F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"),
        )
        .withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")),
        "candidates",
    )
    n_sets = members.count()
    wanted = F.broadcast(members) if n_sets <= MOST_BROADCAST else members
    # Rows of one id and text are the same; one of them is enough.
    texts = _rows(docs, id_col, text_col).join(wanted, "row").dropDuplicates(["class"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                found = shingle_sets(words(*text_bytes(part[0]), LETTERS))
                data = pa.array([s.tobytes() for s in found], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], data], ["class", "group", "block", "blocks", "shingles"]
                )

    candidates = texts.select("text", "class", "group", "block", "blocks").mapInArrow(
        sets, "class long, group long, block int, blocks int, shingles binary"
    )
    verified = written(_verify(candidates, n_sets, least), "links")
    links = verified.groupBy("class").agg(F.sum("links").alias("n_links"))
    roots = components(verified.filter("class <> root"), "class", "root")
    grouped = (
        classes.select("class", "first_row", "n_copies")
        .join(roots.select(F.col("node").alias("class"), "root"), "class", "left")
        .withColumn("root", F.coalesce("root", "class"))
    )
    firsts = grouped.groupBy("root").agg(F.min("first_row").alias("group_row"))
    # Written, so that the next join reads both its sides from shuffles of their own: only
    # then can adaptive execution split the rows of a class with many copies.
    known = written(
        grouped.join(firsts, "root")
        .join(links, "class", "left")
        .select(
            "class",
            "first_row",
            "n_copies",
            "group_row",
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
        ),
        "known-classes",
    )
    result = signed.select("row", "class").join(known, "class", "left")
    return result.select(
        F.col("row.id").alias(id_col),
        F.col("row.text_hash").alias("text_hash"),
        F.coalesce("first_row", "row")["id"].alias("class_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("group_row", "row")["id"].alias("group_id"),
        F.coalesce("group_row", "row")["text_hash"].alias("group_hash"),
    )


def one_per_group(
    docs: DataFrame, joined: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows of ``docs`` that are the first of their group in a result of ``join``, unchanged.

    Rows of one id and text are the same document, of which one stays.
    """
    row = F.struct(F.col(id_col).alias("id"), "text_hash")
    first = F.struct(F.col("group_id").alias("id"), F.col("group_hash").alias("text_hash"))
    others = joined.filter(~row.eqNullSafe(first)).select(row.alias("row")).distinct()
    others = written(others, "dropped")
    if others.count() <= MOST_BROADCAST:
        others = F.broadcast(others)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    own = F.struct(docs[id_col].alias("id"), F.xxhash64(text).alias("text_hash"))
    kept = docs.join(others, own == others["row"], "left_anti")
    if joined.groupBy(id_col, "text_hash").count().filter("count > 1").isEmpty():
        return kept
    names = docs.columns
    spare = "_row" + "_" * max(map(len, names))
    key = F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("h"))
    return kept.withColumn(spare, key).dropDuplicates([spare]).drop(spare)
