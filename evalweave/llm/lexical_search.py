"""Ranked lexical search by impact-sorted lists without random access (NRA).

Documents are dealt into shards of bounded size. A shard holds, for every term of a query, its
documents by falling impact. A query reads its lists from the top, some postings of each per
round, and keeps for every document of the shard a lower score (the impacts read so far) and an
upper one (that and the last impact read of every list in which the document has not been met).
It stops when every document whose upper score reaches the lower one of the k-th document has
a closed interval: then membership, ties and scores are exact. Shards return their best, and
the best of these are the result. Statistics cover all documents and are summed before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from evalweave.llm.packed import pack, unpack
from evalweave.llm.shared import written
from evalweave.llm.words import LETTERS, slices, text_bytes, words

# Largest shard; a text with more postings is a shard by itself.
SHARD_DOCS, SHARD_POSTINGS = 1 << 14, 1 << 21
# Postings that a query reads of a list in its first round; twice as many in each later one.
FIRST_READ = 64
# Queries that are searched together, and the bytes of their texts.
BLOCK_QUERIES, BLOCK_BYTES = 10_000, 16 << 20
_SALTS = 64


@dataclass(frozen=True)
class Queries:
    """A block of queries: their ids, and their terms as places in the sorted vocabulary."""

    ids: list
    terms: list[np.ndarray]
    vocabulary: np.ndarray


def _queries(rows: list) -> Queries:
    """Terms of query texts; each term counts once."""
    texts = pa.array([r["text"] for r in rows], pa.string())
    found = words(*text_bytes(texts), LETTERS)
    vocabulary, place = np.unique(found.hashes, return_inverse=True)
    terms = [np.unique(place[a:b]) for a, b in zip(found.first, found.first[1:])]
    return Queries([r["id"] for r in rows], terms, vocabulary)


def _shards(docs: DataFrame, vocabulary: np.ndarray, id_kind: str) -> DataFrame:
    """Postings of the vocabulary's terms, some documents per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n_docs = n_postings = 0

        def done() -> pa.RecordBatch:
            nonlocal held, n_docs, n_postings
            ids = pa.concat_arrays([h[0] for h in held])
            sizes, term, tf = (np.concatenate([h[i] for h in held]) for i in (1, 2, 4))
            offsets = np.cumsum([0] + [len(h[0]) for h in held[:-1]])
            doc = np.concatenate([h[3] + at for h, at in zip(held, offsets)])
            order = np.argsort(term, kind="stable")
            kinds, df = np.unique(term, return_counts=True)
            one = pa.array(np.array([0, len(ids)], np.int32))
            bounds = pa.array(np.array([0, len(kinds)], np.int32))
            row = [
                pa.ListArray.from_arrays(one, ids),
                pa.array([pack(sizes, "<i8")], pa.binary()),
                pa.array([pack(doc[order])], pa.binary()),
                pa.array([pack(tf[order])], pa.binary()),
                pa.ListArray.from_arrays(bounds, pa.array(kinds.astype(np.int32))),
                pa.ListArray.from_arrays(bounds, pa.array(df.astype(np.int64))),
                pa.array([int((sizes > 0).sum())], pa.int64()),
                pa.array([int(sizes.sum())], pa.int64()),
            ]
            held, n_docs, n_postings = [], 0, 0
            return pa.RecordBatch.from_arrays(row, names)

        for batch in batches:
            for part in slices(batch, 1):
                for at in range(0, part.num_rows, SHARD_DOCS):
                    some = part.slice(at, SHARD_DOCS)
                    found = words(*text_bytes(some[1]), LETTERS)
                    place = np.searchsorted(vocabulary, found.hashes)
                    place[place == len(vocabulary)] = 0
                    known = np.flatnonzero(vocabulary[place] == found.hashes)
                    pair, tf = np.unique(found.docs[known] * len(vocabulary) + place[known], return_counts=True)
                    doc, term = np.divmod(pair, len(vocabulary))
                    held.append((some[0], np.diff(found.first), term, doc, tf))
                    n_docs, n_postings = n_docs + some.num_rows, n_postings + len(term)
                    if n_docs >= SHARD_DOCS or n_postings >= SHARD_POSTINGS:
                        yield done()
        if held:
            yield done()

    names = ["ids", "sizes", "doc", "tf", "terms", "df", "n_docs", "n_terms"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("id", text.alias("text")).mapInArrow(
        run,
        f"ids array<{id_kind}>, sizes binary, doc binary, tf binary, terms array<int>, df array<long>, "
        "n_docs long, n_terms long",
    )


def weights(df: dict[int, int], n_docs: int) -> dict[int, int]:
    """``floor(1000 ln((2 N + 2) / (2 df + 1)))`` of each term."""
    return {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}


def impacts(w: np.ndarray, tf: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds to a document's score, in 64-bit integers."""
    m = 10 + 90 * size * n_docs // max(n_terms, 1)
    return w * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def best(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Documents that may be among the ``k`` best, and their exact scores.

    ``lists`` hold documents (numbers below ``n_docs``, each once) by falling positive impact.
    Every document is returned that has a score of at least the ``k``-th best and ``floor``,
    ties included.
    """
    depth = [0] * len(lists)
    last = [int(impact[0]) if len(impact) else 0 for _, impact in lists]
    reading = [t for t, bound in enumerate(last) if bound]
    lower = np.zeros(n_docs, np.int64)
    step = FIRST_READ
    while True:
        for t in reading:
            docs, impact = lists[t]
            end = min(depth[t] + step, len(docs))
            lower[docs[depth[t] : end]] += impact[depth[t] : end]
            depth[t], last[t] = end, int(impact[end - 1]) if end < len(docs) else 0
        slack = np.full(n_docs, sum(last))
        for (docs, _), end, bound in zip(lists, depth, last):
            if bound:
                slack[docs[:end]] -= bound
        least = floor
        if n_docs > k:
            least = max(least, int(np.partition(lower, n_docs - k)[n_docs - k]))
        possible = lower + slack >= least
        if not slack[possible].any():
            found = np.flatnonzero(possible)
            return found, lower[found]
        # A list whose unread part can hold none of these documents needs no more reading.
        n_possible = int(possible.sum())
        reading = [
            t
            for t, bound in enumerate(last)
            if bound and np.count_nonzero(possible[lists[t][0][: depth[t]]]) < n_possible
        ]
        step *= 2


def _ranked(found: DataFrame, by: list[str | Column], k: int) -> DataFrame:
    first = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, queries: Queries, k: int, id_kind: str) -> DataFrame | None:
    """``(query, id, score)``: the best of every shard."""
    if not len(queries.vocabulary):
        return None
    shards = written(_shards(docs, queries.vocabulary, id_kind), "search-shards")
    total = shards.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    n_docs, n_terms = total["docs"] or 0, total["terms"] or 0
    # One row for each term of the block at most.
    df = (
        shards.select(F.explode(F.arrays_zip("terms", "df")).alias("x"))
        .groupBy("x.terms")
        .agg(F.sum("x.df").alias("df"))
    )
    w = np.zeros(len(queries.vocabulary), np.int64)
    for term, weight in weights(dict(df.collect()), n_docs).items():
        w[term] = weight

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The k-th best score of a query so far: a document below it is not among the best.
        floors = np.ones(len(queries.ids), np.int64)
        for batch in batches:
            for number in range(batch.num_rows):
                shard = batch.slice(number, 1)
                ids = shard["ids"].flatten()
                sizes, doc, tf = unpack(shard["sizes"][0].as_py(), "<i8"), *(unpack(shard[c][0].as_py()) for c in ("doc", "tf"))
                terms, counts = shard["terms"].flatten().to_numpy(), shard["df"].flatten().to_numpy()
                impact = impacts(np.repeat(w[terms], counts), tf.astype(np.int64), sizes[doc], n_docs, n_terms)
                order = np.lexsort((-impact, np.repeat(np.arange(len(terms)), counts)))
                doc, impact = doc[order], impact[order]
                ends = np.cumsum(counts)
                place = pc.sort_indices(ids, null_placement="at_end").to_numpy()
                id_rank = np.empty(len(ids), np.int64)
                id_rank[place] = np.arange(len(ids))
                out = ([], [], [])
                for query, wanted in enumerate(queries.terms):
                    at = np.searchsorted(terms, wanted)
                    at = [a for a, t in zip(at, wanted) if a < len(terms) and terms[a] == t and w[t] > 0]
                    lists = [(doc[ends[a] - counts[a] : ends[a]], impact[ends[a] - counts[a] : ends[a]]) for a in at]
                    # Impacts of 0 stand at the end of a list and add nothing.
                    lists = [(d, v) if v[-1] else (d[: np.count_nonzero(v)], v[: np.count_nonzero(v)]) for d, v in lists]
                    found, score = best(lists, len(ids), k, int(floors[query]))
                    kept = np.lexsort((id_rank[found], -score))[:k]
                    if len(kept) == k:
                        floors[query] = max(floors[query], score[kept[-1]])
                    out[0].append(np.full(len(kept), query, np.int32))
                    out[1].append(found[kept])
                    out[2].append(score[kept])
                query, found, score = map(np.concatenate, out)
                columns = [pa.array(query), ids.take(pa.array(found)), pa.array(score.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["query", "id", "score"])

    return shards.select("ids", "sizes", "doc", "tf", "terms", "df").mapInArrow(run, f"query int, id {id_kind}, score long")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``k`` best documents with a score above 0.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z counting
    as a-z, known by 64-bit hashes. Equal scores rank by ascending id, NULL ids last; every row
    of ``docs`` is a document of its own, also a repeated one; a NULL or empty text has no term;
    repeated items (id and text) are searched once, items without a term give no row, and so
    does an empty table; other columns are ignored whatever their names. Texts may have any
    length. Items are searched in blocks of ``BLOCK_QUERIES`` (``BLOCK_BYTES`` of text), each of
    which reads the documents once; a task holds one shard and one block.
    """
    spark = docs.sparkSession
    id_kind = docs.schema[id_col].dataType.simpleString()
    item_kind = items.schema[item_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("id"), F.col(item_text_col).cast("string").alias("text"))
    asked = written(asked.filter("text <> ''").distinct(), "search-items")
    size = asked.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n_blocks = max(1, -(-size["n"] // BLOCK_QUERIES), -(-(size["bytes"] or 0) // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks))
    result = None
    for number in range(n_blocks):
        queries = _queries(asked.filter(block == number).collect())
        found = _search_block(rows, queries, k, id_kind)
        if found is None:
            continue
        some = _ranked(found.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS))), ["query", "salt"], k)
        top = _ranked(some, ["query"], k)
        names = spark.createDataFrame(list(enumerate(queries.ids)), f"query int, item {item_kind.simpleString()}")
        top = top.join(F.broadcast(names), "query").select(
            F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score"
        )
        result = top if result is None else result.unionByName(top)
    if result is None:
        return spark.createDataFrame([], f"{item_col} {item_kind.simpleString()}, rank int, {id_col} {id_kind}, score long")
    return result


def oracle_sql(k: int = 10) -> str:
    """The same result in SQL, over ``documents`` and ``benchmark``."""
    term = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{term}')"
    return f"""
    WITH doc_terms AS (SELECT doc_id, {terms} AS terms FROM documents),
    total AS (SELECT count(*) FILTER (len(terms) > 0) AS docs, sum(len(terms))::BIGINT AS terms FROM doc_terms),
    asked AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark),
    doc_term AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM doc_terms),
    tf AS (SELECT doc_id, n, term, count(*) AS tf FROM doc_term GROUP BY doc_id, n, term),
    w AS (
        SELECT term, floor(1000 * ln((2.0 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
        FROM tf, total WHERE term IN (SELECT term FROM asked) GROUP BY term, docs),
    scored AS (
        SELECT item_id, doc_id,
            sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total.terms))))::BIGINT AS score
        FROM asked JOIN w USING (term) JOIN tf USING (term), total
        GROUP BY item_id, doc_id),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
        FROM scored WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {k}
    """
