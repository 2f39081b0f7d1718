"""Benchmark decontamination by MinHash containment search.

Test items are short and documents long, so only items are sketched: an item's sketch is
its smallest shingle hashes, and a document is a candidate if it holds enough of them. Items
are partitioned by size, which sets how many hashes a sketch needs so that no document with
the wanted share of an item's shingles can miss them all. Candidates are then verified on
the shingles themselves. Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from evalweave.llm.shared import written

WORDS = 5
LEAST = 0.8
# Rows of at most 40 bytes that are sent to every executor; more are joined by shuffle.
MOST_BROADCAST = 1_000_000


def normalized_words(text: Column) -> Column:
    """Runs of letters and digits in lower case; none for NULL."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _windows(words: Column, make) -> Column:
    """``make`` of every run of ``WORDS`` words; a shorter text is one run."""
    every = F.transform(words, lambda w, i: make([w, *(F.get(words, i + k) for k in range(1, WORDS))]))
    return F.slice(every, F.lit(1), F.greatest(F.size(words) - (WORDS - 1), F.least(F.size(words), F.lit(1))))


def shingle_hashes(words: Column) -> Column:
    """64-bit hashes of the shingles of an array of words."""
    return _windows(words, lambda run: F.xxhash64(*run))


def shingle_texts(words: Column) -> Column:
    """The shingles of an array of words as texts; words hold no space."""
    return _windows(words, lambda run: F.concat_ws(" ", *run))


def sketches(items: DataFrame, least: float, item_col: str, text_col: str) -> DataFrame:
    """One row per distinct set of shingles, with its sketch and the hits a match must have.

    An item of q shingles may lack ``floor((1 - least) q)`` of them. Its size partition is
    the power of two u that bounds q; sketches there have ``floor((1 - least) u) + 1`` hashes,
    so at least one is in every match, and ``needed`` are if q is below u.
    """
    sized = (
        items.select(F.col(item_col).alias("item_id"), normalized_words(F.col(text_col)).alias("w"))
        .select("item_id", F.array_sort(F.array_distinct(shingle_texts(F.col("w")))).alias("shingles"))
        .filter(F.size("shingles") > 0)
        .groupBy("shingles")
        .agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"))
        .withColumn("size", F.size("shingles"))
        .withColumn("class", F.ceil(F.log2("size")).cast("int"))
    )
    spare = F.floor(F.lit(1 - least + 1e-9) * F.pow(F.lit(2), "class"))
    length = F.least(spare + 1, F.col("size")).cast("int")
    lacking = F.floor(F.lit(1 - least + 1e-9) * F.col("size"))
    hashes = F.transform(
        "shingles", lambda s: F.xxhash64(*(F.get(F.split(s, " "), k) for k in range(WORDS)))
    )
    return sized.withColumn("sketch", F.slice(F.array_sort(hashes), F.lit(1), length)).withColumn(
        "needed", (length - lacking).cast("int")
    )


def search(
    docs: DataFrame,
    items: DataFrame,
    least: float = LEAST,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Documents that hold at least ``least`` of an item's five-word shingles.

    One row per document and distinct item: the id, ``text_hash`` (of the text, to tell rows
    of one id apart), ``item_id`` (the smallest of items with the same shingles),
    ``n_items`` (how many there are), ``item_shingles``, ``shared`` and ``containment``. No
    match is missed. Rows of the same id and text give one result; NULL ids are kept; NULL
    and empty texts or items, and empty tables, give none; a text below five words is one
    shingle; other columns are ignored whatever their names.
    """
    sketched = written(sketches(items, least, item_col, item_text_col), "benchmark-sketches")
    probes = sketched.select("item_id", "needed", F.explode("sketch").alias("hash"))
    # A written table has a known size, so that the choice follows a measured count.
    if probes.count() <= MOST_BROADCAST:
        probes = F.broadcast(probes)
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash")).alias("row"),
        text.alias("text"),
    )
    hits = (
        rows.select("row", normalized_words(F.col("text")).alias("words"))
        .select("row", F.explode(F.array_distinct(shingle_hashes(F.col("words")))).alias("hash"))
        .join(probes, "hash")
        .groupBy("row", "item_id", "needed")
        .agg(F.count_distinct("hash").alias("hits"))
        .filter(F.col("hits") >= F.col("needed"))
    )
    items_of = sketched.select("item_id", "n_items", "size", "shingles")
    if sketched.count() <= MOST_BROADCAST // 100:
        items_of = F.broadcast(items_of)
    pairs = written(hits.select("row", "item_id"), "benchmark-candidates")
    if pairs.count() <= MOST_BROADCAST:
        pairs = F.broadcast(pairs)
    shared = F.size(F.array_intersect("shingles", shingle_texts(F.col("words"))))
    return (
        rows.join(pairs, "row")
        .withColumn("words", normalized_words(F.col("text")))
        .join(items_of, "item_id")
        .withColumn("shared", shared.cast("long"))
        .filter(F.col("shared") >= F.ceil(F.lit(least - 1e-9) * F.col("size")))
        .dropDuplicates(["row", "item_id"])
        .select(
            F.col("row.id").alias(id_col),
            F.col("row.text_hash").alias("text_hash"),
            "item_id",
            "n_items",
            F.col("size").cast("long").alias("item_shingles"),
            "shared",
            (F.col("shared") / F.col("size")).alias("containment"),
        )
    )


def without_leaks(
    docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows of ``docs`` that ``found`` (a result of ``search``) does not list, unchanged."""
    keys = found.select(F.struct(F.col(id_col).alias("id"), "text_hash").alias("key")).distinct()
    own = F.struct(
        docs[id_col].alias("id"), F.xxhash64(docs[text_col].cast("string")).alias("text_hash")
    )
    return docs.join(keys, own == keys["key"], "left_anti")


def oracle_sql(least: float = LEAST) -> str:
    """Exact containment in SQL for DuckDB over ``documents`` and ``benchmark``."""
    def shingled(key: str, table: str) -> str:
        return f"""
  SELECT {key}, t, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {WORDS - 2}),
      lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) END AS s
  FROM (SELECT {key}, coalesce(text, '') AS t, list_filter(string_split(
    regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '),
    lambda x: x <> '') AS w FROM {table})"""

    return f"""
WITH d AS (SELECT DISTINCT doc_id, t, unnest(s) AS g FROM ({shingled("doc_id", "documents")})),
i AS (
  SELECT min(item_id) AS item_id, count(*) AS n_items, s
  FROM (SELECT item_id, list_sort(s) AS s FROM ({shingled("item_id", "benchmark")}))
  WHERE len(s) > 0 GROUP BY s
), j AS (SELECT item_id, n_items, len(s) AS item_shingles, unnest(s) AS g FROM i)
SELECT doc_id, item_id, n_items, item_shingles, count(*) AS shared,
  count(*) / item_shingles AS containment
FROM d JOIN j USING (g)
GROUP BY doc_id, t, item_id, n_items, item_shingles
HAVING count(*) >= ceil({least - 1e-9} * item_shingles)
"""
