"""Exact, seeded splits, samples and positions that ignore the partitioning.

Rows are ordered by ``md5(seed:id)`` and then by id. ``id`` has to be unique within
the table (or within a split where one is given). Cuts through that order are found
on the id column alone: rows are counted per prefix of the hash, the one bucket that
contains the cut is ranked, and the resulting ``(hash, id)`` pair is a constant that a
plain filter compares with. The payload columns are never shuffled or sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from evalweave.operators.joins import group_join

# 16 ** 4 buckets: the bucket table has at most 65,536 rows whatever the data size.
BUCKET_DIGITS = 4
# Positions by id: 2 ** 20 ids per block, 2 ** 16 blocks per parent block.
_ID_BITS, _PARENT_BITS = 20, 16


def seeded_key(seed: int, row_id: str) -> Column:
    """The seeded order's sort key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))


def seeded_shuffle(
    df: DataFrame, seed: int, row_id: str = "example_id", position: str | None = None
) -> DataFrame:
    """All rows in seeded order, with their 0-based ``position`` in it if a name is given."""
    if position is None:
        return df.orderBy(seeded_key(seed, row_id), row_id)
    return dense_index(df, row_id, seed=seed, name=position).orderBy(position)


def _position(seed: int, row_id: str) -> Column:
    return F.struct(seeded_key(seed, row_id).alias("key"), F.col(row_id).alias("id"))


def _cuts(
    df: DataFrame, seed: int, row_id: str, ranks: Callable[[Column], Sequence[Column]]
) -> DataFrame:
    """One row: the ``(key, id)`` at each 1-based rank of the seeded order, as ``cut0, ...``.

    ``ranks`` gets the number of rows. A rank outside the table gives NULL.
    """
    keyed = df.select(_position(seed, row_id).alias("at")).withColumn(
        "bucket", F.substring("at.key", 1, BUCKET_DIGITS)
    )
    running = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    counts = keyed.groupBy("bucket").agg(F.count("*").alias("n"))
    wanted = ranks(F.col("total"))
    # One record per rank: exactly one bucket contains it.
    found = (
        counts.withColumn("end", F.sum("n").over(running))
        .withColumn("total", F.sum("n").over(Window.partitionBy()))
        .select("bucket", "n", "end", F.posexplode(F.array(*wanted)).alias("which", "rank"))
        .withColumn("offset", F.col("rank") - F.col("end") + F.col("n"))
        .filter((F.col("offset") > 0) & (F.col("offset") <= F.col("n")))
        .select("bucket", "which", "offset")
    )
    order = Window.partitionBy("which", "bucket").orderBy("at")
    hits = (
        keyed.join(F.broadcast(found), "bucket")
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") == F.col("offset"))
    )
    return hits.agg(
        *[
            F.max(F.when(F.col("which") == i, F.col("at"))).alias(f"cut{i}")
            for i in range(len(wanted))
        ]
    )


def _first_n_cut(df: DataFrame, n: int, seed: int, row_id: str) -> DataFrame:
    return _cuts(df, seed, row_id, lambda total: [F.least(F.lit(n), total)])


def _up_to(cut: Column, seed: int, row_id: str) -> Column:
    return F.coalesce(_position(seed, row_id) <= cut, F.lit(False))


def seeded_sample(
    df: DataFrame, size: int | None, seed: int = 42, row_id: str = "example_id"
) -> DataFrame:
    """The first ``min(size, rows)`` rows of the seeded order; ``None`` keeps the table."""
    if size is None:
        return df
    cut = _first_n_cut(df, size, seed, row_id).scalar()
    return df.filter(_up_to(cut, seed, row_id))


def split_exact(
    df: DataFrame, train: int | float, seed: int = 42, row_id: str = "example_id"
) -> DataFrame:
    """Add ``split``: ``train`` rows (count, or share rounded down), the rest halved.

    Of the remaining rows validation gets the smaller and test the larger half. Asking
    for more training rows than there are is an error.
    """

    def n_train(total: Column) -> Column:
        if isinstance(train, float):
            return F.floor(total * F.lit(train))
        message = F.lit(f"cannot take {train} training rows from a smaller table")
        return F.when(total >= train, F.lit(train)).otherwise(F.raise_error(message))

    def ends(total: Column) -> Sequence[Column]:
        first = n_train(total).cast("bigint")
        return [first, first + F.floor((total - first) / 2)]

    cuts = _cuts(df, seed, row_id, ends).select(F.struct("cut0", "cut1")).scalar()
    in_train = _up_to(cuts["cut0"], seed, row_id)
    before_test = _up_to(cuts["cut1"], seed, row_id)
    label = F.when(in_train, "train").when(before_test, "validation").otherwise("test")
    return df.withColumn("split", label)


def split_caps(
    df: DataFrame,
    caps: Mapping[str, int | None],
    seed: int = 42,
    row_id: str = "example_id",
) -> DataFrame:
    """Sample every split down to its cap; splits without a cap, also NULL, stay whole.

    All cuts are found in one pass over the ids: counts per split and hash prefix, then the
    one bucket of each split that holds its cut.
    """
    capped = {name: n for name, n in caps.items() if n is not None}
    if not capped:
        return df
    cap = F.create_map(*[F.lit(x) for pair in capped.items() for x in pair])
    keyed = (
        df.filter(F.col("split").isin(*capped))
        .select("split", _position(seed, row_id).alias("at"))
        .withColumn("bucket", F.substring("at.key", 1, BUCKET_DIGITS))
    )
    running = Window.partitionBy("split").orderBy("bucket")
    total = F.sum("n").over(Window.partitionBy("split"))
    found = (
        keyed.groupBy("split", "bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("end", F.sum("n").over(running.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("rank", F.least(F.element_at(cap, F.col("split")), total))
        .withColumn("offset", F.col("rank") - F.col("end") + F.col("n"))
        .filter((F.col("offset") > 0) & (F.col("offset") <= F.col("n")))
        .select("split", "bucket", "offset")
    )
    order = Window.partitionBy("split", "bucket").orderBy("at")
    hits = (
        keyed.join(F.broadcast(found), ["split", "bucket"])  # one row per capped split
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") == F.col("offset"))
    )
    cuts = hits.agg(F.map_from_entries(F.collect_list(F.struct("split", "at")))).scalar()
    within = _up_to(F.try_element_at(cuts, F.col("split")), seed, row_id)
    return df.filter(F.coalesce(~F.col("split").isin(*capped), F.lit(True)) | within)


def check_split_sizes(df: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """``(split, rows, expected, ok)`` for every split found or expected."""
    wanted = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("split"), F.lit(n).cast("bigint").alias("expected"))
                for name, n in expected.items()
            ]
        )
    )
    wanted_rows = df.sparkSession.range(1).select(wanted.alias("w")).select("w.*")
    counts = df.groupBy("split").agg(F.count("*").alias("rows"))
    return counts.join(wanted_rows, "split", "full").select(
        "split",
        F.coalesce("rows", F.lit(0)).alias("rows"),
        "expected",
        F.coalesce(F.coalesce("rows", F.lit(0)) == F.col("expected"), F.lit(False)).alias("ok"),
    )


def _block_starts(counts: DataFrame, by: Sequence[str], parents: int) -> DataFrame:
    """Add ``_start``, the number of rows before each ``_block`` within ``by``.

    Blocks are summed within parent blocks, and those within theirs, so that no window
    spans more than 2 ** 16 records however many blocks there are.
    """
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    if parents == 0:
        return counts.withColumn(
            "_start", F.coalesce(F.sum("_n").over(before.partitionBy(*by)), F.lit(0))
        )
    nested = counts.withColumn("_parent", F.shiftright("_block", _PARENT_BITS))
    within = nested.withColumn(
        "_within", F.coalesce(F.sum("_n").over(before.partitionBy(*by, "_parent")), F.lit(0))
    )
    sums = nested.groupBy(*by, F.col("_parent").alias("_block")).agg(F.sum("_n").alias("_n"))
    starts = _block_starts(sums, by, parents - 1).select(
        *by, F.col("_block").alias("_parent"), F.col("_start").alias("_parent_start")
    )
    return group_join(within, starts, [*by, "_parent"], "inner").select(
        *by, "_block", "_n", (F.col("_parent_start") + F.col("_within")).alias("_start")
    )


def dense_index(
    df: DataFrame,
    row_id: str = "example_id",
    seed: int | None = None,
    by: Sequence[str] = (),
    name: str = "example_index",
) -> DataFrame:
    """Add a dense 0-based position, per ``by`` group, in seeded or in id order.

    ``seed=None`` numbers by id (an unsampled table), a seed numbers by the seeded
    order (a sampled one). Rows are ranked inside small blocks of the order and each
    block is shifted by the rows before it; blocks hold at most 2 ** 20 ids, or a
    65,536th of the rows.
    """
    if seed is None:
        parents = 2
        order = [F.col(row_id)]
        blocked = df.withColumn("_block", F.shiftright(F.col(row_id).cast("bigint"), _ID_BITS))
    else:
        parents = 0
        order = [F.col("_key"), F.col(row_id)]
        blocked = df.withColumn("_key", seeded_key(seed, row_id)).withColumn(
            "_block", F.conv(F.substring("_key", 1, BUCKET_DIGITS), 16, 10).cast("bigint")
        )
    counts = blocked.groupBy(*by, "_block").agg(F.count("*").alias("_n"))
    # One struct is the key of both the window and the join, so that the join finds the
    # rows already partitioned and sorted; a missing group name is a group of its own.
    key = F.struct(*by, "_block").alias("_group")
    starts = _block_starts(counts, by, parents).select(key, "_start")
    rank = F.row_number().over(Window.partitionBy("_group").orderBy(*order))
    return (
        blocked.withColumn("_group", key)
        .withColumn("_rank", rank)
        .join(starts, "_group")
        .withColumn(name, F.col("_start") + F.col("_rank") - 1)
        .select(*df.columns, name)
    )


def batches(df: DataFrame, batch_size: int, index: str = "example_index") -> DataFrame:
    """Add ``batch_id`` for consecutive batches of ``batch_size`` positions."""
    return df.withColumn("batch_id", F.floor(F.col(index) / F.lit(batch_size)))
